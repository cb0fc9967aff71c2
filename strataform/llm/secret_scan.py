"""Secrets in texts: fixed patterns, and a battery of randomness tests. DataFrame functions only.

Patterns give the base spans. The battery looks at other runs of key characters: it
infers an encoding, tests its symbols for uniformity (chi-squared), runs about the
middle and serial correlation, and combines the three into one p-value of "random".
A run is reported if it isn't rejected as random and if ordinary writing of its length
would so rarely look as uniform that all such reports together keep the false-discovery
rate. That second p-value knows the length: short runs can't tell the two apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import restored, whole_rows

#: Fixed patterns (fixed values): kind, pattern, group that is measured, its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")
#: A run whose combined p-value is smaller isn't random; the reports' false-discovery rate.
REJECT, FALSE_DISCOVERIES = 0.001, 0.01
#: Chance that two symbols of ordinary writing are equal, for letters and for hexadecimal digits.
LETTERS_ALIKE, HEX_ALIKE = 0.067, 0.14
#: Binned p-values: tenths of -log10 p, up to this many.
BINS = 400
MASK = "[secret]"
SPANS = "array<struct<start:int,kind:int,end:int>>"



#: Elements of an array that are gone through one after another: longer arrays are cut into such chunks,
#: as each step of a fold copies what it has put together so far.
CHUNK = 256


def let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def chunks(array: str) -> str:
    """SQL: the array in chunks."""
    return f"transform(sequence(0, greatest(0, (size({array}) - 1) div {CHUNK})), c -> slice({array}, c * {CHUNK} + 1, {CHUNK}))"


def running(values: str, step: str, least: int) -> str:
    """SQL: for each of an array of integers what step, of {a} and x, makes of those before it."""

    def fold(array: str, start: str) -> str:
        return f"aggregate({array}, named_struct('a', {start}, 'out', cast(array() AS array<int>)), (acc, x) -> named_struct('a', {step.format(a='acc.a')}, 'out', array_append(acc.out, acc.a)), acc -> acc.out)"

    total = f"transform(parts, part -> aggregate(part, {least}, (a, x) -> {step.format(a='a')}))"
    whole = f"flatten(transform(arrays_zip(parts, {fold(total, str(least))}), z -> {fold('z.parts', 'z.`1`')}))"
    return let("v", values, let("parts", chunks("v"), whole))


def places(text: str, pattern: str) -> str:
    """SQL: array of (start, match) of every leftmost match that doesn't overlap; code points.

    What lies between the matches tells where they are.
    """
    p = "r\"" + pattern.replace('"', r"\x22") + '"'
    starts = running("transform(arrays_zip(gaps, hits), x -> length(x.gaps) + length(x.hits))", "{a} + x", 0)
    found = f"transform(arrays_zip({starts}, gaps, hits), x -> named_struct('start', x.`0` + length(x.gaps), 'hit', x.hits))"
    return f"""CASE WHEN {text} RLIKE {p} THEN
      {let('hits', f'regexp_extract_all({text}, {p}, 0)', let('gaps', f'slice(split({text}, {p}, -1), 1, size(hits))', found))}
      ELSE cast(array() AS array<struct<start:int,hit:string>>) END"""


def spans_of(found: str, kind: int, keep: str = "true") -> str:
    return f"transform(filter({found}, x -> {keep}), x -> named_struct('start', x.start, 'kind', {kind}, 'end', x.start + length(x.hit)))"


def below(z: Column) -> Column:
    """The normal distribution function, to about 0.0002; for small values the tail's own bound."""
    middle = 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))
    tail = F.exp(-z * z / 2) / (F.sqrt(F.lit(2 * math.pi)) * F.greatest(-z, F.lit(1.0)))
    return F.when(z < -2.5, tail).otherwise(middle)


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * below(-F.abs(z)))


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, the first that a run fits counts: pattern, alphabet, whether case is folded.
ENCODINGS = [
    ("^[0-9+/_-]+$", "", False),
    ("^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", True),
    ("^([A-Z]?[a-z]+|[A-Z]+)$", LOWER, True),
    ("^[A-Z2-7]+$", UPPER + "234567", False),
    ("^([a-z0-9]+|[A-Z0-9]+)$", LOWER + DIGITS, True),
    ("^[A-Za-z]+$", UPPER + LOWER, False),
    ("", UPPER + LOWER + DIGITS + "+/", False),
]


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def neighbours(array: Column) -> Column:
    """Pairs of neighbouring elements, as structs of a and b."""
    n = F.size(array) - 1
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def battery(runs: Column) -> Column:
    """Runs (start, hit) as (start, end, random, ordinary): p-values under "uniform symbols" and "ordinary writing".

    One step adds what the next one needs, so that nothing is computed twice.
    """

    def step(array: Column, **made) -> Column:
        return F.transform(array, lambda x: F.struct(*(f(x).alias(k) for k, f in made.items())))

    keep = lambda *names: {n: (lambda x, n=n: x[n]) for n in names}

    def encoding(x: Column) -> Column:
        out = F.lit(len(ENCODINGS) - 1)
        for k, (pattern, _, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
            out = F.when(x["hit"].rlike(pattern), k).otherwise(out)
        return out

    of_encoding = lambda x, values: F.get(F.array(*(F.lit(v) for v in values)), x["encoding"])
    r = step(runs, start=lambda x: x["start"], end=lambda x: x["start"] + F.length(x["hit"]), bare=lambda x: F.translate(x["hit"], "-_", "+/"), encoding=encoding)
    r = step(
        r,
        **keep("start", "end"),
        alphabet=lambda x: of_encoding(x, [a for _, a, _ in ENCODINGS]),
        alike=lambda x: F.when(x["encoding"] == 1, HEX_ALIKE).otherwise(LETTERS_ALIKE),
        symbols=lambda x: F.when(of_encoding(x, [fold for _, _, fold in ENCODINGS]), F.lower(x["bare"])).otherwise(x["bare"]),
    )
    r = F.filter(r, lambda x: x["alphabet"] != "")
    r = step(r, **keep("start", "end", "alike"), size=lambda x: F.length(x["alphabet"]).cast("double"), v=lambda x: F.transform(F.split(x["symbols"], ""), lambda c: F.instr(x["alphabet"], c).cast("double") - 1))
    r = step(
        r,
        **keep("start", "end", "alike", "size", "v"),
        n=lambda x: F.size(x["v"]).cast("double"),
        mean=lambda x: total(x["v"]) / F.size(x["v"]),
        squares=lambda x: total(F.transform(F.array_distinct(x["v"]), lambda s: F.pow(F.size(F.filter(x["v"], lambda y: y == s)).cast("double"), F.lit(2.0)))),
        high=lambda x: F.transform(x["v"], lambda y: F.when(y * 2 >= x["size"], 1.0).otherwise(0.0)),
    )
    r = step(
        r,
        **keep("start", "end", "alike", "n"),
        free=lambda x: x["size"] - 1,
        chi=lambda x: x["squares"] * x["size"] / x["n"] - x["n"],
        excess=lambda x: F.greatest(x["size"] * x["alike"] - 1, F.lit(0.0)) * x["n"],
        n1=lambda x: total(x["high"]),
        changes=lambda x: total(F.transform(neighbours(x["high"]), lambda y: F.when(y["a"] != y["b"], 1.0).otherwise(0.0))),
        var=lambda x: total(F.transform(x["v"], lambda y: (y - x["mean"]) * (y - x["mean"]))),
        lag=lambda x: total(F.transform(neighbours(x["v"]), lambda y: (y["a"] - x["mean"]) * (y["b"] - x["mean"]))),
    )
    r = step(
        r,
        **keep("start", "end", "n", "free", "var", "changes"),
        uniform_z=lambda x: (F.pow(x["chi"] / x["free"], F.lit(1 / 3)) - (1 - 2 / (9 * x["free"]))) / F.sqrt(2 / (9 * x["free"])),
        ordinary_z=lambda x: (x["chi"] - x["free"] - x["excess"]) / F.sqrt(2 * (x["free"] + 2 * x["excess"])),
        expected=lambda x: 2 * (x["n"] - x["n1"]) * x["n1"] / x["n"],
        serial_z=lambda x: F.when(x["var"] > 0, (x["lag"] / x["var"] + 1 / x["n"]) * F.sqrt(x["n"])),
    )
    r = step(
        r,
        **keep("start", "end", "uniform_z", "ordinary_z", "serial_z", "n"),
        runs_z=lambda x: F.when(x["expected"] > 1, (x["changes"] - x["expected"]) / F.sqrt(x["expected"] * (x["expected"] - 1) / (x["n"] - 1))),
    )
    least = F.lit(1e-300)
    r = step(
        r,
        **keep("start", "end", "ordinary_z"),
        half=lambda x: -(
            F.log(F.greatest(two_sided(x["uniform_z"]), least))
            + F.log(F.coalesce(F.greatest(two_sided(x["runs_z"]), least), F.pow(F.lit(2.0), 1 - x["n"])))
            + F.log(F.greatest(F.coalesce(two_sided(x["serial_z"]), F.lit(0.0)), least))
        ),
    )
    return step(r, **keep("start", "end"), random=lambda x: F.exp(-x["half"]) * (1 + x["half"] + x["half"] * x["half"] / 2), ordinary=lambda x: below(x["ordinary_z"]))


def candidates(rows: DataFrame, text: str) -> DataFrame:
    """Adds _base, the spans of the patterns, and _runs: (start, end, bin) of other runs that pass as random."""
    named = lambda kind, keep="true": spans_of(f"_p{kind}", kind, keep)
    group = f"regexp_extract(x.hit, r\"{ASSIGN.replace(chr(34), chr(92) + 'x22')}\", 2)"
    rows = rows.withColumns({f"_p{k}": F.expr(places(text, p)) for k, p in enumerate((ASSIGN, ACCESS, HEX, RUN))})
    base = f"array_sort(concat({named(0, f'length({group}) >= {LEAST_ASSIGNED}')}, {named(1)}, {named(2)}))"
    rows = rows.withColumn("_base", F.expr(f"CASE WHEN size(_p0) + size(_p1) + size(_p2) > 0 THEN {base} ELSE cast(array() AS {SPANS}) END"))
    # Base spans and runs in one order: a run is alone if no base span before it reaches it and none after it begins in it.
    both = "array_sort(concat(transform(base, b -> named_struct('start', b.start, 'run', 0, 'end', b.end, 'hit', '')), transform(runs, x -> named_struct('start', x.start, 'run', 1, 'end', x.start + length(x.hit), 'hit', x.hit))))"
    reached = running("transform(both, x -> if(x.run = 0, x.end, -1))", "greatest({a}, x)", -1)
    begun = f"reverse({running('reverse(transform(both, x -> if(x.run = 0, x.start, 2147483647)))', 'least({a}, x)', 2147483647)})"
    alone = f"transform(filter(arrays_zip(both, {reached}, {begun}), x -> x.both.run = 1 AND x.`1` <= x.both.start AND x.`2` >= x.both.end), x -> named_struct('start', x.both.start, 'hit', x.both.hit))"
    alone = let("runs", "_p3", let("base", "_base", f"CASE WHEN size(runs) = 0 OR size(base) = 0 THEN runs ELSE {let('both', both, alone)} END"))
    rows = rows.withColumn("_alone", F.expr(alone)).drop("_p0", "_p1", "_p2", "_p3")
    rows = rows.withColumn("_judged", battery(F.col("_alone")))
    binned = F.transform(
        F.filter("_judged", lambda x: x["random"] >= REJECT),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(x["ordinary"], F.lit(1e-300)))).cast("int")).alias("bin")),
    )
    return rows.withColumn("_tests", F.size("_judged")).withColumn("_runs", binned).drop("_alone", "_judged")


def threshold(found: DataFrame, rate: float) -> int:
    """The least bin that is reported: Benjamini and Hochberg over all runs, p-values rounded up to their bin."""
    marks = F.concat("_runs.bin", F.array_repeat(F.lit(-1), F.col("_tests")))  # -1 for each run that was tested
    rows = found.where(F.size(marks) > 0).select(F.explode(marks).alias("bin")).groupBy("bin").count().collect()  # at most BINS + 2 rows
    counts = {r["bin"]: r["count"] for r in rows}
    tests = counts.pop(-1, 0)
    least, above = BINS + 1, 0
    for bin_, count in sorted(counts.items(), reverse=True):
        above += count
        if 10 ** (-bin_ / 10) * tests <= rate * above:
            least = bin_
    return least


def scanned(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """The rows of docs with _base and _spans, arrays of (start, kind, end) in order.

    kind is a place in KINDS; code points, end exclusive. A null or empty text has none.
    """
    text = "_text"
    rows = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    whole = candidates(rows, text)
    slim = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text)).where(F.col(text).rlike(RUN))
    least = threshold(candidates(slim, text).select("_tests", "_runs"), rate)
    more = F.expr(f"transform(filter(_runs, x -> x.bin >= {least}), x -> named_struct('start', x.start, 'kind', {len(KINDS) - 1}, 'end', x.end))")
    return whole.withColumn("_spans", F.when(F.size("_runs") > 0, F.array_sort(F.concat("_base", more))).otherwise(F.col("_base"))).drop("_runs", "_tests", text)


def written(spans: str) -> Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {kinds}[x.kind], x.start, x.end)), ',')")


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each document.

    A row for each row, repeated ones too; null doc_ids stay. Without secrets the counts
    are 0, spans is empty and base_sha256 is that of the empty string.
    """
    rows = scanned(docs.select("doc_id", "text"))
    count = lambda kind: F.expr(f"cast(size(filter(_spans, x -> x.kind = {kind})) AS long)").alias(f"n_{KINDS[kind]}")
    return rows.select("doc_id", *(count(k) for k in range(len(KINDS))), F.sha2(written("_base").cast("binary"), 256).alias("base_sha256"), written("_spans").alias("spans"))


def masked(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The documents with every span of a secret replaced by a mark; columns as they were, n_chars counted anew."""
    rows = scanned(docs.select(whole_rows(docs), F.col("text").cast("string").alias("text")))
    # A span that begins within an earlier one is part of it: heads are those that don't.
    reached = running("transform(spans, x -> x.end)", "greatest({a}, x)", -1)
    heads = f"filter(arrays_zip(spans, {reached}), x -> x.spans.start > x.`1`)"
    last = "array_max(transform(spans, x -> x.end))"
    ends = f"concat(transform(slice(heads, 2, size(heads)), x -> x.`1`), array({last}))"
    merged = let("spans", "_spans", let("heads", heads, f"transform(arrays_zip(heads, {ends}), x -> named_struct('start', x.heads.spans.start, 'end', x.`1`))"))
    rows = rows.withColumn("_merged", F.when(F.size("_spans") > 0, F.expr(merged)))
    # The text is cut once a chunk of spans, and each piece of it by places from there on.
    cut = "substring(text, z.`1` + 1, element_at(z.parts, -1).end - z.`1`)"
    inner = f"transform(sequence(1, size(z.parts)), i -> {let('from', 'if(i = 1, z.`1`, z.parts[greatest(i - 2, 0)].end)', 'concat(substring(part, from - z.`1` + 1, z.parts[i - 1].start - from), mark)')})"
    before = "concat(array(0), transform(slice(parts, 1, size(parts) - 1), x -> element_at(x, -1).end))"
    pieces = f"transform(arrays_zip(parts, {before}), z -> {let('part', cut, f"array_join({inner}, '')")})"
    built = let("mark", f"'{mask}'", let("parts", chunks("_merged"), f"concat(array_join({pieces}, ''), substring(text, element_at(_merged, -1).end + 1))"))
    built = F.expr(built)
    changed = F.col("_merged").isNotNull()
    rows = rows.withColumn("text", F.when(changed, built).otherwise(F.col("row.text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return restored(rows, docs, **new)
