"""Nested JSON values of any depth as column expressions: a fold over the tokens of a text, inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataform.functions.text import let

#: A token: a string, a bracket, or what is between them.
TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\]]|[^"{}\[\]]+'
#: White space inside a JSON string: as it is, or escaped.
BLANK = r"(?:[ \xa0]|\\[tnrf])"


def tokens(json: Column) -> Column:
    """array<struct<kind, text>>: all tokens of a JSON text, in order. Kinds: key, text, open, close, other."""

    def named(parts: Column) -> Column:
        def kind(x: Column, k: Column) -> Column:
            is_key = F.coalesce(F.get(parts, k + 1).rlike(r"^\s*:"), F.lit(False))
            return F.when(x.startswith('"'), F.when(is_key, "key").otherwise("text")).when(x.isin("{", "["), "open").when(x.isin("}", "]"), "close").otherwise("other")

        return F.transform(parts, lambda x, k: F.struct(kind(x, k).alias("kind"), x.alias("text")))

    return let(F.regexp_extract_all(json, F.lit(TOKEN), F.lit(0)), named)


def is_container(json: Column) -> Column:
    """Whether a text is JSON for an object or an array."""
    return F.coalesce(json.rlike(r"^\s*[{\[]") & F.try_parse_json(F.when(json.rlike(r"^\s*[{\[]"), json)).isNotNull(), F.lit(False))


def extents(json: Column) -> Column:
    """array<struct<start, length>>: where the objects and arrays of a JSON text are, outer ones before what they hold."""
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<start:int,length:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        after = (acc["at"] + F.length(x)).cast("int")
        start = F.element_at(acc["open"], -1)
        return (
            F.when(x.isin("{", "["), F.struct(after.alias("at"), F.array_append(acc["open"], acc["at"]).alias("open"), acc["found"].alias("found")))
            .when(x.isin("}", "]"), F.struct(after.alias("at"), F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1).alias("open"), F.array_append(acc["found"], F.struct(start.alias("start"), (after - start).cast("int").alias("length"))).alias("found")))
            .otherwise(F.struct(after.alias("at"), acc["open"].alias("open"), acc["found"].alias("found")))
        )

    return F.aggregate(F.regexp_extract_all(json, F.lit(TOKEN), F.lit(0)), none, step, lambda acc: F.array_sort(acc["found"]))


def containers(texts: Column) -> Column:
    """array<string>: the objects and arrays in JSON texts, as they are written, outer ones before what they hold; texts that aren't JSON give none."""
    return F.flatten(F.transform(F.filter(texts, is_container), lambda x: F.transform(extents(x), lambda e: F.substring(x, e["start"], e["length"]))))


def leaf_texts(json: Column, skipped: tuple[str, ...]) -> Column:
    """array<string>: the texts in a JSON object or array, in order, but for those under skipped keys."""
    none = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("skip"), F.lit(False).alias("next"), F.array().cast("array<string>").alias("found"))
    keys = [f'"{k}"' for k in skipped]

    def step(acc: Column, x: Column) -> Column:
        def state(depth=acc["depth"], skip=acc["skip"], goes=F.lit(False), found=acc["found"]) -> Column:
            return F.struct(depth.cast("int").alias("depth"), skip.cast("int").alias("skip"), goes.alias("next"), found.alias("found"))

        kind, down = x["kind"], acc["depth"] + 1
        wanted = (acc["skip"] == 0) & ~acc["next"]
        return (
            F.when(kind == "key", state(goes=x["text"].isin(*keys) if keys else F.lit(False)))
            .when(kind == "text", state(found=F.when(wanted, F.array_append(acc["found"], x["text"])).otherwise(acc["found"])))
            .when(kind == "open", state(depth=down, skip=F.when(acc["next"] & (acc["skip"] == 0), down).otherwise(acc["skip"])))
            .when(kind == "close", state(depth=acc["depth"] - 1, skip=F.when(acc["skip"] == acc["depth"], F.lit(0)).otherwise(acc["skip"])))
            .otherwise(state(goes=acc["next"] & ~x["text"].rlike(r"[^\s:,]")))
        )

    found = F.aggregate(tokens(json), none, step, lambda acc: acc["found"])
    return F.transform(found, lambda x: F.when(x.contains("\\"), F.try_variant_get(F.try_parse_json(x), "$", "string")).otherwise(F.substring(x, F.lit(2), F.length(x) - 2)))


def search_text(json: Column, plain, skipped: tuple[str, ...] = ("version", "type")) -> Column:
    """array<string>: the texts of a nested value; text that is JSON itself is read as a value, other text goes through plain().

    Texts under skipped keys, null and blank ones are left out. What isn't a JSON object or array counts as one text.
    """
    read = lambda texts: F.flatten(F.transform(texts, lambda x: F.when(is_container(x), leaf_texts(x, skipped)).otherwise(F.array(x))))
    # JSON in a text of JSON is at most half as long, as its quotes are escaped again each time.
    turns = F.sequence(F.lit(1), F.ceil(F.log2(F.length(json) + 2)).cast("int"))
    again = lambda texts, _: F.when(F.exists(texts, is_container), read(texts)).otherwise(texts)
    found = F.aggregate(turns, F.array(json), again)
    return F.when(json.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.filter(found, lambda x: F.trim(x) != ""), plain), lambda x: x != ""))


def without_citations(json: Column) -> Column:
    """A JSON value without bracketed lists of numbers such as [1, 2] in its texts, however deep; arrays of numbers, keys and quantities such as [1/2] stay."""
    citation = rf"(?:[ ]|\\t)*\[{BLANK}*[0-9]+(?:{BLANK}*[,;]{BLANK}*[0-9]+)+{BLANK}*\]"

    def cleaned(x: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(x["text"], citation, ""), r"(?:[ ]|\\t){2,}", " ")
        return F.when((x["kind"] == "text") & x["text"].rlike(citation), F.regexp_replace(text, r" *\\n *", r"\\n")).otherwise(x["text"])

    return F.array_join(F.transform(tokens(json), cleaned), "")
