"""Nested values, markup, rows of words, positions, versions and chains against independent computations."""

import json
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from strataform.functions import markup, nested
from strataform.functions import text as tx
from strataform.operators import catalogue, inheritance, layout, segments
from strataform.plans import catalogue_queries, import_queries, page_queries  # noqa: F401  (they register their queries)
from strataform.sources import staging


def value(r, depth):
    kind = r.random()
    if depth and kind < 0.35:
        return {r.choice(["a", "type", "version", "k [1, 2]", 'q"x', "z"]): value(r, depth - 1) for _ in range(r.randint(0, 3))}
    if depth and kind < 0.6:
        return [value(r, depth - 1) for _ in range(r.randint(0, 4))]
    return r.choice([1, -2.5, True, None, "", "plain", "cite [1, 2] x", "half [1/2]", 'quo"te \\ back', "[3;4]", "é😀", json.dumps({"in": ["deep [5,6]", {"type": "no"}]}), "{not json"])


def by_hand(x):
    """(containers, texts, value without citations)."""
    clean = lambda s: re.sub(" *\n *", "\n", re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]*\[\s*\d+(?:\s*[,;]\s*\d+)+\s*\]", "", s))) if re.search(r"\[\s*\d+(?:\s*[,;]\s*\d+)+\s*\]", s) else s
    if isinstance(x, str):
        try:
            y = json.loads(x) if x.strip()[:1] in "{[" and x.strip() else None
        except ValueError:
            y = None
        texts = by_hand(y)[1] if isinstance(y, (dict, list)) else [x] if x.strip() else []
        return [], texts, clean(x)
    if not isinstance(x, (dict, list)):
        return [], [], x
    parts = [(k, *by_hand(v)) for k, v in (x.items() if isinstance(x, dict) else enumerate(x))]
    inner = [c for p in parts for c in p[1]]
    texts = [t for p in parts if p[0] not in ("type", "version") for t in p[2]]
    return [x, *inner], texts, {p[0]: p[3] for p in parts} if isinstance(x, dict) else [p[3] for p in parts]


def test_nested_values_equal_a_walk(spark):
    r = random.Random(4)
    values = [v for v in (value(r, 6) for _ in range(300)) if isinstance(v, (dict, list))]
    deep = "x"
    for _ in range(60):
        deep = {"a": [deep]}
    values.append(deep)
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)], "id int, j string")
    for row in df.select("id", nested.containers(F.array("j")).alias("c"), nested.search_text(F.col("j"), lambda x: x).alias("t"), nested.without_citations(F.col("j")).alias("w")).collect():
        held, texts, clean = by_hand(values[row["id"]])
        assert [json.loads(c) for c in row["c"]] == held
        assert row["t"] == texts, values[row["id"]]
        assert json.loads(row["w"]) == clean
    odd = spark.createDataFrame([(None,), ("",), ("no json",), ("{broken",), ("7",)], "j string")
    assert [len(r[0]) for r in odd.select(nested.containers(F.array("j"))).collect()] == [0] * 5
    assert [r[0] for r in odd.select(nested.search_text(F.col("j"), lambda x: x)).collect()] == [[], [], ["no json"], ["{broken"], ["7"]]


class Parsed(HTMLParser):
    """Text and elements of markup, by another parser; scripts, styles and comments are left out."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.text, self.names, self.skip = [], [], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.names.append(tag)

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def test_sanitised_pages_equal_another_parser(spark):
    """Every page: the text of the markup, the number of each element, and that every element is closed."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    flat = lambda x: re.sub("[ \t\r\n\f\x0b\xa0]+", " ", x).strip()
    for row in pages.select("html", markup.sanitised(F.col("html")).alias("x")).collect():
        want, got = Parsed(row["html"]), Parsed(row["x"])
        assert flat("".join(got.text)) == flat("".join(want.text))
        for name in markup.ALLOWED:
            assert got.names.count(name) == want.names.count(name)
        stack = []
        for end, name in re.findall("<(/?)([a-z0-9]+)[^>]*>", row["x"]):
            if end:
                assert stack.pop() == name
            elif name not in markup.VOID:
                stack.append(name)
        assert not stack


MARKUP = [
    ("<ul><li>one<li>two <b>bold<ul><li>in</li></ul></li></ul> tail", "<ul><li>one</li><li>two <b>bold<ul><li>in</li></ul></b></li></ul> tail"),
    ('<a href="#recipe-7" onclick="x()">c <i>d</a></i> <a href="http://q">e</a>', '<a href="#recipe-7" data-recipe-id="7">c <i>d</i></a> e'),
    ('x < y & z &amp; <script>f("</p>")</script><!-- <b>c</b> -->w', "x &lt; y &amp; z &amp; w"),
    ('<p title="a > b">q<p>r</b><div>s', "<p>q</p><p>r</p><div>s</div>"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "abc"),
    ("<style>p{}</style><br/>t<!-- open", "<br>t"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize("given,want", MARKUP)
def test_markup(spark, given, want):
    assert spark.range(1).select(markup.sanitised(F.lit(given).cast("string")).alias("v")).first()["v"] == want


def test_classes_and_blocks(spark):
    html = '<div class="a q"><div>in <div class="q">deep</div></div> er</div><p class="qq">no</p><span class=q>bare</span>'
    row = spark.range(1).select(markup.class_texts(F.lit(html), "q").alias("q"), F.to_json(markup.blocks(F.lit("<p>a<hr><ul><li>b</ul>"))).alias("b"), F.to_json(markup.blocks(F.lit("a & b\n---\n\nc"))).alias("t")).first()
    assert row["q"] == ["in deep er", "deep", "bare"]
    assert json.loads(row["b"]) == [{"type": "line", "html": "<p>a</p>"}, {"type": "divider", "html": ""}, {"type": "line", "html": "<ul><li>b</li></ul>"}]
    assert json.loads(row["t"]) == [{"type": "line", "html": "a &amp; b"}, {"type": "divider", "html": ""}, {"type": "line", "html": "c"}]


def test_rows_of_words_equal_a_loop(spark):
    r, rows, want = random.Random(9), [], {}
    for page in range(40):
        words = [(f"w{k}", float(r.randint(0, 300)), float(r.randint(0, 120)), r.choice([8.0, 12.0, 30.0])) for k in range(r.randint(1, 40))]
        rows += [(page, t, x, y, x + 9, y + h, k) for k, (t, x, y, h) in enumerate(words)]
        heights = sorted(y + h - y for _, _, y, h in words)
        near, found = max(8, heights[len(heights) // 2] * 0.55), []
        for t, x, y, h in sorted(words, key=lambda w: (w[2], w[1], w[0])):
            c = (y + y + h) / 2
            row = next((q for q in found if abs(q[0] - c) < near), None)
            if row is None:
                found.append(row := (c, []))
            row[1].append((x, y, t))
        want |= {(page, k): " ".join(t for *_, t in sorted(q[1])) for k, q in enumerate(found)}
    df = spark.createDataFrame(rows, "page int, text string, x0 double, y0 double, x1 double, y1 double, ord int")
    assert {(x["page"], x["row"]): x["text"] for x in layout.rows_of_words(df, "page").collect()} == want
    assert "Python" not in layout.rows_of_words(df, "page")._jdf.queryExecution().toString()


def test_positions(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), "id").repartition(7)
    rows, ranges = catalogue.placed(df, F.desc("v"), F.asc("id"), parts=9)
    want = [r["id"] for r in df.orderBy(F.desc("v"), "id").collect()]
    assert [r["id"] for r in rows.orderBy("position").collect()] == want
    assert [[r["id"] for r in catalogue.placed_page(rows, ranges, k, 37).collect()] for k in (0, 13, 27, 28)] == [want[k * 37 : k * 37 + 37] for k in (0, 13, 27, 28)]
    last, seen = None, []
    while page := catalogue.after(df, [("v", False), ("id", True)], last, 300).collect():
        last, seen = page[-1].asDict(), seen + [r["id"] for r in page]
    assert seen == want
    assert catalogue.placed(df.limit(0), F.asc("id"))[0].count() == 0


def test_grams_equal_contains(spark):
    r = random.Random(2)
    texts = [(i, "".join(r.choice("abAB ") for _ in range(r.randint(0, 9)))) for i in range(300)] + [(900, None)]
    terms = [(t,) for t in ("a", "ab", "AbA", "abab", "zzz", " ", "", "bbbbb")]
    df = spark.createDataFrame(texts, "id int, t string")
    index, counts = catalogue.postings(df, "id", "t")
    got = sorted(tuple(x) for x in catalogue.found_by_grams(df, "id", "t", spark.createDataFrame(terms, "term string"), "term", index, counts).collect())
    assert got == sorted((t, i) for (t,) in terms if t for i, x in texts if x and t.lower() in x.lower())


def test_query_string_operands_are_values(spark):
    df = spark.createDataFrame([(1, "O'Brien", 5.0), (2, "OBrien", 10.0), (3, "a\\", 9.0), (4, "50%_x", None)], "id int, name string, price double")
    ids = lambda q: sorted(r["id"] for r in catalogue.from_query_string(df, q, {"id", "name", "price"}).collect())
    assert ids("name=eq.O'Brien") == [1] and ids("name=eq.a\\") == [3] and ids("name=eq.x' OR '1'='1") == []
    assert ids("price=gt.9") == [2] and ids("price=lte.9.0") == [1, 3] and ids("id=in.(1,3)") == [1, 3] and ids("price=is.null") == [4]
    assert ids("name=like.50%25_*") == [4] and ids("name=like.*Br*") == [1, 2]


def test_a_long_chain_of_bases(spark):
    rows = [(1, 0, "First", ["flour"], ["Knead."])] + [(1, k, f"Bread {k}", [], ["Same dough."]) for k in range(1, 400)] + [(2, 5, "Alone", [], ["Same dough."])]
    df = spark.createDataFrame(rows, "doc int, pos int, name string, ingredients array<string>, method array<string>")
    got = {(r["doc"], r["pos"]): (r["ingredients"], r["base_name"]) for r in inheritance.inherited(df, "doc").collect()}
    assert len(got) == 401 and got[2, 5] == ([], None) and got[1, 399] == (["flour"], "Bread 398")
    assert all(got[1, k][0] == ["flour"] for k in range(400))


def test_headings_and_texts_as_pages_write_them(spark, tmp_path):
    """Entities that a heading holds, and ampersands that begin none, as the SQL of the queries has them."""
    import duckdb

    pages = [(1, "<h1>a &quot;b&quot; &amp; &lt;c</h1><p>x &am<li>y &amp; z"), (2, "<h1> t <i>u</i>&nbsp;</h1>R&D &a"), (3, "<p>none</p>"), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_headings", "sanitised_markup"):
        got = [tuple(r) for r in catalogue_queries.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(duck.execute(catalogue_queries.oracle_sql()[name]).fetchall()), name


def test_bases_grow_with_records_not_pairs(spark):
    """Each record's base by brute force, marks around names aside; records meet by equal names, never pair by pair."""
    import random
    import re

    some, words = random.Random(3), ["rye", "oat", "plain", "dough", "sweet", "bun"]
    rows = [(d, p, " ".join(some.choices(words, k=some.randint(1, 2))) + some.choice(["", "!", " (1)"]), [], [some.choice(["Same dough as ", "Above base: ", "Own "]) + " ".join(some.choices(words, k=3)) + "."]) for d in (1, 2) for p in range(40)]
    rows += [(3, 0, "!", [], []), (3, 1, None, [], ["Same dough."]), (3, 2, "Bun", [], ["Same dough."]), (None, 1, "Bun", [], ["Same dough."])]
    df = spark.createDataFrame(rows, "doc int, pos int, name string, ingredients array<string>, method array<string>")
    told = lambda text: " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "
    want = {}
    for d, p, name, _, method in rows:
        before = [r for r in rows if d and r[0] == d and r[1] < p]
        text = " ".join([*([name] if name else []), *method])
        if before and re.search(inheritance.REFERS[4:], text, re.I):
            named = [r[1] for r in before if r[2] and told(r[2]).strip() and told(r[2]) in told(text)]
            want[d, p] = max(named or [r[1] for r in before])
    found = inheritance.bases(df, "doc")
    assert {(r["doc"], r["pos"]): r["base_pos"] for r in found.collect()} == want and len(want) > 40
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("<" in line or ">" in line for line in joins)


@pytest.mark.parametrize("name", ["numbered_records", "best_page_blocks", "best_pdf_blocks", "best_scan_blocks", "best_blocks", "menu_parts", "sanitised_markup"])
def test_work_inside_a_row_is_dealt_first(spark, name):
    """A table in one row group is dealt to all tasks before the work on a row, and moves only once."""
    plan = catalogue_queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Window" not in plan


def test_parts_of_lines(spark):
    """Blocks inside a row and of lines that are rows; stops, headings without lines, documents without blocks."""
    texts = {1: "x\nMethod\nno\nIngredients\n1 egg\n\nNotes\nn\nMethod\nMix.\nMethod\nFry.\nShare this\nMethod\nStir.", 2: "Ingredients\nIngredients\nsalt\nMethod\nCook.", 3: "nothing", 4: "", 5: None, 6: "Ingredients\nsalt\nShare this\nMethod\nCook."}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    want = [(1, 1, 13, ["1 egg"], ["Mix.", "Fry."]), (2, 2, 7, ["salt"], ["Cook."])]
    for found in (segments.best_of(segments.line_arrays(df, "id"), "id"), segments.best_block(segments.lines_of(df, "id"), "id")):
        assert sorted(tuple(r) for r in found.collect()) == want
    parts = df.where("id = 2").select(segments.parted(F.split("text", "\n")).alias("p")).first()["p"]
    assert [(p["kind"], p["body"]) for p in parts] == [("ingredients", []), ("ingredients", ["salt"]), ("method", ["Cook."])]


def test_versions(spark, tmp_path):
    """A failed save leaves the old version, a replayed batch changes nothing, undo takes back one part, late commits fail."""
    rows = lambda v, n=None: sorted(r["id"] for r in v.read(n).collect())
    v = staging.Versions(spark, f"{tmp_path}/t", "id long")
    assert rows(v) == [] and v.manifests() == []
    assert v.save(spark.range(3), "a") == 1 and v.save(spark.range(10, 12), "b") == 2 and v.save(spark.range(50), "a") == 1
    with pytest.raises(Exception, match="broken"):
        v.save(spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id")), "c")
    assert rows(v) == [0, 1, 2, 10, 11] and rows(v, 1) == [0, 1, 2]
    report = v.save_each([("d", spark.range(20, 21)), ("e", spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))), ("f", spark.range(9))])
    assert (report["saved"], report["failed"], report["left"]) == (["d"], "e", ["f"]) and "no" in report["error"]
    v.undo_batches(["b", "d"])
    assert rows(v) == [0, 1, 2] and rows(v, 3) == [0, 1, 2, 10, 11, 20]
    v.save(spark.range(7, 8), replace=True)
    assert rows(v) == [7]
    with pytest.raises(Exception, match="exist"):
        v._commit({"version": 1, "parts": [], "batch": None, "part": None})


def test_a_replayed_stream_saves_once(spark, tmp_path):
    source, v = f"{tmp_path}/in", staging.Versions(spark, f"{tmp_path}/t", "id long")
    spark.range(5).write.parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema("id long").parquet(source).writeStream.foreachBatch(v.sink())
        stream.option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    run("one")
    run("two")  # without its checkpoint, the stream sends batch 0 again
    assert sorted(r["id"] for r in v.read().collect()) == [0, 1, 2, 3, 4]
    spark.range(5, 7).write.mode("append").parquet(source)
    run("one")
    assert sorted(r["id"] for r in v.read().collect()) == list(range(7))


def cut_by_hand(words, column_gap, block_gap):
    """Blocks of (y0, x0, text, x1, y1), in reading order."""

    def widest(low, high):
        best, at, end = 0.0, 0.0, None
        for a, b in sorted((w[low], w[high]) for w in words):
            if end is not None and a - end > best:
                best, at = a - end, a
            end = b if end is None else max(end, b)
        return best, at

    for (gap, at), least, axis in ((widest(1, 3), column_gap, 1), (widest(0, 4), block_gap, 0)):
        if gap >= least:
            return [b for side in ([w for w in words if w[axis] < at], [w for w in words if w[axis] >= at]) for b in cut_by_hand(side, column_gap, block_gap)]
    return [words]


def test_blocks_equal_recursive_cuts(spark):
    r, rows, want = random.Random(12), [], {}
    for page in range(30):
        words = sorted({(float(y := r.randint(0, 40) * 10), float(x := r.randint(0, 60) * 10), f"w{k}", x + r.choice([20.0, 60.0]), y + 10.0) for k in range(r.randint(1, 25))})
        rows += [(page, t, x0, y0, x1, y1) for y0, x0, t, x1, y1 in words]
        want |= {(page, k): [w[2] for w in sorted(b)] for k, b in enumerate(cut_by_hand(words, 40.0, 30.0))}
    df = spark.createDataFrame(rows, "page int, text string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    assert {(x["page"], x["block"]): [w["text"] for w in x["words"]] for x in layout.page_blocks(df, "page").collect()} == want
