"""Literal cases, derived by hand from the rules that they name."""

import pytest
from pyspark.sql import functions as F

from strataform.functions import markup
from strataform.functions import text as tx
from strataform.operators import catalogue, inheritance, layout, lines, quality, scoring, segments
from strataform.sources import sinks, tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def s(text):
    return F.lit(text).cast("string")


CASES = [
    (lambda: tx.squeezed(s(" a\t b \n c ")), "a b c"),
    (lambda: tx.search_term(s("  x " + "y" * 100)), "x " + "y" * 78),
    (lambda: tx.search_term(s(None)), ""),
    (lambda: tx.cleaned(s("a \t b\r\n\n\n\nc ")), "a b\n\nc"),
    (lambda: tx.without_controls(s("a\x00b� c")), "a b c"),
    (lambda: tx.without_links(s("see ![pic](u) and [text](http://x)")), "see pic and text"),
    (lambda: tx.without_marker(s("- 2 eggs")), "2 eggs"),
    (lambda: tx.without_marker(s("12) Mix")), "Mix"),
    (lambda: tx.without_marker(s("## Method")), "Method"),
    (lambda: tx.without_marker(s("2 eggs")), "2 eggs"),
    (lambda: tx.without_citations(s("Mix [1, 2] well")), "Mix well"),
    (lambda: tx.without_citations(s("[1/2] cup")), "[1/2] cup"),
    (lambda: tx.with_fractions(s("1/2 cup, 11/2, 2 Ib")), "½ cup, 11/2, 2 lb"),
    (lambda: tx.with_halves(s("1% cup")), "1½ cup"),
    (lambda: tx.with_halves(s("20% off")), "20% off"),
    (lambda: tx.slug(s("Red-Sauce")), "red sauce"),
    (lambda: tx.slug(s("—")), None),
    (lambda: tx.file_title(s("butter_chicken (1).pdf")), "butter chicken"),
    (lambda: tx.first_filled(s(""), s(" "), s("x")), "x"),
    (lambda: tx.stars(F.lit(3)), "★★★☆☆"),
    (lambda: tx.stars(F.lit(None)), "☆☆☆☆☆"),
    (lambda: tx.iso_date(s("01-02-2024")).cast("string"), "2024-02-01"),
    (lambda: tx.iso_date(s("31-02-2024")), None),
    (lambda: tx.iso_date(s("1-2-24")), None),
    (lambda: tx.escaped(s("<a href=\"x\">'&'</a>")), "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"),
    (lambda: tx.unescaped(s("a&nbsp;&lt;b&gt; &amp;lt;")), "a <b> &lt;"),
    (lambda: tx.html_text(s("<style>x</style><p>One<br>two</p><ul><li>a<li>b</ul><!-- no -->")), "One\ntwo\na\nb"),
    (lambda: tx.safe_html(s('<p onclick="x()">a</p><script>y</script><a href="javascript:z">b</a>')), '<p>a</p><a href="z">b</a>'),
    (lambda: tx.language_by_block(s("वरण भात आमटी खळ")), "Marathi"),
    (lambda: tx.language_by_block(s("दाल चावल")), "Hindi"),
    (lambda: tx.language_by_block(s("கறி")), "Tamil"),
    (lambda: tx.language_by_block(s("Dal")), "English"),
    (lambda: tx.sentences(s("One. Two! Three")), ["One.", "Two!", "Three"]),
    (lambda: tx.title_and_yield(s("Dal serves 4"))[0], "Dal"),
    (lambda: tx.title_and_yield(s("Dal serves 4"))[1], "serves 4"),
    (lambda: tx.title_and_yield(s("Dal"))[1], ""),
    (lambda: tx.capped(s("a b. c"), 2), "a b."),
    (lambda: tx.capped(s("a b c"), 2), "a b…"),
    (lambda: tx.letter_share(s("")), 0.0),
    (lambda: tables.file_kind(s("a.DOCX"), s(None)), "docx"),
    (lambda: tables.file_kind(s("x"), s("image/png")), "image"),
    (lambda: tables.payload_field(s('{"recipe":{"recipeYield":"4"}}'), "servings", "recipeYield"), "4"),
    (lambda: tables.payload_field(s('{"name":" "}'), "name"), None),
    (lambda: tables.holds_many(s('{"version":7,"multiple":true,"recipes":[{}]}')), True),
    (lambda: tables.holds_many(s("plain text")), False),
    (lambda: tables.plain_ingredients(s('[{"quantity":"2","unit":"","name":"eggs"},{"quantity":"1","unit":"cup","name":"milk"}]')), ["2 eggs", "1 cup milk"]),
    (lambda: tables.plain_ingredients(s('["a","b"]')), ["a", "b"]),
    (lambda: tables.plain_ingredients(s('{"html":"<ul><li>a</li><li>b</li></ul>"}')), ["a", "b"]),
    (lambda: tables.plain_ingredients(s("a\n\nb")), ["a", "b"]),
    (lambda: segments.numbered_steps(F.array(F.lit("1. Mix"), F.lit("well"), F.lit("2. Bake"))), ["Mix well", "Bake"]),
    (lambda: segments.numbered_steps(F.array(F.lit("Mix"), F.lit("Bake"))), ["Mix", "Bake"]),
    (lambda: segments.split_quantity(s("coconut2 cloves")), ["coconut", "2 cloves"]),
    (lambda: segments.split_quantity(s("2 cloves garlic")), ["2 cloves garlic"]),
    (lambda: segments.split_notes(F.array(F.lit("Serves: 1–2 Note: chill")))[0], ["Serves: 1–2"]),
    (lambda: segments.split_notes(F.array(F.lit("Serves: 1–2 Note: chill")))[1], ["chill"]),
    (lambda: F.to_json(markup.blocks(s("Soup\n---\n Fish "))), '[{"type":"line","html":"Soup"},{"type":"divider","html":""},{"type":"line","html":"Fish"}]'),
    (lambda: markup.class_texts(s('<div class="x wprm-name">Dal</div><span class="y">n</span>'), "wprm-name"), ["Dal"]),
    (lambda: tx.category(s("Tomato soup"), [("soup", "soups"), ("cake", "cakes")], "other"), "soups"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(spark, k):
    make, want = CASES[k]
    assert value(spark, make()) == want


@pytest.mark.parametrize("total,offset,want", [(25, 12, (3, 2, 0, 24, 24)), (0, 0, (1, 1, 0, 0, 0))])
def test_pager(spark, total, offset, want):
    assert tuple(spark.range(1).select(*catalogue.pager(F.lit(total), F.lit(offset))).first()) == want


RECIPE = "Saoi Mutton\nMutton Gravy | Serves 4–6\n\nIngredients\n- 500 g mutton\n- coconut2 cloves\n- 1 tsp salt\n- 1 tsp salt\nMethod: Soak the mutton [1, 2] in water.\n1. Fry the coconut Tip: slowly\nuntil brown.\n2. Add the mutton and cook.\nNotes\nRest it.\nShare this\nno"


def test_records(spark):
    df = spark.createDataFrame([(1, RECIPE), (2, ""), (3, None)], "id int, text string")
    rows = segments.records(segments.lines_of(df, "id"), "id").collect()
    assert [r["id"] for r in rows] == [1]
    r = rows[0]
    assert r["title"] == "Saoi Mutton" and r["description"] == "Mutton Gravy | Serves 4–6"
    assert r["ingredients"] == ["500 g mutton", "coconut", "2 cloves", "1 tsp salt"]
    assert r["method"][0] == "Soak the mutton in water." and r["method"][-1] == "Add the mutton and cook." and len(r["method"]) == 3
    assert "Rest it." in r["notes"] and not any("no" == n for n in r["notes"])


def test_many_records(spark):
    text = "Book\nRed Dal\nIngredients\nlentils\nMethod\nBoil.\nGreen Dal\nIngredients\npeas\nMethod\nFry."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = segments.many(segments.lines_of(df, "id"), "id", lambda line: line.endswith("Dal")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        got.setdefault(r["record"], []).append(r["line"])
    assert got == {1: ["Red Dal", "Ingredients", "lentils", "Method", "Boil."], 2: ["Green Dal", "Ingredients", "peas", "Method", "Fry."]}


def test_cascade(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, None, None)], "id int, x string, y string")
    parsers = [("x", F.struct(F.col("x").alias("v")), F.col("x").isNotNull()), ("y", F.struct(F.col("y").alias("v")), F.col("y").isNotNull())]
    assert {r["id"]: (r["parser"], r["record"] and r["record"]["v"]) for r in segments.cascade(df, "id", parsers).collect()} == {1: ("x", "a"), 2: ("y", "b"), 3: (None, None)}


def test_html(spark):
    page = '<h1>Dal</h1><script type="application/ld+json">[{"x":{"recipeIngredient":[]}},{"y":[{"name":"N","recipeIngredient":["a"],"recipeInstructions":"Boil"}]}]</script><h2>Ingredients</h2><ul><li>one <b>x</li><li>two</ul><h2>Method</h2><p>Boil</p>'
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    assert [r["item"] for r in segments.html_lists(df, "id").orderBy("pos").collect()] == ["one x", "two"]
    assert [(r["heading"], r["body"]) for r in segments.html_sections(df, "id", tag="h2").orderBy("pos").collect()] == [("Ingredients", "one x\ntwo"), ("Method", "Boil")]
    got = df.select(segments.linked_record(F.col("html")).alias("r"), segments.heading_record(F.col("html")).alias("h")).collect()
    assert [x["r"] and tuple(x["r"][c] for c in ("name", "ingredients", "method")) for x in got] == [("N", ["a"], ["Boil"]), None]
    assert [x["h"] and tuple(x["h"][c] for c in ("name", "ingredients", "method")) for x in got] == [("Dal", ["one x", "two"], ["Boil"]), None]


GOOD = dict(name="Plain Dal", description="", ingredients=["1 cup lentils", "2 cups water", "1 tsp salt"], method=["Boil the lentils in water with the salt until they are soft."], mode="text")


@pytest.mark.parametrize(
    "change,score,good,reason",
    [
        ({}, 100, True, None),
        ({"method": []}, 90, True, None),
        ({"mode": "scanned_pdf", "ingredients": ["1 cup rice", "2 cups water", "1 tsp salt", "1 tsp oil"]}, 100, False, "scanned_pdf_ingredient_list_suspiciously_short"),
        ({"name": "By Jane Doe"}, 100, False, "title_looks_like_credit_or_byline"),
        ({"name": "By the Sea"}, 100, True, None),
        ({"ingredients": ["1 cup lentils", "1 cup lentils", "salt"]}, 95, False, "repeated_lines"),
        ({"name": None}, 80, False, "missing_or_implausible_title"),
        ({"description": "A bar with a terrace and cocktails"}, 100, False, "description_looks_like_venue_promotion"),
        ({"ingredients": None}, 80, False, "too_few_ingredients"),
        ({"method": ["Take 1 cup lentils and boil them in plenty of water for long"]}, 100, False, "possible_section_contamination"),
    ],
)
def test_quality(spark, change, score, good, reason):
    schema = "name string, description string, ingredients array<string>, method array<string>, mode string"
    r = quality.checked(spark.createDataFrame([GOOD | change], schema)).first()
    assert (r["score"], r["good"]) == (score, good) and (reason is None and not r["reasons"] or reason in r["reasons"])


def test_layout(spark):
    words = [(1, "Red", 10.0, 10.0, 40.0, 30.0), (1, "Dal", 50.0, 14.0, 80.0, 32.0), (1, "lentils", 12.0, 60.0, 60.0, 80.0), (2, "x", 0.0, 0.0, 5.0, 10.0)]
    df = spark.createDataFrame(words, "page int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page"], r["row"]): r["text"] for r in layout.rows_of_words(df, "page").collect()}
    assert got == {(1, 0): "Red Dal", (1, 1): "lentils", (2, 0): "x"}
    schema = "page int, ord int, text string, x0 double, x1 double, y0 double, y1 double"
    titles = spark.createDataFrame([(1, 0, "A", 0.0, 10.0, 0.0, 10.0), (1, 1, "B", 100.0, 110.0, 0.0, 10.0)], schema)
    rows = spark.createDataFrame([(1, 0, "a", 0.0, 10.0, 20.0, 30.0), (1, 1, "b", 4.0, 12.0, 40.0, 50.0), (1, 2, "c", 100.0, 110.0, 20.0, 30.0), (1, 3, "far", 0.0, 10.0, 900.0, 910.0)], schema)
    assert {(r["text"], r["title"]) for r in layout.under_titles(rows, titles, "page").collect()} == {("a", "A"), ("b", "A")}


def test_inheritance(spark):
    rows = [(1, 0, "Plain Dough", ["flour"], ["Knead."]), (1, 1, "Sweet (Dough)", [], ["Use the above dough."]), (1, 2, "Buns", [], ["Same dough as Plain Dough."]), (1, 3, "Rolls", ["x"], [])]
    df = spark.createDataFrame(rows, "doc int, pos int, name string, ingredients array<string>, method array<string>")
    got = {r["pos"]: (r["ingredients"], r["base_name"]) for r in inheritance.inherited(df, "doc").collect()}
    assert got == {0: (["flour"], None), 1: (["flour"], "Plain Dough"), 2: (["flour"], "Plain Dough"), 3: (["x"], None)}


def test_line_windows(spark):
    rows = [(1, 0, "1. a"), (1, 1, "1. ab"), (1, 2, "2. c"), (1, 3, "2. d")]
    df = spark.createDataFrame(rows, "id int, pos int, line string")
    kept = lines.without_shorter_repeat(df, "id", F.regexp_extract("line", "^[0-9]+", 0))
    assert sorted(r["line"] for r in kept.collect()) == ["1. ab", "2. c", "2. d"]
    df = spark.createDataFrame([(1, "the new bar in town is open\nRed Lentil Dal\nmix it all together with care and wait.")], "id int, text string")
    assert scoring.titles(lines.arrays(df, "id"), "id").first()["title"] == "Red Lentil Dal"


def test_upper_median(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (10, 20, 30, 40)] + [("b", 1.0), ("c", None)], "k string, h double")
    assert {r["k"]: r["m"] for r in catalogue.upper_median(df, ["k"], "h", "m").collect()} == {"a": 30.0, "b": 1.0}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (4, "D"), (4, "D")], "id int, v string")
    rows = lambda df: sorted(df.collect(), key=str)
    assert [tuple(r) for r in rows(sinks.updated(old, "id", new.where("id = 2"), ["v"]))] == [(1, "a"), (2, "B"), (3, None)]
    assert [tuple(r) for r in rows(sinks.upserted(old, new, ["id"]))] == [(1, "a"), (2, "B"), (3, None), (4, "D")]
    assert [r["id"] for r in rows(sinks.deleted(old, new, ["id"]))] == [1, 3]
    saved, skipped = sinks.inserted_unless_there(old, new, F.col("id"), "v")
    assert [r["id"] for r in saved.collect()] == [4] and sorted(r["id"] for r in skipped.collect()) == [2, 4]


def test_paging_covers_everything_once(spark):
    df = spark.range(30)
    pages = [r["id"] for k in range(3) for r in catalogue.page(df, [F.desc("id")], 12 * k).collect()]
    assert pages == list(range(29, -1, -1))


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.csv").write_text("x,y\n1,2")
    assert sorted(r["text"] for r in tables.whole_texts(spark, str(tmp_path)).collect()) == ["one\ntwo", "x,y\n1,2"]
    assert [r["length"] for r in tables.objects(spark, str(tmp_path), "*.txt").collect()] == [7]


def test_best_block(spark):
    text = "Ingredients\nnothing\nShare this\nMethod\nno\nIngredients\n1 egg\n2 eggs\nMethod\nMix.\nFry.\nShare this\nx"
    r = segments.best_block(segments.lines_of(spark.createDataFrame([(1, text)], "id int, text string"), "id"), "id").collect()
    assert [(x["block"], x["score"], x["ingredients"], x["method"]) for x in r] == [(2, 22, ["1 egg", "2 eggs"], ["Mix.", "Fry."])]


def test_repaired(spark):
    given = [F.array(F.lit("Dough: flour Filling: cheese"), F.lit("salt"), F.lit("salt"), F.lit("Mix it well.")), F.array(F.lit("Bake."))]
    r = spark.range(1).select(*(c.alias(n) for c, n in zip(segments.repaired(*given), "im"))).first()
    assert (r["i"], r["m"]) == (["Dough: flour", "Filling: cheese", "salt"], ["Bake.", "Mix it well."])


def test_ranked(spark):
    names = ["Zoe", "éa", "Eb", "ea", "e", "EA", "cáfa", "cafb", "CAFZ", "a b", "a-b", "", "zoë"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = df.createOrReplaceTempView("names") or spark.sql("SELECT name, rank() OVER (ORDER BY name COLLATE UNICODE_CI) AS place FROM names")
    got = catalogue.ranked(df, "name", "place")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
