"""Registered queries of the import steps: tests and repairs of lines, records of texts and pages, queues and links.

The tables have none of the vocabulary of recipes, so each row carries one of a few fixed
texts, chosen by its key; the queries still run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import noise
from strataform.functions import text as tx
from strataform.operators import catalogue, inheritance, layout, lines, quality, segments
from strataform.plans import import_flow
from strataform.plans.catalogue_queries import query
from strataform.sources import sinks, tables
from strataform.sources.tables import spread, table
from strataform.streaming import status_log

#: Lines of recipes, pages and scans.
LINES = [
    "1 1/2 cups flour", "2 Ib beef and 3 tsps salt", "%  cup sugar", "Rate now", "12 ratings | rate now", "45 mins", "Prep time: 20 minutes", "Reviews 12", "Nutrition: per serving", "Calories 230 kcal", "Fat 12g", "low",
    "Follow us for more", "Save 2 cup of stock", "\u00a9 2020 Somebody", "@ | @ x", "7", "!", "Ingredients:", "For the dough", "## step 3 - Stir the pot", "Step 4. Pour it out", "3. Bake until brown.", "- [Lemon](http://x.y/z) zest",
    "Boil well [1, 2] and serve [1/2]", "Lamb leg rub", "Green Bean Curry With Rice", "the quick meal of a very long day with no capital", "Salt to taste", "\u2022  two  eggs", "Our complete Pilau Rice, recipe for all", "window.dataLayer = []", "<script>x</script>", "Mix it in",
    "Note: keep it cool", "Dal serves 4", "Red_Lentil-Dal (2).docx", "cr\u00e8me br\u00fbl\u00e9e \u00c5ngstr\u00f6m food", "Bread, milk &amp;amp; tea", "<p onclick=\"go()\">a <b class=\"k\">b</b><a href=\"#recipe-7\">c</a><a href=\"http://q\">d</a></p>",
]


def literal(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def chosen(texts: list[str], key: str) -> Column:
    """One of the texts, by the key."""
    return F.get(F.array(*(F.lit(t) for t in texts)), (F.col(key) % len(texts)).cast("int"))


SAMPLE = f"s AS (SELECT p_partkey, p_name, CASE WHEN (p_partkey // {len(LINES)}) % 2 = 1 THEN x || ' ' || p_name ELSE x END AS line FROM (SELECT p_partkey, p_name, ({literal(LINES)})[1 + p_partkey % {len(LINES)}] AS x FROM part))"


def sample(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    line = chosen(LINES, "p_partkey")
    return part.select("p_partkey", "p_name", F.when(F.floor(F.col("p_partkey") / len(LINES)) % 2 == 1, F.concat(line, F.lit(" "), "p_name")).otherwise(line).alias("line"))


SPACES = r"[ \t\r\n\f\x0b\xa0]+"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def hit(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


Q = squeezed("line")


@query(rf"""WITH {SAMPLE}, q AS (SELECT p_partkey, {Q} AS x FROM s) SELECT p_partkey, x = '' OR {hit('x', *noise.PAGE_NOISE)} AS page, {hit('x', *noise.NUTRITION)} AS nutrition,
  x = '' OR {hit('x', noise.GENERIC)} OR (length(regexp_replace(x, '[^@©®™|]', '', 'g')) >= 2 AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) < 18) OR {hit('x', '[©®™]')} OR ({hit('x', noise.CALLS)} AND NOT {hit('x', noise.SCAN_UNIT)})
    OR (length(regexp_replace(x, '[^A-Za-z]', '', 'g')) < 2 AND length(regexp_replace(x, '[^0-9]', '', 'g')) < 1) AS scan,
  x = '' OR {hit('x', '[©®™]')} OR ({hit('x', noise.CALLS.replace('|ends in', ''))} AND NOT {hit('x', noise.UNIT)}) AS document FROM q""")
def line_noise(spark, d):
    """Noise of pages, of nutrition tables, of scans and of documents."""
    x = F.col("line")
    return sample(spark, d).select("p_partkey", noise.page_noise(x).alias("page"), noise.nutrition_noise(x).alias("nutrition"), noise.scan_garbage(x).alias("scan"), noise.document_garbage(x).alias("document"))


def fractions_sql(x: str) -> str:
    for written, sign in tx.FRACTIONS.items():
        x = f"regexp_replace({x}, '\\b{written.replace('/', ' ?/ ?')}\\b', '{sign}', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?i)\\bIbs\\b', 'lbs', 'g'), '\\bIb\\b', 'lb', 'g')"
    return f"regexp_replace(regexp_replace({x}, '(?i)\\btsps?\\b', 'tsp', 'g'), '(?i)\\btbsps?\\b', 'tbsp', 'g')"


@query(rf"""WITH {SAMPLE} SELECT p_partkey, {squeezed(r"regexp_replace(line, '[\x00-\x1f\x7f\x{fffd}]', ' ', 'g')")} AS controls,
  regexp_replace(regexp_replace(line, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS links,
  {squeezed(r"regexp_replace(line, '^[ \t\xa0]*(#+[ \t]*|[-*\x{2022}\x{25aa}\x{25cf}]+[ \t]*|[0-9]{1,3}[.)][ \t]+)', '')")} AS marker,
  {squeezed(r"regexp_replace(line, '\[[0-9]+([ ]*[,\x{2013}-][ ]*[0-9]+)+\]', '', 'g')")} AS citations, {fractions_sql('line')} AS fractions, regexp_replace(line, '%([ ]*({tx.UNITS})\b)', '½\1', 'g') AS halves,
  {squeezed(rf"regexp_replace({squeezed(rf"regexp_replace({Q}, '(?i)(^| )#{{1,6}} ?step ([0-9]+) ?[:.)-]? ?', ' Step \2: ', 'g')")}, '(?i)^ ?step ([0-9]+) ?[:.)-]? ?', 'Step \1: ')")} AS step FROM s""")
def line_forms(spark, d):
    """Lines without controls, links, marks and citations, with signs for fractions and halves, with steps named alike."""
    x = F.col("line")
    forms = {"controls": tx.without_controls(x), "links": tx.without_links(x), "marker": tx.without_marker(x), "citations": tx.without_citations(x), "fractions": tx.with_fractions(x), "halves": tx.with_halves(x), "step": noise.step_line(x)}
    return sample(spark, d).select("p_partkey", *(v.alias(k) for k, v in forms.items()))


def title_sql(words: int, chars: int) -> str:
    return rf"""length(x) BETWEEN 3 AND {chars} AND len(w) <= {words} AND NOT {hit('x', noise.GENERIC)} AND NOT {hit('x', noise.STEP)} AND ((len(w) >= 2 AND {hit('w[1]', noise.CAPITALISED)} AND NOT {hit('x', '[.!?]$')})
      OR len(list_filter(w, lambda y: {hit('y', noise.CAPITALISED)})) * 100 >= greatest(100, 35 * len(w)))"""


@query(rf"""WITH {SAMPLE}, q AS (SELECT p_partkey, line, {Q} AS x, list_filter(string_split({Q}, ' '), lambda y: y <> '') AS w FROM s),
  b AS (SELECT *, regexp_replace({squeezed(r"regexp_replace(line, '^[ \t\xa0]*(#+[ \t]*|[-*\x{2022}\x{25aa}\x{25cf}]+[ \t]*|[0-9]{1,3}[.)][ \t]+)', '')")}, '{segments.HEADING_END}', '') AS bare FROM q)
  SELECT p_partkey, ({hit('line', '^[0-9]+[.)] ')} OR ({hit('line', '[0-9¼½¾⅓⅔⅛⅜⅝⅞]')} AND {hit('line', noise.UNIT)}) OR {hit('line', noise.AMOUNT)}) AND NOT {hit('line', noise.GENERIC)} AND NOT {hit('line', noise.STEP)} AS ingredient,
  {hit('line', quality.Vocabulary.instruction)} AS instruction, coalesce({title_sql(12, 90)}, false) AS title, coalesce({title_sql(8, 70)}, false) AS short_title,
  CASE WHEN {hit('bare', segments.Headings.ingredients)} THEN 'ingredients' WHEN {hit('bare', segments.Headings.method)} THEN 'method' WHEN {hit('bare', segments.Headings.notes)} THEN 'notes'
    WHEN {hit('bare', segments.Headings.description)} THEN 'description' WHEN {hit('bare', segments.Headings.stop)} THEN 'stop' END AS heading FROM b""")
def line_kinds(spark, d):
    """Lines that look like an ingredient, an instruction, a title, a heading."""
    x = F.col("line")
    kinds = {"ingredient": noise.ingredient_like(x), "instruction": x.rlike(quality.Vocabulary.instruction), "title": noise.title_like(x, 12, 90), "short_title": noise.title_like(x, 8, 70), "heading": segments.Headings().kind(x)}
    return sample(spark, d).select("p_partkey", *(v.alias(k) for k, v in kinds.items()))


@query(rf"""WITH {SAMPLE}, t AS (SELECT p_partkey, line || chr(10) || lag(line, 1, '') OVER (ORDER BY p_partkey) || chr(10) || p_name AS text, line FROM s),
  k AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda y: {squeezed('y')}), lambda y: NOT (y = '' OR {hit('y', *noise.PAGE_NOISE)}) AND NOT {hit('y', noise.SCRIPT_TAG)} AND NOT {hit('y', noise.TRACKER)}) AS kept FROM t)
  SELECT p_partkey, CASE WHEN array_to_string(kept, ' ') <> '' AND length(array_to_string(kept, ' ')) < 60 THEN array_to_string(kept, ' ') END AS description,
  {squeezed(f"regexp_replace(regexp_extract({Q}, '{noise.EMBEDDED}', 2), '[,:;.!?]+$', '')")} AS embedded FROM k""")
def described_texts(spark, d):
    """Descriptions without noise and trackers, if short enough, and titles inside sentences."""
    from pyspark.sql import Window

    rows = sample(spark, d)
    # The line of the row before, by key: the table's keys are consecutive, so that is a join.
    before = rows.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("line").alias("_before"))
    text = F.concat_ws("\n", "line", F.coalesce("_before", F.lit("")), "p_name")
    return rows.join(before, "p_partkey", "left").select("p_partkey", noise.described(text, 60).alias("description"), noise.embedded_title(F.col("line")).alias("embedded"))


@query(rf"""WITH {SAMPLE}, t AS (SELECT p_partkey, p_size, line, list_filter(string_split_regex(regexp_replace(lower(strip_accents(line)), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: length(w) >= 4 AND NOT list_contains({literal(list(noise.COMMON_TERMS))}, w)) AS terms FROM s JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)),
  h AS (SELECT *, len(list_filter(terms, lambda w: contains('small widget curry of rice lentil dal bread', w)))::BIGINT AS hits, 1000 + p_size * 20 AS width, 700 + (p_partkey % 10) * 50 AS height, CASE WHEN p_partkey % 7 = 0 THEN 'application/pdf' ELSE 'image/png' END AS mime FROM t)
  SELECT p_partkey, array_to_string(terms, ' ') AS terms, hits, starts_with(mime, 'image/') AND NOT {hit('line', noise.BLOCKED_TITLE)} AND width >= 1200 AND height >= 800 AND width / height::DOUBLE BETWEEN 1.4 AND 1.8 AND hits > 0 AS suitable FROM h""")
def image_terms(spark, d):
    """Search terms without accents and common words, and the pictures that suit them."""
    terms = noise.search_terms(F.col("line"))
    rows = sample(spark, d).join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").withColumn("_terms", terms)
    hits = F.size(F.filter("_terms", lambda w: F.contains(F.lit("small widget curry of rice lentil dal bread"), w))).cast("long")
    rows = rows.withColumns({"hits": hits, "width": 1000 + F.col("p_size") * 20, "height": 700 + (F.col("p_partkey") % 10) * 50, "mime": F.when(F.col("p_partkey") % 7 == 0, "application/pdf").otherwise("image/png")})
    return rows.select("p_partkey", F.array_join("_terms", " ").alias("terms"), "hits", noise.suitable_image(F.col("line"), F.col("mime"), F.col("width"), F.col("height"), F.col("hits")).alias("suitable"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ' HTTP://x.y/' || user_id || ' ' END AS url, event_type AS name, user_id % 5 AS size, user_id % 2 AS modified FROM events),
  k AS (SELECT event_id, CASE WHEN url IS NOT NULL THEN 'url|' || lower(trim(url)) ELSE 'file|' || lower(trim(name)) || '|' || size || '|' || modified END AS key FROM e) SELECT key, min(event_id) AS event_id, count(*) - 1 AS duplicates FROM k GROUP BY 1""")
def queue_duplicates(spark, d):
    """C17: queued items by address, else by name, size and time of change: the first of each, and how often it comes again."""
    url = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" HTTP://x.y/"), "user_id", F.lit(" ")))
    key = noise.queue_key(url, F.col("event_type"), F.col("user_id") % 5, F.col("user_id") % 2)
    return table(spark, d, "events").groupBy(key.alias("key")).agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("duplicates"))


@query("""WITH p AS (SELECT p_partkey, unnest([p_partkey % 40, p_partkey % 7]) AS id FROM part) SELECT DISTINCT p_partkey, s_suppkey, s_name FROM p JOIN supplier ON s_suppkey = id""")
def record_links(spark, d):
    """The records that a text's links of the form #recipe-N lead to."""
    html = F.concat(F.lit('<p><a href="#recipe-'), F.col("p_partkey") % 40, F.lit('">x</a> <a href="#recipe-'), F.col("p_partkey") % 7, F.lit('">y</a> <a href="#other-1">z</a></p>'))
    ids = F.array_distinct(F.regexp_extract_all(html, F.lit('href="#recipe-([0-9]+)"'), F.lit(1)))
    links = table(spark, d, "part").select("p_partkey", F.explode(ids).alias("id")).select("p_partkey", F.col("id").cast("long").alias("s_suppkey"))
    return links.join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("p_partkey", "s_suppkey", "s_name")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) - 1 AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), h AS (SELECT l_orderkey, max(l_quantity) FILTER (r = n // 2) AS med FROM m GROUP BY 1),
  c AS (SELECT l.l_orderkey, l_linenumber, l_quantity, l_quantity >= med * 1.22 AS tall FROM lineitem l JOIN h USING (l_orderkey))
  SELECT l_orderkey, l_linenumber, l_quantity AS height FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY tall DESC, l_quantity DESC, l_linenumber) = 1""")
def tallest_titles(spark, d):
    """Of a page's lines the tallest, then the topmost; an order is a page, its items are lines."""
    page = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("y0"), F.col("l_quantity").alias("height"))
    return layout.tallest(page, "l_orderkey").select("l_orderkey", F.col("y0").alias("l_linenumber"), "height")


@query(rf"""WITH {SAMPLE} SELECT p_partkey, CASE {' '.join(f"WHEN {hit('lower(line)', p)} THEN '{name}'" for p, name in noise.CATEGORIES)} ELSE 'other' END AS category FROM s""")
def picture_categories(spark, d):
    """The category of the first of eight rules whose words occur."""
    return sample(spark, d).select("p_partkey", tx.category(F.col("line"), list(noise.CATEGORIES), "other").alias("category"))


@query(rf"""WITH {SAMPLE} SELECT p_partkey, {squeezed(r"regexp_replace(regexp_replace(regexp_replace(line, '\.[A-Za-z0-9]{1,5}$', ''), '\([0-9]+\)', ' ', 'g'), '[_-]+', ' ', 'g')")} AS file_title,
  CASE WHEN regexp_matches(line, '(?i)^(.*[^ ])[ ]+((?:serves|makes|yields?)[ ]+[0-9].*)$') THEN regexp_extract(line, '(?i)^(.*[^ ])[ ]+((?:serves|makes|yields?)[ ]+[0-9].*)$', 1) ELSE line END AS title,
  regexp_extract(line, '(?i)^(.*[^ ])[ ]+((?:serves|makes|yields?)[ ]+[0-9].*)$', 2) AS servings, coalesce(nullif({squeezed("CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE line END")}, ''), p_name) AS filled,
  replace(replace(line, '&amp;', '&'), '&amp;', '&') AS unescaped,
  round(length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) / greatest(1, length(line)) + CASE WHEN len(list_filter(string_split_regex(line, '{SPACES}'), lambda w: w <> '')) BETWEEN 2 AND 9 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(line, '^\p{{Lu}}') THEN 0.05 ELSE 0 END, 6) AS title_quality,
  regexp_replace(regexp_replace(regexp_replace(line, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?i) on[a-z]+[ ]*=[ ]*("[^"]*"|''[^'']*''|[^ >]+)', '', 'g'), '(?i)javascript:', '', 'g') AS safe FROM s""")
def scalar_forms(spark, d):
    """Titles of files, servings in titles, first filled values, entities read twice, a title's quality, markup without handlers."""
    x = F.col("line")
    title, servings = tx.title_and_yield(x)
    filled = tx.first_filled(F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(x), F.col("p_name"))
    out = {"file_title": tx.file_title(x), "title": title, "servings": servings, "filled": filled, "unescaped": tx.unescaped_twice(x), "title_quality": F.round(import_flow.title_quality(x), 6), "safe": tx.safe_html(x)}
    return sample(spark, d).select("p_partkey", *(v.alias(k) for k, v in out.items()))


#: Texts of recipes with the record of each: title, description, ingredients, method, notes.
RECIPES = [
    ("%\nSlow and mild\nIngredients:\n- 500 g lamb\ncoconut2 cloves\n- 500 g lamb\nMethod\n1. Soak the lamb\nin water.\n2. Boil. Note: keep the stock\nNotes\nRest it.", ("%", "Slow and mild", ["500 g lamb", "coconut", "2 cloves"], ["Soak the lamb in water.", "Boil."], ["Rest it.", "keep the stock"])),
    ("%\nWhat you need\n2 eggs [1, 2]\nsalt\nDirections:\nBeat the eggs.\nFry.\nTips: eat warm\nNutrition facts\nFat 12g", ("%", "", ["2 eggs", "salt"], ["Beat the eggs.", "Fry."], ["eat warm"])),
    ("%\nDescription: For cold days\nIngredients\n1 onion\nInstructions\nChop the onion.\nComments\nnice", ("%", "For cold days", ["1 onion"], ["Chop the onion."], [])),
]


def fields(k: int) -> str:
    """DuckDB: the texts of one field of the expected records."""
    texts = [x[1][k] if isinstance(x[1][k], str) else "|".join(x[1][k]) for x in RECIPES]
    return f"replace(({literal(texts)})[1 + c_custkey % {len(RECIPES)}], '%', c_name)"


def recipe_text(texts: list[str]) -> Column:
    return F.replace(chosen(texts, "c_custkey"), F.lit("%"), F.col("c_name"))


@query(f"SELECT c_custkey, {fields(0)} AS title, {fields(1)} AS description, {fields(2)} AS ingredients, {fields(3)} AS method, {fields(4)} AS notes FROM customer")
def labelled_records(spark, d):
    """Texts with headings as records."""
    rows = spread(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", recipe_text([t for t, _ in RECIPES]).alias("text"))
    found = segments.records(segments.lines_of(rows, "c_custkey"), "c_custkey")
    return found.select("c_custkey", "title", "description", *(F.array_join(c, "|").alias(c) for c in ("ingredients", "method", "notes")))


#: Lines as scans have them, with their ingredients and method.
NUMBERED = [
    ("2 eggs\nINGREDIENTS\n1 cup milk\n1. Beat the eggs\nthen rest\n@ | @\nMethod\nFry.", "2 eggs|1 cup milk", "1. Beat the eggs|then rest|Fry."),
    ("%\nstep 2 Stir\nIngredients\nsalt\nsalt\nNotes\n1. none", "%|salt|1. none", "step 2 Stir"),
]


@query(f"SELECT c_custkey, replace(({literal([b for _, b, _ in NUMBERED])})[1 + c_custkey % 2], '%', c_name) AS ingredients, replace(({literal([c for _, _, c in NUMBERED])})[1 + c_custkey % 2], '%', c_name) AS method FROM customer")
def numbered_records(spark, d):
    """A numbered line belongs to the method whatever is above it."""
    found = segments.numbered_record(recipe_text([a for a, _, _ in NUMBERED]))
    return spread(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", found.alias("r")).select("c_custkey", F.array_join("r.ingredients", "|").alias("ingredients"), F.array_join("r.method", "|").alias("method"))


#: Texts of several records, with each one's title and numbers of lines.
SEVERAL = [
    ("Book\n1. Red Dal\nIngredients\nlentils\nsalt\nMethod\nBoil.\n2. Green Dal\nIngredients\npeas\nMethod\nFry.\nServe.", [("Red Dal", 2, 1), ("Green Dal", 1, 2)]),
    ("1. Plain Rice\nIngredients\nrice\nMethod\nCook.", []),
    ("1. Tea\nIngredients\nleaves\nMethod\nBrew.\n2. Tea Cake\nIngredients\nflour\nMethod\nBake.\n3. Toast\nIngredients\nbread\nMethod\nToast.", [("Tea", 1, 1), ("Tea Cake", 1, 1), ("Toast", 1, 1)]),
]


@query("SELECT c_custkey, r.record::BIGINT AS record, r.title AS title, r.i::INT AS ingredients, r.m::INT AS method FROM (SELECT c_custkey, unnest(CASE c_custkey % 3 " + " ".join(f"WHEN {k} THEN [" + ", ".join(f"{{'record': {j}, 'title': '{t}', 'i': {i}, 'm': {m}}}" for j, (t, i, m) in enumerate(found, 1)) + "]" for k, (_, found) in enumerate(SEVERAL) if found) + " ELSE [] END) AS r FROM customer)")
def several_records(spark, d):
    """Texts parted at numbered titles with ingredients below; only those that give two records or more."""
    rows = spread(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", recipe_text([t for t, _ in SEVERAL]).alias("text"))
    found = segments.separated(segments.lines_of(rows, "c_custkey"), "c_custkey", lambda line: line.rlike("^[0-9]{1,2}[.)] "))
    return found.select("c_custkey", "record", "title", F.size("ingredients").alias("ingredients"), F.size("method").alias("method"))


#: Pages as sites write them, with the parser that reads each, its title, ingredients and method.
SITES = [
    ('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"main":{"@type":"Recipe","name":"%","recipeIngredient":["1 egg","salt"],"recipeInstructions":[{"text":"Beat."},{"text":"Fry."}]}}]}</script><h1>No</h1>', ("linked_data", "%", "1 egg|salt", "Beat.|Fry.")),
    ('<div class="wprm-recipe-name">%</div><ul><li class="a wprm-recipe-ingredient">2 <b>eggs</b></li><li class="wprm-recipe-ingredient">Fat 12g</li><li class="wprm-recipe-ingredient b">milk</li></ul><div class="wprm-recipe-instruction">step 1: Mix</div>', ("plugin", "%", "2 eggs|milk", "Step 1: Mix")),
    ("<h1>%</h1><h2>Method</h2><p>not this</p><h2>Ingredients:</h2><ul><li>rice<li>peas</ul><h3>Directions</h3><p>Cook.</p><p>Serve.</p>", ("headings", "%", "rice|peas", "Cook.|Serve.")),
    ("<p>%</p><p>Ingredients</p><p>tea</p><p>Method</p><p>Brew.</p>", ("labelled", "%", "tea", "Brew.")),
    ("<h1>%</h1><p>Nothing to cook</p>", (None, None, None, None)),
]


def site(k: int) -> str:
    return "CASE page_id % 5 " + " ".join(f"WHEN {j} THEN replace('{x[1][k]}', '%', 'P' || page_id)" for j, x in enumerate(SITES) if x[1][k]) + " END"


@query(f"SELECT page_id, {site(0)} AS parser, {site(1)} AS title, {site(2)} AS ingredients, {site(3)} AS method FROM pages")
def page_parsers(spark, d):
    """The record of the first parser that has one, in order."""
    html = F.replace(F.get(F.array(*(F.lit(x) for x, _ in SITES)), (F.col("page_id") % 5).cast("int")), F.lit("%"), F.concat(F.lit("P"), "page_id"))
    found = segments.page_records(spread(table(spark, d, "pages").select("page_id"), "page_id").select("page_id", html.alias("html")), "page_id")
    return found.select("page_id", "parser", F.col("record.name").alias("title"), F.array_join("record.ingredients", "|").alias("ingredients"), F.array_join("record.method", "|").alias("method"))


#: Texts with several blocks, and the best one's number, score and sizes.
BLOCKS = [
    ("Ingredients\nnothing\nShare this\nMethod\nno\nIngredients\n1 egg\n2 eggs\nMethod\nMix.\nFry.\nShare this\nx", (2, 22, 2, 2)),
    ("Ingredients\n1 cup rice\nMethod\nCook the rice.\nIngredients\nsalt\nMethod\nStop.", (1, 11, 1, 1)),
]


@query(f"SELECT c_custkey, " + ", ".join(f"(CASE c_custkey % 2 WHEN 0 THEN {BLOCKS[0][1][k]} ELSE {BLOCKS[1][1][k]} END)::{t} AS {n}" for k, (n, t) in enumerate((("block", "BIGINT"), ("score", "INT"), ("ingredients", "INT"), ("method", "INT")))) + " FROM customer")
def best_blocks(spark, d):
    """Of several blocks with ingredients and a method the one with the most points."""
    rows = spread(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", recipe_text([t for t, _ in BLOCKS]).alias("text"))
    found = segments.best_of(segments.line_arrays(rows, "c_custkey"), "c_custkey")
    return found.select("c_custkey", "block", "score", F.size("ingredients").alias("ingredients"), F.size("method").alias("method"))


@query("""SELECT c_custkey, 'Dough: flour' || '|' || 'Filling: ' || c_name || '|salt' AS ingredients, 'Bake.|Mix it well.' AS method FROM customer""")
def repaired_sections(spark, d):
    """Labels on one line parted, instructions among ingredients moved, repeats dropped."""
    ingredients, method = segments.repaired(F.array(F.concat(F.lit("Dough: flour Filling: "), F.col("c_name")), F.lit("salt"), F.lit("salt"), F.lit("Mix it well.")), F.array(F.lit("Bake.")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(ingredients, "|").alias("ingredients"), F.array_join(method, "|").alias("method"))


@query("""WITH n AS (SELECT conv_id, turn, turn // 2 AS number, length(text) AS size, lead(turn // 2) OVER w AS next_number, lead(length(text)) OVER w AS next_size FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn FROM n WHERE NOT coalesce(number = next_number AND size < next_size, false)""")
def shorter_repeats(spark, d):
    """F8: no row that is followed by a longer one of the same number."""
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("line"))
    return lines.without_shorter_repeat(rows, "conv_id", F.floor(F.col("pos") / 2)).select("conv_id", F.col("pos").alias("turn"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber AS ord, l_linenumber % 2 * 300.0 AS x, l_linenumber * 30.0 AS y, l_linenumber <= 2 AS title FROM lineitem),
  p AS (SELECT a.l_orderkey, a.ord, b.ord AS title_ord, abs(a.x - b.x) + 0.55 * (a.y - b.y) AS cost FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND NOT a.title AND b.title AND a.y >= b.y AND a.y - b.y < 480),
  f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey, ord ORDER BY cost, title_ord) = 1), n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, title_ord) AS n FROM f) SELECT l_orderkey, ord, title_ord FROM n WHERE n >= 2""")
def lines_under_titles(spark, d):
    """Each line under the nearest title above it; titles with two lines or more."""
    number = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select("l_orderkey", number.cast("int").alias("ord"), F.concat(F.lit("w"), number).alias("text"), (number % 2 * 300).cast("double").alias("x0"), (number % 2 * 300).cast("double").alias("x1"), (number * 30).cast("double").alias("y0"))
    return layout.under_titles(rows.where("ord > 2"), rows.where("ord <= 2"), "l_orderkey").select("l_orderkey", "ord", "title_ord")


#: Ingredients as they are stored.
STORED = ['["1 egg", " salt "]', '[{"quantity":"2","unit":"cups","name":"%"},{"quantity":"","unit":"","name":"tea"}]', '{"html":"<p>a <b>%</b></p><p>c</p>"}', "x\n\n%"]


@query(f"SELECT c_custkey, replace(({literal(['1 egg|salt', '2 cups %|tea', 'a %|c', 'x|%'])})[1 + c_custkey % 4], '%', c_name) AS ingredients FROM customer")
def stored_ingredients(spark, d):
    """Ingredients in any of their stored forms as lines."""
    return table(spark, d, "customer").select("c_custkey", F.array_join(tables.plain_ingredients(recipe_text(STORED)), "|").alias("ingredients"))


#: Stored payloads.
PAYLOADS = ['{"multiple":true,"recipes":[{"name":"%"}]}', '{"multiple":true,"recipes":{}}', '{"recipe":{"name":" % ","recipeYield":"4"}}', '{"name":"","servings":2}', "plain"]


@query(f"SELECT c_custkey, c_custkey % 5 = 0 AS many, CASE c_custkey % 5 WHEN 2 THEN c_name END AS name, CASE c_custkey % 5 WHEN 2 THEN '4' WHEN 3 THEN '2' END AS servings FROM customer")
def stored_payloads(spark, d):
    """Whether a payload holds several records, and the fields of the one it holds."""
    payload = recipe_text(PAYLOADS)
    return table(spark, d, "customer").select("c_custkey", tables.holds_many(payload).alias("many"), tables.payload_field(payload, "name").alias("name"), tables.payload_field(payload, *tables.ALIASES["servings"]).alias("servings"))


@query(rf"""WITH t AS (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN ' Please solve the CAPTCHA' WHEN 1 THEN ' Method: captcha' WHEN 2 THEN ' recipeIngredient' ELSE '' END AS x FROM pages),
  b AS (SELECT *, {squeezed('x')} = '' OR ({hit('x', noise.BLOCKED_SIGNAL)} AND NOT {hit('x', noise.RECIPE_WORD)}) AS blocked FROM t)
  SELECT page_id, blocked, NOT blocked AND ((length(x) >= 250 AND {hit('x', noise.HEADING_SIGNAL)}) OR {hit('x', noise.STRUCTURED_SIGNAL)}) AS signals FROM b""")
def page_signals(spark, d):
    """Pages that show a check or a refusal, and pages with signs of a recipe."""
    tail = F.get(F.array(*(F.lit(x) for x in (" Please solve the CAPTCHA", " Method: captcha", " recipeIngredient", ""))), (F.col("page_id") % 4).cast("int"))
    x = F.concat("html", tail)
    return table(spark, d, "pages").select("page_id", noise.blocked_page(x).alias("blocked"), noise.recipe_signals(x).alias("signals"))


@query("""SELECT n_nationkey, n_nationkey % 5 AS pos, CASE WHEN n_nationkey % 5 IN (0, 4) THEN 'own' ELSE 'N' || (n_nationkey - n_nationkey % 5) END AS ingredients FROM nation""")
def inherited_records(spark, d):
    """Records that say "same dough" have the ingredients of the record before them, however many do."""
    key, pos = F.col("n_nationkey"), F.col("n_nationkey") % 5
    own = F.when(pos == 0, F.array(F.concat(F.lit("N"), key))).when(pos == 4, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "nation").select(F.floor(key / 5).alias("book"), key.alias("pos"), F.concat(F.lit("Bread "), key).alias("name"), own.alias("ingredients"), F.array(F.lit("Same dough, baked.")).alias("method"))
    found = inheritance.inherited(rows, "book")
    return found.select(F.col("pos").alias("n_nationkey"), (F.col("pos") % 5).alias("pos"), F.when(F.col("pos") % 5 == 0, "own").otherwise(F.get("ingredients", F.lit(0))).alias("ingredients"))


@query(r"""SELECT doc_id, len(string_split_regex(text, '[.!?][ \n]+'))::BIGINT AS n_split, CASE WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'doc ' || doc_id || ' (Chinese)' ELSE 'doc ' || doc_id END AS title FROM documents WHERE text IS NOT NULL""")
def file_named_titles(spark, d):
    """Titles from file names where a text's own is no good, and how often a text ends a sentence."""
    name = F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf"))
    n = F.size(F.split("text", "[.!?][ \n]+")).cast("long")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", n.alias("n_split"), import_flow.title_for(F.lit("1"), F.col("text"), name).alias("title"))


@query("""SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND p_size >= 10 AND p_name LIKE '%widget%' ORDER BY p_partkey DESC LIMIT 5""")
def query_string(spark, d):
    """A10: a filter, an order and a limit from a query string."""
    return catalogue.from_query_string(table(spark, d, "part"), "select=p_partkey,p_name&p_type=eq.ECONOMY&p_size=gte.10&p_name=like.*widget*&order=p_partkey.desc&limit=5", {"p_partkey", "p_name", "p_type", "p_size"})


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'F'""")
def readable_rows(spark, d):
    """The rows that a viewer may read: their own, and those that are published."""
    rows = table(spark, d, "orders")
    return rows.where(catalogue.readable(F.lit(7), F.lit("member"), F.col("o_custkey"), F.col("o_orderstatus") == "F")).select("o_orderkey", "o_custkey")


@query("""WITH n AS (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 50) SELECT c_custkey FROM n WHERE c_custkey % 5 = 0 AND contains(lower(c_name), '0')""")
def newest_with_name(spark, d):
    """Of the newest fifty payloads those that hold a record of some name."""
    newest = table(spark, d, "customer").select("c_custkey", "c_name").orderBy(F.desc("c_custkey")).limit(50)
    names = F.from_json(F.get_json_object(recipe_text(PAYLOADS), "$.recipes"), "array<struct<name:string>>")
    return newest.where(F.coalesce(F.exists(names, lambda r: F.contains(F.lower(F.trim(r["name"])), F.lit("0"))), F.lit(False))).select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')""")
def childless_parents(spark, d):
    """Parents that are left without a child."""
    children = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
    return sinks.orphans(table(spark, d, "customer"), children, "c_custkey", "o_custkey").select("c_custkey")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'stored' ELSE 'read' END AS source, CASE WHEN doc_id % 4 = 0 THEN 'kept ' || doc_id ELSE source END AS value FROM documents""")
def reused_texts(spark, d):
    """A stored text is taken again if it was made with the same profile; others are read anew."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    stored = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("kept "), "doc_id").alias("text"), F.when(F.col("doc_id") % 4 == 0, "v2").otherwise("v1").alias("profile"))
    return sinks.reused(docs, stored, "doc_id", "v2", F.col("source")).select("doc_id", F.when(F.col("reused"), "stored").otherwise("read").alias("source"), "value")


@query("""SELECT doc_id, length(substring(text, 1, 8000))::BIGINT AS chars, least(80, len(list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n\\f\\x0b\\xa0]+', ' ', 'g')) <> '')))::BIGINT AS n_lines FROM documents WHERE text IS NOT NULL""")
def capped_texts(spark, d):
    """At most 8000 characters and 80 lines of each text."""
    kept = F.slice(lines.line_array(F.col("text")), 1, 80)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length(F.substring("text", 1, 8000)).cast("long").alias("chars"), F.size(kept).cast("long").alias("n_lines"))


@query("""SELECT date_trunc('day', ts)::DATE AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def status_by_day(spark, d):
    """The status log counted by day and kind; the same plan runs over a stream."""
    counts = status_log.status_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), late=None)
    return counts.withColumn("start", F.to_date("start"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \t\xa0]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{SPACES}|{SPACES}$', '', 'g') AS text FROM documents""")
def cleaned_texts(spark, d):
    """Texts without carriage returns, with blanks collapsed and at most two line ends together."""
    return table(spark, d, "documents").select("doc_id", tx.cleaned(F.col("text")).alias("text"))
