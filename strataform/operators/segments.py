"""From lines to records: headings, sections, parser cascade, notes, multi-record documents.

Vocabularies are parameters; the defaults are those of recipes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.markup import folded, marked, texts_with
from strataform.functions.nested import containers
from strataform.functions.noise import nutrition_noise, page_noise, scan_garbage, step_line
from strataform.functions.text import html_text, let, squeezed, without_citations, without_marker
from strataform.operators.lines import along, carried, exploded, line_array


#: What a heading line may end with.
HEADING_END = r"(?: ?\([^()]*\))?[ :,\x{2013}\x{2014}-]*$"


@dataclass(frozen=True)
class Headings:
    """Patterns of heading lines (fixed values), for a line without its marks, closing colon or dash; what follows in brackets doesn't count."""

    ingredients: str = r"(?i)^(?:(?:the |general )?ingredients?(?: (?:list|profile|section|needed|required))?|shopping list|you will need|what you need|साहित्य)$"
    method: str = (
        r"(?i)^(?:(?:the )?(?:method|instructions?|directions?|preparations?|steps?|stages?)|procedure|how to make|(?:cooking|recipe|preparation) (?:steps|method|instructions)"
        r"|step[- ]by[- ]step(?: [a-z0-9&/ -]+)?|(?:[a-z0-9&/ -]+ )?(?:cooking|pressure cooker) instructions?|प्रक्रिया)$"
    )
    notes: str = r"(?i)^(?:the )?(?:notes?|tips?|storage|serving suggestions?|chef.s tips?)$"
    description: str = r"(?i)^(?:description|about|introduction)$"
    stop: str = r"(?i)^(?:nutrition.*|special equipment|make[- ]?ahead(?: and storage)?|video|comments?|reviews?.*|share.*|subscribe.*|related.*|more ideas|most helpful.*|featured tweaks.*)$"

    def kind(self, line: Column) -> Column:
        def named(bare: Column) -> Column:
            out = None
            for name in ("ingredients", "method", "notes", "description", "stop"):
                hit = bare.rlike(getattr(self, name))
                out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
            return out

        return let(F.regexp_replace(without_marker(line), HEADING_END, ""), named)


def labelled(lines: DataFrame, key: str, headings: Headings = Headings()) -> DataFrame:
    """Lines with their section. A heading opens one; "Heading: text" opens one and leaves its text as a line.

    Lines before the first heading are in the section "head"; heading lines go.
    """
    inline = r"^([^:]{2,30}):[ ]*(.+)$"
    label = F.regexp_extract("line", inline, 1)
    rows = lines.withColumn("_whole", headings.kind(F.col("line"))).withColumn("_inline", F.when(F.col("line").rlike(inline), headings.kind(label)))
    rows = carried(rows, key, F.coalesce("_whole", "_inline"), "section").withColumn("section", F.coalesce("section", F.lit("head")))
    text = F.when(F.col("_inline").isNotNull() & F.col("_whole").isNull(), F.regexp_extract("line", inline, 2)).otherwise(F.col("line"))
    return rows.withColumn("line", text).where("_whole IS NULL").drop("_whole", "_inline")


def split_notes(method: Column) -> list[Column]:
    """[method, notes]: a method line's "Note: ..." or "Tip: ..." moves to the notes."""
    pattern = r"(?i)^(.*?)[ ]*\b(?:notes?|tips?):[ ]*(.+)$"
    kept = F.transform(method, lambda x: F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(x))
    notes = F.transform(F.filter(method, lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, pattern, 2))
    return [F.filter(kept, lambda x: x != ""), notes]


def numbered_steps(lines: Column) -> Column:
    """Steps of numbered lines: a number opens one, other lines go on with it; unnumbered lines stay as they are."""
    starts = r"^[0-9]{1,3}[.)][ ]*"
    joined = F.aggregate(
        lines,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.rlike(starts) | (F.size(acc) == 0), F.array_append(acc, F.regexp_replace(x, starts, ""))).otherwise(
            F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.concat_ws(" ", F.element_at(acc, -1), x))
        ),
    )
    return F.when(F.exists(lines, lambda x: x.rlike(starts)), joined).otherwise(lines)


#: Words that, without a space, follow an ingredient in stored text (fixed values).
ATTACHED = "cloves?|cups?|tsp|tbsp|teaspoons?|tablespoons?|grams?|g|kg|ml|inch|pinch"


def split_quantity(line: Column) -> Column:
    """"coconut2 cloves" as two lines; other lines as they are."""
    pattern = rf"(?i)^(.*\p{{L}})([0-9]+(?:[/.][0-9]+)?[ ]*(?:{ATTACHED})\b.*)$"
    return F.when(line.rlike(pattern), F.array(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2))).otherwise(F.array(line))


def records(lines: DataFrame, key: str, headings: Headings = Headings(), most_ingredients: int = 200) -> DataFrame:
    """(key, title, description, ingredients, method, notes) of each document of lines.

    The title is the first line before a heading, the description what follows it there
    or under its own heading. Lists are distinct, in order.
    """
    rows = labelled(lines, key, headings)
    of = lambda name: F.array_sort(F.filter(F.collect_list(F.when(F.col("section") == name, F.struct("pos", "line"))), lambda x: x.isNotNull()))["line"]
    out = rows.groupBy(key).agg(*(of(s).alias(s) for s in ("head", "description", "ingredients", "method", "notes")))
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: without_citations(without_marker(x))), lambda x: x != ""))
    ingredients = F.slice(clean(F.flatten(F.transform("ingredients", split_quantity))), 1, most_ingredients)
    method, moved = split_notes(clean(numbered_steps(F.col("method"))))
    notes = clean(F.concat("notes", moved))
    described = F.array_join(clean(F.concat("description", F.slice("head", F.lit(2), F.greatest(F.size("head") - 1, F.lit(0))))), " ")
    out = out.select(key, without_marker(F.get("head", F.lit(0))).alias("title"), described.alias("description"), ingredients.alias("ingredients"), method.alias("method"), notes.alias("notes"))
    return out.withColumn("method", F.filter("method", lambda x: ~F.exists("notes", lambda n: F.lower(n) == F.lower(x))))


def cascade(df: DataFrame, key: str, parsers: list[tuple[str, Column, Column]]) -> DataFrame:
    """The record of the first parser, in order, that has one, and that parser's name; a parser is (name, record, accepts)."""
    found = F.coalesce(*(F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("parser"), record.alias("record"))) for name, record, ok in parsers))
    return df.select(key, found.alias("found")).select(key, "found.parser", "found.record")


def html_lists(html: DataFrame, key: str, column: str = "html") -> DataFrame:
    """(key, pos, item): the text of each list item; an item ends at the next one if it isn't closed."""
    items = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<li[^>]*>(.*?)(?=</li>|<li[ >]|</[uo]l>|$)"), F.lit(1))
    rows = html.select(key, F.posexplode(items).alias("pos", "item"))
    return rows.withColumn("item", squeezed(html_text(F.col("item")))).where("item <> ''")


def html_sections(html: DataFrame, key: str, column: str = "html", tag: str = "h[1-6]", read=lambda markup: squeezed(html_text(markup))) -> DataFrame:
    """(key, pos, heading, body): each heading of a page, its markup read as text, and the text up to the next one."""
    marked = F.regexp_replace(F.col(column), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", "\u0001$1\u0002")
    rows = html.select(key, F.posexplode(F.split(marked, "\u0001")).alias("pos", "part")).where("pos > 0")
    heading, body = F.substring_index("part", "\u0002", 1), F.substring_index("part", "\u0002", -1)
    return rows.select(key, "pos", read(heading).alias("heading"), html_text(body).alias("body"))


RECORD = "struct<name:string,description:string,ingredients:array<string>,method:array<string>,notes:array<string>,servings:string>"


def record(name: Column, ingredients: Column, method: Column, description: Column | None = None, notes: Column | None = None, servings: Column | None = None) -> Column:
    none = F.lit(None)
    fields = {"name": name, "description": none if description is None else description, "ingredients": ingredients, "method": method, "notes": F.array() if notes is None else notes, "servings": none if servings is None else servings}
    return F.struct(*(v.alias(k) for k, v in fields.items())).cast(RECORD)


def linked_nodes(html: Column) -> Column:
    """The objects and arrays in a page's linked-data scripts as JSON, of any depth, outer ones before what they hold."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    told = F.filter(scripts, lambda x: x.rlike("(?i)recipeIngredient|recipeInstructions"))
    return containers(F.transform(told, lambda x: F.replace(F.trim(x), F.lit("&quot;"), F.lit('"'))))


def linked_record(html: Column) -> Column:
    """The record of the first linked-data object with ingredients and instructions, however deep it lies; null without one.

    A step is a text, or an object's text or name.
    """
    listed = lambda x, field: F.from_json(F.get_json_object(x, f"$.{field}"), "array<string>")
    good = F.filter(linked_nodes(html), lambda x: x.startswith("{") & (F.size(listed(x, "recipeIngredient")) > 0) & F.get_json_object(x, "$.recipeInstructions").isNotNull())
    step = lambda x: F.when(x.startswith("{"), F.coalesce(F.nullif(F.get_json_object(x, "$.text"), F.lit("")), F.get_json_object(x, "$.name"))).otherwise(x)

    def made(x: Column) -> Column:
        told = F.get_json_object(x, "$.recipeInstructions")
        method = F.when(told.startswith("["), F.filter(F.transform(listed(x, "recipeInstructions"), step), lambda y: F.coalesce(y, F.lit("")) != "")).otherwise(F.split(told, "\n"))
        return record(F.get_json_object(x, "$.name"), listed(x, "recipeIngredient"), method)

    return let(F.get(good, F.lit(0)), lambda x: F.when(x.isNotNull(), made(x)))


#: Names that a plug-in puts where a page gives none.
PLACEHOLDER = r"(?i)^#?(wprm[- ]recipe[- ]container|recipe container)\b"


def page_title(html: Column) -> Column:
    """The text of a page's first heading, else of its title; null without either."""
    of = lambda tag: F.nullif(squeezed(html_text(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))), F.lit(""))
    return F.coalesce(of("h1"), of("title"))


def plugin_record(html: Column, prefix: str = "wprm-recipe-") -> Column:
    """The record of a recipe plug-in's markup, by class; null with fewer than two ingredients or without a step.

    Elements keep their extent however they are nested. Without a name of its own, or
    with a placeholder for one, it has the page's title. Servings are the first that hold a digit.
    """
    first = lambda a: F.get(a, F.lit(0))
    clean = lambda a, noisy: F.filter(a, lambda x: ~noisy(x) & (F.length(x) > 1))

    def made(found: Column) -> Column:
        field = lambda name: texts_with(found, prefix + name)
        name = F.coalesce(first(F.filter(field("name"), lambda x: ~x.rlike(PLACEHOLDER))), page_title(html))
        summary = F.nullif(F.array_join(field("summary"), "\n"), F.lit(""))
        return record(name, F.slice(clean(field("ingredient"), nutrition_noise), 1, 200), F.transform(clean(field("instruction"), page_noise), step_line), summary, field("notes"), first(F.filter(field("servings"), lambda x: x.rlike("[0-9]"))))

    whole = let(let(let(folded(html), lambda parts: marked(parts, prefix)), made), lambda r: F.when((F.size(r["ingredients"]) >= 2) & (F.size(r["method"]) >= 1) & r["name"].isNotNull(), r))
    return F.when(F.coalesce(html.contains(f"{prefix}ingredient") & html.contains(f"{prefix}instruction"), F.lit(False)), whole)


def heading_record(html: Column, headings: Headings = Headings()) -> Column:
    """The record under a page's first ingredients heading and the first method heading below it: list items, else lines."""
    marked = F.regexp_replace(html, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", "\u0001$1\u0002")
    parts = F.transform(F.split(marked, "\u0001"), lambda x, i: F.struct(i.alias("pos"), squeezed(html_text(F.substring_index(x, "\u0002", 1))).alias("heading"), F.substring_index(x, "\u0002", -1).alias("body")))
    of = lambda parts, kind, after: F.get(F.filter(parts, lambda x: (x["pos"] > after) & (headings.kind(x["heading"]) == kind)), F.lit(0))
    lines = lambda text: F.filter(F.transform(F.split(html_text(text), "\n"), squeezed), lambda x: x != "")
    item = F.lit(r"(?is)<li[^>]*>(.*?)(?=</li>|<li[ >]|</[uo]l>|$)")
    items = lambda body: let(F.regexp_extract_all(body, item, F.lit(1)), lambda x: F.when(F.size(x) > 0, F.filter(F.transform(x, lambda y: squeezed(html_text(y))), lambda y: y != "")).otherwise(lines(body)))
    title = F.nullif(squeezed(html_text(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1))), F.lit(""))

    def made(parts: Column) -> Column:
        return let(of(parts, "ingredients", F.lit(0)), lambda a: let(of(parts, "method", a["pos"]), lambda b: F.when(a.isNotNull() & b.isNotNull(), record(title, items(a["body"]), items(b["body"])))))

    return let(parts, made)


def numbered_record(text: Column, headings: Headings = Headings()) -> Column:
    """The record of a text in which a numbered line, or one with a step's number, belongs to the method whatever heading is above it.

    Lines before the first heading are ingredients; noise goes; lists are distinct.
    """
    every = F.filter(F.transform(F.split(text, "\n"), squeezed), lambda x: x != "")

    told = lambda x, kind: F.struct(x.alias("line"), kind.alias("kind"), x.rlike(r"(?i)^([0-9]{1,2}[.)]|step ?[0-9]+)").alias("numbered"), F.when(kind.isNull(), ~scan_garbage(x)).otherwise(F.lit(False)).alias("stays"))
    every = F.transform(every, lambda x: let(headings.kind(x), lambda kind: told(x, kind)))

    def step(acc: Column, x: Column) -> Column:
        def grown(section: Column) -> Column:
            put = lambda name, here: F.when(x["stays"] & here, F.array_append(acc[name], x["line"])).otherwise(acc[name]).alias(name)
            return F.struct(section.alias("section"), put("ingredients", section != "method"), put("method", section == "method"))

        return let(F.when(x["kind"].isNotNull(), x["kind"]).when(x["numbered"] & (acc["section"] != "notes"), F.lit("method")).otherwise(acc["section"]), grown)

    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("section"), none.alias("ingredients"), none.alias("method"))
    return F.aggregate(every, start, step, lambda acc: record(F.lit(None).cast("string"), F.array_distinct(acc["ingredients"]), F.array_distinct(acc["method"])))


def page_records(pages: DataFrame, key: str, html: str = "html", headings: Headings = Headings()) -> DataFrame:
    """(key, parser, record) of web pages: linked data, then a plug-in's markup, headings with lists, labelled lines; the first that has one."""
    told = records(lines_of(pages.select(key, html_text(F.col(html)).alias("text")), key), key, headings)
    labelled_ = told.select(key, record(F.col("title"), F.col("ingredients"), F.col("method")).alias("_labelled"))
    rows = pages.select(key, html).join(labelled_, key, "left")
    both = lambda r: (F.size(r["ingredients"]) > 0) & (F.size(r["method"]) > 0)
    parsers = [("linked_data", linked_record(F.col(html))), ("plugin", plugin_record(F.col(html))), ("headings", heading_record(F.col(html), headings)), ("labelled", F.col("_labelled"))]
    return cascade(rows, key, [(name, r, both(r)) for name, r in parsers])


def many(lines: DataFrame, key: str, is_title, headings: Headings = Headings(), reach: int = 60) -> DataFrame:
    """Lines of documents with several records: (key, record, pos, line).

    Each ingredients heading belongs to a record, which begins at the first title line at
    most reach lines before it and after the last method heading. Lines before the first
    record go.
    """
    from strataform.operators.lines import title_before

    rows = lines.withColumn("_kind", headings.kind(F.col("line")))
    is_kind = lambda name: lambda line: F.coalesce(headings.kind(line) == name, F.lit(False))
    every = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    starts = title_before(every, key, is_kind("ingredients"), lambda line: is_title(line) & headings.kind(line).isNull(), is_kind("method"), reach)
    starts = starts.where("title_pos IS NOT NULL").select(key, F.col("title_pos").alias("pos"), F.lit(1).alias("_new")).distinct()
    marked = rows.join(starts, [key, "pos"], "left")
    record = F.sum(F.coalesce("_new", F.lit(0))).over(along(key).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("record", record).where("record > 0").select(key, "record", "pos", "line")


def separated(lines: DataFrame, key: str, is_title, headings: Headings = Headings(), least: int = 2) -> DataFrame:
    """(key, record, title, ingredients, method, ...) of the parts of a document that many() finds; only of documents with at least so many whole records."""
    parts = many(lines, key, is_title, headings).withColumn("_part", F.struct(key, "record"))
    found = records(parts.select("_part", "pos", "line"), "_part", headings).where((F.size("ingredients") > 0) & (F.size("method") > 0))
    found = found.select(f"_part.{key}", "_part.record", *(c for c in found.columns if c != "_part"))
    return found.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") >= least).drop("_n")


def lines_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return exploded(df, key, text)


def line_arrays(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lines): each row's lines as an array, empty without any."""
    return df.select(key, line_array(F.col(text)).alias("lines"))


@dataclass(frozen=True)
class Scoring:
    """Points of a block: for each ingredient, each with a quantity, and each method line (up to most_steps, with verb only those that match it); less for long lines without a quantity.

    The defaults are those of web pages; PDF and SCAN those of texts from pages and scans.
    """

    ingredient: int = 5
    quantity: int = 4
    step: int = 2
    most_steps: int = 8
    verb: str | None = r"(?i)\b(add|bake|boil|cook|fry|mix|pour|serve|stir)\b"
    prose: int = 1
    prose_chars: int = 80
    without_method: int | None = None  # points of a block without a method; None: it has none
    least_ingredients: int = 1
    least_method_chars: int = 0


PDF = Scoring(quantity=2, step=1, verb=None, prose=0, without_method=2, least_ingredients=3, least_method_chars=40)
SCAN = Scoring(quantity=3, step=2, verb=None, prose=0, without_method=2, least_ingredients=2)


def parted(lines: Column, headings: Headings = Headings()) -> Column:
    """array<struct<kind, body>> of an array of lines: each heading's kind and the lines below it, up to the next one."""

    def of(lines: Column, heads: Column) -> Column:
        return F.transform(heads, lambda h, j: F.struct(h["kind"].alias("kind"), F.slice(lines, h["at"] + 2, F.coalesce(F.get(heads, j + 1)["at"], F.size(lines)) - h["at"] - 1).alias("body")))

    every = lambda lines: F.transform(lines, lambda x, i: F.struct(headings.kind(x).alias("kind"), i.alias("at")))
    return let(lines, lambda lines: let(F.filter(every(lines), lambda h: h["kind"].isNotNull()), lambda heads: of(lines, heads)))


def best_block(lines: DataFrame, key: str, headings: Headings = Headings(), quantity: str = "[0-9]", scoring: Scoring = Scoring()) -> DataFrame:
    """best_of() of documents whose lines are rows: shuffled once, by document."""
    docs = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return best_of(docs, key, headings, quantity, scoring)


def best_of(docs: DataFrame, key: str, headings: Headings = Headings(), quantity: str = "[0-9]", scoring: Scoring = Scoring()) -> DataFrame:
    """(key, block, score, ingredients, method) of line arrays: of the parts that begin with an ingredients heading the one with the most points, of equal ones the first.

    A part ends at the next ingredients heading or at a stop; see Scoring for what it must have. All inside the row.
    """
    count = lambda c, test: F.size(F.filter(c, test))

    def block(own: Column, n: Column) -> Column:
        stop = F.array_position(F.transform(own, lambda p: p["kind"]), "stop").cast("int")
        method = F.transform(F.filter(F.when(stop > 0, F.slice(own, F.lit(1), stop - 1)).otherwise(own), lambda p: p["kind"] == "method"), lambda p: p["body"])
        return F.struct(n.cast("long").alias("block"), F.get(own, F.lit(0))["body"].alias("ingredients"), F.flatten(method).alias("method"))

    def scored(b: Column) -> Column:
        ingredients, method = b["ingredients"], b["method"]
        has, chars = F.size(method) > 0, F.length(F.array_join(method, "\n"))
        whole = has & (chars >= scoring.least_method_chars) if scoring.without_method is None else ~has | (chars >= scoring.least_method_chars)
        steps = F.size(method) if scoring.verb is None else count(method, lambda x: x.rlike(scoring.verb))
        score = scoring.ingredient * F.size(ingredients) + scoring.quantity * count(ingredients, lambda x: x.rlike(quantity)) + scoring.step * F.least(steps, F.lit(scoring.most_steps))
        score = score - scoring.prose * count(ingredients, lambda x: F.length(x) > scoring.prose_chars) + F.when(has, 0).otherwise(scoring.without_method or 0)
        return F.when((F.size(ingredients) >= scoring.least_ingredients) & whole, F.struct(score.alias("score"), (-b["block"]).alias("before"), ingredients.alias("ingredients"), method.alias("method")))

    def best(parts: Column) -> Column:
        starts = F.filter(F.transform(parts, lambda p, i: F.when(p["kind"] == "ingredients", i)), lambda i: i.isNotNull())
        own = lambda starts, at, j: F.slice(parts, at + 1, F.coalesce(F.get(starts, j + 1), F.size(parts)) - at)
        blocks = let(starts, lambda starts: F.transform(starts, lambda at, j: let(own(starts, at, j), lambda some: block(some, j + 1))))
        return F.array_max(F.transform(blocks, scored))

    lines = F.transform("lines", lambda x: x["line"])
    # A generator computes its rows once; a filter on the best would do so again.
    found = docs.select(key, F.inline(F.filter(F.array(let(parted(lines, headings), best)), lambda b: b.isNotNull())))
    return found.select(key, (-F.col("before")).alias("block"), "score", "ingredients", "method")


def repaired(ingredients: Column, method: Column, label: str = r"(?<=[a-z.]) (?=\p{Lu}[a-z]+( [a-z]+)?: )", instruction: str = r"(?i)^(add|bake|boil|cook|fry|heat|mix|pour|serve|stir)\b.*\.$") -> list[Column]:
    """[ingredients, method]: lines with several labels split before each, instructions moved to the method, both distinct."""
    split = F.flatten(F.transform(ingredients, lambda x: F.split(x, label)))
    moved = F.filter(split, lambda x: x.rlike(instruction))
    return [F.array_distinct(F.filter(split, lambda x: ~x.rlike(instruction))), F.array_distinct(F.concat(method, moved))]


def intro(df: DataFrame, key: str, headings: Headings = Headings(), least: int = 80, most: int = 500) -> DataFrame:
    """(key, intro) of line arrays: the first line that is a paragraph and not a heading."""
    good = F.filter("lines", lambda x: F.length(x["line"]).between(least, most) & headings.kind(x["line"]).isNull())
    return df.select(key, F.get(good, F.lit(0))["line"].alias("intro")).where("intro IS NOT NULL")
