"""Word-processor documents as ordered paragraphs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.text import escaped, let
from strataform.sources.staging import saved

SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, pos int, text string, tag string, bold boolean, list_type string"


def docx_lines(objects: DataFrame) -> DataFrame:
    """(path, pos, text, tag, bold, list_type) of each paragraph; a file that can't be read gives no rows."""

    def paragraphs(content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                body = ElementTree.fromstring(archive.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return
        for p in body.iter(f"{SPACE}p"):
            texts = [(t.text or "", run.find(f"{SPACE}rPr/{SPACE}b") is not None) for run in p.iter(f"{SPACE}r") for t in run.iter(f"{SPACE}t")]
            text = "".join(t for t, _ in texts).strip()
            style = p.find(f"{SPACE}pPr/{SPACE}pStyle")
            name = style.get(f"{SPACE}val", "") if style is not None else ""
            listed = p.find(f"{SPACE}pPr/{SPACE}numPr") is not None
            yield text, f"h{name[-1]}" if name.startswith("Heading") and name[-1].isdigit() else "li" if listed else "p", bool(texts) and all(b for t, b in texts if t.strip()), "list" if listed else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(path, k, *row) for k, row in enumerate(paragraphs(content or b""))]
                if rows:
                    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["path", "pos", "text", "tag", "bold", "list_type"])

    return objects.select("path", "content").mapInArrow(run, SCHEMA)


PARTS = (
    "path string, kind string, block int, row int, cell int, para int, run int, text string, bold boolean, italic boolean, underline boolean,"
    " link string, style string, list string, level int, span int, merge string, value string"
)
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def docx_parts(objects: DataFrame) -> DataFrame:
    """What an archive holds, as rows of one saved table: runs of text with where they stand, numbering levels, and relationships.

    kind is run (block, in a table row and cell, para, run; list and level of its
    paragraph; span and merge of its cell), level (list, level, value: its format) or
    relation (link, value: its target). A file that can't be read gives no rows.
    """
    names = [f.split()[0] for f in PARTS.split(",")]

    def value(node: ElementTree.Element | None, name: str = "val", default: str | None = None) -> str | None:
        return default if node is None else node.get(SPACE + name, default)

    def on(run: ElementTree.Element, name: str) -> bool:
        found = run.find(f"{SPACE}rPr/{SPACE}{name}")
        return found is not None and found.get(f"{SPACE}val", "1") not in ("0", "false", "none")

    def paragraph(p: ElementTree.Element, where: dict) -> Iterator[dict]:
        style = value(p.find(f"{SPACE}pPr/{SPACE}pStyle"), default="")
        number = p.find(f"{SPACE}pPr/{SPACE}numPr")
        listed = {} if number is None else {"list": value(number.find(f"{SPACE}numId"), default="0"), "level": int(value(number.find(f"{SPACE}ilvl"), default="0"))}
        same = where | listed | {"kind": "run", "style": style}
        links = {id(r): h.get(f"{RELATION}id") for h in p.iter(f"{SPACE}hyperlink") for r in h.iter(f"{SPACE}r")}
        runs = list(p.iter(f"{SPACE}r"))
        for k, run in enumerate(runs):
            text = "".join({f"{SPACE}t": x.text or "", f"{SPACE}tab": "\t", f"{SPACE}br": "\n"}.get(x.tag, "") for x in run)
            yield same | {"run": k, "text": text, "bold": on(run, "b"), "italic": on(run, "i"), "underline": on(run, "u"), "link": links.get(id(run))}
        if not runs:
            yield same | {"run": 0, "text": ""}

    def rows(content: bytes) -> Iterator[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                tree = lambda name: ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None
                body, numbers, relations = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{SPACE}body"), tree("word/numbering.xml"), tree("word/_rels/document.xml.rels")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return
        for k, node in enumerate(body if body is not None else ()):
            if node.tag == f"{SPACE}p":
                yield from paragraph(node, {"block": k, "para": 0})
            elif node.tag == f"{SPACE}tbl":
                for i, row in enumerate(node.findall(f"{SPACE}tr")):
                    for j, cell in enumerate(row.findall(f"{SPACE}tc")):
                        merge = cell.find(f"{SPACE}tcPr/{SPACE}vMerge")
                        where = {"block": k, "row": i, "cell": j, "span": int(value(cell.find(f"{SPACE}tcPr/{SPACE}gridSpan"), default="1")), "merge": None if merge is None else value(merge, default="continue")}
                        for n, p in enumerate(cell.iter(f"{SPACE}p")):
                            yield from paragraph(p, where | {"para": n})
        if numbers is not None:
            formats = {a.get(f"{SPACE}abstractNumId"): [(int(x.get(f"{SPACE}ilvl", "0")), value(x.find(f"{SPACE}numFmt"), default="decimal")) for x in a.findall(f"{SPACE}lvl")] for a in numbers.findall(f"{SPACE}abstractNum")}
            for number in numbers.findall(f"{SPACE}num"):
                for level, kind in formats.get(value(number.find(f"{SPACE}abstractNumId")), []):
                    yield {"kind": "level", "list": number.get(f"{SPACE}numId"), "level": level, "value": kind}
        for relation in relations.iter(f"{PACKAGE}Relationship") if relations is not None else ():
            yield {"kind": "relation", "link": relation.get("Id"), "value": relation.get("Target")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in PARTS.split(",")])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = [{**dict.fromkeys(names), **x, "path": path} for x in rows(content or b"")]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

    return saved(objects.select("path", "content").mapInArrow(run, PARTS), "docx-parts")


def docx_blocks(parts: DataFrame) -> DataFrame:
    """(path, block, tag, level, html) from docx_parts(): paragraphs, headings (h1 to h6), list items (ul or ol with their level) and tables.

    Runs keep their marks and the targets of their links; list items get their kind from
    the numbering; merged cells span columns and rows.
    """
    at = ["path", "block", "row", "cell", "para"]
    targets = parts.where("kind = 'relation'").select("path", "link", F.col("value").alias("target"))
    text = F.regexp_replace(escaped(F.col("text")), "\n", "<br>")
    for column, tag in (("underline", "u"), ("italic", "i"), ("bold", "b")):
        text = F.when(F.col(column) & (F.col("text") != ""), F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))).otherwise(text)
    text = F.when(F.col("target").isNotNull(), F.concat(F.lit('<a href="'), escaped(F.col("target")), F.lit('">'), text, F.lit("</a>"))).otherwise(text)
    runs = parts.where("kind = 'run'").drop("value").join(targets, ["path", "link"], "left").withColumn("html", text)
    same = [F.max(c).alias(c) for c in ("style", "list", "level", "span", "merge")]
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("run", "html")))["html"], "")
    paragraphs = runs.groupBy(*at).agg(joined.alias("html"), *same)
    formats = parts.where("kind = 'level'").select("path", "list", "level", F.col("value").alias("format"))
    lines = paragraphs.where("row IS NULL").join(formats, ["path", "list", "level"], "left")
    heading = F.regexp_extract("style", "^Heading([1-6])$", 1)
    tag = F.when(heading != "", F.concat(F.lit("h"), heading)).when(F.col("list").isNull() | (F.col("list") == "0"), "p").when(F.col("format") == "bullet", "ul").otherwise("ol")
    lines = lines.select("path", "block", tag.alias("tag"), F.coalesce("level", F.lit(0)).alias("level"), "html").where("html <> ''")

    cell = ["path", "block", "row", "cell"]
    told = F.array_join(F.filter(F.sort_array(F.collect_list(F.struct("para", "html")))["html"], lambda x: x != ""), "<br>")
    cells = paragraphs.where("row IS NOT NULL").groupBy(*cell).agg(told.alias("html"), F.max("span").alias("span"), F.max("merge").alias("merge"))
    before = Window.partitionBy("path", "block", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("column", F.coalesce(F.sum("span").over(before), F.lit(0)))
    down = Window.partitionBy("path", "block", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("goes_on", F.coalesce(F.col("merge") == "continue", F.lit(False)))
    cells = cells.withColumn("group", F.sum((~F.col("goes_on")).cast("int")).over(down))
    cells = cells.withColumn("tall", F.count("*").over(Window.partitionBy("path", "block", "column", "group"))).where(~F.col("goes_on") | (F.col("group") == 0))
    spans = F.concat(F.when(F.col("span") > 1, F.concat(F.lit(' colspan="'), "span", F.lit('"'))).otherwise(""), F.when((F.col("tall") > 1) & ~F.col("goes_on"), F.concat(F.lit(' rowspan="'), "tall", F.lit('"'))).otherwise(""))
    shown = F.concat(F.lit("<td"), spans, F.lit(">"), "html", F.lit("</td>"))
    rows = cells.groupBy("path", "block", "row").agg(F.array_join(F.sort_array(F.collect_list(F.struct("cell", shown.alias("x"))))["x"], "").alias("html"))
    tables = rows.groupBy("path", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "html"))), lambda r: F.concat(F.lit("<tr>"), r["html"], F.lit("</tr>"))), "").alias("html"))
    return lines.unionByName(tables.select("path", "block", F.lit("table").alias("tag"), F.lit(0).alias("level"), "html"))


def docx_html(blocks: DataFrame) -> DataFrame:
    """(path, html) from docx_blocks(): list items of consecutive blocks in lists, nested by level. A document is one row while it's folded."""
    none = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("out"))
    ends = lambda tags: F.array_join(F.transform(F.reverse(tags), lambda t: F.concat(F.lit("</li></"), t, F.lit(">"))), "")

    def step(acc: Column, x: Column) -> Column:
        tags, size = acc["open"], F.size(acc["open"])
        whole = F.concat(F.lit("<"), x["tag"], F.lit(">"), x["html"], F.lit("</"), x["tag"], F.lit(">"))
        other = F.struct(F.array().cast("array<string>").alias("open"), F.array_append(acc["out"], F.concat(ends(tags), whole)).alias("out"))
        stay = F.least(size, x["level"] + 1)
        stay = F.when((size > x["level"]) & (F.get(tags, x["level"]) != x["tag"]), x["level"]).otherwise(stay)

        def item(stay: Column) -> Column:
            more = F.greatest(x["level"] + 1 - stay, F.lit(0))
            start = F.when(more == 0, F.lit("</li><li>")).otherwise(F.repeat(F.concat(F.lit("<"), x["tag"], F.lit("><li>")), more))
            text = F.concat(ends(F.slice(tags, stay + 1, F.greatest(size - stay, F.lit(0)))), start, x["html"])
            return F.struct(F.concat(F.slice(tags, F.lit(1), stay), F.array_repeat(x["tag"], more)).alias("open"), F.array_append(acc["out"], text).alias("out"))

        return F.when(x["tag"].isin("ul", "ol"), let(stay.cast("int"), item)).otherwise(other)

    every = blocks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "tag", "level", "html"))).alias("blocks"))
    return every.select("path", F.aggregate("blocks", none, step, lambda acc: F.concat(F.array_join(acc["out"], ""), ends(acc["open"]))).alias("html"))
