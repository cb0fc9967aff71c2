"""Words on a page: rows of words, and the title that a line stands under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.text import let, squeezed


def first_fit(centres: Column, near: Column) -> Column:
    """struct<anchors: array<double>, rows: array<int>>: each centre, in order, goes to the first row whose first centre is less than near away, else it begins one."""
    none = F.struct(F.array().cast("array<double>").alias("anchors"), F.array().cast("array<int>").alias("rows"))

    def placed(acc: Column, centre: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(acc["anchors"], lambda a: F.abs(a - centre) < near), True), F.lit(0)).cast("int")
        return let(at, lambda k: F.struct(F.when(k == 0, F.array_append(acc["anchors"], centre)).otherwise(acc["anchors"]).alias("anchors"), F.array_append(acc["rows"], F.when(k == 0, F.size(acc["anchors"])).otherwise(k - 1)).alias("rows")))

    return F.aggregate(centres, none, placed)


def rows_of_words(words: DataFrame, key: str, least_chars: int = 1) -> DataFrame:
    """(key, row, text, x0, x1, y0, y1, height): words (text, x0, y0, x1, y1) of a page joined to rows, as scans need it.

    From top to bottom, a word goes to the first row whose first word's centre is less
    than max(8, 0.55 * the page's upper median height) away, else it begins one. Rows
    are read from left to right; their height is that of the tallest word. Shorter texts
    than least_chars go. Blank or null words take no part. A page is one row while it's
    folded; words are shuffled once, by page.
    """
    item = F.struct("y0", "x0", "text", "x1", "y1")
    pages = words.where(F.trim("text") != "").groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("words"))
    heights = F.sort_array(F.transform("words", lambda w: w["y1"] - w["y0"]))
    pages = pages.withColumn("near", F.greatest(F.lit(8.0), 0.55 * F.get(heights, F.floor(F.size(heights) / 2).cast("int"))))
    fitted = first_fit(F.transform("words", lambda w: (w["y0"] + w["y1"]) / 2), F.col("near"))["rows"]
    each = pages.select(key, F.inline(F.arrays_zip(fitted.alias("row"), F.col("words").alias("w")))).select(key, "row", "w.*")
    text = squeezed(F.array_join(F.sort_array(F.collect_list(F.struct("x0", "y0", "text")))["text"], " "))
    out = each.groupBy(key, "row").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.max(F.col("y1") - F.col("y0")).alias("height"))
    return out.where(F.length("text") >= least_chars)


def rows_of_items(items: DataFrame, key: str, near: float = 2.5) -> DataFrame:
    """(key, row, text, y): items (ord, text, x, y) of a page's text layer joined to rows.

    In their order, an item goes to the first row whose first item's y is less than near
    away. Rows are numbered from the largest y down, of equal ones the earlier first, and
    read from left to right, equal places in their order. Blank items take no part.
    """
    item = F.struct("ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), squeezed(F.col("text")).alias("text"))
    pages = items.where(squeezed(F.col("text")) != "").groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    pages = pages.withColumn("fitted", first_fit(F.transform("items", lambda w: w["y"]), F.lit(near)))
    each = pages.select(key, F.inline(F.arrays_zip(F.col("fitted.rows").alias("at"), F.transform("fitted.rows", lambda r: F.get("fitted.anchors", r)).alias("y"), F.transform("items", lambda w, k: k).alias("place"), F.col("items").alias("w"))))
    text = F.array_join(F.sort_array(F.collect_list(F.struct("w.x", "place", "w.text")))["text"], " ")
    rows = each.groupBy(key, "at").agg(text.alias("text"), F.first("y").alias("y"))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("y"), "at")) - 1
    return rows.select(key, turn.alias("row"), "text", "y")


WORD = "array<struct<y0:double,x0:double,text:string,x1:double,y1:double>>"


def widest_gap(words: Column, low: str, high: str) -> Column:
    """struct<gap, at>: the widest stretch along an axis that no word covers, of equal ones the first, and where it ends; gap 0 without one."""
    spans = F.sort_array(F.transform(words, lambda w: F.struct(w[low].alias("low"), w[high].alias("high"))))
    start = F.struct(F.get(spans, F.lit(0))["high"].alias("end"), F.lit(0.0).alias("gap"), F.lit(0.0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        wider = x["low"] - acc["end"] > acc["gap"]
        return F.struct(F.greatest(acc["end"], x["high"]).alias("end"), F.when(wider, x["low"] - acc["end"]).otherwise(acc["gap"]).alias("gap"), F.when(wider, x["low"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.struct(acc["gap"].alias("gap"), acc["at"].alias("at")))


def page_blocks(words: DataFrame, key: str, column_gap: float = 40.0, block_gap: float = 30.0) -> DataFrame:
    """(key, block, words): words (text, x0, y0, x1, y1) of a page cut into blocks, in the order in which they are read.

    A part is cut at its widest empty stretch: between columns where one is column_gap wide
    or more, else between what stands above and below where one is block_gap high or more;
    each side is cut again, left before right, upper before lower. Two pages of a spread
    are two columns. Blank words take no part. A page is one row while it's cut.
    """
    item = F.struct(*(F.col(c).cast("double").alias(c) if c != "text" else F.col(c) for c in ("y0", "x0", "text", "x1", "y1")))
    pages = words.where(F.trim("text") != "").groupBy(key).agg(F.sort_array(F.collect_list(item)).cast(WORD).alias("words"))
    none = F.struct(F.array("words").alias("stack"), F.array().cast(f"array<{WORD}>").alias("blocks"))

    def step(acc: Column, _: Column) -> Column:
        def cut(part: Column) -> Column:
            rest = F.slice(acc["stack"], F.lit(2), F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))

            def sides(axis: str, at: Column) -> Column:
                halves = F.array(F.filter(part, lambda w: w[axis] < at), F.filter(part, lambda w: w[axis] >= at))
                return F.struct(F.concat(halves, rest).alias("stack"), acc["blocks"].alias("blocks"))

            whole = F.struct(rest.alias("stack"), F.array_append(acc["blocks"], part).alias("blocks"))
            down = let(widest_gap(part, "y0", "y1"), lambda y: F.when(y["gap"] >= block_gap, sides("y0", y["at"])).otherwise(whole))
            return let(widest_gap(part, "x0", "x1"), lambda x: F.when(x["gap"] >= column_gap, sides("x0", x["at"])).otherwise(down))

        return F.when(F.size(acc["stack"]) == 0, acc).otherwise(let(F.get(acc["stack"], F.lit(0)), cut))

    # n words give at most n blocks and n - 1 cuts.
    found = F.aggregate(F.sequence(F.lit(1), 2 * F.size("words")), none, step, lambda acc: acc["blocks"])
    return pages.select(key, F.posexplode(found).alias("block", "words"))


def reading_lines(words: DataFrame, key: str, column_gap: float = 40.0, block_gap: float = 30.0) -> DataFrame:
    """(key, pos, line): a page's lines in the order in which they are read, block by block, each block's rows as rows_of_words() joins them."""
    blocks = page_blocks(words, key, column_gap, block_gap).select(F.struct(key, "block").alias("_part"), F.inline("words"))
    rows = rows_of_words(blocks, "_part").select(F.col(f"_part.{key}").alias(key), "_part.block", "row", "text")
    turn = F.row_number().over(Window.partitionBy(key).orderBy("block", "row")) - 1
    return rows.select(key, turn.alias("pos"), F.col("text").alias("line"))


def under_titles(lines: DataFrame, titles: DataFrame, key: str, median_height: float = 20.0, least_lines: int = 2) -> DataFrame:
    """Lines with their title above: the smallest of |x centre distance| + 0.55 * y distance, the first title on ties.

    y distance is from 0 to below max(220, 24 * median height). A title with fewer lines is dropped.
    """
    t = titles.select(key, F.col("text").alias("title"), F.col("ord").alias("title_ord"), F.col("y0").alias("ty"), ((F.col("x0") + F.col("x1")) / 2).alias("tx"))
    reach = max(220.0, 24 * median_height)
    down = F.col("y0") - F.col("ty")
    pairs = lines.join(t, key).where((down >= 0) & (down < reach))
    cost = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("tx")) + 0.55 * down
    turn = F.row_number().over(Window.partitionBy(key, "ord").orderBy(cost, "title_ord"))
    best = pairs.withColumn("_turn", turn).where("_turn = 1")
    n = F.count("*").over(Window.partitionBy(key, "title_ord"))
    return best.withColumn("_n", n).where(F.col("_n") >= least_lines).select(*lines.columns, "title", "title_ord")


def tallest(lines: DataFrame, key: str, share: float = 1.22) -> DataFrame:
    """(key, y0, height): of each page's lines the tallest of those at least share times the upper median height, of equal ones the topmost; without such the tallest of all."""
    heights = F.array_sort(F.collect_list("height"))
    page = lines.groupBy(key).agg(F.element_at(heights, F.floor(F.count("*") / 2).cast("int") + 1).alias("_median"), F.collect_list(F.struct("height", "y0")).alias("_lines"))
    tall = F.filter("_lines", lambda x: x["height"] >= F.col("_median") * share)
    best = lambda some: F.array_max(F.transform(some, lambda x: F.struct(x["height"].alias("height"), (-x["y0"]).alias("up"))))
    return page.select(key, F.coalesce(best(tall), best(F.col("_lines"))).alias("b")).select(key, (-F.col("b.up")).alias("y0"), F.col("b.height").alias("height"))
