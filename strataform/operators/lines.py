"""Texts as ordered lines, and computations along them.

What needs one document's lines only is done on an array of them, inside its row, without
a shuffle; every window is one document's, ordered by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.text import let, squeezed


def exploded(df: DataFrame, key: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """(key, pos, line): lines that aren't blank, with their place among all lines."""
    rows = df.select(key, F.posexplode(F.split(text, separator)).alias("pos", "line"))
    return rows.withColumn("line", squeezed(F.col("line"))).where("line <> ''")


def line_array(text: Column, separator: str = "\n") -> Column:
    """array<struct<pos, line>>: lines that aren't blank, with their place among all lines."""
    every = F.transform(F.split(text, separator), lambda x, i: F.struct(i.alias("pos"), squeezed(x).alias("line")))
    return F.filter(every, lambda x: x["line"] != "")


def arrays(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lines): the lines of each row that has some, as an array."""
    return df.select(key, line_array(F.col(text)).alias("lines")).where(F.size("lines") > 0)


def along(key: str) -> Window:
    return Window.partitionBy(key).orderBy("pos")


def carried(df: DataFrame, key: str, value: Column, alias: str) -> DataFrame:
    """The last value that isn't null, up to and with each row: a heading's section for the lines below it."""
    return df.withColumn(alias, F.last(value, ignorenulls=True).over(along(key).rowsBetween(Window.unboundedPreceding, 0)))


def bounded(heads: DataFrame, key: str) -> DataFrame:
    """Heads with the place where the next one starts; null for a document's last."""
    return heads.withColumn("next_pos", F.lead("pos").over(along(key)))


def first_after(df: DataFrame, key: str, first, second) -> DataFrame:
    """(key, first_pos, second_pos) of line arrays: the first line of one kind, and the first of another kind below it."""
    start = lambda lines: F.get(F.filter(lines, lambda x: first(x["line"])), F.lit(0))["pos"]
    below = lambda lines, at: F.get(F.filter(lines, lambda x: (x["pos"] > at) & second(x["line"])), F.lit(0))["pos"]
    both = let(F.struct(F.col("lines"), start(F.col("lines")).alias("at")), lambda x: F.struct(x["at"].alias("first_pos"), below(x["lines"], x["at"]).alias("second_pos")))
    return df.select(key, both.alias("both")).select(key, "both.*")


def joined_items(df: DataFrame, key: str, starts: Column) -> DataFrame:
    """(key, item, text): a row that starts an item, with the rows up to the next start, as one text. Rows before the first start are item 0."""
    numbered = df.withColumn("item", F.sum(F.when(starts, 1).otherwise(0)).over(along(key).rowsBetween(Window.unboundedPreceding, 0)))
    return ordered_text(numbered, [key, "item"], "line", " ", "text")


def ordered_text(df: DataFrame, keys: list[str], line: str, separator: str, alias: str) -> DataFrame:
    """The lines of each group in order, joined. A group is a part of one document."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col(line).alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["line"]), separator).alias(alias))


def runs(df: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, run, tag, n): runs of rows with an equal tag."""
    changed = F.when(F.col(tag).eqNullSafe(F.lag(tag).over(along(key))), 0).otherwise(1)
    numbered = df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(along(key).rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run", tag).agg(F.count("*").alias("n"))


def distinct_lines(lines: Column) -> Column:
    """The lines of an array of them, case aside, the first of each kept, in order; lower-cased."""
    return F.array_distinct(F.transform(lines, lambda x: F.lower(x["line"])))


def repeats(df: DataFrame, key: str, alias: str = "repeats") -> DataFrame:
    """(key, repeats) of line arrays: occurrences beyond the first of each line, case aside."""
    return df.select(key, (F.size("lines") - F.size(distinct_lines(F.col("lines")))).cast("long").alias(alias))


def without_shorter_repeat(df: DataFrame, key: str, number: Column) -> DataFrame:
    """No row that is followed by one of the same number and is shorter than it."""
    w = along(key)
    drop = (number == F.lead(number).over(w)) & (F.length("line") < F.lead(F.length("line")).over(w))
    return df.withColumn("_drop", F.coalesce(drop, F.lit(False))).where("NOT _drop").drop("_drop")


def at_end(df: DataFrame, key: str, most: int) -> DataFrame:
    """(key, pos, line) of line arrays: the last lines of each."""
    return df.select(key, F.inline(F.slice("lines", F.greatest(F.lit(1), F.size("lines") - most + 1), F.lit(most))))


def best(df: DataFrame, key: str, score: Column) -> DataFrame:
    """The row of the highest score in each document; the first wins ties."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), F.asc("pos")))
    return df.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def best_in_order(df: DataFrame, key: str, score: Column, most: int, line: str = "line", alias: str = "summary") -> DataFrame:
    """(key, summary): the lines of the highest scores, joined in the order of the text."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), F.asc("pos")))
    return ordered_text(df.withColumn("_turn", turn).where(F.col("_turn") <= most), [key], line, " ", alias)


def preceding(df: DataFrame, key: str, is_base: Column, value: Column, alias: str) -> DataFrame:
    """The value of the nearest earlier row that is a base, by default that of the row before."""
    w = along(key)
    found = F.last(F.when(is_base, value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(alias, F.coalesce(found, F.lag(value).over(w)))


def title_before(df: DataFrame, key: str, anchor, is_title, barrier, reach: int = 60) -> DataFrame:
    """(key, pos, title_pos) of line arrays: for each anchor the first title at most reach places before it and after the last barrier.

    Each anchor looks at the few lines before it, so the work grows with the lines.
    """

    def found(lines: Column, x: Column, i: Column) -> Column:
        some = F.filter(F.slice(lines, F.greatest(F.lit(1), i + 1 - reach), F.least(i, F.lit(reach))), lambda y: y["pos"] >= x["pos"] - reach)
        wall = lambda some: F.coalesce(F.array_max(F.transform(F.filter(some, lambda y: barrier(y["line"])), lambda y: y["pos"])), F.lit(-1))
        title = let(some, lambda some: let(wall(some), lambda wall: F.get(F.filter(some, lambda y: (y["pos"] > wall) & is_title(y["line"])), F.lit(0))["pos"]))
        return F.struct(x["pos"].alias("pos"), F.when(i > 0, title).alias("title_pos"))

    marked = F.transform("lines", lambda x, i: F.when(anchor(x["line"]), found(F.col("lines"), x, i)))
    return df.select(key, F.inline(F.filter(marked, lambda x: x.isNotNull())))


def joined_sentences(df: DataFrame, key: str, ends: Column | None = None) -> DataFrame:
    """(key, item, text): lines joined until one ends a sentence."""
    ends = F.col("line").rlike("[.!?]$") if ends is None else ends
    done = F.sum(F.when(ends, 1).otherwise(0)).over(along(key).rowsBetween(Window.unboundedPreceding, -1))
    return ordered_text(df.withColumn("item", F.coalesce(done, F.lit(0))), [key, "item"], "line", " ", "text")
