"""Records that refer to an earlier one of their document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.sources.staging import saved

REFERS = r"(?i)\b(same (method|dough|batter|base|recipe)|(the )?above (dough|batter|base|recipe|mixture))\b"


def bases(recipes: DataFrame, key: str) -> DataFrame:
    """(key, pos, base_pos): the latest earlier record named as words in this one's text, else the one before; only for records that refer to one.

    A text's runs of as many words as a name of its document has meet equal names, in order
    of pos, so the work grows with words and names, not with pairs of records. Marks around
    words don't count; a name without words is never named.
    """
    text = F.lower(F.concat_ws(" ", "name", F.array_join("ingredients", " "), F.array_join("method", " ")))
    worded = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    known = recipes.where(F.col(key).isNotNull() & F.col("pos").isNotNull())
    latest = lambda value, *by: F.max(value).over(Window.partitionBy(*by).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1))
    before = known.select(key, "pos", "name", latest(F.col("pos"), key).alias("before"), text.alias("text"))
    here = before.where(F.col("text").rlike(REFERS) & F.col("before").isNotNull())
    names = known.select(key, "pos", worded(F.lower("name")).alias("words")).where(F.size("words") > 0)
    sizes = names.groupBy(key).agg(F.collect_set(F.size("words")).alias("sizes"))
    run = lambda n: F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - n + 1)), lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.array().cast("array<string>"))
    said = here.select(key, "pos", worded("text").alias("words")).join(sizes, key).select(key, "pos", F.explode(F.array_distinct(F.flatten(F.transform("sizes", run)))).alias("said"), F.lit(None).cast(recipes.schema["pos"].dataType).alias("b_pos"))
    named = names.select(key, "pos", F.array_join("words", " ").alias("said"), F.col("pos").alias("b_pos"))
    met = said.unionByName(named).withColumn("_named", latest(F.col("b_pos"), key, "said")).where("b_pos IS NULL AND _named IS NOT NULL")
    best = met.groupBy(key, "pos").agg(F.max("_named").alias("_named"))
    return here.groupBy(key, "pos").agg(F.max("before").alias("before")).join(best, [key, "pos"], "left").select(key, "pos", F.coalesce("_named", "before").alias("base_pos"))


def pointed(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (key, pos, base_pos, arrays) whose empty arrays are filled from the nearest base that has them.

    Every row without a value points to its base. In each round it takes its base's value,
    or where that has none its base's pointer, so a chain of n bases takes log n rounds;
    each round reads the table that the one before wrote, and joins by the whole key.
    """
    next_of = lambda c: f"_next_{c}"
    rows = saved(rows.withColumns({next_of(c): F.when(F.size(c) == 0, F.col("base_pos")) for c in fields}), "pointers")
    while left := [c for c in fields if not rows.where(F.col(next_of(c)).isNotNull()).isEmpty()]:
        out = rows
        for c in left:
            there = rows.select(key, F.col("pos").alias(next_of(c)), F.col(c).alias("_value"), F.col(next_of(c)).alias("_far"))
            out = out.join(there, [key, next_of(c)], "left")
            has = F.size(F.coalesce("_value", F.array())) > 0
            out = out.withColumns({c: F.when(has, F.col("_value")).otherwise(F.col(c)), next_of(c): F.when(~has, F.col("_far"))}).drop("_value", "_far")
        rows = saved(out.select(*rows.columns), "pointers")
    return rows.drop(*(next_of(c) for c in fields))


def inherited(recipes: DataFrame, key: str) -> DataFrame:
    """Records with empty lists filled from the nearest of their bases that has them; a base may itself have one, and so on."""
    rows = recipes.select(key, "pos", "name", "ingredients", "method").join(bases(recipes, key), [key, "pos"], "left")
    filled = pointed(rows, key, ["ingredients", "method"])
    names = recipes.select(key, F.col("pos").alias("base_pos"), F.col("name").alias("base_name"))
    return filled.join(names, [key, "base_pos"], "left").select(key, "pos", "name", "ingredients", "method", "base_pos", "base_name")
