"""Writes as rewrites: each returns the table's new rows; the caller writes them and swaps folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def appended(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new, allowMissingColumns=True)


def updated(table: DataFrame, key: str, values: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the given columns taken from values where the key is there."""
    new = values.select(F.col(key), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = table.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns)


def deleted(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def orphans(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_anti")


def upserted(table: DataFrame, new: DataFrame, on: list[str], order: list[str] | None = None) -> DataFrame:
    """Found by key: the new row; else inserted. Of new rows that repeat a key the one with the largest values of order counts, by default of all columns as they come."""
    last = Window.partitionBy(*on).orderBy(*(F.desc(c) for c in (order or []) + [c for c in new.columns if c not in on]))
    one = new.withColumn("_turn", F.row_number().over(last)).where("_turn = 1").drop("_turn")
    return table.join(new, on, "left_anti").unionByName(one)


def inserted_unless_there(table: DataFrame, new: DataFrame, key: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows skipped): a key that the table has, or that an earlier new row has, is skipped."""
    first = Window.partitionBy("_key").orderBy(order)
    ranked = new.withColumn("_key", key).withColumn("_turn", F.row_number().over(first))
    known = table.select(key.alias("_key"), F.lit(True).alias("_there")).distinct()
    marked = ranked.join(known, "_key", "left").withColumn("_skip", F.col("_there").isNotNull() | (F.col("_turn") > 1))
    return tuple(marked.where(F.col("_skip") == side).select(*new.columns) for side in (False, True))


def reused(rows: DataFrame, stored: DataFrame, key: str, profile: str, fresh: Column) -> DataFrame:
    """rows with (value, reused): the text stored under the key if it has the profile and isn't blank, else what fresh gives."""
    good = stored.where((F.col("profile") == profile) & (F.trim("text") != "")).groupBy(key).agg(F.max("text").alias("_stored"))
    out = rows.join(good, key, "left")
    return out.withColumn("value", F.coalesce("_stored", fresh)).withColumn("reused", F.col("_stored").isNotNull()).drop("_stored")
