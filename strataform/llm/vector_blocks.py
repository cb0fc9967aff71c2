"""Vectors in blocks, and a stated set of queries in passes over them: each pass meets all blocks where they lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, bounded, joined

#: Rows of a block, and bytes of the queries of one pass.
ROWS, PASS_BYTES = 4096, 8 << 20


def vectors(rows: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v array<double>): vectors with finite components.

    Null ids, null vectors, vectors with null or non-finite components, and with nonzero
    zero vectors, take no part. Rows that repeat a vec_id count as one: the smallest vector.
    """
    v = F.col("embedding").cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        good &= F.exists(v, lambda x: x != 0)
    rows = bounded(rows).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & good)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def lengths(rows: DataFrame) -> list[int]:
    """The lengths of the vectors, the most frequent first. Nearness has a meaning among vectors of one length only, so each one is a search of its own."""
    return [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()]


def union_of(parts: list[DataFrame | None], empty: DataFrame) -> DataFrame:
    """All rows of the parts that are there; the empty table if none is."""
    found = [p for p in parts if p is not None]
    return reduce(DataFrame.union, found) if found else empty


def matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, d)


def blocks(tables: Tables, rows: DataFrame, make: Callable[[np.ndarray, np.ndarray], tuple], d: int, names: list[str], size: int = ROWS) -> DataFrame:
    """A row for each block of up to size vectors: its number, the ids, and what make(ids, vectors) returns, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, size * d * 8):
            for at in range(0, batch.num_rows, 2 * size):
                part = batch.slice(at, 2 * size)
                made = make(part.column("vec_id").to_numpy(), matrix(part.column("v"), d))
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in made], ["ids", *names])

    out = rows.mapInArrow(run, ", ".join(f"{n} binary" for n in ["ids", *names]))
    return tables.saved(out.withColumn("block", F.monotonically_increasing_id()), "blocks")


def asked(tables: Tables, rows: DataFrame, every: int, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries, the rows whose vec_id is divisible by every, in passes of at most about PASS_BYTES."""
    queries = rows.where(F.col("vec_id") % every == 0)
    most = max(1, PASS_BYTES // (8 * d))
    passes = max(1, -(-queries.count() // most))
    queries = queries.withColumn("pass", F.pmod(F.xxhash64("vec_id"), F.lit(passes)).cast("int"))
    queries = tables.saved(queries.repartitionByRange(min(passes, 1000), "pass").sortWithinPartitions("pass", "vec_id"), "queries")
    for k in range(passes):
        some = queries.where(F.col("pass") == k).select("vec_id", "v").toPandas().sort_values("vec_id")  # bounded by PASS_BYTES
        if len(some):
            yield some["vec_id"].to_numpy(np.int64), np.stack(some["v"].to_numpy()).astype(float)
