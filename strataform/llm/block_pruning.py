"""Exact top-k inner products by block-at-a-time pruning.

Alike vectors lie in one block: rows are sorted by the nearest of a fixed number of
centres, and a block is parted into ranges along the terms in which its rows differ
most. A range keeps each term's largest and smallest value; a block keeps those and its
forward index, the integer components of its rows. For a query all ranges are ordered by
the sum of the most that each term can give there. The first ones are scored for a k-th
score; every range whose bound reaches it is scored through its block's forward index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables
from .vector_blocks import ROWS, asked, blocks, lengths, matrix, union_of, vectors

SCALE, HIGHEST, RANGE = 256, 5, 64
#: Centres by which rows are laid out, and rows on which they are fitted: a layout only, results don't depend on it.
CENTRES, SAMPLE = 256, 8192
#: Ranges of a query that are scored first, those with the highest bounds of all.
FIRST = 16
NONE = np.iinfo(np.int64).min


def centres(sample: np.ndarray, k: int = CENTRES, steps: int = 8) -> np.ndarray:
    """k-means on a bounded sample."""
    out = sample[np.random.default_rng(1).choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(steps):
        near = ((out * out).sum(1) - 2 * sample @ out.T).argmin(1)
        for j in np.unique(near).tolist():
            out[j] = sample[near == j].mean(0)
    return out


def parted(v: np.ndarray, size: int = RANGE) -> np.ndarray:
    """An order of the rows in which ranges of that size hold alike ones: halved again and again along the term that varies most."""
    done, todo = [], [np.arange(len(v))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        term = int(v[rows].var(0).argmax())
        half = -(-len(rows) // size) // 2 * size
        order = rows[np.argsort(v[rows, term], kind="stable")]
        todo += [order[half:], order[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def bounds(v: np.ndarray, size: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """Each range's largest and smallest value of every term."""
    edges = np.arange(0, len(v), size)
    return np.maximum.reduceat(v, edges), np.minimum.reduceat(v, edges)


def most_of(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The sum of the most that each term can give each query in each range."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def exact_kind(v: np.ndarray, q: np.ndarray) -> type:
    """A type in which sums of products are exact; 64-bit floating point is faster."""
    top = float(max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))) * float(np.abs(q).max(initial=0)) * q.shape[1]
    return np.float64 if top < 2**53 else np.int64


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each query, equal ones by id, in order."""
    order = np.lexsort((ids, -score, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[place < k]


def scanned(data: DataFrame, ids: np.ndarray, q: np.ndarray, least: np.ndarray, ranges: dict | None, k: int, size: int = RANGE) -> DataFrame:
    """(query, query_id, vec_id, score): for each query (its place and id) the best rows that a task sees, and a row with query -1 and no id: the ranges scored, and all.

    Ranges whose bound is below least are passed over; ranges, if given, names by block
    the only ones (query, range) that are scored.
    """
    shared = data.sparkSession.sparkContext.broadcast((ids, q, least, ranges))  # one pass of queries, bounded by PASS_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, least, ranges = shared.value
        least = least.copy()
        held, size_held = [(np.zeros(0, np.int64),) * 3], 0
        looked = every = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "terms", "high", "low"))):
                if ranges is not None and row[0] not in ranges:
                    continue
                names, v, high, low = (np.frombuffer(x, np.int64) for x in row[1:])
                v, high, low = (x.reshape(-1, q.shape[1]) for x in (v, high, low))
                kind = exact_kind(v, q)
                asks, v, high, low = q.astype(kind), v.astype(kind), high.astype(kind), low.astype(kind)
                if ranges is not None:
                    use = np.zeros((len(q), len(high)), bool)
                    use[tuple(ranges[row[0]])] = True
                else:
                    use = most_of(asks, high, low) >= least[:, None]
                looked, every = looked + int(use.sum()), every + use.size
                for r in np.flatnonzero(use.any(0)).tolist():
                    who, some = np.flatnonzero(use[:, r]), slice(r * size, (r + 1) * size)
                    got = (asks[who] @ v[some].T).astype(np.int64)
                    i, j = np.nonzero((got >= least[who][:, None]) & (names[some][None, :] != ids[who][:, None]))
                    held.append((who[i], got[i, j], names[some][j]))
                    size_held += len(i)
                    if size_held > 16 * k * len(q) + 100_000:
                        held, size_held = [shortened(held, least)], 0
                held, size_held = [shortened(held, least)], 0
        query, score, name = held[0]
        who = pa.concat_arrays([pa.array(ids[query]), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(query, -1)), who, pa.array(np.append(name, looked)), pa.array(np.append(score, every))], ["query", "query_id", "vec_id", "score"])

    def shortened(held: list[tuple], least: np.ndarray) -> tuple:
        """The k best of each query; least becomes the scores that others must reach from now on."""
        query, score, name = (np.concatenate(x) for x in zip(*held))
        some = best(query, score, name, k)
        query, score, name = query[some], score[some], name[some]
        count = np.bincount(query, minlength=len(least))
        full = np.flatnonzero(count == k)
        least[full] = np.maximum(least[full], score[np.cumsum(count)[full] - 1])
        return query, score, name

    return data.select("block", "ids", "terms", "high", "low").mapInArrow(run, "query long, query_id long, vec_id long, score long")


def first_ranges(data: DataFrame, q: np.ndarray, first: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each block (queries, ranges): the ranges with the highest bounds of all, first of them for each query."""
    shared = data.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        held = (np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64))
        for batch in batches:
            for block, high, low in zip(*(batch.column(c).to_pylist() for c in ("block", "high", "low"))):
                high, low = (np.frombuffer(x, np.int64).reshape(-1, q.shape[1]).astype(float) for x in (high, low))
                most = most_of(q.astype(float), high, low)
                new = (most, np.full(most.shape, block), np.broadcast_to(np.arange(most.shape[1]), most.shape))
                held = tuple(np.concatenate(x, 1) for x in zip(held, new))
                if held[0].shape[1] > first:
                    top = np.argpartition(-held[0], first - 1, axis=1)[:, :first]
                    held = tuple(np.take_along_axis(x, top, 1) for x in held)
        n = held[0].shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), *(pa.array(x.ravel()) for x in held)], ["query", "most", "block", "range"])

    found = data.select("block", "high", "low").mapInArrow(run, "query long, most double, block long, range long")
    order = Window.partitionBy("query").orderBy(F.desc("most"), "block", "range")
    top = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).select("query", "block", "range").toPandas()  # first for each query of the pass
    return {int(block): (rows["query"].to_numpy(), rows["range"].to_numpy()) for block, rows in top.groupby("block")}


def search(rows: DataFrame, every: int = 50, highest: int = HIGHEST, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for vec_ids divisible by every, the other rows with the highest integer products.

    Components are floor(scale * x). Which vectors take part: see vectors(); zero vectors
    do; those of each length are searched among themselves. Ties go to the smaller vec_id;
    with fewer other rows all are returned. An empty table, or one without queries, gives
    no rows. Components so large that a score may pass 64 bits raise a ValueError. The
    result is a table in the shared folder.
    """
    found = searched(rows, every, highest, scale).where("query_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= highest).select("query_id", "rank", "vec_id", "score")


def pruned(rows: DataFrame, every: int = 50, highest: int = HIGHEST, scale: int = SCALE) -> float:
    """The share of pairs of queries and ranges that the search passes over."""
    looked = searched(rows, every, highest, scale).where("query_id is null").agg(F.sum("vec_id"), F.sum("score")).first()
    return 1 - looked[0] / looked[1] if looked[1] else 0.0


def searched(rows: DataFrame, every: int, highest: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score) of the best rows that each task sees; without query_id the ranges scored, and all."""
    spark = rows.sparkSession
    tables = Tables(spark, "block-pruning")
    good, parts = tables.saved(vectors(rows, nonzero=False), "vectors"), []
    for d in lengths(good):
        some = good.where(F.size("v") == d)
        largest = some.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(F.floor(F.lit(float(scale)) * x).cast("double")))))).first()[0]
        if largest * largest * d >= 2.0**62:
            raise ValueError(f"inner products of components up to {largest:.3g} may pass 64 bits")
        parts += searched_among(tables, some, d, every, highest, scale)
    tables.keep_only(*parts)
    return union_of(parts, spark.createDataFrame([], "query_id long, vec_id long, score long"))


def searched_among(tables: Tables, good: DataFrame, d: int, every: int, highest: int, scale: int) -> list[DataFrame]:
    """searched() for vectors of length d, a saved table for each pass of queries."""
    spark = tables.spark
    sample = np.stack(good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"].to_numpy()).astype(float)
    middle = spark.sparkContext.broadcast(centres(sample))  # CENTRES * d numbers

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, c = matrix(batch.column("v"), d), middle.value
            cell = ((c * c).sum(1) - 2 * v @ c.T).argmin(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["vec_id", "v", "cell"])

    def indexed(ids: np.ndarray, v: np.ndarray) -> tuple:
        terms = np.floor(scale * v).astype(np.int64)
        order = parted(terms)
        return ids[order], terms[order], *bounds(terms[order])

    parts = max(1, -(-good.count() // ROWS))
    placed = good.select("vec_id", "v").mapInArrow(near, "vec_id long, v array<double>, cell long").repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    data = blocks(tables, placed.select("vec_id", "v"), indexed, d, ["terms", "high", "low"])
    out = []
    for ids, v in asked(tables, good, every, d):
        q = np.floor(scale * v).astype(np.int64)
        least = np.full(len(q), NONE)
        seen = scanned(data, ids, q, least, first_ranges(data, q, FIRST), highest).where("query >= 0")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        kth = seen.withColumn("place", F.row_number().over(order)).where(F.col("place") == highest).select("query", "score").toPandas()  # one row a query
        least[kth["query"].to_numpy(np.int64)] = kth["score"].to_numpy(np.int64)
        out.append(tables.saved(scanned(data, ids, q, least, None, highest).select("query_id", "vec_id", "score"), "found"))
    return out
