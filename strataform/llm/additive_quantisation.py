"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word from each of several full-dimensional codebooks, fitted
on a bounded sample to what the books before leave over, then jointly by least squares.
Codes come from a beam search; with each code the norm of its sum is stored. A query
scores all codes through tables of its products with every word, and the best are ranked
anew on the original vectors. Equal vectors are coded and searched as one, which then
stands for as many of their smallest ids as a query can return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables
from .vector_blocks import asked, blocks, lengths, matrix, union_of, vectors

BOOKS, WORDS, BEAM = 32, 256, 4
#: Vectors that codebooks are fitted on: those with the smallest hashes of vec_id.
SAMPLE = 16384
#: Candidates of a query that are ranked by their original vectors.
RERANK = 200
NEAREST = 5
#: Queries that a task scores at once.
TOGETHER = 256


def encode(v: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes of each vector: for each book, the beam keeps the sums with the smallest error so far."""
    m, k, d = books.shape
    out = np.zeros((len(v), m), np.uint8)
    norms = (books * books).sum(2)
    for at in range(0, len(v), 512):
        rest = v[at : at + 512, None, :]
        n = len(rest)
        codes, error = np.zeros((n, 1, 0), np.uint8), (rest * rest).sum(2)
        for j in range(m):
            new = error[:, :, None] + norms[j] - 2 * (rest @ books[j].T)
            flat = new.reshape(n, -1)
            top = np.argpartition(flat, beam - 1, axis=1)[:, :beam] if flat.shape[1] > beam else np.tile(np.arange(flat.shape[1]), (n, 1))
            who, word = top // k, top % k
            rows = np.arange(n)[:, None]
            error, rest = flat[rows, top], rest[rows, who] - books[j][word]
            codes = np.concatenate([codes[rows, who], word[:, :, None].astype(np.uint8)], 2)
        out[at : at + 512] = codes[np.arange(n), error.argmin(1)]
    return out


def summed(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def fit(sample: np.ndarray, m: int = BOOKS, k: int = WORDS, steps: int = 6, seed: int = 1) -> np.ndarray:
    """Codebooks: k-means on residuals, book after book, then least squares over all books for the codes found."""
    random = np.random.default_rng(seed)
    books, rest = np.zeros((m, k, sample.shape[1]), np.float32), sample.astype(np.float32).copy()
    for j in range(m):
        words = rest[random.choice(len(rest), k, replace=len(rest) < k)]
        for _ in range(steps):
            near = ((words * words).sum(1) - 2 * rest @ words.T).argmin(1)
            count = np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            full = np.flatnonzero(count)
            words = words.copy()
            words[full] = np.add.reduceat(rest[order], np.concatenate([[0], np.cumsum(count)])[full], axis=0) / count[full, None]
        near = ((words * words).sum(1) - 2 * rest @ words.T).argmin(1)
        books[j], rest = words, rest - words[near]
    codes = encode(sample.astype(np.float32), books).astype(np.int64) + np.arange(m) * k
    return refined(books.reshape(m * k, -1).astype(float), codes, sample).reshape(books.shape).astype(np.float32)


def refined(words: np.ndarray, codes: np.ndarray, sample: np.ndarray, rounds: int = 10) -> np.ndarray:
    """All words moved together to lessen the squared error of the sums: conjugate gradients on the normal equations.

    A word that few codes use stays near its place.
    """
    m = codes.shape[1]
    orders = [np.argsort(codes[:, j], kind="stable") for j in range(m)]
    edges = []
    for j, order in enumerate(orders):
        mine = codes[order, j]
        edges.append((np.flatnonzero(np.diff(mine, prepend=-1)), mine))

    def gathered(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(words)
        for order, (at, mine) in zip(orders, edges):
            out[mine[at]] = np.add.reduceat(x[order], at, axis=0)
        return out

    def added(x: np.ndarray) -> np.ndarray:
        return sum(x[codes[:, j]] for j in range(m))

    moved = np.zeros_like(words)
    rest = gathered(sample - added(words))
    step, size = rest.copy(), (rest * rest).sum(0)
    for _ in range(rounds):
        turned = gathered(added(step)) + step
        rate = size / np.maximum((step * turned).sum(0), 1e-30)
        moved += rate * step
        rest -= rate * turned
        size, before = (rest * rest).sum(0), size
        step = rest + size / np.maximum(before, 1e-30) * step
    return words + moved


def alike(good: DataFrame, most: int) -> DataFrame:
    """(vec_id, v, one): of equal vectors those with the most smallest vec_ids; one is the smallest."""
    order = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)
    return good.withColumn("one", F.first("vec_id").over(order)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def largest(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the most largest scores of each row; of equal ones those of the smaller ids."""
    top = np.argpartition(-score, most - 1, axis=1)[:, :most]
    least = np.take_along_axis(score, top, 1).min(1)
    for k in np.flatnonzero((score >= least[:, None]).sum(1) > most):
        top[k] = np.lexsort((ids[k], -score[k]))[:most]
    return top


def search(rows: DataFrame, every: int = 50, nearest: int = NEAREST, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for vec_ids divisible by every, the nearest other vectors by cosine.

    Which vectors take part: see vectors(); those of each length are searched among
    themselves. Ties go to the smaller vec_id; with fewer other vectors all are returned.
    An empty table, or one without queries, gives no rows.
    """
    spark = rows.sparkSession
    tables = Tables(spark, "additive-quantisation")
    good, parts = tables.saved(vectors(rows, nonzero=True), "vectors"), []
    for d in lengths(good):
        before = set(tables.paths)
        parts.append(searched(tables, good.where(F.size("v") == d), d, every, nearest, rerank, sample))
        tables.drop(*(t for k, (_, t) in tables.paths.items() if k not in before and t is not parts[-1]))
    tables.drop(good)
    return union_of(parts, spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"))


def searched(tables: Tables, good: DataFrame, d: int, every: int, nearest: int, rerank: int, sample: int) -> DataFrame | None:
    """search() among vectors of length d, as a saved table; None without queries."""
    spark = tables.spark
    members = tables.saved(alike(good, nearest + 1), "alike")  # one more than are returned, as a query leaves itself out
    distinct = members.where("vec_id = one").select("vec_id", "v")
    most = rerank + 1  # a query's own vector is one of them
    some = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    unit = np.stack(some["v"].to_numpy())
    unit = unit / np.sqrt((unit * unit).sum(1))[:, None]
    shared = spark.sparkContext.broadcast(fit(unit))  # BOOKS * WORDS * d floats

    def coded(ids: np.ndarray, v: np.ndarray) -> tuple:
        unit = (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)
        codes = encode(unit, shared.value)
        x = summed(codes, shared.value)
        return ids, codes, (x * x).sum(1)

    data = blocks(tables, distinct, coded, d, ["codes", "norms"])
    passes = []
    for ids, v in asked(tables, good, every, d):
        asking = spark.sparkContext.broadcast((ids, (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)))  # one pass of queries
        found = data.select("ids", "codes", "norms").mapInArrow(scored_by(shared, asking, most, d), "query_id long, vec_id long, near double")
        best = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
        found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
        passes.append(tables.saved(found.select("query_id", "vec_id"), "candidates"))
        asking.unpersist()
    if not passes:
        return None
    found = union_of(passes, None)
    pairs = found.join(distinct, "vec_id").join(good.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, q = matrix(batch.column("v"), d), matrix(batch.column("q"), d)
                cosine = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(cosine)], ["query_id", "vec_id", "score"])

    ranked = pairs.select("query_id", "vec_id", "v", "q").mapInArrow(exact, "query_id long, vec_id long, score double")
    ranked = ranked.withColumnRenamed("vec_id", "one").join(members.select("one", "vec_id"), "one").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
    return tables.saved(out, "found")


def scored_by(books, asking, most: int, d: int):
    """A task's work: for each query the most candidates with the highest approximate scores among the codes that the task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (q_ids, q) = books.value.reshape(-1, d), asking.value
        n = len(books.value)
        held = [(np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0), np.float32)) for x in np.split(q, range(TOGETHER, len(q), TOGETHER))]
        for batch in batches:
            for ids, codes, norms in zip(*(batch.column(c).to_pylist() for c in ("ids", "codes", "norms"))):
                ids, codes, norms = np.frombuffer(ids, np.int64), np.frombuffer(codes, np.uint8).reshape(-1, n), np.frombuffer(norms, np.float32)
                places = codes.T.astype(np.int64) + np.arange(n)[:, None] * WORDS
                for k, (names, score) in enumerate(held):
                    table = q[k * TOGETHER : (k + 1) * TOGETHER] @ words.T
                    near = np.zeros((len(table), len(ids)), np.float32)
                    for place in places:
                        near += table[:, place]
                    near = 2 * near - norms
                    names, score = np.concatenate([names, np.broadcast_to(ids, near.shape)], 1), np.concatenate([score, near], 1)
                    if score.shape[1] > most:
                        top = largest(score, names, most)
                        names, score = np.take_along_axis(names, top, 1), np.take_along_axis(score, top, 1)
                    held[k] = names, score
        for k, (names, score) in enumerate(held):
            who = np.repeat(q_ids[k * TOGETHER : (k + 1) * TOGETHER], names.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(names.ravel()), pa.array(score.ravel().astype(float))], ["query_id", "vec_id", "near"])

    return run
