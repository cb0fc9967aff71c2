"""Clusters of vectors around centroids: plain rounds of Lloyd in whole numbers.

Every round sends the centroids to the tasks. A task computes each vector's squared
differences to one centroid after another, takes the nearest, and returns the sums and
counts of its own vectors; those of all tasks are added up by cluster. Everything is
whole numbers, so no order of rows or tasks changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, bounded

CENTROIDS, ROUNDS, SCALE, SEED = 40, 5, 256, 2
#: Components are smaller than this, so that squared distances fit 64 bits; a table with a larger one is refused.
LIMIT = 1 << 27


def whole_vectors(rows: DataFrame, length: int, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * component) of the vectors of this length with finite components only."""
    v = F.col("embedding").cast("array<double>")
    good = v.isNotNull() & (F.size(v) == length) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = lambda x: F.floor(F.lit(float(scale)) * x)
    bound = F.when(F.forall(v, lambda y: F.abs(F.lit(float(scale)) * y) < LIMIT), F.transform(v, x)).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {LIMIT}: distances may pass 64 bits")).cast("array<bigint>"))
    return bounded(rows).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & good).select("vec_id", bound.alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; of equally near centroids the lowest."""
    distance = np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
    cluster = distance.argmin(1)
    return cluster, distance[np.arange(len(v)), cluster]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of the mean of its vectors; one without vectors stays."""
    d = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # CENTROIDS * length numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        middle = shared.value
        sums, counts = np.zeros(middle.shape, np.int64), np.zeros(len(middle), np.int64)
        for frame in frames:
            if len(frame):
                v = np.stack(frame["v"].to_numpy())
                cluster, _ = nearest(v, middle)
                counts += np.bincount(cluster, minlength=len(middle))
                np.add.at(sums, cluster, v)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": some, "n": counts[some], "sums": list(sums[some])})

    parts = vectors.select("v").mapInPandas(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(d))).alias("sums"))
    out = centroids.copy()
    for row in total.collect():  # a row for each centroid
        out[row["cluster"]] = np.array(row["sums"], np.int64) // row["n"]
    shared.unpersist()
    return out


def clusters(rows: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, length: int = 64, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Vectors of another length, null ones, those with null or non-finite components, and rows
    with a null vec_id take no part. Rows that repeat a vec_id all take part; where they
    could start a centroid, the smaller vector comes first. With fewer vectors than
    centroids each one starts a centroid. Ties go to the lower centroid; an empty table
    gives no rows. A component too large for exact distances in 64 bits raises an error.
    The result is a table in the shared folder.
    """
    spark = rows.sparkSession
    tables = Tables(spark, "lloyd")
    vectors = tables.saved(whole_vectors(rows, length, scale), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(name, "v").limit(centroids).collect()  # centroids rows
    if not first:
        tables.keep_only()
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    middle = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        middle = moved(vectors, middle)
    shared = spark.sparkContext.broadcast(middle)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cluster, distance = nearest(np.stack(frame["v"].to_numpy()), shared.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": cluster, "distance": distance})

    found = tables.saved(vectors.mapInPandas(run, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in middle]
    parts = spark.createDataFrame([(k, s, sum(inertia.values()), digests[k]) for k, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = tables.saved(found.join(F.broadcast(parts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "found")
    tables.keep_only(out)
    return out
