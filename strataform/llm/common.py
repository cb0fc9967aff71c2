"""Helpers shared by the operators: saved tables, bounded batches, word hashes, components."""

from __future__ import annotations

import gc
import hashlib
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of this library are separated by these bytes: space and 0x09 to 0x0D.
SHINGLE = 5
#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="strataform-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Saved tables of one run of an operator, which go as soon as what is made from them is written."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        self.named, self.cleaned = {}, 0.0

    def saved(self, df: DataFrame, name: str = "table", over: tuple[DataFrame, ...] = ()) -> DataFrame:
        """Write ``df``, read it back, and delete the tables in ``over``: nothing needs them any more."""
        path = f"{self.folder}/{len(self.paths)}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        self.drop(*over)
        self.clean()
        return out

    def bucketed(self, df: DataFrame, key: str, parts: int, name: str = "table") -> DataFrame:
        """Write ``df`` in so many buckets of a key and read it back: joins by the key don't shuffle it again."""
        path, table = f"{self.folder}/{len(self.paths)}-{name}", f"{name}_{uuid.uuid4().hex}"
        df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        self.paths[id(out)], self.named[id(out)] = (path, out), table
        self.clean()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for table in tables:
            path, _ = self.paths[id(table)]
            if id(table) in self.named:  # dropping it leaves its files
                self.spark.sql(f"drop table if exists {self.named[id(table)]}")
            where = hadoop(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def clean(self) -> None:
        """Let Spark delete the files of shuffles that no plan holds any more; not more often than every five seconds."""
        if time.monotonic() > self.cleaned + 5:
            gc.collect()
            self.spark._jvm.System.gc()
            self.cleaned = time.monotonic()

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables of this run but these."""
        self.drop(*(t for k, (_, t) in self.paths.items() if k not in {id(x) for x in tables}))


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; from here on, the session sends Python at most BATCH_BYTES at a time, however long the rows are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    value = df.sparkSession.conf.get(name).strip().lower()
    now = int(re.sub(r"[^0-9-]", "", value)) << {"k": 10, "m": 20, "g": 30}.get(value.rstrip("b")[-1:], 0)
    if not 0 < now <= BATCH_BYTES:  # -1: no bound at all
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def text_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id long, text string), a null text as empty; other columns are dropped."""
    bounded(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20, most_rows: int = 4000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of text and so many rows; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(sizes, sizes[at] + most_bytes, "right")) - 1
            end = min(max(end, at + 1), at + most_rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def whole_rows(df: DataFrame) -> F.Column:
    """All columns as one, named row, so that no name of theirs meets one that's added."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def restored(df: DataFrame, like: DataFrame, **new: F.Column) -> DataFrame:
    """The columns that whole_rows() put together, some of them new."""
    return df.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in like.columns))


def joined(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together until they hold about so many bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets start at 0."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


#: Words of more bytes are hashed one by one.
LONG = 256
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: the length, then eight bytes after another, each step mixed.

    Spans of equal length up to eight bytes never share a hash. Spans over LONG bytes get the
    first 64 bits of BLAKE2.
    """
    size = ends - starts
    wide = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mixed(mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[starts] & FIRST_BYTES[np.minimum(size, 8)]))
    rows, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(rows):
        left = size[rows] - at
        out[rows] = mixed(out[rows] * np.uint64(0xD1342543DE82EF95) ^ (wide[starts[rows] + at] & FIRST_BYTES[np.minimum(left, 8)]))
        rows, at = rows[left > 8], at + 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """Words of a slice of texts, A-Z lower-cased: byte spans, 64-bit hashes, and each text's first word."""

    def of(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word starts, word ends, word hashes, first word of each text and the end)."""
        data, offsets = bytes_of(array)
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, span_hashes(lowered(data), starts, ends), np.searchsorted(starts, offsets)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, by the position of the first."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[j : j + n]
    return mixed(out)


#: Links that a task holds at once when it joins them.
LINKS = 1 << 17


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each node of these links to the smallest that it can reach by them; none from that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    rest = np.flatnonzero(root != np.arange(len(root)))
    return nodes[rest], nodes[root[rest]]


def components(edges: DataFrame, tables: Tables | None = None, most: int = LINKS) -> DataFrame:
    """(node, component): each node of (a, b) edges with the smallest node it can reach.

    Tasks join the links that they have, ``most`` at a time. While more than that many are
    left, alternating large-star and small-star steps over saved tables go on; every step is
    an aggregate over the edges, so no component is ever held in one task. A step's table
    goes when the next one is written; the caller's tables hold the last.
    """
    tables = tables or Tables(edges.sparkSession, "components")

    def joined_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            n += batch.num_rows
            if n > most:
                held = [stars(*(np.concatenate(x) for x in zip(*held)))]
                n = len(held[0][0])
                if 2 * n > most:  # as good as nothing to join
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held)))], ["u", "v"])

    links = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v")
    links = tables.saved(links.mapInArrow(joined_links, "u long, v long"), "links")
    sums = lambda x: x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
    before = sums(links)
    while before[0] > most:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = tables.saved(large, "large", (links,))  # a row for each link at most
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        links = tables.saved(small, "small", (large,))
        after = sums(links)
        if after == before:
            break
        before = after
    else:  # so few that one task can hold them
        links = tables.saved(links.coalesce(1).mapInArrow(joined_links, "u long, v long"), "small", (links,))
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
    return tables.saved(found, "components", (links,))
