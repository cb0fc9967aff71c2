"""Token ids on disk as canonical length-limited Huffman codes.

Code lengths come from the counts of all ids. A file holds independent blocks; each has
its documents' ids in ascending doc_id order and, for every so many ids, the bit offset
at which they begin. Decoding is driven by a table of the next bits, and starts at all
checkpoints of a block at once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, bytes_of, joined, shared_dir, text_of
from .subwords import BLOCK_BYTES, WordIds

END, LONGEST = 2, 16
#: Ids of a block, and between two checkpoints.
BLOCK, EVERY = 1 << 19, 256


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The length of each id's code, 0 where the count is 0: package-merge, so the best with that limit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    # Level by level: merge the leaves with pairs of the level below; remember which are leaves.
    row, levels = weight, []
    leaf = np.ones(len(weight), bool)
    for _ in range(longest - 1):
        levels.append(leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        row, leaf = both[at], at < len(weight)
    levels.append(leaf)
    take, length = 2 * len(weight) - 2, np.zeros(len(weight), np.uint8)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def codes_of(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each id, table of the id that the next bits begin with, table of its length): canonical, by length then id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = (1 << (longest - lengths[order].astype(np.int64))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = first >> (longest - lengths[order].astype(np.int64))
    ids, width = np.zeros(1 << longest, np.int32), np.ones(1 << longest, np.uint8)
    ids[: size.sum()], width[: size.sum()] = np.repeat(order, size), np.repeat(lengths[order], size)
    return codes, ids, width


def encoded(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = EVERY) -> tuple[bytes, bytes]:
    """(bits, checkpoints): the codes one after another, and the bit offset of every so many ids."""
    width = lengths.astype(np.int64)
    aligned = codes.astype(np.uint64) << (64 - width).clip(0, 63).astype(np.uint64)
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(width[ids], out=at[1:])
    total, at = int(at[-1]), at[:-1]
    # A code of up to 16 bits lies in one or two words of 32 bits: put it into 64 from its first one on.
    value, where = aligned[ids] >> (at & 31).astype(np.uint64), at >> 5
    words = np.zeros(total // 32 + 2, np.uint64)
    edge = np.flatnonzero(np.diff(where, prepend=-1)) if len(ids) else np.zeros(0, np.int64)
    if len(edge):
        both, to = np.bitwise_or.reduceat(value, edge), where[edge]
        words[to] = both >> np.uint64(32)
        words[to + 1] |= both & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: -(-total // 8)], at[::every].astype("<u4").tobytes()


def decoded(bits: bytes, checkpoints: bytes, count: int, ids: np.ndarray, width: np.ndarray, every: int = EVERY) -> np.ndarray:
    """The ids of a block, all runs between checkpoints side by side."""
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    joined = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]  # 24 bits from each byte on
    out = np.zeros((every, len(at)), np.uint32)
    for k in range(every):
        if k and count - (len(at) - 1) * every == k:  # the last run has ended
            at = at[:-1]
            if not len(at):
                break
        bits16 = (joined[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[k, : len(at)] = ids[bits16]
        at = at + width[bits16]
    return out.T.ravel()[:count]


def tokenized(docs: DataFrame, end: int = END) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of whole texts and the end id, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = WordIds(), np.array([end], "<u2").tobytes()
        for batch in joined(batches, BLOCK_BYTES):
            ids = [x.astype("<u2").tobytes() + last for x in encode.of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def counted(ids: DataFrame, size: int = 1 << 16) -> np.ndarray:
    """Counts of all ids: each task sums its own, so the driver gets at most one short row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(bytes_of(batch.column("ids"))[0].view("<u2"), minlength=size)  # all rows of the batch at once
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_files(docs: DataFrame, path: str, end: int = END, block: int = BLOCK, every: int = EVERY) -> np.ndarray:
    """Write the ids of all documents to a folder, in ascending doc_id order; returns the code lengths.

    Parquet rows (part, block, doc_ids, counts, n_ids, bits, checkpoints): files and rows
    in order are the documents in order, null doc_ids first. Code lengths are written
    beside them, as codes of 65,536 bytes, so that the folder can be read by itself.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "ids")
    rows = tables.saved(tokenized(docs, end))
    lengths = code_lengths(counted(rows))
    codes, _, _ = codes_of(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((lengths, codes))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lengths, codes = shared.value
        part, number = TaskContext.get().partitionId(), 0
        docs, counts, held, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            bits, marks = encoded(ids, codes, lengths, every)
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([bits], pa.binary()), pa.array([marks], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "doc_ids", "counts", "n_ids", "bits", "checkpoints"])

        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(x.as_buffer(), "<u2")
                docs.append(doc), counts.append(len(ids)), held.append(ids)
                size += len(ids)
                if size >= block:
                    yield out()
                    docs, counts, held, size, number = [], [], [], 0, number + 1
        if docs:
            yield out()

    # Ranges of about 64 MB of ids.
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (32 << 20)))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    schema = "part int, block int, doc_ids array<long>, counts array<long>, n_ids long, bits binary, checkpoints binary"
    ordered.select("doc_id", "ids").mapInArrow(run, schema).write.parquet(f"{path}/blocks")
    tables.drop(rows)
    return lengths


def read_files(spark, path: str, every: int = EVERY) -> DataFrame:
    """(part, block, place, doc_id, n_tokens, ids): the documents of a folder, ids as unsigned 32-bit little-endian bytes."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codes").first()[0]), np.uint8)
    shared = spark.sparkContext.broadcast(codes_of(lengths)[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, width = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                part, block, docs, counts, n, bits, marks = (batch.column(j)[k].as_py() for j in range(7))
                flat = decoded(bits, marks, n, ids, width, every).astype("<u4")
                cut = np.cumsum([0, *counts])
                out = [flat[a:b].tobytes() for a, b in zip(cut, cut[1:])]
                columns = [pa.array([part] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int32()), pa.array(range(len(docs)), pa.int32()), pa.array(docs, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "place", "doc_id", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "doc_ids", "counts", "n_ids", "bits", "checkpoints")
    return blocks.mapInArrow(run, "part int, block int, place int, doc_id long, n_tokens long, ids binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from files that were written and read back.

    start is the number of ids of the documents before it. A null text is as an empty one
    and has the end id alone. Rows that repeat a doc_id follow one another in any order;
    those of null doc_ids come first.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(crc, pa.int64())], ["part", "block", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_files(spark, path).mapInArrow(digest, "part int, block int, place int, doc_id long, n_tokens long, ids_crc32 long")
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_ids")
    # Ids before each part, from one row a part; inside a part, before each block; inside a block, before each document.
    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    by_block = blocks.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    starts = by_block.join(by_part.select("part", "before"), "part").select("part", "block", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("within", within).join(starts, ["part", "block"]).select("doc_id", (F.col("before") + F.coalesce("within", F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
