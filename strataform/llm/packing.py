"""Best-fit packing by hierarchical residuals.

Documents become pieces of at most 2048 ids. Each partition packs its pieces best-fit,
longest first; sequences that are nearly full are done. The emptiest of the others travel
on as single items, FAN partitions into one, and are packed best-fit again, up to one
partition at the root. Only lengths travel: a piece's sequence and place follow from
where its items went.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, joined, text_of
from .subwords import BLOCK_BYTES, WordIds

LENGTH, END = 2048, 0
#: Sequences with at most so many places left are nearly full.
SLACK = 8
#: Items of a partition, and partitions whose emptiest sequences, as many as make up ITEMS again, meet in one.
#: That loses no room: best-fit leaves at most one sequence of a partition no more than half full, and two that are
#: more than half full never fit together, so at most FAN sequences of a round can go into others; of these the emptiest
#: ITEMS // FAN of each partition are there.
ITEMS, FAN = 20_000, 16


def pieced(docs: DataFrame, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids, its end id included, cut only if there are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = WordIds(), np.array([end], np.uint32)
        for batch in joined(batches, BLOCK_BYTES):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode.of(batch)):
                ids = np.concatenate([ids, last]).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.data)))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, longest first, each into the fullest bin that can hold it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sizes of room that some bin has, ascending
    count = 0
    for i in order.tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            which = open_by_room[room].pop()
            if not open_by_room[room]:
                del rooms[at]
        else:
            room, which = capacity, count
            count += 1
        bins[i], offsets[i] = which, capacity - room
        left = room - need
        if left:
            if not open_by_room[left]:
                bisect.insort(rooms, left)
            open_by_room[left].append(which)
    return bins, offsets


def packed_once(items: DataFrame, parts: int, turn: int, capacity: int, slack: int, most: int) -> DataFrame:
    """(item, target, base, fill, again): each item's new bin, its place there, what that bin holds in all, and whether it is underfull and one of the most emptiest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        lengths, ids = table.column("length").to_numpy(), table.column("item").to_numpy()
        by_id = np.argsort(ids)  # the same rows give the same bins after a lost task
        lengths, ids = lengths[by_id], ids[by_id]
        bins, base = best_fit(lengths, capacity)
        names = np.full(bins.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(names, bins, ids)  # a bin is named by its smallest item
        fill = np.bincount(bins, lengths).astype(np.int64)
        again = np.zeros(len(fill), bool)
        again[np.lexsort((names, fill))[:most]] = True
        again &= fill < capacity - slack
        out = pa.table({"item": ids, "target": names[bins], "base": base, "fill": fill[bins], "again": again[bins]})
        yield from out.to_batches()

    return items.repartition(parts, F.xxhash64("item", F.lit(turn))).mapInArrow(run, "item long, target long, base long, fill long, again boolean")


def packed(docs: DataFrame, length: int = LENGTH, end: int = END, slack: int = SLACK) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A null or empty text is its end id alone. Rows that repeat a doc_id are pieces of
    their own, as are those of null doc_ids. The result is a table in the shared folder.
    """
    tables = Tables(docs.sparkSession, "packing")
    pieces_ = tables.saved(pieced(docs, length, end).withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = pieces_.where(F.col("length") < length).select("item", "length")
    count, turn, place = items.count(), 0, None
    parts = -(-count // ITEMS)
    while count:
        moved = tables.saved(packed_once(items, parts, turn, length, slack, max(1, ITEMS // FAN)), "moved")
        if place is None:
            place = moved.select("item", F.col("target").alias("sequence"), F.col("base").alias("at"))
        else:
            step = moved.select(F.col("item").alias("sequence"), "target", "base")
            place = place.join(step, "sequence", "left").select("item", F.coalesce("target", "sequence").alias("sequence"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("at"))
            place = tables.saved(place, "place")
        if parts == 1:
            break
        items = moved.where("again").groupBy(F.col("target").alias("item")).agg(F.max("fill").alias("length"))
        count, turn, parts = items.count(), turn + 1, -(-parts // FAN)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if place is None:
        out = pieces_.select(*names, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    else:
        out = pieces_.join(place.select("item", "sequence", "at"), "item", "left")
        out = out.select(*names, F.coalesce("sequence", "item").alias("sequence_id"), F.coalesce("at", F.lit(0)).cast("long").alias("offset"))
    out = tables.saved(out, "packed")
    tables.keep_only(out)
    return out
