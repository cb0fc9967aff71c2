"""Near-duplicates by SimHash: fingerprints that share blocks of bits are compared.

A fingerprint of 64 bits is cut into six blocks. Two fingerprints with at most three
differing bits agree in three whole blocks at least, so each one is listed once for every
three of its blocks, and those with the same bits there are compared bit by bit. A group
too large for that is split in the same way once more, by blocks of the bits that its
members don't share yet; what is left has so few free bits that its size is bounded.
Within a group only a spanning forest of the links leaves the task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, Words, bytes_of, components, lowered, pieces, text_of

WORDS, SEED, DIFFERING, BLOCKS = 3, 42, 3, 6
#: Fingerprints of a group that are compared with each other; a larger group is split once more.
GROUP = 4096
#: Shingles hashed at a time, however long a text is.
TOGETHER = 1 << 16
#: The primes of XXH64: fixed values.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Bytes from which a hash keeps four sums; the library computes those.
STRIPE = 32
#: A byte's bits, each in a byte of its own.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of spans of bytes."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight, four = (np.ndarray((len(data) + 1,), kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    h, at, left = size.astype(np.uint64) + np.uint64(seed) + P5, starts.copy(), np.where(size < STRIPE, size, 0)
    for _ in range(STRIPE // 8 - 1):
        rows = np.flatnonzero(left >= 8)
        h[rows] = turned(h[rows] ^ turned(eight[at[rows]] * P2, 31) * P1, 27) * P1 + P4
        at[rows] += 8
        left[rows] -= 8
    rows = np.flatnonzero(left >= 4)
    h[rows] = turned(h[rows] ^ four[at[rows]].astype(np.uint64) * P1, 23) * P2 + P3
    at[rows] += 4
    left[rows] -= 4
    for _ in range(3):
        rows = np.flatnonzero(left >= 1)
        h[rows] = turned(h[rows] ^ data[at[rows]].astype(np.uint64) * P5, 11) * P1
        at[rows] += 1
        left[rows] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= STRIPE).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], seed)
    return h


def set_bits(hashes: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> None:
    """Add to counts (documents x 64) how often each bit is set in the hashes of each document; doc ascends."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    # Groups of at most 255 hashes of one document: a byte holds each sum.
    starts = np.concatenate([np.arange(a, b, 255) for a, b in zip(first, [*first[1:], len(doc)])])
    for k, byte in enumerate(hashes.astype("<u8").view(np.uint8).reshape(-1, 8).T):
        sums = np.add.reduceat(SPREAD[byte], starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        np.add.at(counts[:, 8 * k : 8 * k + 8], doc[starts], sums.astype(np.int64))


def simhashes(array: pa.Array, words: Words, size: int = WORDS) -> np.ndarray:
    """A fingerprint for each text; 0 without words."""
    starts, ends, _, first = words.of(array)
    data, _ = bytes_of(array)
    count = np.diff(first)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    upto = np.concatenate([[0], np.cumsum(shingles)])
    counts = np.zeros((len(array), 64), np.int64)
    for at in range(0, int(upto[-1]), TOGETHER):
        number = np.arange(at, min(at + TOGETHER, int(upto[-1])))
        doc = np.searchsorted(upto, number, "right") - 1
        begin = first[doc] + number - upto[doc]
        end = begin + np.minimum(count[doc], size) - 1
        low, high = int(begin[0]), int(end.max()) + 1  # words of this round, each followed by one space
        long = ends[low:high] - starts[low:high]
        to = np.concatenate([[0], np.cumsum(long + 1)])
        line = np.full(int(to[-1]), 32, np.uint8)
        inside = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        line[inside + np.repeat(to[:-1], long)] = lowered(data[inside + np.repeat(starts[low:high], long)])
        set_bits(xxh64(line, to[begin - low], to[end - low + 1] - 1), doc, counts)
    bits = (2 * counts > shingles[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, bits long): the fingerprint of each text; a null text is as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(simhashes(batch.column("text"), words, size).view(np.int64))], ["doc_id", "bits"])

    return text_of(docs).mapInArrow(run, "doc_id long, bits long")


def chosen(places: list[int], blocks: int, differing: int) -> list[int]:
    """A mask for each way to take all but so many of the blocks of these bits."""
    cut = [sum(1 << int(p) for p in part) for part in np.array_split(places, blocks)]
    return [sum(some) for some in itertools.combinations(cut, blocks - differing)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def free_bits(mask: int) -> list[int]:
    return [p for p in range(64) if not mask >> p & 1]


def forest(bits: np.ndarray, differing: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a spanning forest of the links between distinct fingerprints."""
    rest, ends, links = np.arange(len(bits)), [], []
    while len(rest):
        if not ends:
            ends, rest = [int(rest[0])], rest[1:]
        here = ends.pop()
        near = np.bitwise_count(bits[rest] ^ bits[here]) <= differing
        found = rest[near].tolist()
        if found:
            links += [(here, x) for x in found]
            ends += found
            rest = rest[~near]
    out = np.array(links, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def forest_by_turning(bits: np.ndarray, differing: int, free: list[int], width: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """As forest(), by looking up every fingerprint with some of its free bits turned: work in proportion to their number."""
    turns = np.array([sum(1 << p for p in some) for k in range(1, differing + 1) for some in itertools.combinations(free, k)], np.uint64)
    order = np.argsort(bits)
    bits, new, links, at = bits[order], np.ones(len(bits), bool), [], 0
    for root in range(len(bits)):
        if not new[root]:
            continue
        new[root] = False
        ends = np.array([root])
        while len(ends):
            found = []
            for at in range(0, len(ends), width):
                here = ends[at : at + width]
                near = bits[here][:, None] ^ turns
                place = np.minimum(np.searchsorted(bits, near), len(bits) - 1)
                i, j = np.nonzero((bits[place] == near) & new[place])
                to, one = np.unique(place[i, j], return_index=True)
                new[to] = False
                links.append(np.stack([here[i[one]], to], 1))
                found.append(to)
            ends = np.concatenate(found)
    out = np.concatenate([np.zeros((0, 2), np.int64), *links])
    return order[out[:, 0]], order[out[:, 1]]


def linked(groups: DataFrame, differing: int, most: int) -> DataFrame:
    """(a, b): links within each group of (mask, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((0, 2), np.int64)]
            for mask, members in zip(batch.column("mask").to_pylist(), batch.column("members")):
                bits = members.values.field("bits").to_numpy().view(np.uint64)
                ids = members.values.field("id").to_numpy()
                a, b = forest(bits, differing) if len(bits) <= most else forest_by_turning(bits, differing, free_bits(mask % (1 << 64)))
                out.append(np.stack([ids[a], ids[b]], 1))
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found.min(1)), pa.array(found.max(1))] if len(found) else [pa.array([], pa.int64())] * 2, ["a", "b"])

    return groups.select("mask", "members").mapInArrow(run, "a long, b long")


def links(tables: Tables, classes: DataFrame, differing: int, blocks: int, most: int) -> DataFrame:
    """(a, b): links that join all distinct fingerprints of (bits, id) that differ in so many bits at most, directly or not."""
    bits = F.col("bits")
    masks = chosen(list(range(64)), blocks, differing)
    each = classes.select("bits", "id", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask")).withColumn("shared", bits.bitwiseAND(F.col("mask")))
    sizes = each.groupBy("mask", "shared").agg(F.count("*").alias("n")).where("n > 1")
    rows = tables.saved(each.join(sizes, ["mask", "shared"]), "rows")
    members = F.collect_list(F.struct("bits", "id")).alias("members")
    out = tables.saved(linked(rows.where(F.col("n") <= most).groupBy("mask", "shared").agg(members), differing, most), "links")
    large = rows.where(F.col("n") > most)
    if large.isEmpty():
        tables.drop(rows)
        return out
    finer = F.create_map(*(x for m in masks for x in (F.lit(signed(m)), F.array(*(F.lit(signed(m | more)) for more in chosen(free_bits(m), blocks, differing))))))
    again = large.select("bits", "id", F.explode(finer[F.col("mask")]).alias("mask")).withColumn("shared", bits.bitwiseAND(F.col("mask")))
    # Members share all bits but 18 at most, so a group is bounded; the number of first-level groups of a fingerprint is, too.
    groups = again.groupBy("mask", "shared").agg(members).where(F.size("members") > 1)
    return tables.saved(out.union(linked(groups, differing, most)).distinct(), "all-links", (out, rows))


def near_duplicates(docs: DataFrame, differing: int = DIFFERING, size: int = WORDS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document; components link fingerprints that differ in so many bits at most.

    A bit is set if more than half of a text's shingles, repeats included, have it set in
    their hash. Texts with fewer words than a shingle are one shingle; null, empty and
    blank texts have fingerprint zero and are linked like any other. The smallest doc_id
    names a component. Rows that repeat a doc_id keep their number; rows with a null
    doc_id get the component of their fingerprint but name none, and null if nobody else
    has it. An empty table gives no rows. The result is a table in the shared folder; all
    others of the run are gone when it is returned.
    """
    tables = Tables(docs.sparkSession, "simhash")
    base = tables.saved(fingerprints(docs, size), "base")
    classes = tables.saved(base.groupBy("bits").agg(F.min("doc_id").alias("id")), "classes")
    found = components(links(tables, classes.where("id is not null"), differing, blocks, group), tables)
    groups = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("bits", F.coalesce("component", "id").alias("component_id"))
    out = base.join(groups, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
    out = tables.saved(out, "found")
    tables.keep_only(out)
    return out
