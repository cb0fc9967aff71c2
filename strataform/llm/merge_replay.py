"""Byte-level BPE for a corpus at once: merges are replayed in rank order.

The distinct words of a block of texts lie in one array of symbols. An inverted index
goes from the rank of a pair to the places where it stands; each rank's places are
merged together, lowest rank first, and only the pairs left and right of a merge are
looked up anew. A word's ids don't depend on other words, so blocks are independent.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import joined, text_of
from .pretokens import gathered, lexicon, sums
from .subwords import vocabulary

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 12 << 20
NONE = np.int32(2**31 - 1)


class Merges:
    """The rank of every pair of tokens that joins into a token, and the bytes of each token."""

    def __init__(self, path: str | None = None) -> None:
        with open(path or vocabulary(VOCABULARY), "rb") as lines:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        self.tokens = [b""] * (max(rank.values()) + 1)
        for token, r in rank.items():
            self.tokens[r] = token
        self.size = len(self.tokens)
        keys, values = [], []
        for token, r in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(r)
        order = np.argsort(keys)
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, np.int32)[order], NONE)
        self.of_byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the two don't join."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def replayed(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, first id of each word and the end)."""
    size = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    token = merges.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    if not n:
        return token, np.zeros(len(words) + 1, np.int64)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[first[1:][size > 0] - 1] = -1
    before[first[:-1][size > 0]] = -1
    pair = np.full(n, NONE, np.int32)
    has = np.flatnonzero(after >= 0)
    pair[has] = merges.rank(token[has], token[has + 1])

    order = np.argsort(pair, kind="stable").astype(np.int32)
    ranks, edge = np.unique(pair[order], return_index=True)
    index: dict[int, list[np.ndarray]] = {int(r): [order[a:b]] for r, a, b in zip(ranks, edge, [*edge[1:], n]) if r != NONE}
    del order
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[pair[at] == rank]
        if not len(at):
            continue
        to = after[at]
        if len(at) > 1:
            chained = at[1:] == to[:-1]
            if chained.any():  # overlapping places: every other one, from the left
                start = np.concatenate([[True], ~chained])
                place = np.arange(len(at))
                keep = (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0
                at, to = at[keep], to[keep]
        right = after[to]
        token[at], token[to], after[at], pair[to], pair[at] = rank, -1, right, NONE, NONE
        some = right >= 0
        before[right[some]] = at[some]
        left = before[at]
        fresh = [at[some], left[left >= 0]]
        places = np.unique(np.concatenate(fresh))  # two merges side by side share one
        if not len(places):
            continue
        got = merges.rank(token[places], token[after[places]])
        pair[places] = got
        joins = np.flatnonzero(got != NONE)
        if len(joins) == 1:
            groups = [(int(got[joins[0]]), places[joins])]
        else:
            joins = joins[np.argsort(got[joins], kind="stable")]
            places, got = places[joins], got[joins]
            cut = np.flatnonzero(np.diff(got)) + 1
            groups = list(zip(got[np.concatenate([[0], cut])].tolist(), np.split(places, cut))) if len(got) else []
        for r, where in groups:
            if r in index:
                index[r].append(where)
            else:
                index[r] = [where]
                heapq.heappush(queue, r)
    alive = token >= 0
    return token[alive], np.concatenate([[0], np.cumsum(alive)])[first]


def encode_batch(texts: list[str], merges: Merges, pattern) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, first id of each text and the end)."""
    words, codes, offsets = lexicon(texts, pattern)
    ids, first = replayed([w.encode() for w in words], merges)
    counts = np.diff(first)[codes]
    return gathered(ids, first[:-1][codes], counts), np.concatenate([[0], np.cumsum(sums(counts, offsets))])


def digests(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, and its ids decoded.

    A null text is as an empty one: no ids. Repeated rows give repeated results and null
    doc_ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        merges, pattern = Merges(path), regex.compile(public_tokenizers.PATTERN)
        take = merges.tokens.__getitem__
        for batch in joined(batches, block_bytes):
            ids, first = encode_batch((x.as_py() for x in batch.column("text")), merges, pattern)
            raw = memoryview(ids.astype("<u4")).cast("B")
            ends = first.tolist()
            of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:])]
            back = [hashlib.sha256(b"".join(map(take, ids[a:b].tolist()))).hexdigest() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(of_ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
