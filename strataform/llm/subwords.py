"""Ids of the word-level tokenizer file for many texts, each distinct word encoded once a task."""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from .common import FIRST_BYTES, LONG, bytes_of, lowered, pieces, span_hashes
from .pretokens import gathered

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text whose distinct words are encoded together, and words that a task
#: remembers from its earlier blocks; later ones are encoded in each block, which changes nothing but speed.
BLOCK_BYTES, REMEMBERED = 4 << 20, 300_000


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library(path: str) -> tuple:
    """(tokenizer of the library, for each id whether it ends a word): the fixed file, read once a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    tokens = found.get_vocab()
    ends_word = np.zeros(max(tokens.values()) + 1, bool)
    ends_word[[k for token, k in tokens.items() if token.endswith("</w>")]] = True
    return found, ends_word


def same_spans(x: np.ndarray, x_at: np.ndarray, x_end: np.ndarray, y: np.ndarray, y_at: np.ndarray, y_end: np.ndarray) -> np.ndarray:
    """Whether each span of bytes x equals the span of y in the same row; both arrays end with eight more bytes."""
    size = x_end - x_at
    wide_x, wide_y = (np.ndarray((len(v) - 7,), "<u8", v, strides=(1,)) for v in (x, y))
    equal = (size == y_end - y_at) & (((wide_x[x_at] ^ wide_y[y_at]) & FIRST_BYTES[np.minimum(size, 8)]) == 0)
    rows, at = np.flatnonzero(equal & (size > 8) & (size <= LONG)), 8
    while len(rows):
        left = size[rows] - at
        good = ((wide_x[x_at[rows] + at] ^ wide_y[y_at[rows] + at]) & FIRST_BYTES[np.minimum(left, 8)]) == 0
        equal[rows[~good]] = False
        rows, at = rows[good & (left > 8)], at + 8
    for k in np.flatnonzero(equal & (size > LONG)).tolist():
        equal[k] = np.array_equal(x[x_at[k] : x_end[k]], y[y_at[k] : y_end[k]])
    return equal


class WordIds:
    """Ids of texts, equal to the library's for the whole text.

    Texts of plain Latin characters are cut where the file's pattern cuts them: between
    letters, single digits, other characters and white space. Equal words go through the
    library once, many together; the tokens that end a word show where each one ends.
    Words are looked up by their hashes and then compared byte by byte; a text with a word
    whose hash belongs to another word, like any other text, goes through the library whole.
    """

    def __init__(self, path: str | None = None) -> None:
        self.library, self.ends_word = library(path or vocabulary(VOCABULARY))
        none = np.zeros(0, np.int64)
        self.keep(np.zeros(0, np.uint64), none, np.zeros(0, np.int32), np.zeros(0, np.uint32), none, none, np.zeros(8, np.uint8))
        self.kind = np.full(256, 3, np.uint8)  # space 0, letter 1, digit 2, other 3
        self.kind[[9, 10, 13, 32]] = 0
        self.kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
        self.kind[48:58] = 2
        self.odd = np.zeros(256, bool)  # controls, and characters before U+00C0 and from U+0180 on
        self.odd[[*range(9), 11, 12, *range(14, 32), 127, 0xC2, *range(0xC6, 256)]] = True

    def cut(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-case bytes and eight more, starts, ends, hashes, first word of each text and the end, texts for the library)."""
        data, offsets = bytes_of(array)
        n = len(data)
        low = lowered(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        two = lambda a, b: (data[:-1] == a) & (data[1:] == b)
        bad = self.odd[data]
        if n > 1:
            bad[:-1] |= two(0x3C, 0x7C) | two(0xC3, 0x97) | two(0xC3, 0xB7) | two(0xC4, 0xB0)  # <| and signs among the letters
        count = np.concatenate([[0], np.cumsum(bad)])[offsets]
        whole = count[1:] > count[:-1]
        kind = self.kind[data]
        changes = np.ones(n, bool)
        changes[1:] = kind[1:] != kind[:-1]
        starts = (kind != 0) & (changes | (kind == 2) | begins[:-1])
        # A piece with an apostrophe before a letter stays whole: it may hold a contraction.
        quote = np.flatnonzero((low[:-1] == 39) & (kind[1:] == 1)) if n > 1 else np.zeros(0, np.int64)
        if len(quote):
            piece = (kind != 0) & ((changes & (np.concatenate([[0], kind[:-1]]) == 0)) | begins[:-1])
            number = np.cumsum(piece)
            marked = np.zeros(number[-1] + 1, bool)
            marked[number[quote]] = True
            starts &= piece | ~marked[number]
        at = np.flatnonzero(starts)
        stop = np.zeros(n + 1, bool)
        stop[:-1] = starts | (kind == 0)
        stop |= begins
        stops = np.flatnonzero(stop)
        ends = stops[np.searchsorted(stops, at, "right")] if len(at) else at
        return np.concatenate([low, np.zeros(8, np.uint8)]), at, ends, span_hashes(low, at, ends), np.searchsorted(at, offsets), whole

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, first id of each word and the end)."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            got = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[got]) + 1
            if len(ends) != len(some):  # contractions are several words
                several = [w for w in some if "'" in w]
                parts = dict(zip(several, (int(self.ends_word[e.ids].sum()) for e in self.library.encode_batch_fast(several, add_special_tokens=False))))
                ends = ends[np.cumsum([parts.get(w, 1) for w in some]) - 1]
            ids.append(got)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def keep(self, hashes: np.ndarray, first: np.ndarray, size: np.ndarray, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, raw: np.ndarray) -> None:
        """Words remembered, by ascending hashes: the place and number of their ids in flat, and of their bytes in raw."""
        self.hashes, self.first, self.size, self.flat, self.begin, self.end, self.raw = hashes, first, size, flat, begin, end, raw

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Remember the ids of words, by their hashes."""
        ids, at = self.encoded([w.decode() for w in words])
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        ends = len(self.raw) - 8 + np.cumsum([0, *map(len, words)])
        into = lambda old, new: np.insert(old, place, new[order])
        raw = np.concatenate([self.raw[:-8], np.frombuffer(b"".join(words), np.uint8), np.zeros(8, np.uint8)])
        self.keep(into(self.hashes, hashes), into(self.first, at[:-1] + len(self.flat)), into(self.size, np.diff(at).astype(np.int32)), np.concatenate([self.flat, ids]), into(self.begin, ends[:-1]), into(self.end, ends[1:]), raw)

    def of(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """The ids of each text of a batch, unsigned 32-bit."""
        parts, fresh = [], {}
        for low, at, ends, hashes, first, whole in (self.cut(p.column("text")) for p in pieces(iter([batch]))):
            used = np.flatnonzero(np.repeat(~whole, np.diff(first)))
            order = used[np.argsort(hashes[used], kind="stable")]
            new = np.ones(len(order), bool)
            new[1:] = hashes[order[1:]] != hashes[order[:-1]]
            number = np.zeros(len(hashes), np.int32)  # of the word among the distinct ones
            number[order] = np.cumsum(new) - 1
            sample = order[new]
            distinct = hashes[sample]
            place = np.searchsorted(self.hashes, distinct)
            known = place < len(self.hashes)
            known[known] = self.hashes[place[known]] == distinct[known]
            raw = low.tobytes()
            for h, a, b in zip(distinct[~known].tolist(), at[sample[~known]].tolist(), ends[sample[~known]].tolist()):
                if h not in fresh:
                    fresh[h] = raw[a:b]
            parts.append((low, at, ends, used, distinct, number, first, whole))
        before = self.hashes, self.first, self.size, self.flat, self.begin, self.end, self.raw
        self.learn(np.array(list(fresh), np.uint64), list(fresh.values()))
        del fresh
        out: list[np.ndarray] = []
        other = []
        for low, at, ends, used, distinct, number, first, whole in parts:
            place = np.searchsorted(self.hashes, distinct)[number[used]]
            alike = same_spans(low, at[used], ends[used], self.raw, self.begin[place], self.end[place])
            if not alike.all():
                whole[np.searchsorted(first, used[~alike], "right") - 1] = True
            sizes, starts = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            sizes[used], starts[used] = self.size[place], self.first[place]
            ids = gathered(self.flat, starts, sizes)
            cut = np.concatenate([[0], np.cumsum(sizes)])[first].tolist()
            out += [ids[a:b] for a, b in zip(cut, cut[1:])]
            other.append(whole)
        if len(self.hashes) > REMEMBERED:
            self.keep(*before)
        texts = batch.column("text")
        for k in np.flatnonzero(np.concatenate([np.zeros(0, bool), *other])).tolist():
            out[k] = np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        return out
