"""Exact token counts of every prefix, by dynamic programming.

For each prefix of a word the last token of its encoding is stored: the one token that
ends there, encodes to itself, and can follow the last token of the prefix before it. Tokens
that end at a byte are those of an automaton's state, which grows as words need it.
Its count is one more than that prefix's. So budgets and truncations need no encoding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import joined, text_of
from .pretokens import lexicon, sums
from .subwords import vocabulary

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
BLOCK_BYTES = 8 << 20
#: Words, tokens and pairs of tokens that a task remembers; beyond them it starts anew, which changes nothing but speed.
REMEMBERED = 500_000


def byte_of_char() -> dict[str, int]:
    """The printable characters by which the file writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixCounts:
    def __init__(self, path: str | None = None) -> None:
        with open(path or vocabulary(VOCABULARY), encoding="utf-8") as file:
            data = json.load(file)
        byte = byte_of_char()
        special = {x["content"] for x in data["added_tokens"]}
        raw = lambda token: bytes(byte[c] for c in token)
        self.special = sorted(special)
        self.vocabulary = {raw(token): k for token, k in data["model"]["vocab"].items() if token not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        self.merges = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.starts = {token[:k] for token in self.vocabulary for k in range(1, len(token) + 1)}
        self.known: dict[str, bytes | np.ndarray] = {}
        #: Merges of tokens that encode to themselves.
        self.steps: dict[bytes, list[tuple[int, bytes, bytes]]] = {}
        self.forget()

    def forget(self) -> None:
        #: For each token the tokens before it, and whether it can follow them; how many there are.
        self.before: dict[bytes, dict[bytes, bool]] = {}
        self.pairs = 0
        #: States of the automaton, by the longest end of what was read that begins a token: next states by byte, tokens that end here.
        self.states: dict[bytes, tuple] = {}
        self.root: tuple = ({}, [], b"")

    def encoded(self, text: bytes) -> list[bytes]:
        """Merges of a short text, lowest rank first."""
        return self.merged(text)[0]

    def merged(self, text: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """(tokens of a short text, its merges in order): each merge's rank, and the first and last part after it."""
        parts, steps = [text[i : i + 1] for i in range(len(text))], []
        ranks = self.merges
        while len(parts) > 1:
            best, at = min((ranks.get(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def whole(self, token: bytes) -> bool:
        """Whether a token encodes to itself; its merges are kept for fits()."""
        parts, steps = self.merged(token)
        if parts == [token]:
            self.steps[token] = [*steps, (1 << 30, token, token)]
        return parts == [token]

    def step(self, state: tuple, byte: int) -> tuple:
        """The state after one more byte. Its tokens encode to themselves and come with what is known of those before them, longest first."""
        end = state[2] + bytes([byte])
        while end not in self.starts and end:
            end = end[1:]
        if (found := self.states.get(end)) is None:
            tokens = [end[k:] for k in range(len(end)) if end[k:] in self.vocabulary and (end[k:] in self.steps or self.whole(end[k:]))]
            found = self.states[end] = ({}, [(len(x), x, self.before.setdefault(x, {})) for x in tokens], end)
        state[0][byte] = found
        return found

    def fits(self, a: bytes, b: bytes, known: dict[bytes, bool]) -> bool:
        """Whether a + b encodes to [a, b]: both merge as they do alone, unless the pair between them comes first.

        Of equal ranks the left one is first.
        """
        left, right, get = self.steps[a], self.steps[b], self.merges.get
        i, j, x, y = 0, 0, a[-1:], b[:1]
        while (across := get((x, y), 1 << 30)) >= left[i][0] or across > right[j][0]:
            if left[i][0] <= right[j][0]:
                if left[i][0] == 1 << 30:
                    break
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1
        found = known[a] = across == 1 << 30
        self.pairs += 1
        return found

    def prefixes(self, words: list[bytes]) -> Iterator[np.ndarray | bytes]:
        """For each of the words, in ascending order, the number of tokens of word[:1], word[:2] and so on.

        What a word shares with the one before it is known already.
        """
        last, count, states, before_it = [b""], [0], [self.root], b""
        for word in words:
            n, same = len(word), 0
            for a, b in zip(word, before_it):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :], states[same + 1 :]
            state = states[-1]
            for i, byte in enumerate(word[same:], same + 1):
                state = state[0].get(byte) or self.step(state, byte)
                states.append(state)
                for size, token, known in state[1]:
                    left = last[i - size]
                    if i == size or (known[left] if left in known else self.fits(left, token, known)):
                        last.append(token)
                        count.append(count[i - size] + 1)
                        break
            before_it = word
            yield bytes(count[1:]) if n < 256 else np.array(count[1:])

    def of_words(self, words: list[str]) -> list:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if self.pairs > REMEMBERED or len(self.states) > REMEMBERED:
            self.forget()
        for mark in self.special:
            known[mark] = bytes([1] * len(mark.encode()))
        new = sorted((w.encode(), w) for w in words if w not in known)
        for (_, word), found in zip(new, self.prefixes([x for x, _ in new])):
            known[word] = found
        return [known[w] for w in words]


def counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, bytes_within): counts of each whole text.

    bytes_within is the longest prefix, in bytes, whose words and last cut word have at
    most limit tokens. A special token's string in a text is that token, as the library
    has it. A null or empty text has no bytes and no tokens. Repeated rows give repeated
    results and null doc_ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        table = PrefixCounts(path)
        # A special token is a word of its own here; what stands before it ends there.
        marks = "|".join(map(regex.escape, table.special))
        plain = regex.compile(public_tokenizers.PATTERN)
        split = regex.compile(f"({marks})")

        class Pattern:
            @staticmethod
            def findall(text: str) -> list[str]:
                if "<|" not in text:
                    return plain.findall(text)
                return [w for k, part in enumerate(split.split(text)) for w in ([part] if k % 2 else plain.findall(part))]

        for batch in joined(batches, BLOCK_BYTES):
            words, codes, offsets = lexicon((x.as_py() for x in batch.column("text")), Pattern)
            prefix = table.of_words(words)
            each = np.array([int(p[-1]) for p in prefix], np.int64)
            size = np.array([len(p) for p in prefix], np.int64)
            tokens, sizes = sums(each[codes], offsets) if len(words) else np.zeros(batch.num_rows, np.int64), sums(size[codes], offsets) if len(words) else np.zeros(batch.num_rows, np.int64)
            within = sizes.copy()
            for k in np.flatnonzero(tokens > limit):
                own = codes[offsets[k] : offsets[k + 1]]
                run_ = np.cumsum(each[own])
                cut = int(np.searchsorted(run_, limit, "right"))  # the first word that goes beyond
                room = limit - (int(run_[cut - 1]) if cut else 0)
                inner = np.frombuffer(prefix[own[cut]], np.uint8) if isinstance(prefix[own[cut]], bytes) else prefix[own[cut]]
                fits = np.flatnonzero(inner <= room)
                within[k] = int(size[own[:cut]].sum()) + (int(fits[-1]) + 1 if len(fits) else 0)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit), pa.array(within, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "bytes_within"])

    return text_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, bytes_within long")
