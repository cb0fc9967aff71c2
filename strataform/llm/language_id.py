"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built.
A text is parsed greedily into the longest pieces that occur in that sample. Each phrase
costs the bits that name its place in the sample and its length, so that a language with
a smaller sample, which needs more phrases, pays less for each; the language with the
fewest bits a byte wins. Whole texts are parsed, in lanes of a fixed length that advance
together, so that each step is a table lookup; where a lane begins inside a phrase, it's
parsed again from there until both parses agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, bytes_of, joined, pieces, whole_rows

#: The training sample: at most so many documents of each language, and so many characters of each of them.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 600
#: Bytes of automata that travel and are held at once: languages are scored in blocks of about this size.
TABLE_BYTES = 128 << 20
#: Bytes of rows that meet one block after another, if there are several.
SCORED_BYTES = 32 << 20
UNKNOWN = "und"
#: Bytes of a lane, and rounds in which lanes may be parsed again before the rest of a text is parsed byte by byte.
LANE, AGAIN = 256, 4


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with Latin letters in lower case; other ASCII bytes become spaces."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    if len(data):
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        low = np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), low + np.uint8(32), low)
    return np.where((low < 128) & ~((low >= 97) & (low <= 122)), np.uint8(32), low)


def automaton(texts: list[list[int]], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of several texts: state * width + code gives the next state.

    A missing transition ends a phrase: it holds the state that the code leads to
    from the start, with the sign bit set. Code width - 1 pads: it leads to the start.
    """
    link, length, step = [-1], [0], [{}]
    for codes in texts:
        last = 0
        for c in codes:
            if c in step[last] and length[step[last][c]] == length[last] + 1:
                last = step[last][c]
                continue
            new = len(step)
            link.append(0), length.append(length[last] + 1), step.append({})
            at = last
            while at >= 0 and c not in step[at]:
                step[at][c] = new
                at = link[at]
            if at >= 0:
                to = step[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    copy = len(step)
                    link.append(link[to]), length.append(length[at] + 1), step.append(dict(step[to]))
                    while at >= 0 and step[at].get(c) == to:
                        step[at][c] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
    table = np.full((len(step), width), -1, np.int64)
    for state, row in enumerate(step):
        for c, to in row.items():
            table[state, c] = to
    root = np.where(table[0] < 0, 0, table[0])
    table = np.where(table < 0, root[None, :] - (1 << 31), table)
    table[:, width - 1] = 0
    return table.astype(np.int32).ravel()


def learn(docs: DataFrame, label: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict:
    """A model from rows with doc_id, text and a label; rows with neither text nor label are left out.

    The sample is the rows of each label with the smallest hashes of doc_id. Every label
    with such rows is learned; the driver holds the samples.
    """
    sample = docs.select(
        F.col(label).cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.col("text").cast("string"), 1, sample_chars).alias("text")
    ).where("lang is not null and text rlike '\\\\p{L}'")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = sample.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs).orderBy("lang", "rank").collect()
    texts: dict[str, list[np.ndarray]] = {}
    for r in rows:
        texts.setdefault(r["lang"], []).append(folded(np.frombuffer(r["text"].encode(), np.uint8)))
    langs = sorted(texts)
    seen = np.unique(np.concatenate([x for k in langs for x in texts[k]])) if langs else np.zeros(0, np.uint8)
    codes = np.zeros(256, np.uint8)  # 0: a byte that no sample has
    codes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 2
    return {"langs": langs, "codes": codes, "width": width, "samples": [[codes[x] for x in texts[k]] for k in langs]}  # codes of each sample text


def blocks_of(model: dict, most_bytes: int) -> Iterator[dict]:
    """The model in parts of consecutive languages, each with automata of about so many bytes or one language."""
    langs, tables, sizes = [], [], []
    block = lambda: {"langs": langs, "codes": model["codes"], "width": model["width"], "tables": tables, "sizes": np.array(sizes)}
    for lang, sample in zip(model["langs"], model["samples"]):
        langs.append(lang)
        sizes.append(sum(map(len, sample)))
        tables.append(automaton([x.tolist() for x in sample], model["width"]))
        if sum(x.nbytes for x in tables) >= most_bytes:
            yield block()
            langs, tables, sizes = [], [], []
    if langs:
        yield block()


def parsed(table: np.ndarray, width: int, steps: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that end in each lane; steps has a row for each place in the lanes, follows tells which lanes go on with the text of the lane before."""
    state = np.zeros(steps.shape[1], np.int32)
    states, ended = np.empty(steps.shape, np.int32), np.empty(steps.shape, np.uint8)
    for k, row in enumerate(steps):
        to = table[state * width + row]
        ended[k] = to < 0
        states[k] = state = to & 0x7FFFFFFF
    entry = np.zeros(steps.shape[1], np.int32)
    for turn in range(AGAIN + 1):
        true = np.where(follows, np.concatenate([[0], states[-1, :-1]]), 0)
        lanes = np.flatnonzero(true != entry)
        if not len(lanes):
            break
        if turn < AGAIN:
            entry, state = true, true[lanes]
            for k in range(len(steps)):
                to = table[state * width + steps[k, lanes]]
                state = to & 0x7FFFFFFF
                differ = state != states[k, lanes]
                ended[k, lanes], states[k, lanes] = to < 0, state
                lanes, state = lanes[differ], state[differ]
                if not len(lanes):
                    break
            continue
        # Texts like one letter again and again: parses never meet.
        lane, quick = int(lanes[0]), memoryview(table)
        while lane < steps.shape[1]:
            now = int(states[-1, lane - 1]) if follows[lane] else 0
            if now != entry[lane]:
                entry[lane] = now
                for k, c in enumerate(steps[:, lane].tolist()):
                    to = quick[now * width + c]
                    now = to & 0x7FFFFFFF
                    ended[k, lane], states[k, lane] = to < 0, now
            lane += 1
    return ended.sum(0, dtype=np.int64)


def phrases(array: pa.Array, model: dict) -> np.ndarray:
    """Phrases of each text, a row for each language."""
    data, offsets = bytes_of(array)
    n = np.diff(offsets)
    lanes = -(-n // LANE)
    first = np.concatenate([[0], np.cumsum(lanes)])
    out = np.zeros((len(model["langs"]), len(n)), np.int64)
    if not first[-1]:
        return out
    within = np.arange(first[-1]) - np.repeat(first[:-1], lanes)
    starts = np.repeat(offsets[:-1], lanes) + within * LANE
    ends = np.minimum(starts + LANE, np.repeat(offsets[1:], lanes))
    width, pad = model["width"], model["width"] - 1
    codes = model["codes"][folded(data)].astype(np.int32)
    where = np.arange(LANE)[:, None] + starts[None, :]
    steps = np.where(where < ends[None, :], codes[np.minimum(where, len(codes) - 1)], pad)
    full = np.flatnonzero(n)
    for k, table in enumerate(model["tables"]):
        out[k, full] = np.add.reduceat(parsed(table, width, steps, within > 0), first[:-1][full]) + 1
    return out


def entropy(count: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits a byte: each phrase names one of the sample's bytes and its own length, twice the logarithm of the mean length and a bit."""
    n = np.maximum(n, 1)
    mean = n / np.maximum(count, 1)
    return count * (np.log2(sizes + 1)[:, None] + 2 * np.log2(np.maximum(mean, 1)) + 1) / n


def labelled(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs with lang_pred and score; columns of these names are replaced.

    score is 1 - bits of the best / bits of the second language (1 if only one
    is learned). Ties go to the first language by name. ``und`` with score 0: a null
    or empty text, one without a letter, or a model without languages. Repeated rows
    give repeated results; an empty table gives none.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in blocks_of(model, TABLE_BYTES)]  # each bounded by TABLE_BYTES or one language
    names = np.array([*model["langs"], UNKNOWN], object)
    docs = bounded(docs).drop("lang_pred", "score")
    rows = docs.select(whole_rows(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("letters", F.col("text").rlike(r"\p{L}"))

    def two_best(parts: list[pa.RecordBatch]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(bits a byte, language) of the two best languages of each text, for each part; equal ones by name."""
        held, at = [(np.zeros((0, x.num_rows)), np.zeros((0, x.num_rows), np.int64)) for x in parts], 0
        for block in shared:
            some = block.value
            for k, part in enumerate(parts):
                bits = entropy(phrases(part.column("text"), some), np.diff(bytes_of(part.column("text"))[1]), some["sizes"])
                count = np.concatenate([held[k][0], bits])
                which = np.concatenate([held[k][1], np.repeat(np.arange(at, at + len(some["langs"]))[:, None], part.num_rows, 1)])
                top = np.argsort(count, axis=0, kind="stable")[:2]
                held[k] = np.take_along_axis(count, top, 0), np.take_along_axis(which, top, 0)
            at += len(some["langs"])
            if len(shared) > 1:
                block.__dict__.pop("_value", None)  # a worker holds one block at a time
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in joined(batches, SCORED_BYTES) if len(shared) > 1 else batches:
            parts = list(pieces(iter([whole])))
            for batch, (count, which) in zip(parts, two_best(parts)):
                known = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                score, best = np.zeros(batch.num_rows), np.full(batch.num_rows, len(names) - 1)
                if len(count):
                    best = np.where(known, which[0], best)
                    score = np.where(known, 1 - count[0] / np.maximum(count[1], 1e-9) if len(count) > 1 else 1.0, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    out = rows.mapInArrow(run, rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")).schema)
    return out.select("row.*", "lang_pred", "score")


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every text, as labelled() has them."""
    return labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "lang_pred", "score")


def held_out() -> F.Column:
    """A third of the documents by id, on which nothing is learned."""
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out")


