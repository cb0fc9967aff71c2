"""Collocations: phrases that occur far more often than their parts would let expect.

Frequent phrases are grown as PrefixSpan grows patterns. Every place of a frequent word is
projected to that word: it leaves its document as a pointer, which holds the frequent
words after it in its piece, as far as a phrase can reach. A task has all pointers of a
prefix; it sorts them by the next word, keeps the next words that are frequent after the
prefix, and goes on with the pointers of each of them, depth first, to the right. A
prefix with very many places is dealt to several tasks by what follows it, so that all
places of a longest phrase still meet; their counts of shorter phrases are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FIRST_BYTES, Tables, bounded, bytes_of, lowered, mixed, pieces, span_hashes

LEAST, LONGEST, TOP, NO_LANGUAGE = 10, 3, 2000, "und"
#: Words that have a short code, the most frequent ones; all tasks hold the list (CODED * 12 bytes). Others travel as 64 bits.
CODED = 1 << 20
#: Places of a prefix in one task, as long as there are not over CODED times as many in all.
PLACES = 1 << 20
#: Bytes of text at a time, and distinct pointers that a task holds before it adds up equal ones.
TEXT_BYTES, HELD = 4 << 20, 1 << 20
#: Bits of a code. Two codes in one number name a pointer; the second is 0 where a piece ends or a rare word stands.
CODE_BITS = 21
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09]] = True


def texts_by_language(docs: DataFrame) -> DataFrame:
    """(lang, text): a null text as empty, a null lang as NO_LANGUAGE."""
    return bounded(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def placed(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, piece, start, end) of each word: a 64-bit name of language and word, never 0, and where it stands."""
    data, offsets = bytes_of(batch.column("text"))
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4
    cut = BREAKS[data]
    inside = ~(cut | BLANKS[data])
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a document's text starts here
    before = np.concatenate([[False], inside[:-1]]) & ~first[:n]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    piece = np.cumsum(cut | first[:n])[start]
    lang = batch.column("lang").dictionary_encode()
    name, at = bytes_of(lang.dictionary)
    salt = mixed(span_hashes(name, at[:-1], at[1:]) + np.uint64(seed))[lang.indices.to_numpy()]
    word = span_hashes(lowered(data) ^ np.uint8(seed), start, end)
    return np.maximum(mixed(word ^ salt[doc]), np.uint64(1)), doc, piece, start, end


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span whose number is in to."""
    size = ends - starts
    wide = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    same = size == size[to]
    rows, at = np.flatnonzero(same & (to != np.arange(len(to)))), 0
    while len(rows):
        differ = (wide[starts[rows] + at] ^ wide[starts[to[rows]] + at]) & FIRST_BYTES[np.minimum(size[rows] - at, 8)]
        same[rows[differ != 0]] = False
        at += 8
        rows = rows[(differ == 0) & (size[rows] > at)]
    return same


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(key, lang, word, n): the occurrences of every word of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, TEXT_BYTES):
            key, doc, _, start, end = placed(batch, seed)
            if len(key):
                data = lowered(bytes_of(batch.column("text"))[0])
                lang = batch.column("lang").dictionary_encode()
                spoken = lang.indices.to_numpy()[doc]
                names, at, which = np.unique(key, return_index=True, return_inverse=True)
                same = equal_spans(data, start, end, at[which]) & (spoken == spoken[at][which])
                other = np.flatnonzero(~same)  # two words with one key: each one tells the vocabulary
                at, n = np.append(at, other), np.append(np.bincount(which[same]), np.ones(len(other), np.int64))
                text = data.tobytes()
                words = pa.array([text[i:j] for i, j in zip(start[at].tolist(), end[at].tolist())], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), lang.dictionary.take(pa.array(spoken[at])), words, pa.array(n)], ["key", "lang", "word", "n"])

    return texts.mapInArrow(run, "key long, lang string, word string, n long").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def vocabulary(tables: Tables, texts: DataFrame) -> tuple[DataFrame, int]:
    """word_counts() with a seed under which no two words have the same key, and the seed."""
    seed = 0
    while True:
        words = tables.saved(word_counts(texts, seed), "words")
        if words.groupBy("key").agg(F.count("*").alias("same")).where("same > 1").isEmpty():
            return words, seed
        tables.drop(words)
        seed += 1


def places_of(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Each one's place in the list of keys; 0, where a key that no word has stands, for those not in it."""
    at = np.searchsorted(keys, some)
    at[at == len(keys)] = 0
    return np.where(keys[at] == some, at, 0)


def listed(words: DataFrame, least: int, coded: int, places: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(keys in ascending order, tasks of each, whether there are frequent words besides): the most frequent words, coded of them at most.

    Words are taken by eighths of a power of two of their occurrences, as many as fit whole.
    """
    size = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    frequent = words.where(F.col("n") >= least)
    sizes = frequent.groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect()  # 500 rows at most
    fit, from_size = 0, None
    for row in sizes:
        if fit + row["words"] > coded:
            break
        fit, from_size = fit + row["words"], row["size"]
    limit = max(places, -(-words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // coded))
    none = (np.zeros(1, np.uint64), np.ones(1, np.int32), bool(sizes))
    if from_size is None:
        return none
    rows = frequent.where(size >= from_size).select("key", F.ceil(F.col("n") / limit).cast("int").alias("tasks")).toPandas()  # coded rows at most
    keys = np.append(none[0], rows["key"].to_numpy(np.int64).view(np.uint64))
    order = np.argsort(keys)
    return keys[order], np.append(none[1], rows["tasks"].to_numpy(np.int32))[order], fit < sum(r["words"] for r in sizes)


def pointers(texts: DataFrame, seed: int, known) -> DataFrame:
    """(prefix, shard, wide, second, third, n): for each prefix of a slice its distinct pointers, as bytes.

    With wide, second and third hold keys, 0 for none; else second holds both codes and third nothing.
    known: what listed() returns.
    """

    def binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
        offsets = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])

    def rows(prefix: np.ndarray, shard: np.ndarray, second: np.ndarray, third: np.ndarray, n: np.ndarray, wide: bool) -> pa.RecordBatch:
        """One row for each prefix and shard; they come in order."""
        start = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (shard[1:] != shard[:-1])])) if len(prefix) else np.zeros(0, np.int64)
        empty = binary(np.zeros(0, np.int64), np.zeros(len(start), np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(prefix[start].view(np.int64)), pa.array(shard[start], pa.int32()), pa.array(np.full(len(start), wide)), binary(second, start), binary(third, start) if wide else empty, binary(n.astype(np.uint32), start)],
            ["prefix", "shard", "wide", "second", "third", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tasks, more = known.value
        for batch in pieces(batches, TEXT_BYTES):
            key, _, piece, _, _ = placed(batch, seed)
            if len(key) < 2:
                continue
            code = places_of(keys, key)
            coded = code > 0
            use = coded | more
            follows = np.append(piece[1:] == piece[:-1], False)
            second = follows & use & np.append(use[1:], False)
            at = np.flatnonzero(second)
            third = second[np.minimum(at + 1, len(key) - 1)]
            last = np.minimum(at + 2, len(key) - 1)
            narrow = coded[at] & coded[at + 1] & (coded[last] | ~third)
            i = at[narrow]
            packed, n = np.unique(code[i] << 2 * CODE_BITS | code[i + 1] << CODE_BITS | np.where(third[narrow], code[last[narrow]], 0), return_counts=True)
            first, post = packed >> 2 * CODE_BITS, packed & (1 << 2 * CODE_BITS) - 1
            shard = (mixed(post.astype(np.uint64)) % tasks[first].astype(np.uint64)).astype(np.int32)
            if len(shard) and shard.max():
                order = np.lexsort((post, shard, first))
                first, post, shard, n = first[order], post[order], shard[order], n[order]
            yield rows(keys[first], shard, post, post, n, False)
            if more and not narrow.all():
                i = at[~narrow]
                names = np.stack([key[i], key[i + 1], np.where(third[~narrow], key[last[~narrow]], np.uint64(0))])
                names, n = np.unique(names, axis=1, return_counts=True)
                shard = (mixed(names[1] ^ mixed(names[2])) % tasks[places_of(keys, names[0])].astype(np.uint64)).astype(np.int32)
                order = np.lexsort((names[2], names[1], shard, names[0]))
                yield rows(names[0][order], shard[order], names[1][order], names[2][order], n[order], True)

    return texts.mapInArrow(run, "prefix long, shard int, wide boolean, second binary, third binary, n binary")


def grown(columns: list[np.ndarray], n: np.ndarray, least: int, whole: bool, prefix: tuple, out: list) -> None:
    """Add (phrase, occurrences) of the prefix with each next word, depth first. columns: the words after the prefix, 0 for none.

    With whole, these are all places of the prefix, and rare phrases go; else those whose
    words reach the end of the pointers are whole, and counts of shorter ones are shares.
    """
    here = np.flatnonzero(columns[0])
    here = here[np.argsort(columns[0][here], kind="stable")]
    word = columns[0][here]
    starts = np.flatnonzero(np.diff(word, prepend=np.zeros(1, word.dtype))) if len(word) else np.zeros(0, np.int64)
    if not len(starts):
        return
    n = n[here]
    total, ends = np.add.reduceat(n, starts), np.append(starts[1:], len(word))
    last = len(columns) == 1
    for k in np.flatnonzero(total >= (least if whole or last else 1)).tolist():
        phrase, some = (*prefix, int(word[starts[k]])), slice(starts[k], ends[k])
        out.append((phrase, int(total[k])))
        if not last and total[k] >= least:
            grown([c[here[some]] for c in columns[1:]], n[some], least, whole, phrase, out)


def phrases(projected: DataFrame, known, least: int) -> DataFrame:
    """(first, second, third, n) of the phrases of two and three words that occur often enough; third is null for two."""

    def summed(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pointers in order, and how often each occurs."""
        second, third, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((third, second))
        second, third, n = second[order], third[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], (second[1:] != second[:-1]) | (third[1:] != third[:-1])]))
        return second[starts], third[starts], np.add.reduceat(n, starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tasks, _ = known.value
        now, held, size, out = None, [], 0, []

        def finished() -> None:
            prefix = np.array([now[0]]).view(np.uint64)
            second, third, n = summed(held)
            grown([second, third], n, least, tasks[places_of(keys, prefix)[0]] == 1, (int(prefix[0]),), out)

        def table() -> pa.RecordBatch:
            columns = [np.array([(p + (0,))[k] for p, _ in out], np.uint64).view(np.int64) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], mask=columns[2] == 0), pa.array([n for _, n in out], pa.int64())], ["first", "second", "third", "n"])

        for batch in batches:
            for prefix, shard, wide, second, third, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (prefix, shard):
                    if held:
                        finished()
                    now, held, size = (prefix, shard), [], 0
                    if len(out) > 50_000:
                        yield table()
                        out.clear()
                second, n = np.frombuffer(second, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64)
                if wide:
                    held.append((second, np.frombuffer(third, np.uint64), n))
                else:
                    held.append((keys[(second >> np.uint64(CODE_BITS)).astype(np.int64)], keys[(second & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)], n))
                size += len(n)
                if size > 2 * HELD:
                    held = [summed(held)]
                    size = len(held[0][2])
        if held:
            finished()
        yield table()

    # A partition has all rows of its prefixes, or of their shards, one prefix after another.
    parts = projected.repartition("prefix", "shard").sortWithinPartitions("prefix", "shard")
    found = parts.mapInArrow(run, "first long, second long, third long, n long")
    return found.groupBy("first", "second", "third").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def score(left: str, right: str) -> F.Column:
    """floor(1000000 * a * a / (left * right)), exact for counts of up to 15 digits."""
    exact = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({exact('a')} * {exact('a')})) div ({exact(left)} * {exact(right)})")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = 50, coded: int = CODED, places: int = PLACES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of two and three words with the highest scores in each language.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces
    into words at blanks and tabs. a, l, r: occurrences of the phrase and of the two parts
    of its lowest-scoring cut (ties: the earlier cut); n: words of the language; score:
    floor(1000000 * a * a / (l * r)), exact. A phrase goes if a longer one that occurs often
    enough holds it and has percent of its occurrences. Ties: larger a, then the phrase by its bytes.
    Null texts are as empty ones, a null lang is ``und``; repeated rows count as often as
    they occur. An empty table, or one without frequent phrases, gives no rows. The result
    is a table in the shared folder.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "phrases")
    texts = texts_by_language(docs)
    words, seed = vocabulary(tables, texts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    known = spark.sparkContext.broadcast(listed(words, least, coded, places))
    often = tables.saved(phrases(pointers(texts, seed, known), known, least), "phrases")
    known.unpersist()

    pairs = often.where("third is null").select("first", "second", F.col("n").alias("a"))
    triples = often.where("third is not null").select("first", "second", "third", F.col("n").alias("a"))
    named = lambda c, k: frequent.select(F.col("key").alias(c), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}"), *([F.col("lang")] if k == 1 else []))

    longer = triples.select("first", "second", "a").union(triples.select("second", "third", "a").toDF("first", "second", "a")).groupBy("first", "second").agg(F.max("a").alias("longer"))
    two = pairs.join(longer, ["first", "second"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    two = two.join(named("first", 1), "first").join(named("second", 2), "second")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), score("n1", "n2").alias("score"))
    three = triples.join(pairs.select("first", "second", F.col("a").alias("n12")), ["first", "second"]).join(pairs.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("n23")), ["second", "third"])
    three = three.join(named("first", 1), "first").join(named("second", 2), "second").join(named("third", 3), "third")
    three = three.withColumn("s1", score("n1", "n23")).withColumn("s2", score("n12", "n3"))
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"), F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.union(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out = ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = tables.saved(out, "found")
    tables.keep_only(out)
    return out
