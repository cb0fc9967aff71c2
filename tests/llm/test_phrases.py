"""Collocations against brute force in Python's whole numbers."""

import collections
import random
import re

import pytest

from strataform.llm import phrase_growth

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, phrase string, n int, first int, score double"


def by_hand(rows, least=10, top=2000):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = collections.Counter()
        for p, a in often.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    held[part] = max(held[part], a)
        best = []
        for p, a in often.items():
            if not (len(p) == 2 and held[p] and 100 * held[p] >= 50 * a):
                score, _, le, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), le, r))
        out += [(lang, i + 1, p.decode(), -a, le, r, total[lang], -score) for i, (score, a, p, le, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, 0.5) for i, (t, lang) in enumerate(rows)], SCHEMA)


def sentences(seed, n, words):
    r = random.Random(seed)
    some = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(words)]
    return " ".join(r.choice(some[: r.randint(1, words)]) + r.choice(["", "", "", "", ".", ",", "\n", "\t"]) for _ in range(n))


def odd_rows():
    rows = [(None, "en"), ("", "en"), ("  ..\n", None), ("one", None), ("A-b C, a-B c. " * 12, "en"), ("x x x x x x x x x x x x x x", "en"), ("New York City! " * 30 + "new york, " * 20, "en")]
    rows += [("New York City " * 11, "de"), ("naïve Élan\x0bstraße ŒUVRE 日本 語。 " * 15, None), ("und wörter " * 15, "und"), ("\x1c\x85 odd " * 20, ""), ("of the " * 40 + "z" * 3000, "en")]
    rows += [(sentences(k, 600, 25), "en") for k in range(12)] + [(sentences(50, 900, 12), lang) for lang in ("fr", "fr", None)]
    return rows + [rows[-1]] * 5


@pytest.mark.parametrize("most", [{}, {"coded": 12}, {"coded": 1}, {"places": 40}, {"coded": 30, "places": 50}, {"top": 7}])
def test_equal_to_brute_force(spark, most):
    """Also with a list of words too short for most of them, and with prefixes dealt to many tasks."""
    rows = odd_rows()
    want = by_hand(rows, top=most.get("top", 2000))
    got = phrase_growth.collocations(table(spark, rows).repartition(4), **most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_words_that_share_a_key_get_another_seed(spark, monkeypatch):
    whole = phrase_growth.span_hashes
    monkeypatch.setattr(phrase_growth, "span_hashes", lambda data, *ends: whole(data, *ends) % 64 if (data < 128).all() and data.any() and data[0] == ord("n") else whole(data, *ends))
    rows = [(f"n{k} often said " * 3, "en") for k in range(200)]
    got = phrase_growth.collocations(table(spark, rows).coalesce(1))
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows)


def test_a_frequent_phrase_of_large_numbers(spark):
    """Products that pass 64 bits."""
    rows = spark.range(1).selectExpr("cast(9e12 as bigint) as a", "cast(9e12 as bigint) as l", "cast(9.1e12 as bigint) as r")
    assert rows.select(phrase_growth.score("l", "r").alias("s")).first()["s"] == 10**6 * (9 * 10**12) ** 2 // (9 * 10**12 * 91 * 10**11)


def test_no_phrases(spark):
    assert phrase_growth.collocations(table(spark, [])).count() == 0
    assert phrase_growth.collocations(table(spark, [("a b c", "en")])).count() == 0
