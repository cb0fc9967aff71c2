"""The pipeline against a brute-force version on a small table with planted cases."""

import random
import re

import pytest

import corpus_pipeline
from strataform.llm.common import saved

WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


@pytest.fixture(scope="module")
def texts():
    base, passage = prose(1, 200), prose(2, 60)
    texts = {0: None, 1: "12 34 !", 2: base, 3: base.replace("a", "A", 3), 4: base + " tail", 5: prose(3, 90) + " " + passage, 6: passage + " " + prose(4, 90)}
    texts |= {7: prose(5, 40) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(6, 40), 8: prose(7, 3000), 9: "clean short text", 10: ""}
    return texts | {i: prose(i, 50) for i in range(20, 40)}


def by_hand(texts):
    """(documents kept by the first four stages with their texts)."""
    known = {k: t for k, t in texts.items() if t and any(c.isalpha() for c in t)}
    kept = {}
    for k, t in sorted(known.items()):
        mine = shingles(t)
        if not any(100 * len(mine & shingles(u)) >= 75 * len(mine | shingles(u)) for u in kept.values()):
            kept[k] = t
    out = {}
    for k, t in kept.items():
        words, drop = t.split(" "), set()
        for j, u in kept.items():
            if j < k:
                others = u.split(" ")
                runs = {tuple(others[i : i + 50]) for i in range(len(others) - 49)}
                for i in range(len(words) - 49):
                    if tuple(words[i : i + 50]) in runs:
                        drop |= set(range(i, i + 50))
        left = " ".join(w for i, w in enumerate(words) if i not in drop)
        out[k] = re.sub(r'token = "[0-9a-f]{40}', "[secret]", left)
    return out


def test_stages(spark, texts):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "xx", "s", len(t or "")) for k, t in texts.items()], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    rows = docs.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == by_hand(texts)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}


def test_run(spark, texts, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "xx", "s", len(t or "")) for k, t in texts.items()], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(by_hand(texts))


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
