"""SimHash fingerprints and their components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strataform.llm import common, simhash_blocks

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, bits long, id long, mask string, n string, component string, fingerprint int"


def by_hand(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(bits, differing=3):
    """The smallest id that each one reaches, from {id: fingerprint}."""
    out, left = {}, sorted(bits)
    while left:
        root, left, todo = left[0], left[1:], [left[0]]
        out[root] = root
        while todo:
            x = todo.pop()
            near = [y for y in left if (bits[x] ^ bits[y]).bit_count() <= differing]
            out.update(dict.fromkeys(near, root))
            todo += near
            left = [y for y in left if y not in set(near)]
    return out


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(1, 9))) for _ in range(n))


def odd_texts():
    a = prose(1, 400)
    texts = [None, "", " \t\n", "word", "Two words", "two  WORDS", "a b c", "A\tb\nC", a, a.upper(), a + " tail", "new " + a, a.replace("a", "e", 3), prose(2, 60_000)]
    texts += ["naïve Élan straße ŒUVRE 日本語のテキストの長い言葉 ΣΑΣ 😀 x", "y" * 5000 + " b c", " ".join(["same"] * 900), "\x1c\x85 odd space three", *(prose(3, 300) + f" {k}" for k in range(12))]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2, "m", "n", "c", 3) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, (None, "a b c", 1, 2, "m", "n", "c", 3), (None, "nobody else", 1, 2, "m", "n", "c", 3), rows[8]], SCHEMA).repartition(3)


def test_hashes_equal_the_library():
    r = random.Random(5)
    spans = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(70), 300, 5000]]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    got = simhash_blocks.xxh64(data, ends - [len(s) for s in spans], ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(s, 42) for s in spans]


def test_fingerprints_equal_brute_force():
    texts = [t or "" for t in odd_texts()]
    got = simhash_blocks.simhashes(pa.array(texts), common.Words())
    assert got.tolist() == [by_hand(t) for t in texts]


def test_components_equal_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    want = components({r["doc_id"]: by_hand(r["text"]) for r in rows if r["doc_id"] is not None})
    got = simhash_blocks.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    prints = {f"{by_hand(r['text']):016x}" for r in rows}
    assert {r["fingerprint"] for r in got} == prints
    named = {r["fingerprint"]: r["component_id"] for r in got if r["doc_id"] is None}
    assert named[f"{by_hand('a b c'):016x}"] == 6 and named[f"{by_hand('nobody else'):016x}"] is None
    assert len(set(want.values())) < len(want)


def planted(seed, groups, most):
    """Fingerprints around some middles, up to so many bits away, and far ones."""
    r, out = random.Random(seed), set()
    for n in groups:
        middle = r.getrandbits(64)
        out |= {middle ^ sum(1 << p for p in r.sample(range(64), r.randint(0, most))) for _ in range(n)}
    return dict(enumerate(sorted(out | {r.getrandbits(64) for _ in range(100)})))


@pytest.mark.parametrize("group", [4096, 30])
def test_links_in_dense_groups(spark, group):
    """Chains and clusters, with groups small enough to be compared at once and with groups that are split."""
    bits = planted(7, [300, 200, 5, 2], 5)
    frame = spark.createDataFrame([(simhash_blocks.signed(b), i) for i, b in bits.items()], "bits long, id long")
    tables = common.Tables(spark, "test")
    found = common.components(simhash_blocks.links(tables, frame, 3, 6, group), tables).collect()
    named = {r["node"]: r["component"] for r in found}
    assert {i: named.get(i, i) for i in bits} == components(bits)


def test_forests_span_alike():
    r = random.Random(11)
    free = list(range(20, 36))
    bits = np.array(sorted({sum(1 << p for p in free if r.random() < 0.2) | 5 for _ in range(400)}), np.uint64)
    want = len(bits) - len(set(components({i: int(b) for i, b in enumerate(bits)}).values()))
    for a, b in (simhash_blocks.forest(bits, 3), simhash_blocks.forest_by_turning(bits, 3, free, 7)):
        assert (np.bitwise_count(bits[a] ^ bits[b]) <= 3).all() and len(a) == len(set(b.tolist())) == want


def test_empty_table(spark):
    out = simhash_blocks.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0
