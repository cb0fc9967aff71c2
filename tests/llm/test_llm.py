"""Each operator against brute force, a round trip or held-out accuracy, on small tables with odd rows."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers

from strataform.llm import additive_quantisation, block_pruning, common, huffman_files, language_id, merge_replay, minhash_forest, packing, passages, secret_scan, subwords, token_counts, vector_blocks

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, kept string, score double, row string, _text string, _spans int, id string, letters string, `a.b` int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def edited(text, seed, every):
    r = random.Random(seed)
    return " ".join(w if r.random() > 1 / every else "changed" + str(r.randint(0, 999)) for w in text.split(" "))


def odd_texts():
    a, b = prose(1, 120), prose(2, 400)
    texts = [None, "", "   ", "?!", "word", "Two Words", "two words", a, a, a.upper(), edited(a, 3, 60), edited(a, 4, 60), edited(a, 5, 8), b, prose(6, 30) + " " + a[: len(a) // 2] + " " + prose(7, 30)]
    texts += [prose(8, 20000), "x" * 5000, " ".join(["same"] * 300), "naïve Élan straße ŒUVRE ΣΑΣ 日本語のテキスト 😀 <|endoftext|> it's I'LL ٣٤", "tab\tline\nend\r\n  spaces   ", "1 22 333 4,444.55 -- ... !!", "\x1c\x85 odd spaces"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), 7, "clash", 0.5, "r", "t", 1, "i", "l", 2) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def shingles(text):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def by_hand_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def test_near_duplicates_equal_brute_force(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_forest.near_duplicates(docs).collect()}
    assert got == by_hand_components(texts_of(docs))


def test_near_duplicates_of_a_large_group(spark):
    base = prose(11, 150)
    rows = [(i, edited(base, i, 40)) for i in range(300)] + [(1000 + i, prose(i + 50, 60)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_forest.near_duplicates(df).collect()}
    assert got == by_hand_components(dict(rows))


def test_near_duplicates_beyond_regions(spark):
    """Many texts with a common core, just not alike, and some pairs that are: regions of very few rows split them again and again."""
    core = prose(12, 150).split()

    def text(seed, own):
        r = random.Random(seed)
        words = list(core)
        for k in r.sample(range(150), own):
            words[k] = f"w{seed}x{k}"
        return words

    rows = [(i, " ".join(text(i, 6))) for i in range(400)]
    for i in range(30):  # a pair shares the changed words of one, and has one more change
        words = text(i, 6)
        words[75] = f"pair{i}"
        rows.append((1000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_hand_components(dict(rows))
    assert len({c for _, c, _ in want.values()}) > 200
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_forest.near_duplicates(df, region=40, reach=1, trees=2).collect()}
    assert got == want


@pytest.mark.parametrize("varied", [2, 14, 26])
def test_near_duplicates_of_one_template(spark, varied):
    """Texts of one template, most of them not alike, with pairs that are: no region is small, and shingles of the template have more documents than any region."""
    core = prose(700, 80).split()
    r, rows = random.Random(varied), []
    for k in range(0, 600, 2):
        own = prose(8000 + 100 * varied + k, varied).split()
        rows.append((k, " ".join(core + own)))
        again = own[: varied - 1] + ["new"] if r.random() < 0.3 else prose(9000 + 100 * varied + k, varied).split()
        rows.append((k + 1, " ".join(core + again)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_forest.near_duplicates(df, region=32, trees=3, depth=3).collect()}
    assert got == by_hand_components(dict(rows))


def test_near_duplicates_of_thousands_alike(spark):
    """5,000 near copies that differ in one word each, and copies with a changed half: all minima of a tree alike in far more rows than a region has."""
    base = prose(13, 60).split()
    rows = [(i, " ".join([*base[: i % 60], f"n{i}", *base[i % 60 + 1 :]])) for i in range(5000)] + [(9000 + i, " ".join([*base[:30], *prose(700 + i, 30).split()])) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region=256).collect()}
    assert {got[i] for i in range(5000)} == {0} and all(got[9000 + i] == 9000 + i for i in range(40))


def test_regions_of_few_tables(spark):
    """The shortest prefix that few enough rows have, whatever the depth; all depths are counted in two tables."""
    r, rows = random.Random(7), []
    for k in range(600):
        for tree in range(3):
            rows.append((k, 9, bytes([0, tree]) + b"".join(bytes([0, 0 if r.random() < 0.8 else r.randrange(3)]) for _ in range(6))))
    rows += [(1000 + k, 9, bytes([0, 5]) + bytes(12)) for k in range(90)]  # alike at every depth: in no region
    forest = spark.createDataFrame(rows, "doc_id long, n_shingles long, label binary")
    many = collections.Counter(label[:n] for _, _, label in rows for n in range(6, 15, 2))
    want, large = set(), set()
    for doc, _, label in rows:
        n = next((n for n in range(6, 15, 2) if many[label[:n]] <= 40), None)
        if n and many[label[:n]] > 3:
            want.add((label[:n], doc))
        if many[label[:6]] > 40:
            large.add(doc)
    tables = common.Tables(spark, "test-regions")
    members, split = minhash_forest.regions(tables, forest, 6, 2, 2, 40)
    got = [(bytes(x["region"]), x["doc_id"]) for x in members.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {x["doc_id"] for x in split.collect()} == large and len({len(x) for x, _ in want}) > 2
    assert sum(path.endswith("-counts") for path, _ in tables.paths.values()) <= 2


def test_components_of_few_links_take_no_rounds(spark):
    """Links that one task can hold are joined at once: a step of shuffles over all partitions costs seconds even where it moves next to nothing."""
    tables = common.Tables(spark, "test-components")
    edges = spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long")
    assert {r["component"] for r in common.components(edges, tables).collect()} == {0}
    assert len(tables.paths) <= 3


@pytest.mark.parametrize("most", [4, 40, 400])
def test_components_in_rounds(spark, most):
    """More links than a task may hold: rounds over tables end at the same components."""
    r = random.Random(most)
    links = [(i, i + 1) for i in range(0, 100)] + [(200, k) for k in range(201, 260)] + [(r.randrange(300, 700), r.randrange(300, 700)) for _ in range(190)] + [(900 + i, 950 - i) for i in range(25)]
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = [(x["node"], x["component"]) for x in common.components(spark.createDataFrame(links, "a long, b long").repartition(7), most=most).collect()]
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert len(got) == len(dict(got)) and dict(got) == {x: root[x] for x in root if x not in alone}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 499), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 499, 499: 499}


def test_passages(spark, docs, empty):
    shared, other = prose(21, 60), prose(22, 400)
    rows = [(1, prose(23, 80) + " " + shared + " " + prose(24, 50)), (2, shared + " " + prose(25, 70)), (3, prose(26, 200)), (4, other), (5, edited(other, 27, 25)), (6, prose(28, 100) + " " + " ".join(shared.split()[:30])), (None, shared), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["other_id"]): r for r in passages.passages(df).collect()}
    assert set(found) == {(2, 1), (5, 4)}
    r = found[2, 1]
    assert (r["start"], r["end"], r["other_start"], r["other_end"], r["matched"]) == (0, 60, 80, 140, 1.0)
    assert found[5, 4]["end"] - found[5, 4]["start"] > 380 and found[5, 4]["matched"] > 0.9
    cut = {r["doc_id"]: r["text"] for r in passages.without_passages(df, passages.passages(df)).collect()}
    assert cut[2] == rows[1][1].split(" ", 60)[60] and cut[1] == rows[0][1] and cut[8] is None and cut[None] == shared
    assert passages.passages(empty).count() == 0 and passages.without_passages(empty, passages.passages(empty)).count() == 0
    found = passages.passages(docs)
    assert passages.without_passages(docs, found).columns == docs.columns and passages.without_passages(docs, found).where("doc_id in (7, 15)").count() == 2
    pairs = {(r["doc_id"], r["other_id"]) for r in found.collect()}
    assert {(8, 7), (9, 7), (10, 7), (11, 7), (14, 7)} <= pairs and not any(a in (15, 16, 18) for a, _ in pairs)


def test_passages_deal_texts_once(spark, monkeypatch):
    """Joins by document find the texts in buckets and don't shuffle them; table and files go with the run."""
    read = []
    monkeypatch.setattr(passages, "text_of", lambda docs: read.append(docs) or common.text_of(docs))
    words = prose(61, 60)
    df = spark.createDataFrame([(k, prose(600 + k, 60) + " " + words) for k in range(3)], "doc_id long, text string")
    assert passages.passages(df).count() == 3 and len(read) == 2  # for the seeds, and for the buckets
    tables = common.Tables(spark, "test")
    texts = tables.bucketed(df, "doc_id", 8, "texts")
    both = texts.join(spark.range(3).withColumnRenamed("id", "doc_id").hint("merge"), "doc_id")
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and both.count() == 3
    name, = tables.named.values()
    tables.keep_only()
    assert not spark.catalog.tableExists(name) and not any(t.name.startswith("texts_") for t in spark.catalog.listTables())


def test_passages_broadcast_no_table_that_grows(spark, monkeypatch):
    """Small tables are broadcast unless a hint says otherwise; only the ends of partitions may be, however small the others are."""
    plans, write = {}, common.Tables.saved

    def saved(self, df, name="table", over=()):
        plans[len(plans), name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, name, over)

    monkeypatch.setattr(common.Tables, "saved", saved)
    one, two = prose(91, 30), prose(92, 30)
    rows = [(k, prose(920 + k, 60) + " " + t + " " + prose(940 + k, 60)) for k, t in enumerate([one, one, two, two, one + " " + two, one + " " + two])]
    assert [(r["doc_id"], r["other_id"]) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [(5, 4)]
    assert {"spans", "asked", "runs", "cuts", "found"} <= {name for _, name in plans}
    assert [k for k, plan in plans.items() if "Broadcast" in plan and k[1] != "edges"] == []


def test_passages_of_two_stock_sentences(spark):
    one, two = prose(31, 30), prose(32, 30)
    texts = {1: one, 2: one, 3: two, 4: two, 10: one + " " + two, 20: one + " " + two}
    rows = [(k, prose(100 + k, 60) + " " + t + " " + prose(200 + k, 60)) for k, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.passages(df)
    assert [(r["doc_id"], r["start"], r["end"], r["other_id"], r["other_start"], r["n_matched"]) for r in found.collect()] == [(20, 60, 120, 10, 60, 60)]
    cut = {r["doc_id"]: r["text"] for r in passages.without_passages(df, found).collect()}
    assert cut == {k: t for k, t in rows} | {20: prose(120, 60) + " " + prose(220, 60)}


def test_passages_between_later_holders(spark):
    words = prose(41, 60).split()
    pieces = [words[i : i + 25] for i in range(0, 36, 6)] + [words[35:]]
    rows = [(2 * k + j, prose(300 + 2 * k + j, 80) + " " + " ".join(p) + " " + prose(400 + 2 * k + j, 80)) for k, p in enumerate(pieces) for j in range(2)]
    rows += [(900, prose(42, 100) + " " + " ".join(words) + " " + prose(43, 40)), (901, prose(44, 30) + " " + " ".join(words) + " " + prose(45, 90))]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any((r["doc_id"], r["other_id"]) == (901, 900) and r["start"] <= 30 and r["end"] >= 90 for r in found)
    assert all(r["doc_id"] == 901 and r["start"] >= 25 and r["end"] <= 95 for r in found)


def test_fuzzy_passages_between_later_holders(spark):
    """Each half of a passage with changed words is in other documents first, so that neither the first holder nor the one before has enough of it."""
    words = prose(71, 64).split()
    changed = [f"new{i}" if i % 16 == 8 else w for i, w in enumerate(words)]
    part = lambda k, a: (k, prose(700 + k, 80) + " " + " ".join(words[a : a + 32]) + " " + prose(800 + k, 80))
    rows = [part(1, 0), part(2, 32), part(11, 0), part(12, 32)]
    rows += [(k, prose(700 + k, 80) + " " + " ".join(x) + " " + prose(800 + k, 80)) for k, x in ((10, words), (20, changed))]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["other_id"]) for r in found] == [(20, 10)]
    assert found[0]["start"] <= 81 and found[0]["end"] >= 143 and found[0]["n_matched"] == 60


def test_frequent_seeds_are_seen_where_they_lie(spark):
    """Of a seed with very many places, only the few rows at the ends of batches aren't known to be such."""
    rows = [(i, 0, 5) for i in range(30000)] + [(i, 1, 6) for i in range(3)]
    tables = common.Tables(spark, "test")
    _, shared = passages.counted(tables, tables.saved(spark.createDataFrame(rows, "doc_id long, pos int, seed long")), 3)
    n, few = collections.Counter(), collections.Counter()
    for r in shared.collect():
        n[r["seed"]] += 1
        few[r["seed"]] += r["seen"] <= passages.HOLDERS
    assert n[6] == few[6] == 3 and n[5] >= 30000 and few[5] <= 400


def test_passages_far_apart_are_several(spark):
    one, two = prose(51, 600), prose(52, 600)
    rows = [(1, one + " " + prose(53, 1000) + " " + two), (2, one + " " + prose(54, 3000) + " " + two)]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["start"], r["end"], r["other_start"], r["other_end"]) for r in found) == [(0, 600, 0, 600), (3600, 4200, 1600, 2200)]


def test_passages_with_changed_words(spark):
    """Of fuzzy passages that are long and alike enough between their first and last equal words, most are found; fewer, the share is printed, if one word in six or five is another."""
    rows, cases, r, k = [], {}, random.Random(7), 0
    for percent, n, spaced in itertools.product((80, 83, 87.5, 90, 95), (60, 100, 200), (True, False)):
        for _ in range(12):
            k, text, every = k + 1, prose(1000 + k, n).split(), round(100 / (100 - percent))
            at = r.randrange(every)
            same = [i % every != at if spaced else r.random() < percent / 100 for i in range(n)]
            changed = [w if x else f"new{i}" for i, (w, x) in enumerate(zip(text, same))]
            rows += [(2 * k, prose(20000 + k, 60) + " " + " ".join(text) + " " + prose(30000 + k, 60)), (2 * k + 1, prose(40000 + k, 60) + " " + " ".join(changed) + " " + prose(50000 + k, 60))]
            inner = same[same.index(True) : n - same[::-1].index(True)]
            if len(inner) >= 50 and sum(inner) >= 0.8 * len(inner):
                cases[2 * k + 1] = (percent, n)
    found = collections.Counter()
    for x in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert x["other_id"] == x["doc_id"] - 1 and x["matched"] >= passages.LEAST_MATCH
        found[x["doc_id"]] += x["end"] - x["start"]
    share = collections.defaultdict(list)
    for k, (percent, n) in cases.items():
        share[percent, n].append(found[k] >= 0.5 * n)
    share = {k: sum(x) / len(x) for k, x in share.items()}
    print(share)
    assert all(share[percent, n] >= 0.9 for percent in (90, 95) for n in (60, 100, 200)) and all(share[87.5, n] >= 0.75 for n in (60, 100, 200))


def test_ends_grow_over_dropped_words():
    x = np.arange(100, 140)
    y = np.concatenate([x[:7], x[8:20], [1, 2], x[20:30], np.arange(500, 520)])
    assert passages.grown(x, y) == (30, 31, 29) and passages.grown(x, x[:0]) == (0, 0, 0) and passages.grown(x, x[1:]) == (40, 39, 39)


def test_matches_across_partitions(spark):
    """However the sorted seeds are dealt, every later holder of a seed is linked with an earlier one."""
    rows = [(i, i % 7, 5) for i in range(200)] + [(i, 3, 9) for i in range(5)] + [(3, 4, 9), (3, 8, 9), (4, 8, 9), (1, 1, 77)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, seed long")
    tables = common.Tables(spark, "test")
    links, shared = passages.linked(tables, tables.saved(df.repartition(3)))
    assert sorted(tuple(r) for r in shared.distinct().collect()) == sorted(set(rows) - {(1, 1, 77)})
    of = collections.defaultdict(set)
    for doc, pos, other, at in links.collect():
        assert other < doc and any((other, at, seed) in rows and (doc, pos, seed) in rows for seed in (5, 9))
        of[doc, pos].add(other)
    assert all(of[doc, pos] for doc, pos, seed in rows if seed == 5 and doc)
    assert {(4, 8), (4, 3), (3, 4), (3, 8), (1, 3)} <= set(of)


def test_chain_scores_equal_brute_force():
    r = random.Random(5)
    for _ in range(100):
        links = sorted({(r.randint(0, 60), r.randint(0, 60)) for _ in range(r.randint(1, 25))})
        p, q = np.array([x for x, _ in links]), np.array([y for _, y in links])
        score = []
        for j in range(len(links)):
            best = max([score[i] - passages.GAP * (p[j] - p[i] + q[j] - q[i]) for i in range(j) if p[i] < p[j] and q[i] < q[j]], default=0)
            score.append(passages.SEED + max(0, best))
        chains = passages.chains_of(p, q)
        assert sorted(i for c in chains for i in c) == list(range(len(links)))
        first = chains[0]
        got = passages.SEED * len(first) - passages.GAP * sum(p[b] - p[a] + q[b] - q[a] for a, b in zip(first, first[1:]))
        assert got == pytest.approx(max(score))


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def by_hand_secrets(x):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark, docs, empty):
    r = random.Random(9)
    keys = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64)) for _ in range(5)]
    texts = ["é😀 Token = 'abc' secret:\"abcdef1\" token=token:abcdefgh", "AKIA" + "Z" * 15 + " AKIA" + "Q1" * 8, "0123456789abcdef" * 2 + " api_key= " + "f" * 24, None, "", "thisisaverylongordinarywordthatcontinuesforawhileandawhile " * 3, *(f"see {k} there" for k in keys), "AKIAAKIA" + "B" * 20, "PASSWORD:   hunter2hunter2, apikey='zz.zz-zz'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secret_scan.secrets(df).collect():
        base = by_hand_secrets(texts[r["doc_id"]] or "")
        written = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))
        assert r["n_random"] == (1 if 6 <= r["doc_id"] <= 10 else 0), texts[r["doc_id"]]
    masked = {r["doc_id"]: r["text"] for r in secret_scan.masked(df).collect()}
    assert masked[6] == "see [secret] there" and masked[3] is None and masked[5] == texts[5] and masked[1] == "AKIA" + "Z" * 15 + " [secret]"
    assert secret_scan.secrets(empty).count() == 0
    assert secret_scan.secrets(docs).count() == docs.count() and secret_scan.masked(docs).columns == docs.columns


def test_many_secrets_in_one_text(spark):
    r = random.Random(12)
    part = lambda: r.choice(["é 😀 plain words", "token=" + "ab1" * r.randint(2, 9), "AKIA" + "Q7" * 9, "0a1b2c3d" * r.randint(3, 6), 'secret: "' + "f0" * 13 + '"', "passwd=AKIA" + "Z" * 16])
    texts = [" ".join(part() for _ in range(n)) for n in (1, 255, 256, 257, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.secrets(df).collect()}
    for r in secret_scan.masked(df).collect():
        text, out, at = texts[r["doc_id"]], "", 0
        own = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in spans[r["doc_id"]].split(",") if x))
        assert [x for x in own] == sorted(set(own) | {(a, b) for a, _, b in by_hand_secrets(text)})
        while own:
            a, b = own.pop(0)
            while own and own[0][0] <= b:
                b = max(b, own.pop(0)[1])
            out, at = out + text[at:a] + "[secret]", b
        assert r["text"] == out + text[at:]


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r, alphabet = random.Random(3), "abCÉß 0²19.,'!?#<|\t\n­ª½ſİlst"
    texts = [t or "" for t in odd_texts()] + ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(500)]
    texts += ["it's John's they'll we'Re 'tis rock'n'roll '' 'x' l'été d'", "a'", "'", "'s", "don't stop"] + [""] * 3
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    got = subwords.WordIds().of(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    assert [x.tolist() for x in got] == want


def thue_morse(n, flip=False):
    return "".join("ba"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_polynomial_hashes_confuse():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = [thue_morse(n, flip) for n in (8, 16, 256, 1024, 2048) for flip in (False, True)] + [thue_morse(1024) + thue_morse(1024), thue_morse(1024) + thue_morse(1024, True)]
    starts, ends, hashes, _ = common.Words().of(pa.array([" ".join(words)]))
    assert len(starts) == len(words) and len(set(hashes.tolist())) == len(set(words))
    got = subwords.WordIds().of(pa.RecordBatch.from_arrays([pa.array(words)], ["text"]))
    assert [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in words]


def test_words_that_share_a_hash(monkeypatch):
    from tokenizers import Tokenizer

    whole, r = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.choice([1, 5, 8, 9, 20, 300]))) for _ in range(200)]
    texts = [" ".join(r.choices(words, k=20)) for _ in range(60)]
    monkeypatch.setattr(subwords, "span_hashes", lambda data, starts, ends: np.array([int(data[a:b].sum()) % 40 for a, b in zip(starts, ends)], np.uint64))
    encoder = subwords.WordIds()
    for some in (texts[:30], texts[30:]):
        got = encoder.of(pa.RecordBatch.from_arrays([pa.array(some)], ["text"]))
        assert [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in some]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.packed(docs).collect()
    want = {}
    for k, t in texts_of(docs).items():
        ids = whole.encode(t, add_special_tokens=False).ids + [0]
        for j, at in enumerate(range(0, len(ids), 2048)):
            want[k, j] = (at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(v[1] for v in want.values()) // 2048)
    assert packing.packed(empty).count() == 0


def test_packing_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 100)
    rows = [(i, prose(i, 1 + i * 7 % 90)) for i in range(300)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), length=256).collect()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 256
    best, _ = packing.best_fit(np.array([r["length"] for r in got]), 256)
    assert len(sequences) <= 1.05 * (best.max() + 1) + 1


def unit_vectors(n, d=16, seed=0):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) + 2 * r.normal(size=(8, d))[r.integers(0, 8, n)]
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(unit_vectors(3000))]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None] * 8), (5200, [1.0]), (None, [1.0] * 16), (3000, rows[0][1]), (3001, rows[0][1]), (0, rows[0][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def taking_part(df, zero):
    out = {}
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[r["vec_id"]] = v
    return np.array(list(out)), np.array(list(out.values()))


def test_additive_quantisation_recall(spark, vectors):
    ids, v = taking_part(vectors, False)
    got = collections.defaultdict(list)
    for r in additive_quantisation.search(vectors, sample=2000).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    unit, hits = v / np.linalg.norm(v, axis=1)[:, None], 0
    queries = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    assert set(got) == {int(ids[i]) for i in queries}
    for i in queries:
        cosine = unit @ unit[i]
        cosine[i] = -2
        best = set(ids[np.argsort(-cosine)[:5]].tolist())
        mine = sorted(got[int(ids[i])])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5] and int(ids[i]) not in {x[1] for x in mine}
        assert all(abs(score - cosine[list(ids).index(k)]) < 1e-12 for _, k, score in mine)
        hits += len(best & {x[1] for x in mine})
    assert hits >= 0.9 * 5 * len(queries)
    assert [x[1] for x in sorted(got[0])[:2]] == [3000, 3001]
    assert additive_quantisation.search(vectors.limit(0)).count() == 0


def test_additive_quantisation_of_many_copies(spark):
    v = unit_vectors(600, seed=3)
    rows = [(i, v[0 if i % 3 else i // 3].tolist()) for i in range(1800)]
    got = collections.defaultdict(list)
    for r in additive_quantisation.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample=600).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    copies = [i for i in range(1800) if i % 3 or i == 0]
    assert len(got) == 36
    for q in (q for q in got if q in copies):
        assert [k for _, k in sorted(got[q])] == [k for k in copies[:6] if k != q][:5]


def test_largest_of_equal_scores():
    score, ids = np.array([[1, 2, 2, 2, 0], [5, 4, 3, 2, 1]], np.float32), np.array([[9, 8, 3, 5, 1], [1, 2, 3, 4, 5]])
    assert [sorted(x) for x in additive_quantisation.largest(score, ids, 2).tolist()] == [[2, 3], [0, 1]]


def test_block_pruning_equals_brute_force(spark, vectors):
    ids, v = taking_part(vectors, True)
    terms, want = np.floor(256 * v).astype(int), []
    for i in np.flatnonzero(ids % 50 == 0):
        scores = sorted((-int(s), int(k)) for s, k in zip(terms @ terms[i], ids) if k != ids[i])
        want += [(int(ids[i]), j + 1, k, -s) for j, (s, k) in enumerate(scores[:5])]
    assert sorted(tuple(r) for r in block_pruning.search(vectors).collect()) == sorted(want)
    few = vectors.where("vec_id in (0, 3)")
    assert len(block_pruning.search(few).collect()) == 1 and block_pruning.search(vectors.limit(0)).count() == 0


def test_block_pruning_passes_over_most_ranges(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "PASS_BYTES", 16 * 8 * 40)  # several passes
    r = np.random.default_rng(4)
    middle = 3 * r.normal(size=(40, 16))
    v = middle[r.integers(0, 40, 12_000)] + 0.1 * r.normal(size=(12_000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    share = block_pruning.pruned(df)
    print(f"{share:.3f} of pairs of queries and ranges passed over")
    assert share > 0.8
    terms, want = np.floor(256 * v).astype(int), []
    for i in range(0, 12_000, 50):
        score = terms @ terms[i]
        score[i] = -(1 << 60)
        want += [(i, j + 1, int(k), int(score[k])) for j, k in enumerate(np.lexsort((np.arange(12_000), -score))[:5])]
    assert sorted(tuple(x) for x in block_pruning.search(df).collect()) == want


def tiktoken_of(name):
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay(docs, empty):
    library, texts = tiktoken_of("byte_bpe_multi_50k.tiktoken"), texts_of(docs)
    for r in merge_replay.digests(docs).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert merge_replay.digests(empty).count() == 0


def test_merge_replay_of_repeats():
    import regex

    library, r = tiktoken_of("byte_bpe_multi_50k.tiktoken"), random.Random(2)
    words = ["".join(r.choice(["er", "ed", "ing", "a", "aa", "é", "日", "n"]) for _ in range(r.randint(1, 12))) for _ in range(2000)]
    merges = merge_replay.Merges()
    ids, first = merge_replay.replayed([w.encode() for w in words], merges)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [library.encode_ordinary(w) for w in words]
    ids, first = merge_replay.encode_batch(["", "a b", ""], merges, regex.compile(public_tokenizers.PATTERN))
    assert first.tolist() == [0, 0, 2, 2]


def test_prefix_counts(docs, empty):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), texts_of(docs)
    for r in token_counts.counts(docs).collect():
        t = texts[r["doc_id"]]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
        assert (r["bytes_within"] == r["n_bytes"]) != r["over_limit"]
    assert token_counts.counts(empty).count() == 0


def test_every_prefix_has_its_count():
    library, table, r = tiktoken_of("byte_bpe_50k.tiktoken"), token_counts.PrefixCounts(), random.Random(4)
    words = sorted({"".join(r.choice(["er", "ed", "ing", "th", "x", "é", "q", "ss"]) for _ in range(r.randint(1, 9))).encode() for _ in range(300)})
    for word, counts in zip(words, table.prefixes(words)):
        assert list(counts) == [len(library._core_bpe.encode_single_piece(word[: i + 1])) for i in range(len(word))]


def test_tokens_follow_each_other_as_in_the_whole():
    """Pairs judged by their tokens' own merges, against merges of the two together; tied ranks go to the left."""
    table, r = token_counts.PrefixCounts(), random.Random(5)
    tokens = [t for t in r.sample(sorted(table.vocabulary), 400) if table.whole(t)] + [t for t in (b"a", b"aa", b"b", b"ab", b"aaa", b"th", b"e", b" th") if table.whole(t)]
    told = {(a, b): table.fits(a, b, {}) for a in tokens[::4] + tokens[-8:] for b in tokens}
    assert told == {(a, b): table.encoded(a + b) == [a, b] for a, b in told} and len(set(told.values())) == 2
    table.merges = {(b"a", b"a"): 0, (b"aa", b"a"): 1}
    assert table.whole(b"aa") and table.whole(b"a")
    assert [table.fits(x, y, {}) for x, y in ((b"a", b"aa"), (b"aa", b"aa"), (b"aa", b"a"))] == [table.encoded(x + y) == [x, y] for x, y in ((b"a", b"aa"), (b"aa", b"aa"), (b"aa", b"a"))]


def test_language_on_held_out_text(spark, empty):
    letters = {"aa": "aeiou", "bb": "bcdfg", "cc": "éèàçù"}
    rows = []
    for i in range(300):
        r, lang = random.Random(i), ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(r.choice(letters[lang] + "lmn") for _ in range(6)) for _ in range(r.randint(3, 300))), lang))
    rows += [(900, None, "aa"), (901, "12 34 ?", "aa"), (902, "", None), (903, "aeiou alomi", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df.where(~language_id.held_out()))
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    held = [x for x in rows[:300] if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.learn(empty)
    extra = language_id.labelled(empty, none)
    assert extra.columns == [*(c for c in empty.columns if c != "score"), "lang_pred", "score"] and extra.count() == 0
    assert language_id.identify(df, none).where("lang_pred <> 'und'").count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    vocabulary = {f"l{k:02}": prose(1000 + k, 12).split() for k in range(70)}
    rows = [(i * 70 + k, " ".join(random.Random(i * 70 + k).choices(words, k=40)), lang) for i in range(3) for k, (lang, words) in enumerate(vocabulary.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    assert model["langs"] == sorted(vocabulary)
    whole = sorted(language_id.identify(df, model).collect())
    assert {r["doc_id"]: r["lang_pred"] for r in whole} == {i: lang for i, _, lang in rows}
    monkeypatch.setattr(language_id, "TABLE_BYTES", 1 << 20)
    assert len(list(language_id.blocks_of(model, 1 << 20))) > 2
    assert sorted(language_id.identify(df, model).collect()) == whole


def test_phrases_equal_a_greedy_parse():
    r = random.Random(8)
    sample = ["".join(r.choice("abc ") for _ in range(40)) for _ in range(5)] + ["a" * 7]
    codes = np.zeros(256, np.uint8)
    for k, c in enumerate(b"abc ", 1):
        codes[c] = k
    table = language_id.automaton([[int(codes[ord(c)]) for c in t] for t in sample], 6)
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 60))) for _ in range(50)]
    texts += ["".join(r.choice("abcd ") for _ in range(3000)), "a" * 5000, "ab" * 700 + "a" * 1000 + "c", sample[0] * 40]
    got = language_id.phrases(pa.array(texts), {"langs": ["x"], "codes": codes, "width": 6, "tables": [table]})[0]
    for text, n in zip(texts, got):
        count, piece = 0, ""
        for c in text:
            if any(piece + c in t for t in sample):
                piece += c
            else:
                count, piece = count + 1, c if any(c in t for t in sample) else ""
        assert n == (count + 1 if text else 0)


def test_language_with_a_small_sample(spark):
    vocabulary = {lang: prose(seed, 400).split() for lang, seed in (("large", 1), ("small", 2))}
    line = lambda seed, lang: " ".join(random.Random(seed).choices(vocabulary[lang], k=60))
    rows = [(i, line(i, "large"), "large") for i in range(64)] + [(100 + i, line(100 + i, "small"), "small") for i in range(4)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1000 + i, line(1000 + i, ("large", "small")[i % 2])) for i in range(100)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert sum(got[k] == ("large", "small")[k % 2] for k, _ in asked) >= 98


def test_huffman_files(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, at = {r["doc_id"]: r for r in huffman_files.round_trip(docs).collect()}, 0
    for k, t in sorted(texts_of(docs).items()):
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert huffman_files.round_trip(empty).count() == 0


def test_huffman_codes():
    r = np.random.default_rng(1)
    for n, longest in ((1, 16), (2, 16), (300, 16), (40_000, 16), (200, 8), (256, 8)):
        counts = np.zeros(1 << 16, np.int64)
        counts[r.choice(1 << 16, n, replace=False)] = (r.pareto(0.4, n) * 10 + 1).clip(max=1e12).astype(np.int64)
        lengths = huffman_files.code_lengths(counts, longest)
        used = np.flatnonzero(counts)
        assert (lengths[used] > 0).all() and lengths.max() <= longest and (2.0 ** -lengths[used].astype(float)).sum() <= 1
        codes, ids, width = huffman_files.codes_of(lengths)
        for size in (0, 1, 255, 256, 257, 5000):
            some = r.choice(used, size)
            bits, marks = huffman_files.encoded(some, codes, lengths)
            assert (huffman_files.decoded(bits, marks, size, ids, width) == some).all()
    counts = np.zeros(1 << 16, np.int64)
    counts[:6] = [1, 1, 2, 3, 5, 8]
    assert (huffman_files.code_lengths(counts)[:6] * counts[:6]).sum() == 2 + 4 + 7 + 12 + 20  # the sums of Huffman's merges


def test_null_and_repeated_ids(spark):
    """A row for each row, whatever its doc_id; rows without one form no links."""
    a = prose(61, 60)
    rows = [(None, a), (None, a), (None, None), (1, a), (1, a), (2, a + " more"), (3, "x")]
    df = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string")
    near = minhash_forest.near_duplicates(df).collect()
    assert len(near) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in near if r["doc_id"] is not None} == {(1, 1), (2, 1), (3, 3)}
    assert {(r["doc_id"], r["other_id"]) for r in passages.passages(df).collect()} == {(2, 1)}
    for found in (secret_scan.secrets(df), packing.packed(df), merge_replay.digests(df), token_counts.counts(df), language_id.identify(df, language_id.learn(df)), huffman_files.round_trip(df)):
        assert sorted(str(r["doc_id"]) for r in found.select("doc_id").collect()) == sorted(str(k) for k, _ in rows)


def test_tables_go(spark):
    import os

    tables = common.Tables(spark, "test-tables")
    one = tables.saved(spark.range(3), "one")
    two = tables.saved(one.selectExpr("id + 1 AS id"), "two", (one,))
    three = tables.saved(two.selectExpr("id + 1 AS id"), "three")
    assert sorted(os.listdir(tables.folder)) == ["1-two", "2-three"]
    tables.keep_only(three)
    assert os.listdir(tables.folder) == ["2-three"] and sorted(r["id"] for r in three.collect()) == [2, 3, 4]


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for value, want in (("64m", common.BATCH_BYTES), ("1m", "1m"), ("1000", "1000")):
        spark.conf.set(name, value)
        common.bounded(spark.range(1))
        assert spark.conf.get(name) == str(want)
    spark.conf.set(name, before)


def test_vectors_of_several_lengths_are_searched_by_length(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8 if i % 3 else 5).tolist()) for i in range(120)] + [(500, [1.0]), (150, [2.0]), (501, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: np.array(v) for i, v in rows if v}
    for search, score in ((additive_quantisation.search, lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))), (block_pruning.search, lambda a, b: int((np.floor(256 * a) * np.floor(256 * b)).sum()))):
        want = {}
        for q in whole:
            if q % 50 == 0:
                near = sorted((-score(whole[q], v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
                want |= {(q, k): (i, -s) for k, (s, i) in enumerate(near, 1)}
        got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in search(table).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_products_that_pass_64_bits_are_refused(spark):
    table = spark.createDataFrame([(1, [1e17, 0.0]), (50, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        block_pruning.search(table).collect()


def test_what_does_not_travel_would_not_have_fitted():
    """Sequences of several partitions: packing only the emptiest of them again gives as few as packing all of them again."""
    r, capacity = np.random.default_rng(3), 200
    for longest in (199, 150, 90):
        lengths = [r.integers(1, longest + 1, 400) for _ in range(packing.FAN)]
        fills = [np.sort(np.bincount(packing.best_fit(x, capacity)[0], x).astype(np.int64)) for x in lengths]
        all_of_them = packing.best_fit(np.concatenate(fills), capacity)[0].max() + 1
        emptiest = packing.best_fit(np.concatenate([f[:25] for f in fills]), capacity)[0].max() + 1 + sum(len(f[25:]) for f in fills)
        assert emptiest == all_of_them
