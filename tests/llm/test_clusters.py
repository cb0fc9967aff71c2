"""Rounds of Lloyd against brute force in Python's whole numbers."""

import hashlib
import math
import random

import pytest

from strataform.llm import lloyd_clusters

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string, distance string, n long, sums int"


def by_hand(rows, centroids, rounds, length, scale=256):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    middle = [v for _, v in sorted(good, key=lambda x: (digest(f"2:{x[0]}"), x[1]))[:centroids]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), k) for k, c in enumerate(middle))
    for _ in range(rounds):
        members = [[] for _ in middle]
        for _, v in good:
            members[near(v)[1]].append(v)
        middle = [[sum(x) // len(m) for x in zip(*m)] if m else c for c, m in zip(middle, members)]
    found = [(i, *near(v)) for i, v in good]
    inside = [sum(d for _, d, k in found if k == c) for c in range(len(middle))]
    return sorted((i, k, d, inside[k], sum(inside), digest(",".join(map(str, middle[k])))) for i, d, k in found)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", "d", 2, 3) for i, v in rows], SCHEMA)


def vectors(seed, n, length):
    r = random.Random(seed)
    middles = [[r.randint(-32, 32) / 8 for _ in range(length)] for _ in range(5)]
    return [(i, [x + r.randint(-8, 8) / 32 for x in r.choice(middles)]) for i in range(n)]


def odd_rows(length):
    rows = vectors(3, 120, length) + [(200 + i, [0.5] * length) for i in range(60)]  # a very common vector
    rows += [(300, None), (301, []), (302, [1.0] * (length - 1)), (303, [1.0] * (length + 1)), (304, [None] + [1.0] * (length - 1)), (305, [math.nan] * length), (306, [math.inf] * length)]
    return rows + [(None, [1.0] * length), (5, [9.0] * length), (5, [9.0] * length), (6, [0.0] * length), (307, [-0.001] * length)]


@pytest.mark.parametrize("centroids, rounds, length", [(7, 5, 4), (40, 5, 8), (3, 0, 4), (500, 2, 3)])
def test_equal_to_brute_force(spark, centroids, rounds, length):
    rows = odd_rows(length)
    got = lloyd_clusters.clusters(table(spark, rows).repartition(5), centroids, rounds, length)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, centroids, rounds, length)


def test_a_centroid_without_vectors_stays(spark):
    rows = [(i, [1.0, 2.0]) for i in range(12)] + [(20, [5.0, 5.0])]  # equal starts: all vectors go to the lowest
    got = lloyd_clusters.clusters(table(spark, rows), 6, 3, 2)
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, 6, 3, 2)


def test_no_vectors(spark):
    assert lloyd_clusters.clusters(table(spark, [(1, [1.0])])).count() == 0
    assert lloyd_clusters.clusters(table(spark, [])).count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        lloyd_clusters.clusters(table(spark, [(1, [1e17, 0.0])]), 3, 1, 2)
