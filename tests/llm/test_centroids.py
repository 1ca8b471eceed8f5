"""Hilbert curve, zone maps and integer k-means against brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from netquarry.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, row int, key string, vector double"


@pytest.mark.parametrize(("d", "bits"), [(2, 1), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbours(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    keys = [k.tobytes() for k in centroids.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_box_bounds_lose_no_centroid():
    draw = np.random.default_rng(2)
    for _ in range(200):
        v = draw.integers(-40, 40, (20, 6))
        c = draw.integers(-80, 80, (9, 6))
        some = centroids.candidates(v.min(axis=0), v.max(axis=0), c)
        everywhere = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert set(everywhere.argmin(axis=1)) <= set(some.tolist())
        at, distance = centroids.nearest(v, c[some])
        assert (some[at] == everywhere.argmin(axis=1)).all() and (distance == everywhere.min(axis=1)).all()


def test_far_boxes_are_pruned():
    c = np.array([[0, 0], [100, 100], [0, 1]])
    assert centroids.candidates(np.array([0, 0]), np.array([3, 3]), c).tolist() == [0, 2]


def brute(rows, k=centroids.CENTROIDS, rounds=centroids.ROUNDS, size=centroids.COMPONENTS):
    def whole(x):
        return max(-(1 << 26), min(1 << 26, math.floor(64 * x)))

    kept = [(i, v, [whole(float(x)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [r[2] for r in start[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for r in kept:
            groups.setdefault(near(r[2])[1], []).append(r[2])
        for j, vs in groups.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(r[0], *near(r[2])) for r in kept]
    total = sum(d for _, d, _ in out)
    own = {j: sum(d for _, d, i in out if i == j) for j in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]

    def fits(x):
        return x if x < 1 << 63 else None

    return sorted(((i, j, d, fits(own[j]), fits(total), digest[j]) for i, d, j in out), key=repr)


def run(spark, rows, **kwargs):
    df = spark.createDataFrame([(*r, 0, "c", 1, "k", 0.5) for r in rows], SCHEMA)
    return sorted(map(tuple, centroids.cluster(df, **kwargs).assigned().collect()), key=repr)


def vectors(draw, n, size=64):
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    return [[float(np.float32(draw.gauss(c, 0.2))) for c in draw.choice(centres)] for _ in range(n)]


def test_clusters_against_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    rows = list(enumerate(vectors(draw, 400)))
    rows += [(400 + i, rows[7][1]) for i in range(300)]  # one very common vector
    draw.shuffle(rows)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, k=40, rounds=2) == brute(rows, 40, 2)


def test_odd_vectors(spark):
    draw = random.Random(6)
    some = vectors(draw, 12)
    nan, inf = float("nan"), float("inf")
    rows = list(enumerate(some))
    rows += [(3, some[3]), (3, some[3]), (3, some[5]), (None, some[1]), (None, some[2]), (20, None), (21, []), (22, some[0][:63]), (23, [*some[0], 1.0]),
             (24, [None, *some[0][1:]]), (25, [nan, *some[0][1:]]), (26, [-inf, *some[0][1:]]), (27, [0.0] * 64), (28, [-0.5 / 64] * 64)]
    assert run(spark, rows) == brute(rows)
    huge = [(30, [float(np.float32(1e30))] * 64), (31, [float(np.float32(-1e30))] * 64), (32, [float(2**14)] * 64), (33, [0.25] * 64)]
    got = run(spark, huge + rows, k=2)
    assert got == brute(huge + rows, 2)
    many = [(i, [float(np.float32((-1) ** i * 1e30))] * 64) for i in range(40)]
    assert run(spark, many, k=1, rounds=1) == brute(many, 1, 1) and run(spark, many, k=1, rounds=1)[0][4] is None


def test_few_or_no_vectors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [1.0])]) == []
    three = list(enumerate(vectors(random.Random(1), 3)))
    assert run(spark, three) == brute(three)
