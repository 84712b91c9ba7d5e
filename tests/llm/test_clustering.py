"""Centroid clustering against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from sitesieve.llm import clustering

VECTORS = "vec_id bigint, embedding array<float>, cluster string, key string"


def brute(rows, k=16, rounds=3, components=64):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in order[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    near = lambda q: min(range(len(centroids)), key=lambda c: (far(q, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q), []).append(q)
        for c, members in groups.items():
            centroids[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    found = [(i, near(q), far(q, centroids[near(q)])) for i, q in kept]
    inertia = {c: sum(d for _, x, d in found if x == c) for _, c, _ in found}
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha(c)) for i, c, d in found), key=str)


def made(rng, n, spread=0.3):
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(n)]


def test_clusters_of_odd_rows(spark):
    rng = random.Random(8)
    rows = made(rng, 500)
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[3][1])]
    rows += [(1000 + k, rows[0][1]) for k in range(300)]  # a common vector
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [None] + [0.5] * 63), (2005, [float("nan")] * 64), (2006, [float("inf")] + [0.0] * 63), (2007, [1000.0, -1000.0] * 32), (2008, [0.0] * 64)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(5)
    assert sorted(map(tuple, clustering.clusters(docs, size=32).collect()), key=str) == brute(rows)
    assert sorted(map(tuple, clustering.clusters(docs.filter("vec_id < 5"), size=2).collect()), key=str) == brute([r for r in rows if r[0] is not None and r[0] < 5])
    assert clustering.clusters(docs.limit(0)).collect() == []
    with pytest.raises(Exception, match="or more"):
        clustering.clusters(spark.createDataFrame([(1, [1e30] * 64, "", "")], VECTORS)).collect()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-300, 300, (16, 64))
    kept = 0
    for centre in centroids[:8]:
        for spread in (2, 60, 300):
            rows = centre + rng.integers(-spread, spread, (64, 64))
            low, high = rows.min(0), rows.max(0)
            least, most = clustering.box_bounds(low, high, centroids)
            far = ((rows[:, None] - centroids) ** 2).sum(2)
            assert (least <= far.min(0)).all() and (far.max(0) <= most).all()
            few = clustering.candidates(low, high, centroids)
            at, distance = clustering.nearest(rows, centroids[few])
            assert (few[at] == far.argmin(1)).all() and (distance == far.min(1)).all()
            kept += len(few)
    assert kept < 0.7 * 8 * 3 * 16
    large = rng.integers(-(2**26), 2**26, (50, 64))
    at, distance = clustering.nearest(large, large[:20])
    assert distance[:20].tolist() == [0] * 20 and at[:20].tolist() == list(range(20))


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(n, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    keys = clustering.hilbert_keys(points, bits)
    assert len(set(keys)) == len(points)
    path = points[sorted(range(len(points)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
