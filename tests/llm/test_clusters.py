"""Sort-means against plain k-means in Python integers."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from itemforge.llm import sortmeans


def plain(rows, dim, k, rounds, scale):
    """(id, cluster, distance, sum in the cluster, sum, digest) by measuring everything."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [max(-(1 << 27), min(1 << 27, math.floor(v * scale) if math.isfinite(v * scale) else (1 << 40) * (1 if v > 0 else -1))) for v in x]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [x for _, x in start]

    def find():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c)) for _, x in kept]

    for _ in range(rounds):
        at = find()
        for j in range(len(c)):
            own = [x for (_, x), (_, g) in zip(kept, at, strict=True) if g == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = find()
    part = Counter()
    for d, j in at:
        part[j] += d
    most = (1 << 63) - 1
    return Counter((i, j, d, min(part[j], most), min(sum(part.values()), most), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at, strict=True))


def got(spark, rows, **settings):
    df = spark.createDataFrame([(i, x, "a", 7, "b") for i, x in rows], "vec_id long, embedding array<double>, id string, cluster int, v string").repartition(3)
    return Counter(tuple(r) for r in sortmeans.clustering(df, **settings).collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, 4)) * 2
    rows = [(i, [round(float(v), 1) for v in middle[i % 9] + rng.normal(size=4) * (0.1 + seed)]) for i in range(300)]
    settings = {"clusters": 7, "rounds": 4, "components": 4, "scale": 3}
    assert got(spark, rows, **settings) == plain(rows, 4, 7, 4, 3)


def test_odd_vectors(spark):
    """Nulls, wrong lengths, huge values, ties, equal rows and ids, fewer vectors than clusters."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [-1.0, 0.0]), (None, [5.0, 5.0]), (None, [4.0, 5.0]), (4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]),
            (10, [1e308, -1e308]), (11, [-0.001, -1e-300]), (12, [1.0, 2.0, 3.0])]
    for k in (3, 16):
        assert got(spark, rows, clusters=k, components=2) == plain(rows, 2, k, 3, 64)
    assert sum(got(spark, rows, components=2).values()) == 9
    assert got(spark, [(1, None), (2, [1.0])], components=2) == Counter() == got(spark, [])


def test_scan_stops_only_strictly_beyond(spark):
    """A centroid at exactly twice the distance is as near: the smaller number must win."""
    points, previous = np.array([[2], [2], [3]]), np.array([1, 0, 1], np.int32)
    cluster, distance = sortmeans.nearest(points, previous, np.array([[0], [4]]))
    assert cluster.tolist() == [0, 0, 1] and distance.tolist() == [4, 4, 1]


def test_far_centroids_are_not_measured(monkeypatch):
    seen, real = [], sortmeans.squares
    monkeypatch.setattr(sortmeans, "squares", lambda p, c: seen.append(len(p)) or real(p, c))
    centroids = np.arange(16)[:, None] * 1000
    points = np.repeat(centroids, 10, axis=0) + 1
    cluster, _ = sortmeans.nearest(points, np.repeat(np.arange(16, dtype=np.int32), 10), centroids)
    assert cluster.tolist() == np.repeat(np.arange(16), 10).tolist() and sum(seen) == 16 * (10 + 16)
