"""Centroid clustering and hard negatives against brute force: nulls, odd lengths, ties, repeats, empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import clusters, negatives

# --- clustering


def lloyd(rows, k=16, rounds=3):
    """vec_id, cluster, distance of each row and the final centroids, all distances worked out in plain integers."""
    start = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in start]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda: [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in rows]
    for _ in range(rounds):
        at = place()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(rows, at, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted((-1 if i is None else i, n, d) for (i, _), (d, n) in zip(rows, place(), strict=True)), centroids


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.4) for m in middles[i % 5]], i % 5) for i in range(300)]
    rows += [(900 + i, rows[0][1], 0) for i in range(60)] + [rows[7], rows[7], (None, rows[8][1], 3), (None, rows[9][1], None)]
    bad = [(500, None, 1), (501, [None, *rows[1][1][1:]], 1), (502, [math.nan, *rows[1][1][1:]], 1), (503, [math.inf, *rows[1][1][1:]], 1), (504, rows[1][1][:63], 1), (505, [], 1)]
    return rows, bad


SCHEMA = "vec_id long, embedding array<double>, label long"


def test_clusters_are_those_of_plain_rounds(spark, vectors):
    rows, bad = vectors
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 AS cluster", "'x' AS near", "2 AS v").repartition(3)
    found, centroids = clusters.cluster(clusters.kept_vectors(df))
    want, middles = lloyd([(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows])
    got = found.collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got) == want
    assert centroids.tolist() == middles
    assert sum(r.checked for r in got) < 0.9 * 16 * len(got)  # the bounds spare distances


def test_few_vectors_and_none(spark, vectors):
    rows, bad = vectors
    found, centroids = clusters.cluster(clusters.kept_vectors(spark.createDataFrame(rows[:3], SCHEMA)))
    assert len(centroids) == 3 and {r.distance for r in found.collect()} == {0}
    found, centroids = clusters.cluster(clusters.kept_vectors(spark.createDataFrame([rows[0]] * 40, SCHEMA)))
    assert {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)} and len(centroids) == 16
    found, centroids = clusters.cluster(clusters.kept_vectors(spark.createDataFrame(bad, SCHEMA)))
    assert found.count() == 0 and len(centroids) == 0
    with pytest.raises(Exception, match="components must lie"):
        clusters.cluster(clusters.kept_vectors(spark.createDataFrame([(1, [1e9] * 64, 0)], SCHEMA)))


def test_bounds_never_pass_the_distance():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 20), 1 << 20, (300, 64))
    x[:40] = x[40:80] + rng.integers(0, 2, (40, 64))  # very near ones
    pivots = clusters.choose_pivots(x[:8], x[:100], 2)
    bounds = clusters.lower_bounds(clusters.pivot_distances(x, pivots), clusters.pivot_distances(x[:60], pivots), clusters.pivot_distances(pivots, pivots))
    exact = np.stack([clusters.squared(x, c) for c in x[:60]], axis=1)
    assert (bounds**2 <= exact * (1 + 1e-12)).all() and bounds.max() > 0


# --- hard negatives


def plain(rows, every=100, k=5, low=80, high=100):
    rows = [(i, n, label, v + [0] * (max(len(r[2]) for r in rows) - len(v))) for n, (i, label, v) in enumerate(rows)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, _, label, v in rows:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, m) for j, _, m, w in rows if j != i)
        for p, pid, _ in [s for s in scored if s[2] == label][:k]:
            fit = [(j, -s) for s, j, m in scored if m != label and low * -p <= 100 * -s <= high * -p][:k]
            out += [(i, pid, rank, j, -p, s) for rank, (j, s) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture
def small_blocks(monkeypatch):
    """Bounds so low that cells are parted and copied and waves end early."""
    for name, value in {"FIRST_POSITIVES": 8, "FIRST_NEGATIVES": 16, "BLOCK": 32, "ASKED": 4, "STEP": 3, "CELL": 16}.items():
        monkeypatch.setattr(negatives, name, value)


def mined(df, every=100):
    rows = negatives.mine(negatives.labelled_vectors(df), F.col("vec_id") % every == 0)
    return sorted(tuple(r) for r in rows.collect())


def as_integers(rows):
    return [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None]


def test_negatives_are_those_of_all_pairs(spark, vectors, small_blocks):
    rows, bad = vectors
    bad = [b for b in bad if b[0] not in (504, 505)]  # shorter vectors take part
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 AS asker", "'x' AS q", "2 AS rank").repartition(3)
    assert mined(df, 10) == plain(as_integers(rows), 10)


def test_lengths_repeats_and_signs(spark, small_blocks):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([0, 1, 2, 3]))], i % 3) for i in range(120)] + [(20, [1.0], 1), (20, [1.0, 2.0], 2)]
    rows += [(200 + i, [1.5, 1.5, 1.5], i % 2) for i in range(80)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 10) == plain(as_integers(rows), 10)


def test_no_partners_and_empty_tables(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)], SCHEMA)
    assert mined(one) == [] and mined(one.where("false")) == []
    with pytest.raises(ValueError, match="too large"):
        mined(spark.createDataFrame([(0, [1e300, 2.0], 1)], SCHEMA))


def test_cells_are_walked_by_descending_bounds():
    rng = np.random.default_rng(2)
    codes = (rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    m = negatives.Cells(codes, (rng.random(7), rng.random(5)), {}, 6)
    walked = list(m.walk(rng.normal(size=6)))
    assert len({(i, j) for *_, i, j in walked}) == 35
    assert all(a[0] >= b[0] for a, b in zip(walked, walked[1:], strict=False)) and all(u >= low for u, low, *_ in walked)
