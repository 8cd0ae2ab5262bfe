"""Largest inner products against all of them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywire.llm import pivot_index as pivots

SCHEMA = "vec_id long, embedding array<double>, label int, class long, pivot int, bin int, query string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, "x") for i, v in rows], SCHEMA)


def brute(rows, k=5):
    """Rows with distinct ids, to per query the best (id, score)."""
    whole = {
        i: [math.floor(256 * x) for x in v]
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(256 * x) for x in v)
    }
    out = {}
    for q, a in whole.items():
        if q % 50 == 0:
            scores = []
            for i, b in whole.items():
                if i != q and len(b) == len(a):
                    s = sum(x * y for x, y in zip(a, b, strict=True))
                    scores.append((-min(max(s, -(2**63)), 2**63 - 1), i))
            if scores:
                out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        near = out.setdefault(r.query_id, [])
        near.append((r.vec_id, r.score))
        assert r["rank"] == len(near)
    return out


def search(df, k=5):
    return found(pivots.top_products(df, F.col("vec_id") % 50 == 0, k))


def clustered(n, dims, centres, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dims))
    points = middle[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dims))
    return [(i, [float(x) for x in v]) for i, v in enumerate(points)]


@pytest.mark.parametrize("dims, centres", [(1, 3), (8, 5), (64, 40)])
def test_random_vectors(spark, dims, centres):
    rows = clustered(700, dims, centres, dims)
    assert search(table(spark, rows)) == brute(rows)


def test_lengths_that_differ_a_lot(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * 10 ** rng.uniform(-3, 3) for _ in range(6)]) for i in range(500)]
    assert search(table(spark, rows)) == brute(rows)


def test_ties_and_copies(spark):
    """A third of all rows is one vector, and many others give the same score."""
    rng = random.Random(4)
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [rng.choice([0.0, 1.0]), 0.5]) for i in range(400)]
    assert search(table(spark, rows).repartition(9)) == brute(rows)


def test_awkward_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (0, [0.0, 0.0]), (50, [1e-9, -1e-9]), (100, [1.0, inf]), (150, [nan, 1.0]), (200, None),
        (250, []), (300, [None, 1.0]), (350, [1.0]), (400, [-0.0, 0.0]), (450, [1.0, 2.0, 3.0]),
        (None, [5.0, 5.0]), (1, [3.0, -4.0]), (2, [0.5, 0.25]), (3, [1e307, 1.0]), (-50, [-1.0, 2.0]),
    ]
    got = search(table(spark, rows))
    assert got == brute(rows)
    assert 350 not in got and 450 not in got and {0, 50, 400, -50} == set(got)


def test_large_numbers(spark):
    """Beyond 2^53 products are still exact, and beyond 64 bits the ends of the range."""
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-(2**20), 2**20)) for _ in range(4)]) for i in range(150)]
    assert search(table(spark, rows)) == brute(rows)
    rows += [(1000, [1e30, 1.0, 0.0, 0.0]), (1050, [-1e30, 1.0, 0.0, 0.0])]
    assert search(table(spark, rows)) == brute(rows)


def test_repeated_ids_and_few_rows(spark):
    rows = [(0, [2.0]), (0, [1.0]), (7, [3.0]), (7, [3.0])]
    assert search(table(spark, rows)) == {0: [(7, 768 * 256)]}
    assert search(table(spark, rows[:2])) == {}
    assert search(table(spark, [])) == {}


def test_pivots_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(pivots, "SHARD", 40)
    monkeypatch.setattr(pivots, "PIVOTS", 3)
    monkeypatch.setattr(pivots, "SEEDS", 12)
    monkeypatch.setattr(pivots, "QUERIES", 5)
    monkeypatch.setattr(pivots, "BINS", 16)
    rows = clustered(900, 5, 4, 9, 0.3)
    # Many vectors at one distance, which bins cannot tell apart.
    rows += [(1000 + i, [math.cos(i), math.sin(i), 0.0, 0.0, 0.0]) for i in range(300)]
    assert search(table(spark, rows)) == brute(rows)


def test_rings_are_skipped_and_nothing_is_lost():
    """On clusters most products are never made; the answers are those of all products."""
    points = np.array([v for _, v in clustered(20_000, 8, 50, 1, 0.02)])
    points *= 50 / np.linalg.norm(points, axis=1, keepdims=True)
    vectors = np.floor(256 * points)
    most = float((vectors**2).sum(axis=1).max())
    sphere = pivots.Sphere(most, vectors[:1])
    radii = sphere.distances(sphere.lifted(vectors))[:, 0]
    order = np.argsort(radii)
    asked = vectors[::400]
    floor = np.full(len(asked), -(2**63))
    at, ids, score, done = pivots.search_shard(
        sphere, 0, order, vectors[order], radii[order], asked, floor, 6
    )
    assert done < 0.3 * len(asked) * len(vectors)
    products = asked @ vectors.T
    for q in range(len(asked)):
        want = np.lexsort((np.arange(len(vectors)), -products[q]))[:6]
        mine = np.flatnonzero(at == q)
        mine = mine[np.lexsort((ids[mine], -score[mine]))]
        assert list(ids[mine]) == list(want)
        assert list(score[mine]) == list(products[q][want])
