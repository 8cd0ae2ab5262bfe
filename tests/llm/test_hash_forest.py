import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywire.llm import hash_forest as hf
from tallywire.llm.hash_forest import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, class int"
def query():
    return F.col("vec_id") % 50 == 0



def frame(spark, rows):
    rows = [(i, v and [x if x is None else float(x) for x in v], 1, 0.5, 3, 9) for i, v in rows]
    return spark.createDataFrame(rows, SCHEMA)


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, k=5):
    vectors = {}
    for i, v in rows:
        if i is not None and usable(v):
            v = tuple(np.float32(v).astype(float))
            vectors[i] = min(vectors.get(i, v), v)
    out = {}
    for q, x in vectors.items():
        if q % 50 == 0:
            near = [
                (-float(np.dot(x, y)) / (math.sqrt(np.dot(x, x)) * math.sqrt(np.dot(y, y))), i)
                for i, y in vectors.items()
                if i != q and len(x) == len(y)
            ]
            if near:
                out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(hf, "SHARD", 700)
    monkeypatch.setattr(hf, "QUERIES", 20)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(2000)]
    want, got = brute(rows), found(nearest(frame(spark, rows), query()))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    true = {q: dict(brute(rows, 2000)[q]) for q in list(want)[:3]}
    for q, scores in true.items():
        for i, score in got[q]:
            assert score == pytest.approx(scores[i], abs=1e-12)


def test_small_tables_are_exact_with_ties_and_odd_rows(spark):
    rng = random.Random(2)
    vectors = [[rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)] for _ in range(40)]
    rows = [(i, rng.choice(vectors)) for i in range(160)]
    rows += [(200, None), (250, []), (300, [0.0] * 4), (350, [1.0, None, 0.0, 0.0])]
    rows += [(400, [float("nan"), 1, 1, 1]), (450, [float("inf"), 1, 1, 1]), (None, vectors[0])]
    rows += [(500, [1.0, 2.0]), (501, [2.0, 1.0]), (550, [1.0, 2.0, 3.0]), (100, rows[100][1])]
    want, got = brute(rows), found(nearest(frame(spark, rows), query()))
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)


def test_a_vector_that_many_rows_share(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1, 700)] + [(i, [float(i), 1.0, 0.0]) for i in range(700, 760)]
    got = found(nearest(frame(spark, rows), query()))
    for q in range(50, 700, 50):
        assert [i for i, _ in got[q]] == [i for i in range(1, 7) if i != q][:5]


def test_empty(spark):
    assert nearest(frame(spark, []), query()).count() == 0
    assert nearest(frame(spark, [(50, [1.0])]), query()).count() == 0


def test_forest_goes_up_all_trees_together():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((500, 8))
    forest = hf.Forest(vectors)
    codes = forest.codes(vectors[:5])
    for i, rows in enumerate(forest.candidates(vectors[:5], 3000)):
        def at(depth):
            low, high = forest.runs(codes[:, i : i + 1], depth)
            return (high - low).sum(), {
                r for t in range(hf.TREES) for r in forest.order[t, low[t, 0] : high[t, 0]]
            }
        depth = max(d for d in range(1, hf.BITS + 1) if at(d)[0] >= 3000)
        assert set(rows) == at(depth)[1]
