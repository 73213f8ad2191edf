import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import ann_forest as A

SF = "/root/testdata/sf0.1"


def brute(ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in queries:
        s = u @ u[ids.index(q)]
        out[q] = [(ids[i], s[i]) for i in sorted(range(len(ids)), key=lambda i: (-round(s[i], 12), ids[i])) if ids[i] != q][:k]
    return out


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_recall_against_brute_force(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = t.vec_id.tolist(), np.stack(t.embedding.to_numpy()).astype(float)
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    got = A.query(spark, SF).toPandas()
    assert got.groupby("query_id")["rank"].apply(lambda r: sorted(r) == [1, 2, 3, 4, 5]).all() and set(got.query_id) == set(want)
    hits = 0
    for q, g in got.groupby("query_id"):
        assert (g.sort_values("rank").score.diff().dropna() <= 0).all()
        exact = dict(zip(ids, (x / np.linalg.norm(x, axis=1)[:, None]) @ (x[ids.index(q)] / np.linalg.norm(x[ids.index(q)])), strict=True))
        assert np.allclose(g.score, [exact[i] for i in g.vec_id], atol=1e-12)
        hits += len({i for i, _ in want[q]} & set(g.vec_id))
    print("recall", hits / (5 * len(want)))
    assert hits / (5 * len(want)) >= 0.93


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), "x") for i in range(300)]
    rows += [(1000 + i, rows[7][1], "y") for i in range(400)]  # one very common vector
    rows += [(2000, None, "z"), (2050, [0.0] * 8, "z"), (2100, [float("nan")] + [1.0] * 7, "z"), (2150, [None] + [1.0] * 7, "z"), (2200, [float("inf")] * 8, "z"), (None, [1.0] * 8, "z"), (2250, [1.0], "z"), (5, rows[5][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = A.search(df, F.col("vec_id") % 50 == 0, visit=1.0).toPandas().sort_values(["query_id", "rank"])
    good = [(i, v) for i, v in dict((r[0], r[1]) for r in rows[:700]).items()]
    ids, x = [i for i, _ in good], np.array([v for _, v in good])
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    assert {q: g.vec_id.tolist() for q, g in got.groupby("query_id")} == {q: [i for i, _ in v] for q, v in want.items()}
    assert got[got.query_id == 1000].vec_id.tolist() == [7, 1001, 1002, 1003, 1004]
    assert A.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    few = A.search(df.where("vec_id in (0, 1, 2000)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]


def test_ties_of_scaled_vectors(spark):
    """Equal scores go by id, however the vectors of one direction are scaled and dealt."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=8)
    rows = [(1000 + i, (v * 2.0 ** (i % 11 - 5)).tolist()) for i in range(30)] + [(i, rng.normal(size=8).tolist()) for i in range(1, 200)]
    rows += [(2000 + i, [3.0 * (1 + i % 7), 4.0 * (1 + i % 7)] + [0.0] * 6) for i in range(40)]
    got = A.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 1000 == 0, visit=1.0).toPandas()
    one = got[got.query_id == 1000].sort_values("rank")
    assert one.vec_id.tolist() == [1001, 1002, 1003, 1004, 1005] and one.score.nunique() == 1
    a = np.array(rows[-40][1])
    exact = sorted((-float(A._cosines(np.array([x]), a[None])[0]), i) for i, x in rows if i != 2000)
    assert got[got.query_id == 2000].sort_values("rank").vec_id.tolist() == [i for _, i in exact[:5]]


def test_drawn_planes_below_fitted_leaves(spark, monkeypatch):
    monkeypatch.setattr(A, "SAMPLE", 64)
    monkeypatch.setattr(A, "LEAF", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = A.search(df, F.col("vec_id") % 50 == 0, visit=0.2).toPandas()
    want = brute(list(range(3000)), x, list(range(0, 3000, 50)))
    hits = sum(len({i for i, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits / 300 > 0.9


def test_a_query_goes_to_a_chunk_once(spark, monkeypatch, tmp_path):
    """Rows of visits are queries by chunks, however many leaves a query visits; bounds are largest distances on paths."""
    from lexspark.llm import shared

    made = {}
    monkeypatch.setattr(A, "materialise", lambda df, name: made.setdefault(name, shared.materialise(df, name)))
    x = np.random.default_rng(8).normal(size=(2000, 8))
    A.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert made["visits"].count() <= 40 * A.TREES and made["leaves"].count() == 2000 * A.TREES
    forest, y = A.Forest(A._unit(x), 2, 32), A._unit(np.random.default_rng(9).normal(size=(50, 8)))
    far, own = forest.bounds(y), forest.leaves(y)
    assert ((far < 0).sum(axis=1) == 2).all() and (np.take_along_axis(far, own, axis=1) == -1).all()
    node, worst = forest.roots[0], np.full(50, -1.0)
    while node >= 0:  # to the last leaf of the first tree
        z = y @ forest.planes[node] - forest.cuts[node]
        worst, node = np.maximum(worst, np.where(z > 0, -1.0, np.abs(z))), forest.children[node][1]
    assert np.allclose(far[:, -node - 1], worst)
