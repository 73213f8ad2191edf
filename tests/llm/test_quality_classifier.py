import os
import zlib

import numpy as np
import pytest

from lexspark.llm import quality_classifier as Q

SF = "/root/testdata/sf0.1"


def test_isotonic_is_monotone_and_optimal():
    rng = np.random.default_rng(0)
    v = np.arange(40.0)
    y = (rng.random(40) < v / 40).astype(float)
    knots, levels = Q.isotonic(v, y, np.ones(40))
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    assert Q.isotonic(np.array([0.0, 1, 2]), np.array([1.0, 0, 1]), np.ones(3))[1].tolist() == [0.5, 1.0]


def test_cosines_approximate_a_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(Q, "FEATURES", 20000)
    m = Q.Model(np.zeros(Q.N_STATS), np.ones(Q.N_STATS), None, None, None)
    x = np.random.default_rng(1).normal(size=(5, Q.N_STATS))
    z = m.cosines(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * Q.WIDTH**2))
    assert np.abs(z @ z.T - want).max() < 0.05


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_held_out_accuracy(spark):
    got = Q.query(spark, SF).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    assert len(got) == 10000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got.join(labels, how="inner")
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in both.held_out.items())
    out = both[both.held_out]
    for k in (0, 1):
        hit = (out.predicted == k)[out.quality == k].mean()
        print(k, hit, len(out))
        assert hit > 0.9


def test_edge_cases(spark):
    rows = [(1, "good text. " * 20, "a"), (2, None, "b"), (2, "", None), (None, "### $$$ " * 30, "c"), (1, "good text. " * 20, "a"), (7, "x" * 200000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = Q.classify(df, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in Q.classify(df, labels.limit(0)).collect())
    assert Q.classify(df.limit(0), labels).collect() == []
