import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import hard_negatives as H

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives=10):
    """All pairs, one by one, in Python's integers."""
    fine = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (i, v, lab) in enumerate(fine):
        if i is None or not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for m, (j, w, other) in enumerate(fine) if m != n and len(w) == len(v)]
        same = sorted([s for s in scored if s[2] == lab], key=key)[:positives]
        for ps, p, _ in same:
            kept = sorted([s for s in scored if s[2] != lab and 30 * ps <= 100 * s[0] <= 90 * ps], key=key)[:negatives]
            out += [(i, p, r, j, ps, s) for r, (s, j, _) in enumerate(kept, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, anchors", [(4096, 4096), (7, 3)])
def test_against_all_pairs(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 48))
    rows = [(i, (centres[i % 4] * (i % 3 > 0) + rng.normal(size=48)).tolist(), int(rng.integers(0, 4))) for i in range(250)]
    rows += [(1000 + i, [0.5] * 48, 1 + i % 2) for i in range(40)]  # ties
    rows += [rows[10], rows[20], (None, rows[3][1], 2), (20, rows[4][1], 3)]  # repeated rows and ids
    rows += [(2000, None, 1), (2010, [1.0, None], 1), (2020, [math.nan] * 48, 1), (2030, [math.inf] * 48, 1), (2040, rows[0][1], None)]
    rows += [(2100 + 10 * i, [float(i), 1.0, -0.001], i % 2) for i in range(6)]  # another length
    rows += [(2300 + 10 * i, [], i % 2) for i in range(5)] + [(2400 + 10 * i, [0.0] * 48, 0) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = H.mine(df, F.col("vec_id") % 10 == 0, F.col("label"))
    assert sorted(map(tuple, made.collect()), key=str) == brute(rows, lambda i: i % 10 == 0)


def test_large_components(spark):
    rows = [(i, [1e6 * (i + 1), -3e5 * i], i % 2) for i in range(12)]
    made = H.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 2, F.col("label"))
    assert sorted(map(tuple, made.collect()), key=str) == brute(rows, lambda i: i == 2)


def test_candidates_shrink():
    """On vectors with a few strong dimensions most rows leave before the last columns."""
    rng = np.random.default_rng(3)
    x = H.whole(rng.normal(size=(2000, 64)) * np.exp(-np.arange(64) / 4) + 0)
    ids = np.arange(2000)
    block = H.Columns(H._stored(64, x, ids, ids, ids % 3, ids < 0))
    seen = []

    def keep(low, high):
        seen.append(len(low))
        return high >= H._kth(low, 5)

    at, score = H.scan(block, x[0], np.arange(1, 2000), keep)
    assert sorted(score.tolist())[-5:] == sorted((x[1:] @ x[0]).tolist())[-5:]
    assert seen[0] == 1999 and seen[-1] < 300


def test_empty_and_other_columns(spark):
    assert H.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    rows = [(0, [1.0, 0.0], 0, 1, 2), (1, [1.0, 0.0], 0, 1, 2), (2, [0.5, 0.0], 1, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row int, rank int")
    assert [tuple(r) for r in H.mine(df, F.col("vec_id") == 0, F.col("label")).collect()] == [(0, 1, 1, 2, 65536, 32768)]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({H.SQL})").fetchall())
    assert sorted(map(tuple, H.query(spark, SF).collect())) == want and want
