import os

import numpy as np
import pytest

from lexspark.llm import mixing as M

SF = "/root/testdata/sf0.01"


def water(sizes, weights, most=3.0):
    """Targets by repeated resharing, as the contract words it."""
    full, total = set(), float(sum(sizes))
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        w = sum(weights[i] for i in free)
        above = [i for i in free if rest * weights[i] / w > most * sizes[i]]
        if not above:
            return [most * sizes[i] if i in full else rest * weights[i] / w for i in range(len(sizes))]
        full.update(above)


def test_targets_match_repeated_resharing(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        sizes = [int(x) for x in rng.integers(0, 1000, n) ** rng.integers(1, 3, n)]
        rows = [(None if i == n - 1 else f"s{i:03d}", s) for i, s in enumerate(sizes)]
        df = spark.createDataFrame(rows, "source string, source_size long")
        got = {r.source: r.target for r in M.targets(df).collect()}
        want = water(sizes, [M.WEIGHTS[i % 3] for i in range(n)])
        assert [got[r[0]] for r in rows] == pytest.approx(want)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(M.SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = M.query(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns)
    assert (got.drop(columns="target") == want.drop(columns="target")).all().all()
    assert np.allclose(got.target, want.target, rtol=1e-12)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas()
    by = got.merge(docs, on="doc_id").groupby("source").agg({"taken": "sum", "target": "first", "size": "max"})
    assert ((by.taken - by.target).abs() <= by["size"]).all() and (got.taken <= 3 * got["size"]).all()


def test_edge_cases(spark):
    rows = [(1, "a b c", "x", 1), (2, None, "x", 1), (3, "", None, 1), (4, "d e", None, None), (None, "f", "y", 1), (4, "d e", None, 2), (6, "g " * 90000, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = M.mix(df).collect()
    assert len(got) == 7 and sorted(map(tuple, got), key=str) == sorted(map(tuple, M.mix(df).collect()), key=str)
    assert all(r.taken == r.times * r["size"] and r.taken <= 3 * r["size"] for r in got)
    assert {r.source_size for r in got if r.doc_id == 4} == {4}
    assert M.mix(df.limit(0)).collect() == []
    assert all(r.taken == 0 for r in M.mix(df.where("text is null")).collect())


def test_one_source_over_many_tasks(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(id % 50 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source")
    got = M.mix(df.repartition(4)).toPandas()
    by = got.groupby("source_size").agg({"taken": "sum", "target": "first"})
    assert ((by.taken - by.target).abs() <= 50).all()
