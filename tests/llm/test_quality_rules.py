import os

import pytest

from lexspark.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(Q.SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = Q.query(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns)
    for c in got.columns:
        assert (got[c] == want[c]).all(), c
    assert 0 < got.kept.sum() < len(got)


def test_edge_cases(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    shared = " ".join(f"legal{i}" for i in range(80))
    rows = [(i, f"{body(i)}\n{shared}", "h1", "x") for i in range(30)]  # mostly a shared line
    rows += [(100 + i, f"{body('copy')}\n{body('second')}", "h1", "x") for i in range(30)]  # copies are kept
    rows += [(200, None, "h1", None), (201, "", None, "x"), (202, " \n\t\n", "h2", "x"), (203, "a\na\n b\na", "h2", "x")]
    rows += [(204, "x y z " * 40, "h2", "x"), (205, "# € <żółć> " + body(5), None, "x"), (206, body(6) + " long" * 60000, "h2", "x"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    got = {}
    for r in Q.assess(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(not got[i][0].kept and not got[i][0].base_failed and got[i][0].n_removed_words == 80 for i in range(30))
    assert len(got[0]) == 2 and all(got[100 + i][0].kept for i in range(30))
    for i in (200, 201, 202):
        assert got[i][0].n_words == 0 and got[i][0].base_failed
    assert (got[203][0].n_words, got[203][0].n_dup_lines) == (4, 2)
    assert got[204][0].n_repeat_words == 120 and got[204][0].base_failed
    assert got[205][0].n_symbols == 3 and got[205][0].kept
    assert got[205][0].word_chars == sum(map(len, rows[-3][1].split()))
    assert got[206][0].n_repeat_words == 60000
    assert Q.assess(df.limit(0)).collect() == []


def test_several_shared_lines(spark):
    shared = [" ".join(f"notice{k}x{i}" for i in range(23)) for k in range(4)]
    own = lambda k: [f"own{k} a{k} b{k}", f"c{k} d{k} e{k}", f"f{k} g{k} h{k}"]
    rows = [(i, "\n".join([*shared, *own(i)]), "h") for i in range(40)]  # 92 of 101 words in four shared lines
    rows += [(100 + i, "\n".join([shared[0], *(f"{k} only{i} {' '.join(f'w{i}x{k}x{j}' for j in range(30))}" for k in range(3))]), "h") for i in range(40)]
    rows += [(200 + i, "\n".join(own(f"copy{k}")[0] + f" {k}" * 20 for k in range(3)), "h") for i in range(40)]  # copies: one document
    got = {r.doc_id: r for r in Q.assess(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].n_removed_words == 92 and not got[i].kept for i in range(40))
    assert all(got[100 + i].n_removed_words == 23 and got[100 + i].kept for i in range(40))
    assert all(got[200 + i].n_removed_words == 0 for i in range(40))


def test_limit_counts_distinct_documents(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(i, f"{body(i)}\nshared line here", "h") for i in range(12)] + [(100 + i, body("copy"), "h") for i in range(400)]
    got = {r.doc_id: r.n_removed_words for r in Q.assess(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == 3 for i in range(12)) and got[100] == 0
