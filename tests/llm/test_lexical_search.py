import math
import os
import random
import re
from collections import Counter

import pytest

from lexspark.llm import lexical_search as S

SF = "/root/testdata/sf0.01"
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return [t.translate(lower) for t in _TERM.findall(text or "")]


def brute(docs, items, k):
    """Scores of all documents for all items."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, wanted in asked.items():
        rows = []
        for doc, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in wanted if b[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("width, step", [(1 << 20, 1_000_000), (7, 64)])
def test_against_scoring_all(spark, monkeypatch, width, step):
    monkeypatch.setattr(S, "CELLS", step)
    rng = random.Random(2)
    words = ["the", "The", "wörd", "字", "a1", "x-y", "rare%d", "b_c", "É", "naïve", "zeta"]
    def text(n):
        return rng.choice([" ", "\n", ", "]).join(rng.choice(words).replace("%d", str(rng.randint(0, 40))) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 10, 60]))) for i in range(300)]
    docs += [(1000 + i, "the copy of a1 and 字 rare7") for i in range(80)]
    docs += [(5, None), (6, ""), (None, "the rare3 字"), (None, "zeta"), (7, "zeta " * 900 + "the"), (8, "!!! ...")]
    items = [(i, text(8)) for i in range(12)] + [(20, "copy rare7"), (21, "absent"), (22, None), (23, "zeta ZETA the"), (24, "a1"), (24, "zeta"), (None, "naïve")]
    made = S.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=10, width=width)
    assert sorted(map(tuple, made.collect()), key=str) == brute(docs, items, 10)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ITEMS", 2)
    docs = [(i, f"w{i % 7} w{i % 5} common") for i in range(60)]
    items = [(i, f"w{i} common") for i in range(7)]
    made = S.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(tuple, made.collect()), key=str) == brute(docs, items, 5)


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, row long, score long")
    some = spark.createDataFrame([(1, "a b", 5, None)], "doc_id long, text string, row long, score long")
    items = spark.createDataFrame([(1, "a", "x")], "item_id long, text string, rank string")
    assert S.search(none, items).count() == 0
    assert S.search(some, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in S.search(some, items).collect()] == [(1, 1, 1)]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({S.SQL})").fetchall())
    assert sorted(map(tuple, S.query(spark, SF).collect())) == want and len(want) == 2000
