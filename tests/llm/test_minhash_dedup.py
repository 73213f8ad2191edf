import collections
import os

import numpy as np
import pytest

from lexspark.llm import minhash_dedup as M

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, key string, label int"


def weights(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return collections.Counter()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(a, b):
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def classes(texts):
    """Components over all pairs that share a shingle and reach the threshold."""
    ws = {k: weights(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = collections.defaultdict(list)
    for k, w in ws.items():
        for s in w:
            where[s].append(k)
    pairs = {(a, b) for ks in where.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    for a, b in pairs:
        if root(a) != root(b) and 0.5 < len(ws[a]) / len(ws[b]) < 2 and brute(ws[a], ws[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in texts}


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: (r.class_id, r.class_size, r.representative) for r in M.near_duplicates(df).collect()}


def test_similarity_is_the_probability_jaccard_index():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = collections.Counter(rng.integers(0, 12, 20).tolist())
        b = collections.Counter(rng.integers(4, 16, 15).tolist())
        one = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
        assert M.similarity(*one(a), *one(b)) == pytest.approx(brute(a, b))


def test_sketch_estimates_similarity():
    n, m = 300, 4096
    doc = np.repeat([0, 1], n)
    item = M.X.mix(np.concatenate([np.arange(n), np.arange(100, n + 100)]).astype(np.uint64))
    weight = np.concatenate([np.ones(n), np.where(np.arange(n) < 50, 3, 1)])
    won = M.prob_minhash(doc, item, weight, 2, m)
    o0, o1 = np.argsort(item[:n]), np.argsort(item[n:])
    exact = M.similarity(item[:n][o0], weight[:n][o0], item[n:][o1], weight[n:][o1])
    assert abs((won[0] == won[1]).mean() - exact) < 0.03


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30 ", "other ")
    rows = [
        (1, base, "k", 1), (2, base, "k", 2), (3, near, None, None), (4, None, "x", 1), (5, "", "x", 1), (6, "\n \t", "x", 1),
        (7, "one two", "x", 1), (8, "one  two", "x", 1), (9, "two one", "x", 1), (1, base, "k", 1),
        (10, "long " * 30000, "x", 1), (11, "unrelated " + " ".join(f"u{i}" for i in range(60)), "x", 1),
    ]
    got = found(spark, rows)
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11}
    assert got[3] == (1, 4, False) and got[4] == (4, 1, True)
    assert found(spark, []) == {}


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = classes(texts)
    got = {r.doc_id: r.class_id for r in M.near_duplicates(docs).collect()}
    assert got == want


def test_pairs_within_a_template_group(spark):
    template = " ".join(f"t{i}" for i in range(204))
    text = lambda p, k: " ".join([template, *(f"p{p}x{i}" for i in range(4)), *(f"o{p}x{k}x{i}" for i in range(22))])
    w = {(p, k): weights(text(p, k)) for p in (0, 1) for k in (0, 1)}
    assert brute(w[0, 0], w[0, 1]) >= 0.8 > brute(w[0, 0], w[1, 0])
    got = found(spark, [(2 * p + k, text(p, k), "x", 1) for p in range(600) for k in (0, 1)])
    assert {i: v[0] for i, v in got.items()} == {i: i - i % 2 for i in range(1200)}
