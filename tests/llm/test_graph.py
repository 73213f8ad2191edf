import random

from lexspark.llm.graph import components


def test_components_match_union_find(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5000, 5001 + i) for i in range(300)]
    some = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain + star + some + [(7, 7)]]
    parent = {n: n for l in links for n in l}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {n: root(n) for n in linked} and len(got) == len(linked)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
