"""The pipeline against plain reimplementations of its decisions on a small fixture."""

import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from lexspark.llm import byte_bpe, mixing, quality_classifier, quality_rules  # noqa: E402
from lexspark.llm.shared import materialise  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(["tha", "ren", "ing", "ou", "st", "er"], k=rng.randint(1, 3)))
    good = lambda n: "\n".join(" ".join(word() for _ in range(20)).capitalize() + "." for _ in range(n))
    rows = [(i, good(rng.randint(4, 9)), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1] if i % 2 else rows[i][1] + " tail", "en", "s1", 0) for i in range(12)]
    rows += [(200 + i, " ".join(word() + "###" for _ in range(80)), "en", "s2", 0) for i in range(30)]
    rows += [(300, None, "en", None, 0), (301, "", None, "s0", None), (302, "short text", "en", "s0", 0), (303, good(12), "en", None, 0), (5, *rows[5][1:])]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 200), 0) for r in rows if (i := r[0]) < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def by_sql(sql, docs):
    """The plain version of a stage: the operator's SQL over the distinct rows of its input."""
    import duckdb

    con = duckdb.connect()
    con.register("rows", docs.toPandas())
    con.execute("CREATE TABLE documents AS SELECT DISTINCT ON (doc_id, text) * FROM rows")
    return con.execute(sql).df()


def test_stages(spark, folder):
    from test_minhash_dedup import classes

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "quality_rules", "near_dedup", "mixing", "encoding"]
    step = lambda name, d: materialise(stages[name](spark, d, folder), "test")

    one = step("quality_classifier", docs)
    assert one.columns == columns
    ids = [r.doc_id for r in one.collect()]
    assert set(range(60)) <= set(ids) and not any(200 <= i < 230 for i in ids) and ids.count(5) == 2

    two = step("quality_rules", one)
    want = {r.doc_id for r in by_sql(quality_rules.SQL, one).itertuples() if r.kept}
    assert want == {r.doc_id for r in quality_rules.assess(one).collect() if r.kept}
    assert two.columns == columns and {r.doc_id for r in two.collect()} == want
    assert not want & {300, 301, 302} and 303 in want

    three = step("near_dedup", two)
    texts = {r.doc_id: r.text for r in two.collect()}
    kept = [r.doc_id for r in three.collect()]
    assert three.columns == columns and sorted(kept) == sorted(set(classes(texts).values()))

    four = step("mixing", three)
    times = {r.doc_id: r.taken // r.size if r.size else 0 for r in by_sql(mixing.SQL, three).itertuples()}
    assert times == {r.doc_id: r.times for r in mixing.mix(three).collect()}
    got = {}
    for r in four.collect():
        assert r.text == texts[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert four.columns == columns and got == {i: n for i, n in times.items() if n}

    five = step("encoding", four).collect()
    e = byte_bpe.Encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert len(five) == sum(got.values())
    for r in five:
        ids = e.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, folder):
    got = pipeline.run(spark, folder)
    assert got.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
    assert quality_classifier.classify(empty, spark.read.parquet(f"{folder}/labels.parquet")).count() == 0


def test_extra_columns_with_clashing_names(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = ["_id", "_row", "_times", "_k", "d", "row", "key", "k_id", "r_id", "r_row", "times", "score", "kept", "label", "odd name.x"]
    more = docs.select("*", *[F.lit(n).alias(n) for n in extra])
    for name, stage in pipeline.STAGES[:4]:
        plain, wide = stage(spark, docs, folder), stage(spark, more, folder)
        assert wide.columns == [*docs.columns, *extra], name
        ids = sorted((r.doc_id for r in plain.collect()), key=str)
        rows = wide.collect()
        assert sorted((r.doc_id for r in rows), key=str) == ids and all(r["_times"] == "_times" and r["d"] == "d" for r in rows), name
    assert pipeline.STAGES[4][1](spark, more, folder).count() == docs.count()
