"""The stored index, the archive, rounds over sources and the fields of panels."""

import pytest
from pyspark.sql import functions as F

from lexspark.functions import clean, fields
from lexspark.operators import acts, search
from lexspark.sources import io
from lexspark.streaming import jobs


def test_a_stored_index_is_read_by_bucket(spark, tmp_path):
    df = spark.createDataFrame([("s", str(i), "the word " * (i % 3 + 1) + f"own{i}") for i in range(30)], "source string, doc_id string, full_text string")
    search.write_postings(search.postings(df, F.col("full_text")), f"{tmp_path}/i", buckets=8)
    index = spark.read.parquet(f"{tmp_path}/i")
    found = search.lookup(index, "THE word", buckets=8)
    plain = search.lookup(search.postings(df, F.col("full_text")), "THE word")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() == 30
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(token" in plan
    assert [r.doc_id for r in search.lookup(index, "own7", buckets=8).collect()] == ["7"] and search.lookup(index, "!", buckets=8).count() == 0


def test_archive_twice(spark, tmp_path):
    df = spark.createDataFrame([("ms", "a/1", "x"), ("ms", "2", "y")], "source string, doc_id string, full_text string")
    for _ in range(2):
        assert sorted(r.name for r in io.archive(df, df.limit(0), f"{tmp_path}/a").collect()) == ["2", "a_1"]
    assert spark.read.json(f"{tmp_path}/a").count() == 2


def test_backfill(spark):
    covered = spark.createDataFrame([("DU", 2026, False), ("DU", 1919, True), ("MP", 2026, True)], "publisher string, year int, complete boolean")
    cursor = spark.createDataFrame([("DU", 1919)], "publisher string, year int")
    step = lambda c: {r.publisher: (r.year, r.also_current) for r in acts.backfilled(c, covered, F.lit(2026)).collect()}
    assert step(cursor) == {"DU": (1918, True), "MP": (2025, False)}
    assert step(cursor.withColumn("year", F.lit(1918)))["DU"] == (2026, True)


def test_rounds_over_sources():
    def bad():
        raise ValueError("down")

    assert jobs.observed({"ms": lambda: 0, "kio": bad}, lambda: 7) == [("ms", "ok", 0, ""), ("kio", "blad", 0, "down"), ("ms:backlog", "ok", 7, "")]
    assert jobs.observed({"ms": lambda: 2}, bad) == [("ms", "ok", 2, "")]


@pytest.mark.parametrize(
    ("head", "want"),
    [
        ("Przewodniczący: SSO Jan Maria Kowalski Sędziowie: SSR del. Anna Nowak-Zych, Piotr Lis (spr.)\nProtokolant sekr. Ewa Mała przy udziale Jana Nowaka", ["przewodniczący:Jan Maria Kowalski", "protokolant:Ewa Mała", "sędzia:Anna Nowak-Zych", "sędzia:Piotr Lis"]),
        ("Członkowie: Jan Kos\nAnna Kos; Jan Kos\norzeka Piotr Lis", ["członek:Jan Kos", "członek:Anna Kos"]),
        ("sędzia sprawozdawca mówi Jan Kos", []), ("", []), (None, []),
    ],
)
def test_panel_lines(head, want):
    assert [f"{p['role']}:{p['name']}" for p in fields._panel(head, 3000)] == want


def test_page_furniture():
    cases = ["– 12 – dalej", "Poz. 12.", "poz. 12 i 13", "Warszawa, dnia 3 maja 2020 r.", "Dziennik Ustaw", "Monitor Polski jest", "–"]
    assert [clean._furniture(c.split()) for c in cases] == [3, 2, 0, 6, 2, 2, 0]
    assert clean._paragraphs("a-\n\nb\nc\n– 2 –\nd") == ["ab c", "d"]


def test_labels_values_markers():
    assert [clean._is_label(x) for x in ("IV", "12a", "1234", "ab", "")] == [True, True, False, False, False]
    assert [clean._is_value(x) for x in ("1 200", "200–300", "400 zł", "x", "")] == [True, True, True, False, False]
    assert [clean._is_marker(x) for x in ("1)", "„2a)”", "b)", "1", ")", "ab)")] == [True, True, True, False, False, False]
