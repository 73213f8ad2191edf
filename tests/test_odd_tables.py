"""Queries against their SQL on tables with values that the given ones lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexspark.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with empty, blank and null texts and such with marks at their ends, and pages with incomplete references."""
    path = str(tmp_path_factory.mktemp("odd"))
    k = F.col("doc_id") % 40
    text = F.when(k.isin(0, 11, 20, 21), "").when(k.isin(4, 5, 14, 31), None).when(k.isin(6, 37), "  ").when(k.isin(8, 9), F.concat(F.lit(" \n"), "text", F.lit(" \n")))
    text = text.when(k.isin(12, 23), F.concat(F.lit("”\n"), "text", F.lit("\n„"))).otherwise(F.col("text"))
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", text).write.parquet(f"{path}/documents.parquet")
    title = F.concat(F.lit("<title>R&amp;D, a&ampb &#39;x&#39; &amp;lt; & "), F.col("page_id").cast("string"), F.lit("&lt</title><h1>&quot;T&quot;&nbsp;&am</h1>"))
    spark.read.parquet(f"{SF}/pages.parquet").withColumn("html", F.when(F.col("page_id") % 5 != 0, title).when(F.col("page_id") % 10 != 0, F.col("html"))).write.parquet(f"{path}/pages.parquet")
    return path


def equal(spark, path, name, tables=("documents",)):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want = sorted(map(str, want.fetchall()))
    assert len(want) and sorted(str(tuple(r)) for r in queries.queries()[name](spark, path).select(*columns).collect()) == want


def test_completed_records(spark, odd):
    equal(spark, odd, "completed_records")


def test_export_text(spark, odd):
    equal(spark, odd, "export_text")


def test_html_title(spark, odd):
    equal(spark, odd, "html_title", ("pages",))


def test_web_text(spark, odd):
    equal(spark, odd, "web_text")


def test_year_lists_are_written_in_pages(spark, tmp_path):
    """A list of many items is several lines, none of which holds it whole; each states the whole count."""
    from lexspark.sources import io

    item = F.struct(F.lit("DU").alias("publisher"), F.lit(2020).alias("year"), F.col("id").cast("int").alias("pos"))
    rows = spark.range(5000).select(F.lit("DU").alias("publisher"), F.lit(2020).alias("year"), item.alias("item"))
    io.write_year_lists(rows, f"{tmp_path}/lists")
    lines = [len(r.value) for r in spark.read.text(f"{tmp_path}/lists/*/*").collect()]
    assert len(lines) == 5 and max(lines) < 0.3 * sum(lines)
    got = io.read_year_lists(spark, f"{tmp_path}/lists/*/*", lines=True).select("pos", "stated").collect()
    assert sorted(r.pos for r in got) == list(range(5000)) and {r.stated for r in got} == {5000}


def test_a_batch_leaves_no_scratch_tables(spark, tmp_path, monkeypatch):
    """Postings are those of the texts, sorted by token, and what a batch and a compaction wrote for themselves is gone."""
    import os

    from lexspark import session
    from lexspark.operators import search
    from lexspark.plans import stored, views
    from lexspark.streaming import store

    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}/scratch")
    j = stored.whole(spark, views.judgments(spark, SF)).where(F.col("doc_id").cast("long") < 40)
    s = store.judgment_store(spark, f"file://{tmp_path}/store", indexed=True, buckets=4)
    for n in (0, 1):
        s.put(j.withColumn("full_text", F.concat("full_text", F.lit(" the" * n))), n, F.lit("2020-03-01").cast("timestamp"), ["judgment_date"], j.where("doc_id = '7'") if n else None)
        want = search.postings(s.last(), s.said()).select("source", "doc_id", "token", "tf")
        got = s.postings().where(F.col("version") == 2 * n).select("source", "doc_id", "token", "tf")
        got = got if not n else got.where("doc_id <> '7'")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    s.compact(1)
    want = search.postings(s.last(), s.said()).select("source", "doc_id", "token", "tf")
    got = s.postings().select("source", "doc_id", "token", "tf")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert [f for f in os.listdir(f"{tmp_path}/scratch") if f.startswith("cut-")] == []
