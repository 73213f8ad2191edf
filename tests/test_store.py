"""Stored tables: what a batch reads and rewrites, replays, pages, the index under changes."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import search
from lexspark.operators.search import Query
from lexspark.plans.stored import whole
from lexspark.schemas import KEY
from lexspark.streaming import store

def now():
    return F.lit("2025-06-01 00:00:00").cast("timestamp")


def judgments(spark, n, first=0, text="tekst the", day="2000-01-01", step=20):
    """n judgments whose dates are ``step`` days apart, over many years."""
    rows = spark.range(first, first + n).select(
        F.element_at(F.array(*map(F.lit, ["ms", "nsa", "kio"])), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.format_string("%08d", "id").alias("doc_id"),
        F.concat(F.lit("I C "), F.col("id")).alias("signature"), F.lit("Sąd").alias("court"), F.date_add(F.lit(day).cast("date"), (F.col("id") * step).cast("int")).alias("judgment_date"),
        F.concat(F.lit(text + " nr"), F.col("id")).alias("full_text"),
    )
    return whole(spark, rows)


def scanned(df, column):
    """The scans of files that know ``column``, as text."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line and column in line]


def files(spark, folder):
    df = spark.read.parquet(folder)
    return {(r.f, r.t) for r in df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).distinct().collect()}


def test_a_batch_rewrites_its_folders_only(spark, tmp_path):
    s = store.judgment_store(spark, f"{tmp_path}/s")
    s.put(judgments(spark, 300, step=25), 0, now(), ["judgment_date"])
    before = files(spark, f"{tmp_path}/s/records")
    new = judgments(spark, 400, first=300, text="inny").withColumn("judgment_date", F.lit("2026-03-01").cast("date"))
    got = s.put(new, 1, now(), ["judgment_date"])
    # 400 new keys of one recent year: three folders of about 60, all other files are the same.
    assert got["texts"] == 400 and got["folders"] == [("kio", 2026), ("ms", 2026), ("nsa", 2026)]
    after = files(spark, f"{tmp_path}/s/records")
    assert len(before - after) * 10 < len(before) and s.records.rows().count() == 700


def test_filters_on_source_and_date_prune_folders(spark, tmp_path):
    s = store.judgment_store(spark, f"{tmp_path}/s")
    s.put(judgments(spark, 300), 0, now(), ["judgment_date"])
    found = search.matches(s.narrow_rows(), Query(source="ms", date_from="2010-02-01", date_to="2011-03-01"), F.col("full_text"))
    (scan,) = scanned(found, "judgment_year")
    parts = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "source" in parts and "judgment_year" in parts and "2010" in parts and "2011" in parts
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in judgments(spark, 300).where("source = 'ms' and judgment_date between '2010-02-01' and '2011-03-01'").collect())


def test_unchanged_texts_are_neither_read_nor_written(spark, tmp_path):
    s = store.judgment_store(spark, f"{tmp_path}/s", indexed=True, buckets=4)
    s.put(judgments(spark, 60), 0, now(), ["judgment_date"])
    before = files(spark, f"{tmp_path}/s/texts") | files(spark, f"{tmp_path}/s/postings")
    read = []
    whole_texts = s.texts
    s.texts = lambda: read.append(1) or whole_texts()
    got = s.put(judgments(spark, 60).withColumn("court", F.lit("Inny")), 1, now(), ["judgment_date"])
    assert got["texts"] == 0 and not read
    assert files(spark, f"{tmp_path}/s/texts") | files(spark, f"{tmp_path}/s/postings") == before
    assert s.last().where("court = 'Inny' and full_text like 'tekst%'").count() == 60
    # Only narrow columns of the records are read to find what is known.
    (scan,) = scanned(s.records.of(judgments(spark, 3)).select(*KEY, "text_hash"), "text_hash")
    assert "ReadSchema: struct<doc_id:string,text_hash:string>" in scan


def test_a_batch_run_again_ends_with_the_same_tables(spark, tmp_path):
    s = store.judgment_store(spark, f"{tmp_path}/s", indexed=True, buckets=4)
    s.put(judgments(spark, 30), 0, now(), ["judgment_date"])
    new = judgments(spark, 20, first=20, text="zmiana")
    state = lambda: (sorted(map(str, s.last().collect())), sorted(map(str, s.postings().join(s.records.rows().select(*KEY, "version"), [*KEY, "version"]).collect())))
    s.put(new, 1, now(), ["judgment_date"])
    want = state()
    s.put(new, 1, now(), ["judgment_date"])
    assert state() == want
    # As after a stop between the texts and the records.
    s._write_texts(s.hashed(new), 2)
    s.put(new, 1, now(), ["judgment_date"])
    assert state() == want


def test_folders_that_become_empty(spark, tmp_path):
    s = store.judgment_store(spark, f"{tmp_path}/s")
    s.put(judgments(spark, 6, step=400), 0, now(), ["judgment_date"])
    s.put(judgments(spark, 1, step=400).withColumn("judgment_date", F.lit(None).cast("date")), 1, now(), ["judgment_date"])
    rows = {r.doc_id: r.judgment_year for r in s.records.rows().collect()}
    assert rows["00000000"] == 0 and len(rows) == 6
    assert s.delete(judgments(spark, 6, step=400)) and s.records.rows().count() == 0 and s.last().count() == 0
    s.put(judgments(spark, 2), 2, now(), ["judgment_date"])
    assert s.last().count() == 2


@pytest.mark.parametrize("compacted", [False, True])
def test_the_index_follows_inserts_changes_and_deletions(spark, tmp_path, compacted):
    s = store.judgment_store(spark, f"{tmp_path}/s", indexed=True, buckets=4)
    s.put(judgments(spark, 40), 0, now(), ["judgment_date"])
    s.put(judgments(spark, 10, first=5, text="inny wyraz"), 1, now(), ["judgment_date"])
    s.put(judgments(spark, 5, first=100, text="tekst the the"), 2, now(), ["judgment_date"], gone=judgments(spark, 3))
    if compacted:
        s.compact(2)
        assert s.postings().select("version").distinct().count() == s.texts().select("version").distinct().count() == 1
    for phrase in ("tekst", "the", "inny nr7", "nr1", "nr20", "nic"):
        q = Query(phrase=phrase)
        got = search.matches(s.narrow_rows(), q, F.col("full_text"), index=s.postings(), key=(*KEY, "version"), buckets=4)
        fresh = search.lookup(search.postings(s.last(), s.said()), phrase)
        assert sorted((r.doc_id, r["rank"]) for r in got.collect()) == sorted((r.doc_id, r["rank"]) for r in fresh.collect()), phrase


def test_postings_are_cut_by_size(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).select(F.lit("ms").alias("source"), F.col("id").cast("string").alias("doc_id"), F.lit("the").alias("token"), F.lit(1).cast("long").alias("tf"))
    rows = rows.unionByName(rows.limit(1000).withColumn("token", F.concat(F.lit("t"), "doc_id")))
    rows.write.parquet(f"{tmp_path}/p")
    counts = {}
    for per_file in (500, 100_000):
        search.write_postings(spark.read.parquet(f"{tmp_path}/p"), f"{tmp_path}/i{per_file}", buckets=1, per_file=per_file)
        index = spark.read.schema(f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, bucket int").parquet(f"{tmp_path}/i{per_file}")
        counts[per_file] = sorted(r["count"] for r in index.groupBy(F.col("_metadata.file_path")).count().collect())
        assert index.count() == 5000 and search.lookup(index, "the", buckets=1).count() == 4000
    assert counts[100_000] == [5000]
    # The one frequent token fills eight of ten files; none is over twice the middle.
    assert len(counts[500]) == 10 and counts[500][-1] <= 2 * counts[500][5]


def test_a_page_reads_its_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TEXT_GROUP", 64 << 10)
    s = store.judgment_store(spark, f"{tmp_path}/s")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat(F.col("doc_id"), i.cast("string")), 256)), " ")
    s.put(judgments(spark, 3000).withColumn("full_text", words), 0, now(), ["judgment_date"])
    page = s.records.rows().where("source = 'nsa'").orderBy("doc_id").limit(20)
    got = s.fetched(page)
    texts = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in texts and "PartitionFilters: [version" in texts.replace("isnotnull(version", "version")
    assert got.count() == 20 and {r.doc_id for r in got.collect()} == {r.doc_id for r in page.collect()}
    # Rows that the scan of texts gave: some groups, not the table.
    key = sorted(r.doc_id for r in page.collect())
    scan = s.texts().where((F.col("source") == "nsa") & F.col("doc_id").isin(key))
    scan.collect()
    plan = scan._jdf.queryExecution().executedPlan()
    while not plan.nodeName().startswith("Scan"):
        plan = plan.children().apply(0)
    assert 20 <= plan.metrics().apply("numOutputRows").value() < 1500


@pytest.mark.parametrize("q", [Query(sort="date_desc"), Query(sort="date_asc"), Query(phrase="x", sort="relevance")])
def test_seeking_equals_offsets(spark, q):
    rows = spark.range(130).select(F.lit("ms").alias("source"), F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") % 5 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 7).cast("int"))).alias("judgment_date"), F.lit(None).cast("date").alias("publication_date"), (F.col("id") % 3 / 2).alias("rank"))
    ranked = bool(q.phrase)
    terms, last, pages = search.sort_terms(q, ranked), None, []
    while True:
        got = search.page_after(rows, terms, last)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject(limit=20" in plan and "Offset" not in plan
        got = got.collect()
        if not got:
            break
        last = got[-1].asDict()
        pages.append([r.doc_id for r in got])
    want = [[r.doc_id for r in search.page(rows, search.ordering(q, ranked), n).collect()] for n in range(1, 8)]
    assert pages == want


def test_pages_are_dealt_by_size(spark):
    from lexspark.sources import pages

    rows = spark.range(2000).select(F.lit("ms").alias("source"), F.lit("content").alias("kind"), F.col("id").cast("string").alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") < 6, 20_000).when(F.col("id") < 40, 3_000).otherwise(F.lit(100) + F.col("id") % 300).cast("int")).alias("html"))
    rows = rows.repartitionByRange(8, "doc_id").unionByName(rows.where("doc_id = '7'").withColumn("html", F.lit(None).cast("string")))
    got = pages.dealt(rows, parts=20).select("doc_id", F.length("html").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert len(got) == 2001
    loads = {}
    for r in got:
        loads[r.task] = loads.get(r.task, 0) + (r.n or 0)
    ordered = sorted(loads.values())
    assert 20 <= len(ordered) <= 30 and ordered[-1] < 2 * ordered[len(ordered) // 2]
    assert pages.dealt(rows.limit(0)).count() == 0


def test_bitmaps_of_batches_merge(spark):
    from lexspark.operators import subject_index as S

    pairs = spark.range(0, 100_000, 7).select(F.concat(F.lit("r"), F.col("id") % 3).alias("root"), F.col("id").alias("number"))
    parts = [pairs.where("number < 60000"), pairs.where("number > 30000"), pairs.limit(0)]
    got = {r.root: r.total for r in S.branch_totals(S.merged_bitmaps(*map(S.branch_bitmaps, parts))).collect()}
    assert got == {r.root: r.n for r in pairs.groupBy("root").agg(F.count_distinct("number").alias("n")).collect()}


@pytest.mark.parametrize("text, literal", [("ab_c", False), ("a%b", False), ("B C", False), ("żół", False), ("a_b", True), ("xy", False), ("%", False), ("100%", True)])
def test_substrings_by_index(spark, tmp_path, text, literal):
    values = ["abXc", "ab_c", "a then b", "b  c", "b c d", "ŻÓŁĆ", "a_b", "xy", None, "", "100% of", "1000 of", "bc"]
    rows = spark.createDataFrame([("s", str(i), v, v and v[::-1], None) for i, v in enumerate(values)], "source string, doc_id string, full_text string, signature string, sentencja string")
    search.write_postings(search.gram_postings(rows, ("full_text", "signature", "sentencja")), f"{tmp_path}/g", buckets=3)
    index = spark.read.schema("token string, source string, doc_id string, tf long, bucket int").parquet(f"{tmp_path}/g")
    want = sorted(r.doc_id for r in rows.where(search.has_substring(text, literal)).collect())
    assert sorted(r.doc_id for r in search.search_grams(rows, index, text, literal=literal, buckets=3).collect()) == want


def test_a_database_is_read_in_ranges(spark, tmp_path):
    from lexspark.sources import io

    url = f"jdbc:derby:{tmp_path}/db"
    spark.range(100).select(F.col("id").alias("n"), F.concat(F.lit("x"), "id").alias("s")).coalesce(1).write.option("driver", "org.apache.derby.jdbc.EmbeddedDriver").jdbc(f"{url};create=true", "stored")
    got = io.read_jdbc(spark, url, "stored", "n", 0, 100, 4)
    assert got.rdd.getNumPartitions() == 4 and sorted(r.s for r in got.collect()) == sorted(f"x{i}" for i in range(100))
