"""Plans: what reaches the scan, and what must not be in a plan."""

import pytest
from pyspark.sql import functions as F

from lexspark.functions.fields import search_text
from lexspark.operators import acts, layout, merge, search, tables
from lexspark.schemas import JUDGMENTS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("judgments") / "t")
    rows = spark.range(200).select(
        F.element_at(F.array(F.lit("ms"), F.lit("nsa"), F.lit("kio")), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.col("id").cast("string").alias("doc_id"),
        F.concat(F.lit("I C "), (F.col("id") / 2).cast("int").cast("string")).alias("signature"), F.lit("Sąd").alias("court"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("judgment_date"), F.lit("kara umowna").alias("full_text"),
    )
    empty = spark.createDataFrame([], JUDGMENTS)
    empty.unionByName(rows, allowMissingColumns=True).coalesce(1).write.partitionBy("source").parquet(path)
    return spark.read.schema(JUDGMENTS).parquet(path)


def test_filters_and_columns_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    q = search.Query(source="ms", date_from="2020-02-01", date_to="2020-03-01")
    text = plan(search.matches(stored, q, F.col("full_text")).select("source", "doc_id"))
    assert "PartitionFilters: [isnotnull(source" in text and "(source" in text.partition("PartitionFilters")[2][:80]
    assert "GreaterThanOrEqual(judgment_date" in text and "LessThanOrEqual(judgment_date" in text
    schema = text.partition("ReadSchema: ")[2].partition("\n")[0]
    assert "judgment_date" in schema and "full_text" not in schema and "sentencja" not in schema


def test_a_page_is_taken_from_each_task(stored):
    found = search.matches(stored, search.Query(phrase="kara"), F.col("full_text"))
    text = plan(search.page(found.select("source", "doc_id", "judgment_date", "rank"), search.ordering(search.Query(phrase="kara"), True), 2))
    assert "TakeOrderedAndProject" in text and "full_text" in text.partition("ReadSchema: ")[2]


def test_counts_are_combined_before_the_shuffle(stored):
    text = plan(search.count_by_source(stored, search.Query(phrase="kara"), search_text(F.col("signature"), F.col("full_text"))))
    assert text.count("HashAggregate") == 2 and "partial_count" in text and "Python" not in text


@pytest.mark.parametrize("job", ["siblings", "pairs", "missing", "nearest", "citing"])
def test_no_products_of_rows(spark, stored, job):
    cells = stored.select(F.col("source").alias("doc"), F.lit(1).alias("table_id"), F.col("doc_id").cast("int").alias("row_idx"), F.rand(1).alias("center"), F.array("doc_id").alias("cells"))
    titled = spark.createDataFrame([("DU", 2020, 1, "Kodeks cywilny")], "publisher string, year int, pos int, title string")
    made = {
        "siblings": lambda: merge.siblings(stored), "pairs": lambda: merge.resolved(merge.pairs(stored)), "missing": lambda: tables.missing(stored, stored),
        "nearest": lambda: layout.nearest(layout.anchors(cells)), "citing": lambda: acts.citing(titled, stored),
    }[job]()
    text = plan(made)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text
