"""Counters, interleaving, freshness and health (AG1, AG2, AG4, AG5, AG13, AG15, AG17, WI3, SO2, SO5, ST1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_source(rows: DataFrame) -> DataFrame:
    """AG2: counts per source and in all (source null)."""
    return rows.rollup("source").agg(F.count("*").alias("n"))


def cursor(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """AG4, AG5: the largest value, per group."""
    return rows.groupBy(*by).agg(F.max(column).alias(column))


def interleaved(hits: DataFrame, order: str = "ord") -> DataFrame:
    """WI3: sources take turns by place within the source; sources in order of first appearance. Adds ``turn``, ``source_rank``."""
    first = hits.groupBy("source").agg(F.min(order).alias("_first"))
    ranked = first.select("source", F.row_number().over(Window.orderBy("_first")).alias("source_rank"))  # a row for each source
    w = Window.partitionBy("source").orderBy(order)
    return hits.withColumn("turn", F.row_number().over(w)).join(ranked, "source").orderBy("turn", "source_rank")


def live_order(sort: str) -> list[Column]:
    """SO2: the order of merged hits."""
    shown = F.coalesce("publication_date", "judgment_date") if sort == "pub_desc" else F.col("judgment_date")
    return [shown.asc_nulls_last() if sort == "date_asc" else shown.desc_nulls_last(), F.col("source"), F.col("doc_id")]


def freshness(rows: DataFrame, as_of: Column, hours: int, time: str = "first_seen_at") -> DataFrame:
    """AG15: rows, newest row, its age in hours and whether that is above the limit."""
    out = rows.agg(F.count("*").alias("n"), F.max(time).alias("newest"))
    age = F.timestamp_diff("HOUR", F.col("newest"), as_of)
    return out.withColumn("age_hours", age).withColumn("alert", F.coalesce(F.col("age_hours") > hours, F.lit(True)))


def last_runs(runs: DataFrame, n: int, *ties: str) -> DataFrame:
    """SO5."""
    return runs.orderBy(F.desc("started_at"), *[F.desc(t) for t in ties]).limit(n)


def healthy(runs: DataFrame, n: int = 60, *ties: str) -> DataFrame:
    """AG17: of the last n runs, how many were well; unhealthy if none."""
    out = last_runs(runs, n, *ties).agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count("*").alias("n"))
    return out.withColumn("unhealthy", (F.col("ok") == 0) & (F.col("n") > 0))


def run_stats(items: DataFrame) -> DataFrame:
    """AG13: per source what was seen, added and rejected, and the run's status."""
    by = items.groupBy("source").agg(F.count("*").alias("seen"), F.count_if("added").alias("added"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return by.withColumn("status", F.when((F.col("failed") > 0) & (F.col("failed") == F.col("seen")), "blad").otherwise("ok"))
