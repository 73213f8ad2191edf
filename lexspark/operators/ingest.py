"""Discovery of new documents and acts, backlog batches and data quality (IO3, SM1, SM2, SM4, WI4, WI6, DQ1-DQ3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled
from .tables import missing

MAX_IDS, BATCH, BACKLOG, WINDOW_DAYS = 20_000, 400, 150, 14


def listed_ids(responses: DataFrame, most: int | None = MAX_IDS) -> DataFrame:
    """IO3: ids of saved XML list pages (``offset``, ``body``) in list order, each once."""
    ids = responses.select("offset", F.posexplode(F.regexp_extract_all("body", F.lit(r"<id>([^<]+)</id>"), F.lit(1))).alias("pos", "doc_id"))
    once = ids.groupBy("doc_id").agg(F.min(F.struct("offset", "pos")).alias("ord"))
    out = once.orderBy("ord").limit(most) if most else once
    return out.select("doc_id", "ord")


def listed_total(responses: DataFrame) -> DataFrame:
    """IO3: the total that the pages state."""
    found = F.regexp_extract("body", r'total="(\d+)"', 1).try_cast("long")
    return responses.agg(F.coalesce(F.max(found), F.lit(0)).alias("total"))


def new_ids(listed: DataFrame, stored: DataFrame, skipped: DataFrame, most: int = BATCH, newest_first: bool = False, order: str = "ord") -> DataFrame:
    """SM1, SM4, WI4: listed ids that are neither stored nor skipped; the first ``most`` in list order or from its end."""
    fresh = missing(listed, stored, skipped)
    o = F.col(order)
    return fresh.orderBy(o.desc() if newest_first else o.asc(), "doc_id").limit(most)


def missing_positions(listed: DataFrame, acts: DataFrame, most: int) -> DataFrame:
    """WI6: per publisher and year the first missing positions, newest first."""
    fresh = missing(listed, acts, key=("publisher", "year", "pos"))
    w = Window.partitionBy("publisher", "year").orderBy(F.desc("pos"))
    return fresh.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def in_window(rows: DataFrame, date: str, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """SM2: rows of the last days before a given day."""
    return rows.where(F.col(date) >= F.date_sub(as_of, days))


def discovery_start(cursor: Column, as_of: Column, days: int = WINDOW_DAYS) -> Column:
    """SM1: where listing starts: the cursor, or some days back where nothing is stored."""
    return F.coalesce(cursor, F.date_sub(as_of, days))


def quality(parsed: DataFrame) -> DataFrame:
    """DQ1, DQ2: ``reason`` and whether it is permanent; only permanent ones go to the skip list."""
    reason = F.when(F.col("blocked"), "blokada").when(F.col("signature").isNull(), "brak metryki").when(filled(F.col("full_text")).isNull(), "brak treści w źródle")
    return parsed.withColumn("reason", reason).withColumn("permanent", F.coalesce(reason == "brak treści w źródle", F.lit(False)))


def without_text(acts: DataFrame) -> DataFrame:
    """DQ3."""
    return acts.agg(F.count_if(filled(F.col("full_text")).isNull()).alias("without_text"), F.count("*").alias("acts"))
