"""Idempotent table jobs: upserts, skip list, retention, decoding and snapshots (IO2, UP1-UP9, WI1-WI2, JO1-JO4).

Parquet tables can't be updated in place, so each job returns the next snapshot. Joins are on the key
alone; wide texts are taken from whichever side wins and are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import excerpt
from ..functions.subjects import canonical_terms
from ..schemas import JUDGES, KEY

MAX_REASON, MAX_DETAIL = 500, 2000


def _same(a: DataFrame, b: DataFrame, key: Sequence[str]) -> Column:
    out = None
    for k in key:
        one = a[k] == b[k]
        out = one if out is None else out & one
    return out


def known(ids: DataFrame, stored: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """JO1, JO2, JO4: rows of ids whose key is stored."""
    return ids.join(stored.select(*key), list(key), "left_semi")


def missing(ids: DataFrame, *stored: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """JO3, ST2: rows of ids whose key is in none of the tables."""
    for s in stored:
        ids = ids.join(s.select(*key), list(key), "left_anti")
    return ids


def first_wins(rows: DataFrame, order: Sequence[Column | str], key: Sequence[str] = KEY) -> DataFrame:
    """WI1: the first row of each key in the given order. Rows without a whole key are dropped."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.dropna(subset=list(key)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinct_in_order(ids: DataFrame, id_col: str, order: str) -> DataFrame:
    """WI2: each id once, with the place of its first occurrence."""
    return ids.groupBy(id_col).agg(F.min(order).alias(order))


def upsert_light(stored: DataFrame, hits: DataFrame, now: Column, order: Sequence[Column | str], key: Sequence[str] = KEY) -> DataFrame:
    """UP1: unknown hits are added; of known ones only last_seen_at moves. The column ``is_new`` marks additions."""
    fresh = first_wins(hits, order, key)
    seen = fresh.select(*key, F.lit(True).alias("_seen"))
    old = stored.join(seen, list(key), "left").withColumn("last_seen_at", F.when(F.col("_seen"), now).otherwise(F.col("last_seen_at")))
    new = missing(fresh, stored, key=key).withColumns({"first_seen_at": now, "last_seen_at": now})
    return old.drop("_seen").withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)), allowMissingColumns=True)


def prepared_judgments(docs: DataFrame) -> DataFrame:
    """UP2: what is stored of parsed documents: canonical terms, panel from judges, excerpt."""
    out = docs.withColumn("thematic", canonical_terms(F.col("thematic")))
    if "judges" in docs.columns:
        out = out.withColumn("panel", F.transform(F.coalesce(F.col("judges"), F.array().cast(JUDGES)), lambda j: j["name"]))
    return out.withColumn("excerpt", excerpt(F.col("excerpt"), F.col("sentencja"), F.col("full_text")))


def upsert_full(stored: DataFrame, docs: DataFrame, now: Column, order: Sequence[Column | str], key: Sequence[str] = KEY) -> DataFrame:
    """UP2, UP3: incoming rows replace stored ones, nulls included; first_seen_at stays."""
    fresh = first_wins(docs, order, key).drop("first_seen_at", "last_seen_at")
    times = stored.select(*key, "first_seen_at")
    taken = fresh.join(times, list(key), "left").withColumns({"first_seen_at": F.coalesce("first_seen_at", now), "last_seen_at": now})
    return missing(stored, fresh, key=key).unionByName(taken, allowMissingColumns=True).select(*stored.columns)


def mark_skipped(skipped: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """UP4: added if absent; the first entry of a key stays. Reasons are cut to their column's length."""
    cut = new.withColumn("reason", F.substring("reason", 1, MAX_REASON)).select(*skipped.columns)
    both = skipped.withColumn("_o", F.lit(0)).unionByName(cut.withColumn("_o", F.lit(1)))
    rest = [c for c in skipped.columns if c not in key]
    best = both.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("_o", "skipped_at", "reason")).alias("s"))
    return best.select(*key, *[F.col(f"s.{c}").alias(c) for c in rest]).select(*skipped.columns)


def delete(stored: DataFrame, keys: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """UP5."""
    return missing(stored, keys, key=key)


def retained(rows: DataFrame, time: str, as_of: Column, keep_days: int) -> DataFrame:
    """UP6: rows not older than keep_days; 0 keeps all. Rows without a time stay."""
    if not keep_days:
        return rows
    return rows.where(F.col(time).isNull() | (F.col(time) >= as_of - F.make_interval(days=F.lit(keep_days))))


def renormalised(stored: DataFrame) -> DataFrame:
    """UP7: terms in their canonical form, with ``changed`` for rows that differ; idempotent."""
    new = canonical_terms(F.col("thematic"))
    return stored.withColumn("_t", new).withColumn("changed", ~F.col("_t").eqNullSafe(F.coalesce("thematic", F.array().cast("array<string>")))).withColumn("thematic", F.col("_t")).drop("_t")


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """UP8: rows of both; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def decoded_judgments(rows: DataFrame) -> DataFrame:
    """IO2: JSON text columns of an imported table become arrays; bad JSON gives empty ones; panel and url filled."""
    strings = F.array().cast("array<string>")
    out = rows
    for c in ("panel", "thematic"):
        out = out.withColumn(c, F.coalesce(F.from_json(F.col(c), "array<string>"), strings))
    out = out.withColumn("judges", F.coalesce(F.from_json("judges", JUDGES), F.array().cast(JUDGES)))
    names = F.filter(F.transform("judges", lambda j: j["name"]), lambda n: n.isNotNull() & (n != ""))
    out = out.withColumn("panel", F.when(F.size("panel") == 0, names).otherwise(F.col("panel")))
    return out.withColumn("url", F.concat_ws("/", F.lit("/orzeczenie"), F.lit(None).cast("string"), "source", "doc_id"))


def decoded_acts(rows: DataFrame) -> DataFrame:
    """IO2 for acts."""
    strings = F.array().cast("array<string>")
    out = rows
    for c in ("released_by", "keywords"):
        out = out.withColumn(c, F.coalesce(F.from_json(F.col(c), "array<string>"), strings))
    refs = F.from_json("act_references", "map<string,array<struct<id:string>>>")
    return out.withColumn("act_references", F.coalesce(refs, F.create_map().cast("map<string,array<struct<id:string>>>")))


def write_snapshot(table: DataFrame, folder: str, version: int, partitions: Sequence[str] = ()) -> str:
    """A new version beside the old ones; readers take the version they were given."""
    path = f"{folder.rstrip('/')}/v={version:08d}"
    writer = table.write.mode("errorifexists")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return path


def appended_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    """IO11: the run log with one more run; details are cut to their column's length."""
    return runs.unionByName(run.withColumn("detail", F.substring("detail", 1, MAX_DETAIL)), allowMissingColumns=True)


