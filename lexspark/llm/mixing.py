"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

*Targets.* Sources share the total by weight; a source's target stops at ``most`` times its size and the
excess is shared again by weight among the others, until none is above. A source is full when its target
per weight exceeds ``most * size / weight``, so in the order of that ratio the full ones come first: one
pass over the sorted sources with running sums finds the level, without repeated rounds.

*Selection.* A source whose target holds its size k times takes all of its documents k times (complete
epochs). The rest of the target is sampled without replacement: each document draws the exponential key
``-ln(u) / w``, with u from a hash of its id and w its quality weight (the share of its lines that are
distinct), and the documents with the smallest keys whose running total of words comes nearest to the
rest are taken once more.

Running totals inside a source are summed by range partitions (``running_sum``), so one source may hold
any share of the rows. Only ids, sources, sizes and keys are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, running_sum

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3, "mix"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    # 48 bits of the digest, from the middle of each step, so that u is neither 0 nor 1.
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    weight = F.size(F.array_distinct(lines)) / F.size(lines)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), (-F.log(u) / weight).alias("key"), F.xxhash64(text).alias("row"),
    )


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """Add ``target`` to ``source``, ``source_size``: one row for each source."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source only
    at = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sources.withColumn("_w", at).withColumn("_ratio", most * F.col("source_size") / F.col("_w"))
    up = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    rest = total - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    left = F.sum("_w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("_level", rest / left).withColumn("_full", F.col("_level") >= F.col("_ratio"))
    # Ratios rise, so the full sources come first; the level of the others is that of the first of them.
    level = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_level"))).over(Window.partitionBy())["_level"]
    target = F.when(F.col("_full"), most * F.col("source_size")).otherwise(F.col("_w") * level).cast("double")
    return out.withColumn("target", target).select("source", "source_size", "target")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST, with_row: bool = False,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``times`` for every row of ``docs``.

    Null texts have size 0 and are never taken; a null source is a source of its own and comes last. Null
    ids share one draw. Ties of keys go by id, then by a hash of the text; repeated rows count as rows.
    Reruns give the same rows. with_row adds ``row``, the 64-bit hash of the text. An empty table gives an empty table. Other columns are not read.
    """
    rows = materialise(sized(docs, id_col, text_col, source_col), "sizes")
    by = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by = materialise(targets(by, weights, share, most), "targets").withColumnRenamed("source", "_s")
    full = running_sum(rows, ["key", "doc_id", "row"], "size", "source", "before")
    out = full.join(by, F.col("source").eqNullSafe(F.col("_s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = out.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    # The document that crosses the rest is taken if that brings the total nearer.
    more = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("_rest"))
    times = (F.col("_epochs") + F.when(more, 1).otherwise(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), *(["row"] if with_row else []))


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return mix(read_table(spark, sf_dir, "documents")).drop("times")


#: The same mix in DuckDB's SQL.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), s AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('{SEED}' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(1 << 48)}::DOUBLE)
      / (len(list_distinct(lines))::DOUBLE / len(lines)) AS key
  FROM d
), g AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM g
), r AS (
  SELECT *, {MOST} * source_size / w AS ratio FROM w
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM g)
      - coalesce(sum({MOST} * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), t AS (
  SELECT source, source_size, CASE WHEN level >= ratio THEN ({MOST} * source_size)::DOUBLE
      ELSE w * (SELECT level FROM l WHERE level < ratio ORDER BY ratio, source NULLS LAST LIMIT 1) END AS target
  FROM l
), b AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN size > 0 AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""
