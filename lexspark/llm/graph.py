"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``label`` for every node of ``links(a, b)``; label is the smallest node of its component.

    Each round points every node's neighbours at the smallest neighbour (first the larger, then the
    smaller ones), until nothing changes. Minima are combined before the shuffle, and the joins let
    adaptive execution split the rows of a node with very many links. Empty links give an empty table.
    """
    stars = materialise(_directed(links), "links")
    for _ in range(most_rounds):
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = _directed(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "n"), F.col("u") == F.col("n"))
        small = small.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        stars = materialise(_directed(small), "links")
        if _settled(stars):
            break
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _settled(stars: DataFrame) -> bool:
    """Every node has one smaller neighbour, which has none: the links are stars around the smallest nodes."""
    ends = stars.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        stars.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    by = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def _directed(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
