"""Rows of tables cut by line breaks become logical rows again; paragraphs (TX5-TX7, JO12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SENTINEL

TABLE = ("doc", "table_id")


def anchors(cells: DataFrame) -> DataFrame:
    """Marks anchors: rows whose first cell is digits, and the first other row with a first cell (the header)."""
    first = F.trim(F.coalesce(F.get("cells", 0), F.lit("")))
    digits = first.rlike(r"^\d+$")
    out = cells.withColumn("_other", (first != "") & ~digits)
    w = Window.partitionBy(*TABLE).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("header", F.col("_other") & (F.sum(F.col("_other").cast("int")).over(w) == 1))
    return out.withColumn("is_anchor", digits | F.col("header")).drop("_other")


def nearest(rows: DataFrame, by: tuple[str, ...] = TABLE) -> DataFrame:
    """JO12: ``anchor_idx`` of the anchor nearest to each row's ``center``; ties go to the earlier anchor.

    One sort for each table: the nearest anchor is the last one above or the first one below, so rows and
    anchors of a table are never paired. Null where a table has no anchor.
    """
    w = Window.partitionBy(*by).orderBy("center")
    up = F.max(F.when(F.col("is_anchor"), F.struct(F.col("center").alias("c"), (-F.col("row_idx")).alias("i")))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    down = F.min(F.when(F.col("is_anchor"), F.struct(F.col("center").alias("c"), F.col("row_idx").alias("i")))).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    out = rows.withColumn("_u", up).withColumn("_d", down)
    above, below = F.col("center") - F.col("_u.c"), F.col("_d.c") - F.col("center")
    a, b = -F.col("_u.i"), F.col("_d.i")
    pick = F.when(F.col("_u").isNull(), b).when(F.col("_d").isNull(), a).when(above < below, a).when(below < above, b).otherwise(F.least(a, b))
    return out.withColumn("anchor_idx", pick).drop("_u", "_d")


def logical_rows(cells: DataFrame) -> DataFrame:
    """TX5: cells of the rows of one anchor, joined by position in row order. Tables with under two anchors stay as they are."""
    marked = anchors(cells.withColumn("cells", F.transform("cells", lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))))
    w = Window.partitionBy(*TABLE)
    marked = nearest(marked.withColumn("_n", F.sum(F.col("is_anchor").cast("int")).over(w)))
    marked = marked.withColumn("group_idx", F.when(F.col("_n") >= 2, F.col("anchor_idx")).otherwise(F.col("row_idx")))
    marked = marked.withColumn("header", F.col("header") & (F.col("_n") >= 2))
    one = marked.select(*TABLE, "group_idx", "row_idx", "header", F.posexplode("cells").alias("col", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("row_idx", "text")))), lambda x: x["text"]), " ")
    by = one.groupBy(*TABLE, "group_idx", "col").agg(text.alias("text"), F.max("header").alias("header"))
    merged = F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"])
    return by.groupBy(*TABLE, "group_idx").agg(merged.alias("cells"), F.max("header").alias("header"))


def escaped(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rendered(rows: DataFrame) -> DataFrame:
    """TX6: one block of HTML for each table, behind the sentinel."""
    tag = lambda t: F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda c: F.concat(F.lit(f"<{t}>"), escaped(c), F.lit(f"</{t}>"))), ""), F.lit("</tr>"))
    filled = rows.where(F.exists("cells", lambda c: c != ""))
    lines = filled.select(*TABLE, "group_idx", "header", F.when(F.col("header"), tag("th")).otherwise(tag("td")).alias("line"))
    by = lines.groupBy(*TABLE).agg(F.max(F.when(F.col("header"), F.col("line"))).alias("head"), F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("group_idx", "line")))).alias("body"))
    body = F.array_join(F.transform("body", lambda x: x["line"]), "")
    head = F.coalesce(F.concat(F.lit("<thead>"), F.col("head"), F.lit("</thead>")), F.lit(""))
    table = F.concat(F.lit(SENTINEL + '<div class="pdf-table-wrap"><table class="pdf-table">'), head, F.lit("<tbody>"), body, F.lit("</tbody></table></div>"))
    return by.select(*TABLE, table.alias("block"))


def paragraphs(rows: DataFrame, text: str = "full_text") -> DataFrame:
    """TX7: one row for each line of a text, with its place and whether it is a rendered table."""
    out = rows.select(*[c for c in rows.columns if c != text], F.posexplode(F.split(F.col(text), "\n", -1)).alias("n", "line"))
    return out.withColumn("is_table", F.startswith("line", F.lit(SENTINEL)))
