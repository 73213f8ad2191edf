"""A ruling and its separately published reasoning become one record (MG1-MG8, JO5, AG6, AG7, ST3, ST4).

Groups are counted before anything is paired, and only groups of exactly two are joined, so a signature
that very many rows share never multiplies. Null signatures and courts match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import RULINGS, excerpt
from ..functions.text import filled

GROUP = ("source", "signature", "court")


def is_pair(a: Column, b: Column) -> Column:
    """MG1: one side is a reasoning, the other a type of ruling."""
    one = F.coalesce(a == "uzasadnienie", F.lit(False)) != F.coalesce(b == "uzasadnienie", F.lit(False))
    return one & (F.coalesce(a.isin(*RULINGS), F.lit(False)) | F.coalesce(b.isin(*RULINGS), F.lit(False)))


def _appended(own: Column, more: Column) -> Column:
    """Own text, followed by the other unless it holds it already."""
    own, more = F.coalesce(own, F.lit("")), F.coalesce(more, F.lit(""))
    text = F.when((more == "") | F.contains(own, more), own).otherwise(F.concat_ws("\n\n", filled(own), more))
    return filled(text)


def united_judges(a: Column, b: Column) -> Column:
    """ST4: the ruling's judges, then those of the reasoning whose names, in small letters, it lacks."""
    a, b = F.coalesce(a, F.array().cast("array<struct<name:string,role:string,note:string>>")), F.coalesce(b, F.array().cast("array<struct<name:string,role:string,note:string>>"))
    low = lambda j: F.lower(F.coalesce(j["name"], F.lit("")))
    names = F.transform(a, low)
    added = F.filter(b, lambda j, i: (low(j) != "") & ~F.array_contains(names, low(j)) & (F.array_position(F.transform(b, low), low(j)) == i + 1))
    return F.concat(a, added)


def combined(r: str, u: str) -> dict[str, Column]:
    """MG2: columns of the merged record from the structs ``r`` (ruling) and ``u`` (reasoning)."""
    c = lambda s, n: F.col(f"{s}.{n}")
    first = lambda n: F.coalesce(filled(c(r, n)), filled(c(u, n)))
    strings = F.array().cast("array<string>")
    full = _appended(c(r, "full_text"), c(u, "full_text"))
    return {
        "uzasadnienie": _appended(c(r, "uzasadnienie"), F.coalesce(filled(c(u, "uzasadnienie")), c(u, "full_text"))),
        "full_text": full,
        "thematic": F.array_union(F.coalesce(c(r, "thematic"), strings), F.coalesce(c(u, "thematic"), strings)),
        "judges": united_judges(c(r, "judges"), c(u, "judges")),
        "legal_basis": first("legal_basis"), "importance": first("importance"), "doc_type_raw": first("doc_type_raw"),
        "excerpt": excerpt(F.lit(None).cast("string"), c(r, "sentencja"), full),
    }


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """AG6: keys that several rows share."""
    return rows.dropna(subset=list(GROUP)).groupBy(*GROUP).agg(F.count("*").alias("n")).where("n > 1")


def pairs(rows: DataFrame) -> DataFrame:
    """AG7 for groups of two: structs ``a`` and ``b``, a with the smaller id."""
    two = duplicate_groups(rows).where("n = 2").select(*GROUP)
    kept = rows.join(two, list(GROUP), "left_semi")
    ends = kept.groupBy(*GROUP).agg(F.min("doc_id").alias("low"))
    whole = F.struct(*rows.columns)
    marked = kept.join(ends, list(GROUP)).select(*GROUP, (F.col("doc_id") == F.col("low")).alias("first"), whole.alias("r"))
    a = marked.where("first").select(*GROUP, F.col("r").alias("a"))
    b = marked.where("not first").select(*GROUP, F.col("r").alias("b"))
    return a.join(b, list(GROUP))


def resolved(pairs: DataFrame) -> DataFrame:
    """MG2-MG4: ``kind`` of each pair, ``keep`` and ``absorb``.

    A reasoning and a ruling are merged. Otherwise contents decide: an operative part and a lone reasoning
    are merged, a complete record replaces one that isn't, and anything else is ambiguous.
    """
    has = lambda s, n: F.coalesce(filled(F.col(f"{s}.{n}")), F.lit("")) != ""
    sa, ua, sb, ub = has("a", "sentencja"), has("a", "uzasadnienie"), has("b", "sentencja"), has("b", "uzasadnienie")
    typed = is_pair(F.col("a.doc_type"), F.col("b.doc_type"))
    a_first = (
        F.when(typed, F.coalesce(F.col("b.doc_type") == "uzasadnienie", F.lit(False)))
        .when(sa & ~ua & ub & ~sb, True).when(sb & ~ub & ua & ~sa, False)
        .when(sa & ua & ~(sb & ub), True).when(sb & ub & ~(sa & ua), False)
    )
    merged = typed | (sa & ~ua & ub & ~sb) | (sb & ~ub & ua & ~sa)
    kind = F.when(merged, "scalono").when((sa & ua) != (sb & ub), "zastąpiono").otherwise("niejednoznaczne")
    out = pairs.withColumn("kind", kind).withColumn("_a", a_first)
    keep, absorb = F.when(F.col("_a"), F.col("a")).otherwise(F.col("b")), F.when(F.col("_a"), F.col("b")).otherwise(F.col("a"))
    known = F.col("kind") != "niejednoznaczne"
    return out.withColumn("keep", F.when(known, keep)).withColumn("absorb", F.when(known, absorb)).drop("_a")


def merge_duplicates(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MG5, AG12: the table after merging, the keys absorbed (for the skip list), and counts by kind."""
    done = resolved(pairs(rows))
    merged = done.where("kind = 'scalono'")
    new = combined("keep", "absorb")
    columns = [new[c].alias(c) if c in new else F.col(f"keep.{c}").alias(c) for c in rows.columns]
    fresh = merged.select(*columns)
    absorbed = done.where("kind <> 'niejednoznaczne'").select(F.col("absorb.source").alias("source"), F.col("absorb.doc_id").alias("doc_id"))
    out = rows.join(absorbed, ["source", "doc_id"], "left_anti").join(fresh.select("source", "doc_id"), ["source", "doc_id"], "left_anti").unionByName(fresh)
    large = duplicate_groups(rows).where("n > 2").select(F.lit("niejednoznaczne").alias("kind"))
    counts = done.select("kind").unionByName(large).groupBy("kind").agg(F.count("*").alias("n"))
    return out, absorbed, counts


def merge_named(rows: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MG6: pairs given as (source, keep, absorb); pairs with a missing or empty record change nothing."""
    whole = rows.where(filled(F.col("full_text")).isNotNull()).select("source", "doc_id", F.struct(*rows.columns).alias("r"))
    a = named.join(whole.select("source", F.col("doc_id").alias("keep"), F.col("r").alias("x")), ["source", "keep"])
    both = a.join(whole.select("source", F.col("doc_id").alias("absorb"), F.col("r").alias("y")), ["source", "absorb"])
    both = both.where("keep <> absorb")
    new = combined("x", "y")
    fresh = both.select(*[new[c].alias(c) if c in new else F.col(f"x.{c}").alias(c) for c in rows.columns])
    gone = both.select("source", F.col("absorb").alias("doc_id"))
    touched = gone.unionByName(fresh.select("source", "doc_id"))
    return rows.join(touched, ["source", "doc_id"], "left_anti").unionByName(fresh), gone


def siblings(rows: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """JO5: for each row the smallest id of another with its source, signature and court and an equal date.

    Equal judgment or equal publication dates count. Each kind of date is an equi-join of its own, on
    the smallest two ids of a key, so no group is joined with itself.
    """
    others = rows if others is None else others
    found = None
    for date in ("judgment_date", "publication_date"):
        key = [*GROUP, date]
        low = others.dropna(subset=key).groupBy(*key).agg(F.min("doc_id").alias("one"))
        rest = others.dropna(subset=key).join(low, key).where("doc_id <> one").groupBy(*key).agg(F.min("doc_id").alias("two"))
        both = low.join(rest, key, "left")
        mine = rows.dropna(subset=key).select("doc_id", *key).join(both, key)
        mine = mine.select("source", "doc_id", F.when(F.col("one") != F.col("doc_id"), F.col("one")).otherwise(F.col("two")).alias("sibling"))
        found = mine if found is None else found.unionByName(mine)
    return found.where("sibling is not null").groupBy("source", "doc_id").agg(F.min("sibling").alias("sibling"))


def completed(rows: DataFrame) -> DataFrame:
    """JO11: a record without a text gives way to its sibling's, under the sibling's id; ``requested`` is the id asked for.

    Records that have a text, or no sibling with one, stay as they are.
    """
    has = filled(F.col("full_text")).isNotNull()
    bare, whole = rows.where(~has), rows.where(has)
    found = siblings(bare, whole).select("source", F.col("doc_id").alias("requested"), "sibling")
    other = found.join(whole.withColumnRenamed("doc_id", "sibling"), ["source", "sibling"]).withColumnRenamed("sibling", "doc_id")
    rest = rows.join(found.select("source", F.col("requested").alias("doc_id")), ["source", "doc_id"], "left_anti")
    return rest.withColumn("requested", F.col("doc_id")).unionByName(other)


def classified(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """MG7: ``action`` for each row of a batch: skip (no text), merge (with ``sibling``), hold (lone reasoning), store.

    Siblings are looked up among the batch and the stored rows with the batch's keys.
    """
    near = stored.join(batch.select(*GROUP).distinct(), list(GROUP), "left_semi").join(batch.select("source", "doc_id"), ["source", "doc_id"], "left_anti")
    columns = ["source", "doc_id", "signature", "court", "judgment_date", "publication_date", "doc_type", "full_text"]
    pool = batch.select(*columns).unionByName(near.select(*columns)).where(filled(F.col("full_text")).isNotNull())
    found = siblings(batch, pool).join(pool.select("source", F.col("doc_id").alias("sibling"), F.col("doc_type").alias("other_type")), ["source", "sibling"])
    out = batch.join(found, ["source", "doc_id"], "left")
    empty = filled(F.col("full_text")).isNull()
    paired = F.col("sibling").isNotNull() & is_pair(F.col("doc_type"), F.col("other_type"))
    action = F.when(empty, "skip").when(paired, "merge").when(F.col("doc_type") == "uzasadnienie", "hold").otherwise("store")
    return out.withColumn("action", action).withColumn("sibling", F.when(F.col("action") == "merge", F.col("sibling"))).drop("other_type")


def merged_hits(hits: DataFrame, order: str = "ord") -> DataFrame:
    """MG8: in a listing, a ruling and its reasoning with an equal date become the ruling's hit, at the earlier place.

    Both are of one source: ids, signatures and courts of other sources are other hits.
    """
    key = list(GROUP)
    two = hits.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).where("n = 2")
    whole = F.struct(*hits.columns)
    a = hits.join(two, key).where(F.col(order) == F.col("low")).select(*key, whole.alias("a"))
    b = hits.join(two, key).where(F.col(order) == F.col("high")).select(*key, whole.alias("b"))
    both = a.join(b, key)
    dates = F.coalesce(F.col("a.judgment_date") == F.col("b.judgment_date"), F.lit(False)) | F.coalesce(F.col("a.publication_date") == F.col("b.publication_date"), F.lit(False))
    both = both.where(is_pair(F.col("a.doc_type"), F.col("b.doc_type")) & dates)
    first = F.col("b.doc_type") == "uzasadnienie"
    keep, other = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    both = both.withColumn("k", keep).withColumn("o", other).withColumn("p", F.least(f"a.{order}", f"b.{order}"))
    take = {order: F.col("p"), "excerpt": F.coalesce(filled(F.col("k.excerpt")), F.col("o.excerpt"))}
    fresh = both.select(*[take.get(c, F.col(f"k.{c}")).alias(c) for c in hits.columns])
    gone = both.select("source", F.explode(F.array("a.doc_id", "b.doc_id")).alias("doc_id"))
    return hits.join(gone, ["source", "doc_id"], "left_anti").unionByName(fresh)
