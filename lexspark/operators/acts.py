"""Legal acts: flags, references between acts, rulings that cite an act, coverage (SC18, SC22-SC24, JO6-JO9, AG3, AG14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ACT_KEY

# Groups of references that hold a consolidated text.
CONSOLIDATED = ["Inf. o tekście jednolitym", "Tekst jednolity dla aktu"]
# Major acts by a part of their title, in this order, and how rulings write them.
CODES = [
    ("kodeks cywilny", ["k.c.", "kc"]),
    ("kodeks karny wykonawczy", ["k.k.w.", "kkw"]),
    ("kodeks karny skarbowy", ["k.k.s.", "kks"]),
    ("kodeks karny", ["k.k.", "kk"]),
    ("kodeks postępowania cywilnego", ["k.p.c.", "kpc"]),
    ("kodeks postępowania karnego", ["k.p.k.", "kpk"]),
    ("kodeks postępowania administracyjnego", ["k.p.a.", "kpa"]),
    ("kodeks rodzinny i opiekuńczy", ["k.r.o.", "kro"]),
    ("kodeks pracy", ["k.p."]),
    ("kodeks spółek handlowych", ["k.s.h.", "ksh"]),
    ("kodeks wykroczeń", ["k.w."]),
    ("prawo o ruchu drogowym", ["prawo o ruchu drogowym"]),
    ("prawo bankowe", ["prawo bankowe"]),
    ("prawo zamówień publicznych", ["prawo zamówień publicznych", "p.z.p.", "pzp"]),
    ("prawo upadłościowe", ["prawo upadłościowe"]),
    ("ordynacja podatkowa", ["ordynacja podatkowa", "ordynacji podatkowej", "o.p."]),
    ("o księgach wieczystych i hipotece", ["KWU"]),
    ("konstytucja rzeczypospolitej polskiej", ["konstytucji", "konstytucja rp"]),
]


def code_of(title: Column) -> Column:
    """SC18: the major act that a title names; amending acts name none."""
    low = F.lower(title)
    out = F.lit(None).cast("string")
    for name, _ in reversed(CODES):
        out = F.when(low.contains(name), name).otherwise(out)
    return F.when(~low.contains("o zmianie"), out)


def codes_cited(basis: Column) -> Column:
    """All major acts whose writings occur in a legal basis, as an array."""
    hits = []
    for name, terms in CODES:
        test = F.lit(False)
        for t in terms:
            test = test | basis.ilike(f"%{t}%")
        hits.append(F.when(test, F.lit(name)))
    return F.array_compact(F.array(*hits))


def has_consolidated(refs: Column, groups: list[str] = CONSOLIDATED) -> Column:
    """SC22."""
    out = F.lit(False)
    for g in groups:
        out = out | (F.size(F.coalesce(F.try_element_at(refs, F.lit(g)), F.array().cast("array<struct<id:string>>"))) > 0)
    return out


def act_id(c: Column) -> Column:
    """SC23: 'P/Y/N' as a struct; null if malformed."""
    parts = F.split(c, "/")
    year, pos = F.get(parts, 1).try_cast("int"), F.get(parts, 2).try_cast("int")
    good = (F.size(parts) == 3) & year.isNotNull() & pos.isNotNull() & (F.get(parts, 0) != "")
    return F.when(good, F.struct(F.get(parts, 0).alias("publisher"), year.alias("year"), pos.alias("pos")))


def reference_ids(refs: Column, groups: list[str]) -> Column:
    """SC24: non-empty ids of the groups, in order."""
    lists = F.array(*[F.coalesce(F.try_element_at(refs, F.lit(g)), F.array().cast("array<struct<id:string>>")) for g in groups])
    return F.filter(F.transform(F.flatten(lists), lambda r: r["id"]), lambda i: i.isNotNull() & (i != ""))


def edges(acts: DataFrame) -> DataFrame:
    """The reference graph: act, group, place in the group, id and its parts."""
    one = acts.select(*ACT_KEY, F.explode("act_references").alias("ref_group", "refs"))
    one = one.select(*ACT_KEY, "ref_group", F.posexplode("refs").alias("ord", "ref")).where("ref.id <> ''")
    out = one.select(*ACT_KEY, "ref_group", "ord", F.col("ref.id").alias("dst_id"), act_id(F.col("ref.id")).alias("d"))
    return out.select(*ACT_KEY, "ref_group", "ord", "dst_id", *[F.col(f"d.{k}").alias(f"dst_{k}") for k in ACT_KEY])


def existing(links: DataFrame, acts: DataFrame) -> DataFrame:
    """JO6: edges whose target is stored; malformed ids never are."""
    target = acts.select(*[F.col(k).alias(f"dst_{k}") for k in ACT_KEY])
    return links.join(target, [f"dst_{k}" for k in ACT_KEY], "left_semi")


def related(links: DataFrame, acts: DataFrame) -> DataFrame:
    """JO7: every edge with its target's title, or its bare id where the target isn't stored."""
    target = acts.select(*[F.col(k).alias(f"dst_{k}") for k in ACT_KEY], F.col("title").alias("dst_title"))
    out = links.join(target, [f"dst_{k}" for k in ACT_KEY], "left")
    return out.withColumn("stored", F.col("dst_title").isNotNull()).withColumn("shown", F.coalesce("dst_title", "dst_id"))


def last_of_group(links: DataFrame, group: str) -> DataFrame:
    """JO8: the last target of a group, such as the newest consolidated text."""
    last = F.max_by("dst_id", "ord").alias("dst_id")
    return links.where(F.col("ref_group") == group).groupBy(*ACT_KEY).agg(last)


def citing(acts: DataFrame, judgments: DataFrame, n: int = 6) -> DataFrame:
    """JO9: for each major act the number of rulings citing it and its newest n, ``rn`` from 1.

    Rulings are tagged once with the acts they cite; the newest n of each act are kept before the join, so
    a code that most rulings cite sends n rows, not all of them.
    """
    tagged = judgments.select("source", "doc_id", "judgment_date", F.explode(codes_cited(F.coalesce("legal_basis", F.lit("")))).alias("code"))
    total = tagged.groupBy("code").agg(F.count("*").alias("total"))
    w = Window.partitionBy("code").orderBy(F.col("judgment_date").desc_nulls_last(), "source", "doc_id")
    # Spark keeps the first n of each group in every task before it shuffles them.
    top = tagged.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    named = acts.select(*ACT_KEY, code_of(F.col("title")).alias("code")).where("code is not null")
    return named.join(total, "code").join(top, "code")


def counts(acts: DataFrame) -> DataFrame:
    """AG3: acts per publisher and how many have a consolidated text."""
    return acts.groupBy("publisher").agg(F.count("*").alias("acts"), F.count_if("has_jednolity").alias("with_consolidated"))


def coverage(listed: DataFrame, acts: DataFrame) -> DataFrame:
    """AG14: per publisher and year the acts in the source, stored and missing, and whether none is missing."""
    stored = acts.select(*ACT_KEY, F.lit(1).alias("has"))
    by = listed.select(*ACT_KEY).distinct().join(stored, list(ACT_KEY), "left").groupBy("publisher", "year")
    out = by.agg(F.count("*").alias("in_source"), F.count("has").alias("had"))
    return out.withColumn("missing", F.col("in_source") - F.col("had")).withColumn("complete", F.col("missing") <= 0)


FIRST_YEAR = 1918


def next_year(state: int, complete: bool, current: int, first: int = FIRST_YEAR) -> int:
    """UP9: the year that the backfill looks at next: the one before a complete year, from the first on the current one."""
    following = state - 1 if complete else state
    return current if following < first else following


def backfilled(cursor: DataFrame, covered: DataFrame, current: Column) -> DataFrame:
    """UP9: the next state of ``cursor`` (publisher, year): one row for each publisher that is known or listed.

    ``covered`` is the result of `coverage`. A publisher without a state starts in the current year; a year
    that isn't listed has nothing to bring and counts as complete. ``also_current`` says that the current year
    still lacks acts, so that it is looked at in this call too.
    """
    known = cursor.select("publisher", "year").unionByName(covered.select("publisher").distinct().join(cursor.select("publisher"), "publisher", "left_anti").withColumn("year", current))
    done = covered.select("publisher", "year", "complete")
    now = covered.where(F.col("year") == current).select("publisher", (~F.col("complete")).alias("also_current"))
    out = known.join(done, ["publisher", "year"], "left").join(now, "publisher", "left")
    following = F.col("year") - F.coalesce("complete", F.lit(True)).cast("int")
    step = F.when(following < FIRST_YEAR, current).otherwise(following)
    return out.select("publisher", step.cast("int").alias("year"), F.coalesce("also_current", F.lit(False)).alias("also_current"))
