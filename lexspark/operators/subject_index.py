"""The two-level subject index: counts, umbrellas, parents, roots, distinct totals (AG8-AG11, AG16, TH1-TH6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import index_letter
from ..functions.subjects import canonical_terms, stem
from ..schemas import KEY
from ..session import cut

# Umbrella terms, terms that stay alone, and parents given by hand.
UMBRELLAS = ["Czynności", "Wysokość", "Świadczenia", "Skarga", "Nieważność", "Koszty", "Wynagrodzenie", "Uchwały", "Odrzucenie", "Upadłość"]
STANDALONE = ["Odrzucenie spadku"]
PARENTS = {"Prawo upadłościowe i naprawcze": "Upadłość", "Postępowanie upadłościowe": "Upadłość"}
# The Polish alphabet of the index and its letters that no term begins with.
ALPHABET = "AĄBCĆDEĘFGHIJKLŁMNŃOÓPQRSŚTUVWXYZŹŻ"
UNUSED = "ĄĘŃQVXY"


def terms(rows: DataFrame) -> DataFrame:
    """Distinct (document, canonical term)."""
    return rows.select(*KEY, F.explode(canonical_terms(F.col("thematic"))).alias("name"))


def counts(rows: DataFrame) -> DataFrame:
    """AG8: documents per term. A document's terms are distinct already, so counts combine before the shuffle."""
    return terms(rows).groupBy("name").agg(F.count("*").alias("count"))


def top(named: DataFrame, n: int = 8) -> DataFrame:
    """AG9."""
    return named.orderBy(F.desc("count"), "name").limit(n)


def is_parent(parent: Column, child: Column) -> Column:
    """TH1: the child has more words, begins with the parent's, and the parent's last matches exactly or by stem."""
    p, c = F.split(F.lower(parent), " "), F.split(F.replace(F.lower(child), F.lit(" – "), F.lit(" - ")), " ")
    n = F.size(p)
    last_p, last_c = F.element_at(p, -1), F.get(c, n - 1)
    same = F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))) == F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return (F.size(c) > n) & same & ((last_p == last_c) | (stem(last_p) == stem(last_c)))


def with_umbrellas(named: DataFrame) -> DataFrame:
    """TH2: umbrella terms with count 0, where absent and where two terms of several words share their stem."""
    spark = named.sparkSession
    wanted = spark.createDataFrame([(u,) for u in UMBRELLAS], "name string").join(named, "name", "left_anti")
    wanted = wanted.withColumn("s", stem(F.col("name")))
    members = named.where(F.col("name").contains(" ") & ~F.col("name").isin(*STANDALONE))
    members = members.groupBy(stem(F.get(F.split("name", " "), 0)).alias("s")).agg(F.count("*").alias("n")).where("n >= 2")
    added = wanted.join(members, "s").select("name", F.lit(0).cast("long").alias("count"))
    return named.select("name", "count").unionByName(added)


def parents(named: DataFrame) -> DataFrame:
    """TH3, TH4: name and parent (null for none): by hand, else the longest name that is a parent, ties by name.

    Parent and child share the stem of their first word, which makes the search an equi-join.
    """
    hand = F.create_map(*[F.lit(x) for pair in PARENTS.items() for x in pair])
    keyed = named.select("name", stem(F.get(F.split(F.lower("name"), " "), 0)).alias("s"))
    candidates = keyed.select(F.col("name").alias("parent"), "s")
    free = keyed.where(~F.col("name").isin(*STANDALONE))
    found = free.join(candidates, "s").where((F.col("name") != F.col("parent")) & is_parent(F.col("parent"), F.col("name")))
    best = found.groupBy("name").agg(F.min_by("parent", F.struct(-F.length("parent"), F.col("parent"))).alias("best"))
    given = named.select("name", F.try_element_at(hand, F.col("name")).alias("given")).where("given is not null")
    given = given.join(named.select(F.col("name").alias("given")), "given", "left_semi")
    out = named.select("name").join(best, "name", "left").join(given, "name", "left")
    return out.select("name", F.coalesce("given", "best").alias("parent"))


def roots(links: DataFrame, rounds: int = 4) -> DataFrame:
    """TH5: name and root. Each round doubles the distance; a cycle ends at its smallest name."""
    out = links.select("name", F.coalesce("parent", "name").alias("root"))
    for _ in range(rounds):
        up = out.select(F.col("name").alias("_n"), F.col("root").alias("_r"))
        out = out.join(up, F.col("root") == F.col("_n"), "left").select("name", F.coalesce("_r", "root").alias("root"))
    back = out.select(F.col("name").alias("_n"), F.col("root").alias("_r"))
    looped = out.join(back, F.col("root") == F.col("_n"), "left")
    return looped.select("name", F.when(F.col("_r") == F.col("root"), F.col("root")).otherwise(F.least("root", "_r")).alias("root"))


def tree(rows: DataFrame) -> DataFrame:
    """TH6, AG10: ``name``, ``count``, ``total``, ``letter``, ``children`` of each root.

    total is the number of distinct documents of the root and its children: (root, document) pairs are
    made distinct first, so a root with very many documents is spread over tasks.
    """
    # Terms are normalised once. The vocabulary is small beside the documents; it is written so that its self-joins read a table.
    pairs = cut(terms(rows))
    named = cut(with_umbrellas(pairs.groupBy("name").agg(F.count("*").alias("count"))))
    root = cut(roots(cut(parents(named))))
    sized = named.join(root, "name")
    kids = sized.where("name <> root").groupBy("root").agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name", "count"))).alias("kids"))
    kids = kids.select("root", F.transform("kids", lambda k: F.struct(k["name"].alias("name"), k["count"].alias("count"))).alias("children"))
    found = pairs.join(root, "name").select("root", *KEY).distinct().groupBy("root").agg(F.count("*").alias("total"))
    out = sized.where("name = root").select("name", "count", "root").join(found, "root", "left").join(kids, "root", "left")
    empty = F.array().cast("array<struct<name:string,count:bigint>>")
    return out.select("name", "count", F.coalesce("total", F.lit(0)).alias("total"), index_letter(F.col("name")).alias("letter"), F.coalesce("children", empty).alias("children"))


def numbered(documents: DataFrame, batch: int) -> DataFrame:
    """Keys of a batch's new documents with a number of their own; numbers of one task follow each other, so bitmaps are dense.

    The rows are written, so a document keeps its number whatever is computed from it.
    """
    return cut(documents.select(*KEY).distinct().withColumn("number", F.monotonically_increasing_id() + F.lit(batch).cast("long") * (1 << 53)))


def branch_bitmaps(pairs: DataFrame) -> DataFrame:
    """AG10, TH6: ``root``, ``bucket``, ``bits``: the documents of each root as bitmaps, of pairs (root, number), repeated or not.

    Bits are set in the tasks that hold the pairs, so what is shuffled are bitmaps, and no root is counted in one task.
    """
    placed = pairs.select("root", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit"))
    return placed.groupBy("root", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged_bitmaps(*batches: DataFrame) -> DataFrame:
    """Bitmaps of several batches as one table: exact whatever documents the batches share."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.groupBy("root", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def branch_totals(bitmaps: DataFrame) -> DataFrame:
    """Distinct documents of each root."""
    return bitmaps.groupBy("root").agg(F.sum(F.bitmap_count("bits")).alias("total"))


def renormalisation(rows: DataFrame) -> DataFrame:
    """AG11: ``stat`` and ``n``: rows with terms, rows whose terms change, distinct terms before and after."""
    new = canonical_terms(F.col("thematic"))
    some = F.size(F.coalesce("thematic", F.array().cast("array<string>"))) > 0
    changed = some & ~new.eqNullSafe(F.col("thematic"))
    out = rows.agg(F.count_if(some).alias("with_terms"), F.count_if(changed).alias("changed")).unpivot([], ["with_terms", "changed"], "stat", "n")
    before = rows.select(F.explode("thematic").alias("t")).agg(F.count_distinct("t").alias("n")).select(F.lit("terms_before").alias("stat"), "n")
    after = terms(rows).agg(F.count_distinct("name").alias("n")).select(F.lit("terms_after").alias("stat"), "n")
    return out.unionByName(before).unionByName(after)


def filtered(index: DataFrame, letter: str = "", text: str = "") -> DataFrame:
    """FI19: by letter, and by text over the term and its children."""
    out = index.where(F.col("letter") == letter) if letter else index
    words = F.lower(F.concat_ws(" ", F.col("name"), F.transform("children", lambda c: c["name"])))
    return out.where(words.contains(text.lower())) if text else out


def letters(index: DataFrame) -> DataFrame:
    """AG16: letters that occur, in alphabetical order, others at the end."""
    place = F.instr(F.lit(ALPHABET), F.col("letter"))
    found = index.select("letter").distinct().where(~F.col("letter").isin(*UNUSED))
    return found.orderBy(F.when(place == 0, 1000).otherwise(place), "letter")
