"""Search over judgments and acts: filters, token index, rank, order, pages, counts (FI*, FT*, SO*, TK*, PR1).

Criteria are parameters; the result is a DataFrame. Candidates keep their key and rank only; wide columns
are joined for the rows of one page. Phrases are looked up in a stored token index, if one is given: only the
buckets and row groups of the phrase's tokens are read, and no text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import as_iso_date
from ..functions.text import tokens
from ..schemas import KEY

PAGE_SIZES, DEFAULT_PAGE = (20, 50, 100), 20
#: Buckets of a stored index, by token, and the postings of one file.
BUCKETS, POSTINGS_PER_FILE = 64, 4_000_000


@dataclass(frozen=True)
class Query:
    """What is searched for; empty strings don't count."""

    phrase: str = ""
    source: str = ""
    signature: str = ""
    judge: str = ""
    legal_basis: str = ""
    thematic: str = ""
    court: str = ""
    date_from: str = ""
    date_to: str = ""
    date_field: str = "judgment"
    sort: str = "relevance"
    literal: bool = False

    @property
    def is_empty(self) -> bool:
        return not any(getattr(self, f.name).strip() for f in fields(self) if f.name not in ("date_field", "sort", "literal"))


def like(text: str, literal: bool = False) -> str:
    """FI18: % and _ are wildcards unless ``literal``."""
    text = " ".join(text.split())
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if literal else text


def query_tokens(text: str) -> list[str]:
    """The distinct tokens of a phrase, as SC21 gives them."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    words = re.split(r"[\W_]+", plain.replace("ł", "l").replace("Ł", "L").lower())
    return list(dict.fromkeys(w for w in words if w))


def date_column(q: Query) -> str:
    return "publication_date" if q.date_field == "publication" else "judgment_date"


def criteria(q: Query, source: bool = True) -> Column:
    """FI3-FI9: all criteria but the phrase. An unreadable bound of dates is ignored; rows without the date fall out."""
    has = lambda c, v: F.col(c).ilike(f"%{like(v, q.literal)}%")
    out = F.lit(True)
    if source and q.source:
        out &= F.col("source") == q.source
    if q.signature:
        out &= has("signature", q.signature)
    if q.judge:
        pattern = f"%{like(q.judge, q.literal)}%"
        out &= F.exists("judges", lambda j: j["name"].ilike(pattern) | j["role"].ilike(pattern) | F.coalesce(j["note"], F.lit("")).ilike(pattern))
    if q.legal_basis:
        out &= has("legal_basis", q.legal_basis)
    if q.thematic:
        out &= F.exists("thematic", lambda t: t.ilike(f"%{like(q.thematic, q.literal)}%"))
    if q.court:
        out &= F.col("court").ilike(f"{like(q.court, q.literal)}%")
    date = F.col(date_column(q))
    for bound, test in ((q.date_from, lambda b: date >= b), (q.date_to, lambda b: date <= b)):
        if bound:
            b = as_iso_date(F.lit(bound))
            out &= b.isNull() | test(b)
    return out


def has_tokens(column: Column, phrase: str) -> Column:
    """FI10: every distinct token of the phrase occurs; a phrase without tokens matches nothing."""
    wanted = query_tokens(phrase)
    if not wanted:
        return F.lit(False)
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tokens(column))) == 0


def has_substring(phrase: str, literal: bool = False, columns: tuple[str, ...] = ("full_text", "signature", "sentencja")) -> Column:
    """FI11."""
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.col(c).ilike(f"%{like(phrase, literal)}%"), F.lit(False))
    return out


def rank(column: Column, phrase: str) -> Column:
    """FT3: tf / (tf + 1), summed over the distinct tokens of the phrase, rounded to six places."""
    # Only tokens of the phrase are kept before they are counted one by one.
    wanted = query_tokens(phrase)
    found = F.filter(tokens(column), lambda x: x.isin(wanted))

    def score(t: str) -> Column:
        tf = F.size(F.filter(found, lambda x: x == t))
        return tf / (tf + 1.0)

    total = F.lit(0.0)
    for t in wanted:
        total = total + score(t)
    return F.round(total, 6)


def postings(rows: DataFrame, column: Column, key: tuple[str, ...] = KEY) -> DataFrame:
    """FT2: the inverted index: token, key, tf. Counts are combined before the shuffle."""
    return rows.select(*key, F.explode(tokens(column)).alias("token")).groupBy("token", *key).agg(F.count("*").alias("tf"))


def counted(column: Column) -> Column:
    """An array of the distinct tokens of a text and their occurrences, found in the row itself by sorting them."""
    runs = lambda t, s: F.transform(s, lambda p, j: F.struct(F.get(t, p).alias("token"), (F.coalesce(F.get(s, j + 1), F.size(t)) - p).cast("long").alias("tf")))
    starts = lambda t: F.filter(F.transform(t, lambda _, i: i), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    # A transform over one element keeps the sorted tokens, and where each begins, from being found again for every use.
    of = lambda t: F.get(F.transform(F.array(starts(t)), lambda s: runs(t, s)), 0)
    return F.get(F.transform(F.array(F.sort_array(tokens(column))), of), 0)


def write_postings(index: DataFrame, path: str, key: Sequence[str] = KEY, buckets: int = BUCKETS, per_file: int = POSTINGS_PER_FILE, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """FT2: stored postings in folders by ``by`` and the bucket of their token, sorted by token inside.

    Rows are ranged by bucket, token and a hash of the key into files of at most about ``per_file`` postings, so the number
    of files follows the data, and a frequent token is dealt over as many of them as its postings need. Few postings
    are ranged into as many tasks as run at once, but no more than there are buckets, which have files of their own anyway.
    ``index`` is a written table: it is counted, sampled for the ranges, and read.
    """
    files = max(math.ceil(index.count() / per_file), min(buckets, index.sparkSession.sparkContext.defaultParallelism), 1)
    placed = index.withColumn("bucket", F.pmod(F.crc32("token"), F.lit(buckets)).cast("int")).withColumn("_salt", F.xxhash64(*key))
    dealt = placed.repartitionByRange(files, *by, "bucket", "token", "_salt").sortWithinPartitions(*by, "bucket", "token").drop("_salt")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by, "bucket").parquet(path)


def lookup(index: DataFrame, phrase: str, key: tuple[str, ...] = KEY, buckets: int = BUCKETS) -> DataFrame:
    """FT2: keys that have every token, with their rank, from the postings of these tokens only.

    Of an index written by ``write_postings`` only the tokens' buckets are read.
    """
    wanted = query_tokens(phrase)
    found = index.where(F.col("token").isin(wanted)) if wanted else index.limit(0)
    if wanted and "bucket" in index.columns:
        found = found.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % buckets for t in wanted})))
    by = found.groupBy(*key).agg(F.count("*").alias("n"), F.round(F.sum(F.col("tf") / (F.col("tf") + 1.0)), 6).alias("rank"))
    return by.where(F.col("n") == len(wanted)).drop("n")


def sort_terms(q: Query, ranked: bool) -> list[tuple[str, bool]]:
    """SO1: columns of the order and whether each descends; the key breaks ties, nulls come last in every column."""
    keys = [(k, False) for k in KEY]
    date = (date_column(q), True)
    if ranked and q.sort == "relevance":
        return [("rank", True), date, *keys]
    named = {"date_desc": ("judgment_date", True), "date_asc": ("judgment_date", False), "pub_desc": ("publication_date", True)}
    return [named.get(q.sort, date), *keys]


def ordering(q: Query, ranked: bool) -> list[Column]:
    """SO1 as columns to sort by."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in sort_terms(q, ranked)]


def behind(terms: Sequence[tuple[str, bool]], last: Mapping) -> Column:
    """TK1: rows that come after the row with the values ``last`` in the order of ``terms``."""
    out, equal = F.lit(False), F.lit(True)
    for c, down in terms:
        v = last[c]
        if v is not None:
            v = F.lit(v)
            out |= equal & ((F.col(c) < v if down else F.col(c) > v) | F.col(c).isNull())
        equal &= F.col(c).eqNullSafe(v)
    return out


def page_after(rows: DataFrame, terms: Sequence[tuple[str, bool]], last: Mapping | None, size: int = DEFAULT_PAGE) -> DataFrame:
    """TK1: the page behind a cursor (the order's values in the last row of the page before; none for the first).

    Every page keeps ``size`` rows for each task, however far down it lies; an offset would sort all rows above it.
    """
    size = size if size in PAGE_SIZES else DEFAULT_PAGE
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in terms]
    return (rows if last is None else rows.where(behind(terms, last))).orderBy(*order).limit(size)


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
    """TK1: one page; sizes other than the offered ones become the default."""
    size = size if size in PAGE_SIZES else DEFAULT_PAGE
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def years(q: Query) -> Column:
    """FI9 for tables in folders by year of judgment: the years that the bounds of the date leave."""
    out = F.lit(True)
    if q.date_field != "publication":
        for bound, test in ((q.date_from, lambda y: F.col("judgment_year") >= y), (q.date_to, lambda y: F.col("judgment_year") <= y)):
            if bound:
                b = as_iso_date(F.lit(bound))
                out &= b.isNull() | test(F.year(b))
    return out


def matches(rows: DataFrame, q: Query, text: Column, source: bool = True, substring: bool = False, index: DataFrame | None = None, key: Sequence[str] = KEY, buckets: int = BUCKETS) -> DataFrame:
    """FT1, FT4: all rows that match, with ``rank`` where there is a phrase. Rows without a text don't count.

    The folders of a table by year of judgment are pruned by the date's bounds.
    """
    out = rows.where(criteria(q, source))
    out = out.where(years(q)) if "judgment_year" in rows.columns else out
    if q.phrase.strip() and index is not None and not substring:
        return out.join(lookup(index, q.phrase, key, buckets), list(key))
    if q.phrase.strip():
        test = has_substring(q.phrase, q.literal) if substring else has_tokens(text, q.phrase)
        out = out.where(test).withColumn("rank", F.lit(0.0) if substring else rank(text, q.phrase))
    return out


def search(rows: DataFrame, q: Query, text: Column, number: int = 1, size: int = DEFAULT_PAGE, substring: bool = False, index: DataFrame | None = None) -> DataFrame:
    """FT7: one page of matches, in order. The page is found on keys; its rows are joined afterwards."""
    found = matches(rows, q, text, substring=substring, index=index)
    narrow = [*KEY, "judgment_date", "publication_date", *(["rank"] if "rank" in found.columns else [])]
    few = page(found.select(*narrow), ordering(q, "rank" in found.columns), number, size)
    kept = few.select(*KEY, *(["rank"] if "rank" in found.columns else []))
    # At most a page of keys, so it is sent to the tasks that read the table.
    return rows.join(F.broadcast(kept), list(KEY)).orderBy(*ordering(q, "rank" in found.columns))


def get_judgment(rows: DataFrame, source: str, doc_id: str) -> DataFrame:
    """FI1: a judgment by its key, if it has a text."""
    return rows.where((F.col("source") == source) & (F.col("doc_id") == doc_id) & (F.coalesce("full_text", F.lit("")) != ""))


def get_act(rows: DataFrame, publisher: str, year: int, pos: int) -> DataFrame:
    """FI2: an act by its key."""
    return rows.where((F.col("publisher") == publisher) & (F.col("year") == year) & (F.col("pos") == pos))


def count_by_source(rows: DataFrame, q: Query, text: Column, substring: bool = False, index: DataFrame | None = None) -> DataFrame:
    """FT5, FT6: matches per source, whatever source the query names."""
    return matches(rows, q, text, source=False, substring=substring, index=index).groupBy("source").count()


def latest(rows: DataFrame, n: int, source: str = "", since: str = "", date_field: str = "judgment") -> DataFrame:
    """SO3, FI17."""
    date = F.col("publication_date" if date_field == "publication" else "judgment_date")
    out = rows.where(F.col("source") == source) if source else rows
    out = out.where(date >= F.lit(since).cast("date")) if since else out
    return out.orderBy(date.desc_nulls_last(), F.col("first_seen_at").desc_nulls_last(), *[F.col(k).desc() for k in KEY]).limit(n)


def suggest(values: DataFrame, column: str, text: str, n: int = 8) -> DataFrame:
    """TK2: distinct values that contain the text, sorted; texts under two characters give nothing."""
    if len(text.strip()) < 2:
        return values.select(column).limit(0)
    found = values.where(F.lower(F.col(column)).contains(text.strip().lower()))
    return found.select(column).distinct().orderBy(column).limit(n)


def grams(column: Column) -> Column:
    """FI11, TK2: the distinct runs of three characters of a text in small letters; null has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def gram_postings(rows: DataFrame, columns: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Postings of the runs of three characters of some columns: ``token``, key, ``tf`` 1, ready for ``write_postings``."""
    found = F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in columns])))
    return rows.select(*key, F.explode(found).alias("token"), F.lit(1).cast("long").alias("tf"))


def asked_grams(text: str, literal: bool = False) -> list[str]:
    """Runs of three characters that every match of the pattern holds: those between its wildcards."""
    import re

    parts = [" ".join(text.split())] if literal else re.split(r"[%_\\]", " ".join(text.split()))
    return sorted({p[i : i + 3] for p in map(str.lower, parts) for i in range(len(p) - 2)})


def gram_candidates(index: DataFrame, text: str, literal: bool = False, key: Sequence[str] = KEY, buckets: int = BUCKETS) -> DataFrame | None:
    """Keys of rows that may hold the text: those with all its runs. None for a text without a run, which any row may hold."""
    wanted = asked_grams(text, literal)
    if not wanted:
        return None
    found = index.where(F.col("token").isin(wanted))
    if "bucket" in index.columns:
        found = found.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % buckets for t in wanted})))
    return found.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")


def search_grams(rows: DataFrame, index: DataFrame, text: str, columns: tuple[str, ...] = ("full_text", "signature", "sentencja"), literal: bool = False, key: Sequence[str] = KEY, buckets: int = BUCKETS) -> DataFrame:
    """FI11, FI4, FI6 without a scan of all texts: candidates by their runs of three characters, each then tested as a whole.

    ``index`` covers all of ``columns``; runs found in different columns only make a candidate more.
    """
    few = gram_candidates(index, text, literal, key, buckets)
    return (rows if few is None else rows.join(few, list(key), "left_semi")).where(has_substring(text, literal, columns))


def suggest_grams(values: DataFrame, index: DataFrame, column: str, text: str, n: int = 8, buckets: int = BUCKETS) -> DataFrame:
    """TK2 on the distinct values of a column and the index of their runs (key: the column)."""
    few = gram_candidates(index, text.strip(), True, (column,), buckets) if len(text.strip()) >= 2 else None
    return suggest(values if few is None else values.join(few, column, "left_semi"), column, text, n)


def any_term(rows: DataFrame, terms: list[str]) -> DataFrame:
    """FI12: rows whose legal basis contains any of the terms."""
    test = F.lit(False)
    for t in terms:
        test |= F.coalesce(F.col("legal_basis").ilike(f"%{t}%"), F.lit(False))
    return rows.where(test)


def filter_acts(acts: DataFrame, publisher: str = "", act_type: str = "", in_force: str = "", jednolity: bool = False, date_from: str = "", date_to: str = "", phrase: str = "", text: Column | None = None) -> DataFrame:
    """FI13, FI14: consolidated texts are in force unless asked otherwise; a null in_force matches neither."""
    if jednolity and in_force == "":
        in_force = "1"
    out = acts
    if publisher:
        out = out.where(F.col("publisher") == publisher)
    if act_type:
        out = out.where(F.col("act_type").ilike(f"%{like(act_type)}%"))
    if in_force in ("0", "1"):
        out = out.where(F.col("in_force") == "IN_FORCE" if in_force == "1" else F.col("in_force") != "IN_FORCE")
    if jednolity:
        out = out.where("has_jednolity")
    for bound, test in ((date_from, ">="), (date_to, "<=")):
        if bound:
            b = as_iso_date(F.lit(bound))
            out = out.where(b.isNull() | (F.col("promulgation_date") >= b if test == ">=" else F.col("promulgation_date") <= b))
    if phrase and text is not None:
        out = out.where(has_tokens(text, phrase)).withColumn("rank", rank(text, phrase))
    return out


def act_order(ranked: bool) -> list[Column]:
    """FT8, SO4."""
    rest = [F.col("promulgation_date").desc_nulls_last(), F.col("year").desc(), F.col("pos").desc(), F.col("publisher").asc()]
    return [F.col("rank").desc(), *rest] if ranked else rest


def capable(hits: DataFrame, q: Query) -> tuple[DataFrame, list[str]]:
    """FI15, FI16: hits of sources that know the criterion, in the publication range; and notes on the others."""
    caps = {"ms": (True, True), "nsa": (False, True), "kio": (False, False)}  # publication date; judge, term, basis
    dated = q.date_field == "publication" and (q.date_from or q.date_to)
    named = q.judge or q.thematic or q.legal_basis
    out = [s for s, (d, n) in caps.items() if (d or not dated) and (n or not named)]
    notes = [f"{s}: no such criterion" for s in caps if s not in out]
    return hits.where(F.col("source").isin(out)).where(criteria(Query(date_from=q.date_from if dated else "", date_to=q.date_to if dated else "", date_field="publication"))), notes
