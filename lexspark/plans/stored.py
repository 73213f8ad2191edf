"""Queries over tables that several batches have changed: upserts, index, pages, streams and their restarts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search, subject_index, tables
from ..operators.search import Query
from ..schemas import ACT_KEY, ACTS, JUDGMENTS, KEY, RUNS
from ..session import cut, shared_folder
from ..sources import pages
from ..streaming import jobs, store
from . import views
from .queries import _day, _text, query
from .views import A, J, S, read


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _at(n: int):
    return F.lit(f"2020-03-0{n + 1} 00:00:00").cast("timestamp")


def whole(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows with all columns of stored judgments."""
    kinds = spark.createDataFrame([], JUDGMENTS).schema
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields])


def _stored(spark: SparkSession, d: str) -> store.Store:
    """Three batches of judgments: most of them; a few with other courts and years beside new ones; other texts, and deletions."""
    s = store.judgment_store(spark, _folder(spark, "store"), indexed=True, buckets=16)
    j = whole(spark, views.judgments(spark, d))
    n = F.col("doc_id").cast("long")
    s.put(j.where(n % 4 != 3), 0, _at(0), ["judgment_date"])
    moved = j.where((n % 4 == 3) | (n % 8 == 0)).withColumn("court", F.when(n % 8 == 0, "Sąd Przeniesiony").otherwise(F.col("court")))
    s.put(moved.withColumn("judgment_date", F.when(n % 8 == 0, F.add_months("judgment_date", 24)).otherwise(F.col("judgment_date"))), 1, _at(1), ["judgment_date"])
    said = j.where(n % 10 == 4).withColumn("full_text", F.concat("full_text", F.lit(" the tion")))
    s.put(said, 2, _at(2), ["judgment_date"], j.where(n % 14 == 7))
    return s


#: The same three batches: what each judgment is in the end.
_END = f"""{J}, k AS (SELECT source, doc_id, n, signature, legal_basis, CASE WHEN n % 8 = 0 AND n % 10 <> 4 THEN 'Sąd Przeniesiony' ELSE court END AS court,
  CASE WHEN n % 8 = 0 AND n % 10 <> 4 THEN (judgment_date + INTERVAL 24 MONTH)::DATE ELSE judgment_date END AS judgment_date,
  full_text || CASE WHEN n % 10 = 4 THEN ' the tion' ELSE '' END AS full_text,
  CASE WHEN n % 10 = 4 THEN 4 WHEN n % 4 = 3 THEN 2 ELSE 0 END AS version, CASE WHEN n % 4 = 3 THEN TIMESTAMP '2020-03-02' ELSE TIMESTAMP '2020-03-01' END AS first_seen_at,
  CASE WHEN n % 10 = 4 THEN TIMESTAMP '2020-03-03' WHEN n % 4 = 3 OR n % 8 = 0 THEN TIMESTAMP '2020-03-02' ELSE TIMESTAMP '2020-03-01' END AS last_seen_at FROM j WHERE n % 14 <> 7)"""
_WORDS = views.TOKENS.format(c="concat_ws(' ', signature, nullif(legal_basis, ''), nullif(full_text, ''))")
_COUNT = "list_count(list_filter(toks, lambda x: x = '{w}'))"
_RANKED = f"""{_END}, t AS (SELECT *, {_WORDS} AS toks FROM k WHERE trim(full_text) <> ''),
m AS (SELECT *, round({_COUNT.format(w="the")} / ({_COUNT.format(w="the")} + 1.0) + {_COUNT.format(w="tion")} / ({_COUNT.format(w="tion")} + 1.0), 6)::DOUBLE AS rank FROM t WHERE list_has_all(toks, ['the', 'tion']))"""


@query("store_upserts", f"{_END} SELECT source, doc_id, court, judgment_date::VARCHAR AS judgment_date, md5(full_text) AS h, version, first_seen_at, last_seen_at FROM k")
def store_upserts(spark, d):
    """UP2, UP5: records with the version of their texts, after inserts, moves, changes and deletions."""
    s = _stored(spark, d)
    versions = s.records.rows().select(*KEY, "version")
    return s.last().join(versions, list(KEY)).select(*KEY, "court", _day("judgment_date"), F.md5("full_text").alias("h"), "version", "first_seen_at", "last_seen_at")


@query("store_index", f"{_RANKED} SELECT source, doc_id, rank FROM m")
def store_index(spark, d):
    """FT2: postings of three batches; those of former versions and of deleted records count no more."""
    s = _stored(spark, d)
    return search.matches(s.narrow_rows(), Query(phrase="The tion"), _text(), index=s.postings(), key=(*KEY, "version"), buckets=16).select(*KEY, "rank")


@query("store_search", f"{_RANKED} SELECT source, doc_id, rank, judgment_date::VARCHAR AS judgment_date, md5(full_text) AS h FROM m WHERE judgment_date >= '2016-01-01' AND judgment_date <= '2017-06-30' ORDER BY rank DESC, m.judgment_date DESC, source, doc_id LIMIT 20 OFFSET 20")
def store_search(spark, d):
    """FT7, TK1: the second page of whole rows, after the versions were gathered in one."""
    s = _stored(spark, d)
    s.compact(2)
    q = Query(phrase="The tion", date_from="2016-01-01", date_to="2017-06-30")
    return s.search(q, number=2).select(*KEY, "rank", _day("judgment_date"), F.md5("full_text").alias("h"))


@query("search_seek", f"{J} SELECT source, doc_id, judgment_date::VARCHAR AS judgment_date FROM j WHERE court ILIKE 'sąd%' ORDER BY j.judgment_date DESC, source, doc_id LIMIT 20 OFFSET 60")
def search_seek(spark, d):
    """TK1, SO1: the fourth page, reached by the cursors of the three before it."""
    q = Query(court="sąd", sort="date_desc")
    found = search.matches(views.judgments(spark, d), q, _text()).select(*KEY, "judgment_date", "publication_date")
    terms, last = search.sort_terms(q, False), None
    for _ in range(3):
        rows = search.page_after(found, terms, last).collect()  # one page
        if not rows:
            break
        last = rows[-1].asDict()
    return search.page_after(found, terms, last).select(*KEY, _day("judgment_date"))


@query("index_build", f"{J}, t AS (SELECT doc_id, unnest({views.TOKENS.format(c='full_text')}) AS token FROM j) SELECT token, count(DISTINCT doc_id) AS docs, count(*) AS tf FROM t GROUP BY token")
def index_build(spark, d):
    """FT2: the stored index, built anew: documents and occurrences of each token."""
    return views.build_index(spark, d).groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


# -- streams of several batches ------------------------------------------------------------------
def fed(frames: list[DataFrame], source: str, start: Callable[[int], object]) -> None:
    """Each frame's files are added to the source and streamed by a query that starts anew from its checkpoint."""
    for n, frame in enumerate(frames):
        frame.write.mode("append").parquet(source)
        start(n).awaitTermination()


@query("stream_upsert", """SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 3, o_orderkey)) AS o_orderkey, TIMESTAMP '2020-03-01 00:00:00' + to_days(min(o_orderkey % 3)::INT) AS first_seen_at,
  TIMESTAMP '2020-03-01 00:00:00' + to_days(max(o_orderkey % 3)::INT) AS last_seen_at FROM orders GROUP BY o_custkey""")
def stream_upsert(spark, d):
    """SM3: the orders as a change feed in three batches: the last change of each customer in the last batch with one wins."""
    folder = _folder(spark, "feed")
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    table = store.Table(spark, f"{folder}/table", "o_custkey long, o_orderkey long, first_seen_at timestamp, last_seen_at timestamp", ("o_custkey",), {"range": F.floor(F.col("o_custkey") / 4096).cast("int")})

    def start(n):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        return jobs.upsert_stream(stream, table, f"{folder}/log", "o_orderkey", lambda: _at(n))

    fed([rows.where(F.col("o_orderkey") % 3 == n) for n in range(3)], f"{folder}/in", start)
    return table.last()


@query("act_changes", f"""{A}, w AS (SELECT *, CASE WHEN pos % 5 = 0 THEN 2 WHEN pos % 2 = 0 THEN 1 ELSE 0 END AS last FROM a)
SELECT publisher, year, pos, CASE last WHEN 2 THEN 'po zmianie 2' ELSE title END AS title, md5(CASE last WHEN 2 THEN full_text WHEN 1 THEN 'nowy tekst ' || pos ELSE full_text END) AS h,
TIMESTAMP '2020-03-01' AS first_seen_at, TIMESTAMP '2020-03-01' + to_days(last) AS last_seen_at, CASE WHEN last = 1 THEN 2 WHEN last = 2 AND pos % 2 = 0 THEN 4 ELSE 0 END AS version FROM w""")
def act_changes(spark, d):
    """SM3, UP3: the acts' change feed in three batches: all, then new texts, then new titles beside the first texts; two changes of an act in one batch."""
    folder = _folder(spark, "acts")
    kinds = spark.createDataFrame([], ACTS).drop("first_seen_at", "last_seen_at").schema
    shaped = lambda rows: rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields])
    a = views.acts(spark, d).withColumn("changed_at", F.lit("2020-01-01"))
    texts = a.where("pos % 2 = 0").withColumn("full_text", F.concat(F.lit("nowy tekst "), F.col("pos").cast("string"))).withColumn("changed_at", F.lit("2020-01-02"))
    titles = a.where("pos % 5 = 0").withColumn("title", F.lit("po zmianie 1")).withColumn("changed_at", F.lit("2020-01-03"))
    titles = titles.unionByName(titles.withColumns({"title": F.lit("po zmianie 2"), "changed_at": F.lit("2020-01-04")}))
    acts = store.act_store(spark, f"{folder}/acts")

    def start(n):
        return jobs.act_changes(spark.readStream.schema(kinds).parquet(f"{folder}/in"), acts, f"{folder}/log", lambda: _at(n))

    fed([shaped(a), shaped(texts), shaped(titles)], f"{folder}/in", start)
    versions = acts.records.rows().select(*ACT_KEY, "version")
    return acts.last().join(versions, list(ACT_KEY)).select(*ACT_KEY, "title", F.md5("full_text").alias("h"), "first_seen_at", "last_seen_at", "version")


# Reasonings (odd ids) come before their rulings where the pair's number is a multiple of three, rulings of others first.
# The last batch brings every fourth pair's ruling again, with another text.
_WAVE = "CASE WHEN (n % 2 = 1) = (g % 3 = 0) THEN 0 ELSE 1 END"


@query("judgment_stream", f"""{J}, w AS (SELECT *, n // 2 AS g, n % 2 = 1 AND doc_type = 'uzasadnienie' AS reasoning, (n // 2) % 5 <> 4 OR (n % 2 = 0 AND (n + n % 29) = (n + 2 + (n + 1) % 29)) AS near FROM j WHERE trim(full_text) <> ''),
p AS (SELECT a.source, a.n AS rn, b.n AS un, a.full_text || CASE WHEN contains(a.full_text, b.full_text) THEN '' ELSE chr(10) || chr(10) || b.full_text END AS full_text
  FROM w a JOIN w b ON b.n = a.n + 1 AND a.n % 2 = 0 AND b.reasoning AND (a.judgment_date = b.judgment_date OR a.publication_date = b.publication_date))
SELECT 'stored' AS state, w.source, w.doc_id, md5(CASE WHEN w.n % 8 = 0 THEN w.full_text || ' x' ELSE coalesce(p.full_text, w.full_text) END) AS h,
  TIMESTAMP '2020-03-01' + to_days(CASE WHEN p.rn IS NULL OR w.g % 3 <> 0 THEN CASE WHEN (w.n % 2 = 1) = (w.g % 3 = 0) THEN 0 ELSE 1 END ELSE 1 END) AS seen FROM w LEFT JOIN p ON p.rn = w.n WHERE NOT w.reasoning
UNION ALL SELECT 'held', source, doc_id, md5(full_text), NULL FROM w WHERE reasoning AND n NOT IN (SELECT un FROM p)
UNION ALL SELECT 'skipped', source, doc_id, NULL, TIMESTAMP '2020-03-02' FROM w WHERE n IN (SELECT un FROM p)
UNION ALL SELECT 'skipped', source, doc_id, NULL, TIMESTAMP '2020-03-01' + to_days(CASE WHEN (n % 2 = 1) = ((n // 2) % 3 = 0) THEN 0 ELSE 1 END) FROM j WHERE coalesce(trim(full_text), '') = ''""")
def judgment_stream(spark, d):
    """SM1, SM6, MG7: three batches; what is stored, waits for its ruling, and was skipped or went into a ruling, with texts and times."""
    folder = _folder(spark, "judgments")
    n, g = F.col("doc_id").cast("long"), F.floor(F.col("doc_id").cast("long") / 2)
    rows = whole(spark, views.judgments(spark, d))
    wave = F.when((n % 2 == 1) == (g % 3 == 0), 0).otherwise(1)
    again = rows.where((n % 8 == 0) & (F.trim("full_text") != "")).withColumn("full_text", F.concat("full_text", F.lit(" x")))
    stored, held, skipped = store.judgment_store(spark, f"{folder}/stored"), jobs.waiting(spark, f"{folder}/held"), jobs.left_out(spark, f"{folder}/skipped")

    def start(k):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        return jobs.judgment_stream(stream, stored, held, skipped, f"{folder}/log", lambda: _at(k))

    fed([rows.where(wave == 0), rows.where(wave == 1), again], f"{folder}/in", start)
    out = stored.last().select(F.lit("stored").alias("state"), *KEY, F.md5("full_text").alias("h"), F.col("first_seen_at").alias("seen"))
    out = out.unionByName(held.last().select(F.lit("held").alias("state"), *KEY, F.md5("full_text").alias("h"), F.lit(None).cast("timestamp").alias("seen")))
    return out.unionByName(skipped.last().select(F.lit("skipped").alias("state"), *KEY, F.lit(None).cast("string").alias("h"), F.col("skipped_at").alias("seen")))


@query("stream_once_each", """WITH b AS (SELECT o_custkey AS k, CASE WHEN o_orderdate < DATE '1997-06-01' THEN 0 WHEN o_orderdate < DATE '1999-06-01' THEN 1 ELSE 2 END AS wave, min(o_orderdate::TIMESTAMP + to_seconds(o_custkey::INT)) AS t FROM orders GROUP BY 1, 2),
wm AS (SELECT max(t) FILTER (wave = 0) - INTERVAL 400 DAY AS w1, max(t) FILTER (wave <= 1) - INTERVAL 400 DAY AS w2 FROM b),
e0 AS (SELECT k, t FROM b WHERE wave = 0),
e1 AS (SELECT b.k, b.t FROM b CROSS JOIN wm LEFT JOIN e0 ON e0.k = b.k AND e0.t + INTERVAL 400 DAY > w1 WHERE wave = 1 AND b.t > w1 AND e0.k IS NULL),
s1 AS (SELECT k, max(t) AS t FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1) GROUP BY k),
e2 AS (SELECT b.k, b.t FROM b CROSS JOIN wm LEFT JOIN s1 ON s1.k = b.k AND s1.t + INTERVAL 400 DAY > w2 WHERE wave = 2 AND b.t > w2 AND s1.k IS NULL)
SELECT k AS o_custkey, t AS seen_at FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2)""")
def stream_once_each(spark, d):
    """SM5: customers listed again in three batches; repeats within 400 days of an item are dropped, later ones come again."""
    folder = _folder(spark, "once")
    o = read(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    wave = F.when(F.col("day") < "1997-06-01", 0).when(F.col("day") < "1999-06-01", 1).otherwise(2)
    at = F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + F.col("o_custkey"))
    rows = cut(o.groupBy("o_custkey", wave.alias("wave")).agg(F.min(at).alias("seen_at")))
    kept = rows.drop("wave")

    def start(n):
        stream = jobs.once_each(spark.readStream.schema(kept.schema).parquet(f"{folder}/in"), "seen_at", "400 days", ("o_custkey",))
        return stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()

    fed([rows.where(F.col("wave") == n).drop("wave") for n in range(3)], f"{folder}/in", start)
    return spark.read.schema(kept.schema).parquet(f"{folder}/out")


@query("watched_sources", f"""{J}, w AS (SELECT source, count(*) FILTER (n % 4 <> 3 AND n % 2 = 0) AS a, count(*) FILTER (n % 4 <> 3 AND n % 2 = 1) AS b, count(*) FILTER (n % 4 = 3) AS late FROM j GROUP BY source)
SELECT 0 AS round, source, CASE source WHEN 'kio' THEN 'blad' ELSE 'ok' END AS status, CASE source WHEN 'kio' THEN 0 ELSE a END AS seen, CASE source WHEN 'kio' THEN 0 ELSE a END AS added FROM w
UNION ALL SELECT 1, source, 'ok', CASE source WHEN 'ms' THEN a WHEN 'nsa' THEN b ELSE a + b END, CASE source WHEN 'ms' THEN 0 WHEN 'nsa' THEN b ELSE a + b END FROM w
UNION ALL SELECT 1, 'ms:backlog', 'ok', late, late FROM w WHERE source = 'ms'""")
def watched_sources(spark, d):
    """SM7, SM8, AG13: two rounds over three sources: one fails and catches up, one brings known rows only and goes on with its backlog."""
    folder, n = _folder(spark, "watched"), F.col("doc_id").cast("long")
    rows = whole(spark, views.judgments(spark, d))
    kept = {s: jobs.by_source(spark, f"{folder}/{s}-kept", "source string, doc_id string") for s in ("ms", "nsa", "kio")}
    broken = {"kio"}

    def taker(source):
        def take(df, batch):
            if source in broken:
                raise ValueError("portal down")
            keys = df.select(*KEY).distinct()
            new = cut(tables.missing(keys, kept[source].rows()))
            kept[source].replace(new, new)
            return new.count()

        return take

    def feed(source, part, name):
        rows.where((F.col("source") == source) & part).select(*KEY).write.mode("append").parquet(f"{folder}/{source}-{name}")

    def sources():
        kinds = rows.select(*KEY).schema
        stream = lambda s, name: spark.readStream.schema(kinds).parquet(f"{folder}/{s}-{name}")
        return {s: jobs.Source(stream(s, "new"), taker(s), stream(s, "late")) for s in kept}

    for s in kept:
        feed(s, (n % 4 != 3) & (n % 2 == 0), "new")
        feed(s, n % 4 == 3, "late")
    made = jobs.watched(spark, sources(), f"{folder}/log", f"{folder}/runs").withColumn("round", F.lit(0))
    broken.clear()
    feed("ms", (n % 4 != 3) & (n % 2 == 0), "new")
    for s in ("nsa", "kio"):
        feed(s, (n % 4 != 3) & (n % 2 == 1), "new")
    made = made.unionByName(jobs.watched(spark, sources(), f"{folder}/log", f"{folder}/runs").withColumn("round", F.lit(1)))
    written = spark.read.schema(RUNS).parquet(f"{folder}/runs")
    # The rows of both rounds are those of the stored runs table.
    return made.join(written.select("source", "started_at"), ["source", "started_at"]).select("round", "source", "status", F.col("seen").cast("long").alias("seen"), F.col("added").cast("long").alias("added"))


# -- mergeable totals, substrings, pages by size ------------------------------------------------------
@query("branch_totals", f"""{S}, c AS (SELECT name FROM s GROUP BY name UNION ALL SELECT 'Koszty' WHERE (SELECT count(DISTINCT name) FROM s WHERE name LIKE 'Koszty %') >= 2),
r AS (SELECT name, CASE WHEN split_part(name, ' ', 1) IN (SELECT name FROM c) THEN split_part(name, ' ', 1) ELSE name END AS root FROM c)
SELECT root, count(DISTINCT (source, doc_id)) AS total FROM r JOIN s USING (name) GROUP BY root""")
def branch_totals(spark, d):
    """AG10, TH6: bitmaps of three batches, the last of which repeats documents of the first two, merged."""
    pairs = cut(subject_index.terms(views.subjects(spark, d)))
    named = cut(subject_index.with_umbrellas(pairs.groupBy("name").agg(F.count("*").alias("count"))))
    roots = cut(subject_index.roots(cut(subject_index.parents(named))))
    k = F.col("doc_id").cast("long") % 3
    numbers = subject_index.numbered(pairs.where(k < 2), 0).unionByName(subject_index.numbered(pairs.where(k == 2), 1))
    found = pairs.join(roots, "name").join(numbers, list(KEY))
    batches = [subject_index.branch_bitmaps(found.where(part)) for part in (k == 0, k == 1, k != 1)]
    return subject_index.branch_totals(subject_index.merged_bitmaps(*batches))


@query("substring_index", f"{J} SELECT source, doc_id FROM j WHERE full_text ILIKE '%tion the%' OR signature ILIKE '%tion the%' UNION ALL SELECT source, 's' || doc_id FROM j WHERE signature ILIKE '%c 1_/2%'")
def substring_index(spark, d):
    """FI11, FI4: a phrase in the texts and a signature with a wildcard, by the index of runs of three characters."""
    j = views.judgments(spark, d)
    path = _folder(spark, "grams")
    search.write_postings(cut(search.gram_postings(j, ("full_text", "signature"))), path)
    index = spark.read.schema("token string, source string, doc_id string, tf long, bucket int").parquet(path)
    texts = search.search_grams(j, index, "tion  the", ("full_text", "signature")).select(*KEY)
    return texts.unionByName(search.search_grams(j, index, "C 1_/2", ("signature",)).select("source", F.concat(F.lit("s"), "doc_id").alias("doc_id")))


@query("suggest_index", "SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'izm') ORDER BY p_name LIMIT 8")
def suggest_index(spark, d):
    """TK2 by the index of runs of three characters of the distinct values."""
    names, path = cut(read(spark, d, "part").select("p_name").distinct()), _folder(spark, "names")
    search.write_postings(cut(search.gram_postings(names, ("p_name",), ("p_name",))), path, ("p_name",))
    index = spark.read.schema("token string, p_name string, tf long, bucket int").parquet(path)
    return search.suggest_grams(names, index, "p_name", " IZM")


@query("pages_dealt", "SELECT page_id, url, md5(html) AS h FROM pages")
def pages_dealt(spark, d):
    """PA1, PA7: every page once, whatever task it was dealt to."""
    rows = read(spark, d, "pages").select(F.lit("ms").alias("source"), F.lit("content").alias("kind"), F.col("page_id").cast("string").alias("doc_id"), "page_id", "url", "html")
    return pages.dealt(rows, parts=16).select("page_id", "url", F.md5("html").alias("h"))
