"""Queries over saved pages, responses and streams that Spark derives from the given tables, and over single fields and criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..operators import acts, ingest, merge, reports, search, subject_index, tables
from ..operators.search import Query
from ..schemas import ACT_KEY, JUDGES, KEY
from ..sources import pages
from . import views
from .queries import _FOUND, _PAIRS, _day, _now, _text, query
from .views import A, J, S, read


def _say(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _text_id():
    return F.col("doc_id").cast("string")


# -- saved responses and pages -----------------------------------------------------------------------
def _responses(spark, d) -> DataFrame:
    """List pages of fifty ids each, in order."""
    rows = read(spark, d, "documents").groupBy((F.floor(F.col("doc_id") / 50) * 50).alias("offset")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    items = F.array_join(F.transform("ids", lambda i: _say("<item><id>", i.cast("string"), "</id></item>")), "")
    return rows.select("offset", _say('<list total="', F.size("ids").cast("string"), '">', items, "</list>").alias("body"))


@query("listed_ids", "SELECT doc_id::VARCHAR AS doc_id, doc_id // 50 * 50 AS page, (row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1)::INT AS pos FROM documents")
def listed_ids(spark, d):
    return ingest.listed_ids(_responses(spark, d), None).select("doc_id", F.col("ord.offset").alias("page"), F.col("ord.pos").alias("pos"))


@query("listed_total", "SELECT max(n) AS total FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id // 50)")
def listed_total(spark, d):
    return ingest.listed_total(_responses(spark, d))


def _listings(spark, d) -> DataFrame:
    """Documents as hits on listing pages of ten, in the three portals' forms."""
    j = views.judgments(spark, d).withColumn("n", F.col("doc_id").cast("long"))
    g, day, out = F.floor(F.col("n") / 2).cast("string"), F.col("judgment_date"), F.col("publication_date")
    ms = _say('<div class="single_result"><h4><a href="/content/$N/15/', F.col("doc_id"), '">I  C ', g, '/20</a></h4><div class="title"><p>Data rozstrzygnięcia: ', day.cast("string"), "</p><p>Data publikacji: ", out.cast("string"), "</p><p>Sąd Okręgowy w Łodzi</p><p>", F.col("doc_type"), '</p></div><div class="excerpt"><blockquote>skrót ', g, "</blockquote></div></div>")
    nsa = _say('<tr><td><a href="/doc/', F.lpad("doc_id", 8, "0"), '">II SA/Łd ', g, "/20 - Wyrok WSA w Łodzi z ", day.cast("string"), "</a></td></tr><tr><td>skrót ", g, "</td></tr>")
    kio = _say('<div class="search-list-item"><a href="/Home/Details/', F.col("doc_id"), '">x</a> Rodzaj dokumentu: wyrok Sygnatura: KIO ', g, "/20 Data wydania: ", F.date_format(day, "dd-MM-yyyy"), "</div>")
    hit = F.when(F.col("source") == "ms", ms).when(F.col("source") == "nsa", nsa).otherwise(kio)
    by = j.select("source", F.floor(F.col("n") / 30).alias("page"), "n", hit.alias("hit")).groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("n", "hit"))).alias("hits"))
    body = F.array_join(F.transform("hits", lambda h: h["hit"]), "\n")
    html = F.when(F.col("source") == "nsa", _say("<table>", body, "</table>")).otherwise(_say("<div>", body, "</div>"))
    return by.select("source", F.lit("listing").alias("kind"), F.col("page").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("url"), _now().alias("fetched_at"), html.alias("html"))


@query("listing_hits", f"""{J} SELECT source, CASE source WHEN 'nsa' THEN lpad(doc_id, 8, '0') ELSE doc_id END AS doc_id, (n // 30)::VARCHAR AS page, (row_number() OVER (PARTITION BY source, n // 30 ORDER BY n) - 1)::INT AS ord,
CASE source WHEN 'ms' THEN 'I C ' WHEN 'nsa' THEN 'II SA/Łd ' ELSE 'KIO ' END || n // 2 || '/20' AS signature, CASE source WHEN 'ms' THEN doc_type ELSE 'wyrok' END AS doc_type, judgment_date::VARCHAR AS judgment_date,
CASE source WHEN 'ms' THEN publication_date::VARCHAR END AS publication_date, CASE source WHEN 'ms' THEN 'Sąd Okręgowy w Łodzi' WHEN 'nsa' THEN 'WSA w Łodzi' END AS court, CASE WHEN source <> 'kio' THEN 'skrót ' || n // 2 END AS excerpt FROM j""")
def listing_hits(spark, d):
    out = pages.listing_hits(_listings(spark, d))
    court = F.when(F.col("source") != "kio", F.col("court"))
    excerpt = F.when(F.col("source") != "kio", F.col("excerpt"))
    return out.select("source", "doc_id", "page", F.col("ord").cast("int").alias("ord"), "signature", "doc_type", _day("judgment_date"), _day("publication_date"), court.alias("court"), excerpt.alias("excerpt"))


def _documents(spark, d) -> DataFrame:
    """Documents as details and content pages of the courts' portal; every tenth details page is a block page."""
    n = F.col("doc_id")
    details = _say('<div id="content"><h2>I C ', n.cast("string"), "/20 - wyrok Sąd Okręgowy</h2><dl><dt>Sygnatura:</dt><dd>I C ", n.cast("string"), "/20</dd><dt>Sąd:</dt><dd>Sąd Okręgowy w Łodzi</dd><dt>Data rozstrzygnięcia</dt><dd>", F.date_add(F.lit("2015-01-01").cast("date"), (n % 3000).cast("int")).cast("string"), "</dd><dt>Data publikacji</dt><dd>2024-01-02</dd><dt>Przewodniczący</dt><dd>SSO Jan Kowalski</dd></dl></div>")
    content = _say('<div id="content"><h2>t</h2><div class="single_wrapper"><div class="single_result"><p>Sąd orzeka, co następuje: oddala powództwo numer ', n.cast("string"), ".</p><p>UZASADNIENIE</p><p>Powody <b>numer</b>&nbsp;", n.cast("string"), ".</p><script>x</script></div></div></div>")
    both = F.array(F.struct(F.lit("details").alias("kind"), F.when(n % 10 == 9, "captchaform").otherwise(details).alias("html")), F.struct(F.lit("content").alias("kind"), content.alias("html")))
    rows = read(spark, d, "documents").select(F.lit("ms").alias("source"), _text_id().alias("doc_id"), F.lit(None).cast("string").alias("url"), _now().alias("fetched_at"), F.explode(both).alias("p"))
    return rows.select("source", F.col("p.kind").alias("kind"), "doc_id", "url", "fetched_at", F.col("p.html").alias("html"))


@query("parsed_pages", "SELECT doc_id::VARCHAR AS doc_id, kind, kind = 'details' AND doc_id % 10 = 9 AS blocked, CASE WHEN kind = 'details' AND doc_id % 10 <> 9 THEN 'I C ' || doc_id || '/20' END AS signature FROM documents, (VALUES ('details'), ('content')) v(kind)")
def parsed_pages(spark, d):
    return pages.parsed(_documents(spark, d)).select("doc_id", "kind", "blocked", F.try_element_at("meta", F.lit("sygnatura")).alias("signature"))


@query("parsed_judgments", """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 10 = 9 THEN 'blokada' END AS reason, CASE WHEN doc_id % 10 <> 9 THEN 'I C ' || doc_id || '/20' END AS signature, CASE WHEN doc_id % 10 <> 9 THEN (DATE '2015-01-01' + (doc_id % 3000)::INT)::VARCHAR END AS judgment_date,
'Sąd orzeka, co następuje: oddala powództwo numer ' || doc_id || '.' AS sentencja, 'Powody numer ' || doc_id || '.' AS uzasadnienie FROM documents""")
def parsed_judgments(spark, d):
    return pages.judgments(pages.parsed(_documents(spark, d))).select("doc_id", "reason", F.when(F.col("reason").isNull(), F.col("signature")).alias("signature"), _day("judgment_date"), "sentencja", "uzasadnienie")


@query("available_hits", """WITH h AS (SELECT 'ms' AS source, doc_id // 4 AS page, doc_id, doc_id % 3 <> 0 AND doc_id // 4 % 5 <> 0 AS has FROM documents), p AS (SELECT page, NOT bool_or(has) AS page_failed FROM h GROUP BY page)
SELECT source, page, doc_id, page_failed FROM h JOIN p USING (page) WHERE has OR page_failed""")
def available_hits(spark, d):
    hits = read(spark, d, "documents").select(F.lit("ms").alias("source"), F.floor(F.col("doc_id") / 4).alias("page"), "doc_id")
    return pages.available_hits(hits, hits.where("doc_id % 3 <> 0 and page % 5 <> 0")).select("source", "page", "doc_id", "page_failed")


@query("page_quality", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'blokada' WHEN doc_id % 7 = 0 THEN 'brak metryki' WHEN doc_id % 5 = 1 THEN 'brak treści w źródle' END AS reason, doc_id % 10 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 1 AS permanent FROM documents")
def page_quality(spark, d):
    n = F.col("doc_id")
    rows = read(spark, d, "documents").select("doc_id", (n % 10 == 0).alias("blocked"), F.when(n % 7 != 0, "I C 1/20").alias("signature"), F.when(n % 5 == 1, "").otherwise(F.col("text")).alias("full_text"))
    return ingest.quality(rows).select("doc_id", "reason", "permanent")


# -- search ------------------------------------------------------------------------------------
_PAGE = "ORDER BY j.judgment_date DESC, source, doc_id LIMIT 50"


def _search(spark, d, q: Query, **more):
    return search.search(views.judgments(spark, d), q, _text(), size=50, **more).select("source", "doc_id", _day("judgment_date"))


@query("search_signature", f"{J} SELECT source, doc_id, judgment_date::VARCHAR AS judgment_date FROM j WHERE signature ILIKE '%i c 12%' {_PAGE}")
def search_signature(spark, d):
    return _search(spark, d, Query(signature="  i   C 12"))


@query("search_basis", f"{J} SELECT source, doc_id, judgment_date::VARCHAR AS judgment_date FROM j WHERE legal_basis ILIKE '%K.c.%' AND (n // 2) % 3 = 1 {_PAGE}")
def search_basis(spark, d):
    return _search(spark, d, Query(legal_basis="K.c.", thematic="rENT"))


@query("search_wildcard", f"{J} SELECT source, doc_id, judgment_date::VARCHAR AS judgment_date FROM j WHERE signature ILIKE '%c _7/2%' {_PAGE}")
def search_wildcard(spark, d):
    return _search(spark, d, Query(signature="c _7/2"))


@query("search_literal", f"{J} SELECT source, doc_id, judgment_date::VARCHAR AS judgment_date FROM j WHERE contains(full_text, '%%') {_PAGE}")
def search_literal(spark, d):
    """A sign that is a wildcard unless asked for as it stands."""
    return _search(spark, d, Query(phrase="%%", literal=True), substring=True)


@query("count_filtered", f"{_FOUND} SELECT source, count(*) AS count FROM m WHERE court ILIKE 'sąd okr%' AND judge ILIKE '%src1%' GROUP BY source")
def count_filtered(spark, d):
    q = Query(phrase="tion the", source="kio", court="Sąd okr", judge="SRC1")
    return search.count_by_source(views.judgments(spark, d), q, _text(), index=views.index(spark, d))


@query("search_acts_ranked", f"{A} SELECT publisher, year, pos, 1.0::DOUBLE AS rank FROM a WHERE title ILIKE '%kodeks karny%' ORDER BY a.promulgation_date DESC, year DESC, pos DESC, publisher LIMIT 50")
def search_acts_ranked(spark, d):
    rows = search.filter_acts(views.acts(spark, d), phrase="karny KODEKS", text=F.col("title"))
    return search.page(rows, search.act_order(True), 1, 50).select("publisher", "year", "pos", "rank")


@query("known_acts", f"{A} SELECT publisher, year, pos FROM a JOIN orders ON o_orderkey = pos WHERE o_custkey % 7 <> 0")
def known_acts(spark, d):
    keys = read(spark, d, "orders").where("o_custkey % 7 <> 0").select(F.when(F.col("o_orderkey") % 2 == 0, "DU").otherwise("MP").alias("publisher"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("int").alias("pos"))
    return tables.known(views.acts(spark, d), keys, ACT_KEY).select(*ACT_KEY)


@query("subject_filter", f"{S} SELECT name, count(*) AS count FROM s WHERE upper(left(name, 1)) = 'K' AND contains(lower(name), 'standard') GROUP BY name")
def subject_filter(spark, d):
    named = subject_index.counts(views.subjects(spark, d)).withColumn("letter", fields.index_letter(F.col("name")))
    none = F.array().cast("array<struct<name:string>>")
    return subject_index.filtered(named.withColumn("children", none), "K", "STANDARD").select("name", "count")


# -- cursors, orders, upserts ------------------------------------------------------------------------
@query("changes_cursor", "SELECT max(o_orderdate::DATE)::VARCHAR AS changed_at FROM orders")
def changes_cursor(spark, d):
    return reports.cursor(read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("changed_at")), "changed_at")


@query("discovery_start", f"{J}, c AS (SELECT source, max(publication_date) FILTER (source <> 'kio') AS c FROM j GROUP BY source) SELECT source, coalesce(c, DATE '2020-03-01' - 14)::VARCHAR AS start FROM c")
def discovery_start(spark, d):
    rows = views.judgments(spark, d).withColumn("publication_date", F.when(F.col("source") != "kio", F.col("publication_date")))
    start = ingest.discovery_start(F.col("publication_date"), F.lit("2020-03-01").cast("date"))
    return reports.cursor(rows, "publication_date", "source").select("source", start.cast("string").alias("start"))


@query("live_order", f"{J} SELECT source, doc_id FROM (SELECT *, CASE WHEN n % 3 <> 0 THEN publication_date END AS p FROM j) ORDER BY coalesce(p, CASE WHEN n % 11 <> 0 THEN judgment_date END) DESC NULLS LAST, source, doc_id LIMIT 40")
def live_order(spark, d):
    n = F.col("doc_id").cast("long")
    rows = views.judgments(spark, d).withColumn("publication_date", F.when(n % 3 != 0, F.col("publication_date"))).withColumn("judgment_date", F.when(n % 11 != 0, F.col("judgment_date")))
    return rows.orderBy(*reports.live_order("pub_desc")).limit(40).select("source", "doc_id")


@query("upsert_acts", f"{A} SELECT publisher, year, pos, CASE WHEN pos % 2 = 0 THEN 'nowy ' || title ELSE title END AS title, CASE WHEN pos % 3 = 0 THEN TIMESTAMP '2020-03-01 00:00:00' ELSE promulgation_date::TIMESTAMP END AS first_seen_at, CASE WHEN pos % 2 = 0 THEN TIMESTAMP '2020-03-01 00:00:00' ELSE promulgation_date::TIMESTAMP END AS last_seen_at FROM a WHERE pos % 3 <> 0 OR pos % 2 = 0")
def upsert_acts(spark, d):
    a = views.acts(spark, d).withColumn("first_seen_at", F.col("promulgation_date").cast("timestamp")).withColumn("last_seen_at", F.col("first_seen_at"))
    new = a.where("pos % 2 = 0").withColumn("title", F.concat(F.lit("nowy "), F.col("title")))
    out = tables.upsert_full(a.where("pos % 3 <> 0"), new, _now(), ["title"], ACT_KEY)
    return out.select(*ACT_KEY, "title", "first_seen_at", "last_seen_at")


@query("backfill", """WITH c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'DU' ELSE 'MP' END AS publisher, year(o_orderdate)::INT AS year, count(*) FILTER (o_custkey % 7 = 0 AND o_orderkey % 2 = 0) = 0 AS complete FROM orders GROUP BY ALL),
s AS (SELECT DISTINCT publisher, CASE publisher WHEN 'DU' THEN 1995 ELSE 1997 END AS year FROM c)
SELECT s.publisher, (s.year - coalesce(c.complete, true)::INT)::INT AS year, coalesce(NOT n.complete, false) AS also_current FROM s LEFT JOIN c ON c.publisher = s.publisher AND c.year = s.year LEFT JOIN c n ON n.publisher = s.publisher AND n.year = 1997""")
def backfill(spark, d):
    """One publisher's cursor stands two years back, at a year that isn't complete; the other has none and is complete."""
    o = read(spark, d, "orders")
    key = [F.when(F.col("o_orderkey") % 2 == 0, "DU").otherwise("MP").alias("publisher"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("int").alias("pos")]
    covered = acts.coverage(o.select(*key), o.where("o_custkey % 7 <> 0 or o_orderkey % 2 = 1").select(*key))
    cursor = covered.where("publisher = 'DU'").select("publisher", F.lit(1995).alias("year")).distinct()
    return acts.backfilled(cursor, covered, F.lit(1997))


# -- rulings and reasonings ----------------------------------------------------------------------
_T = "['Emerytura', 'Renta', 'Kara umowna'][(n // 2) % 3 + 1]"


@query("merge_people", f"""{J}, p AS (SELECT a.*, b.judge AS other FROM j a JOIN j b ON a.signature = b.signature AND a.n % 2 = 0 AND b.n % 2 = 1)
SELECT source, doc_id, {_T} || '|Emerytura pomostowa|Termin' AS thematic, judge || CASE WHEN lower(judge) = lower(other) THEN '' ELSE '|' || other END AS judges FROM p
UNION ALL SELECT source, doc_id, {_T} || CASE WHEN n % 2 = 0 THEN '|Emerytura pomostowa' ELSE '|Termin' END, judge FROM j WHERE signature NOT IN (SELECT signature FROM p)""")
def merge_people(spark, d):
    out = merge.merge_duplicates(views.judgments(spark, d))[0]
    return out.select("source", "doc_id", F.array_join("thematic", "|").alias("thematic"), F.array_join(F.transform("judges", lambda j: j["name"]), "|").alias("judges"))


@query("resolve_kinds", f"{_PAIRS} SELECT ['scalono', 'zastąpiono', 'niejednoznaczne', 'niejednoznaczne'][(n // 2) % 4 + 1] AS kind, count(*) AS n FROM p GROUP BY 1")
def resolve_kinds(spark, d):
    """Pairs of rulings whose parts decide: one part each, all against none, all in both, none in either."""
    n, g = F.col("doc_id").cast("long"), F.floor(F.col("doc_id").cast("long") / 2) % 4
    first = n % 2 == 0
    has = lambda test: F.when(test, F.col("full_text"))
    rows = views.judgments(spark, d).withColumn("doc_type", F.lit("wyrok")).withColumn("sentencja", has((g == 0) & first | (g == 1) & first | (g == 2)))
    return merge.merge_duplicates(rows.withColumn("uzasadnienie", has((g == 0) & ~first | (g == 1) & first | (g == 2))))[2]


@query("merge_by_hand", f"""{J}, p AS (SELECT a.source, a.doc_id, b.doc_id AS other, a.full_text AS x, b.full_text AS y FROM j a JOIN j b ON b.n = a.n + 6 WHERE a.n % 20 = 0)
SELECT source, doc_id, md5(CASE WHEN contains(x, y) THEN x ELSE x || chr(10) || chr(10) || y END) AS h FROM p UNION ALL SELECT source, doc_id, md5(full_text) FROM j WHERE doc_id NOT IN (SELECT doc_id FROM p UNION ALL SELECT other FROM p)""")
def merge_by_hand(spark, d):
    j = views.judgments(spark, d)
    n = F.col("doc_id").cast("long")
    named = j.where(n % 20 == 0).select("source", F.col("doc_id").alias("keep"), (n + 6).cast("string").alias("absorb"))
    return merge.merge_named(j, named)[0].select("source", "doc_id", F.md5("full_text").alias("h"))


# -- fields ------------------------------------------------------------------------------------
@query("signatures", "SELECT o_orderkey, 'II K ' || o_orderkey || '/20|KIO ' || o_custkey || '/2021' AS found FROM orders")
def signatures(spark, d):
    t = _say("sprawa  II K ", F.col("o_orderkey").cast("string"), "/20 oraz KIO ", F.col("o_custkey").cast("string"), "/2021, a nie 12/20 ani A 3/20.")
    return read(spark, d, "orders").select("o_orderkey", F.array_join(fields.signatures(t), "|").alias("found"))


@query("normalize_person", "SELECT s_suppkey, 'łucja zak ' || s_suppkey AS name FROM supplier")
def normalize_person(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", fields.normalize_person(_say("  ŁUCJA \n Żąk ", F.col("s_suppkey").cast("string"))).alias("name"))


@query("sort_panel", "SELECT p_partkey, 'Y' || p_partkey % 2 || '|' || least('N' || p_partkey % 7, 'N' || p_partkey % 5) || '|' || greatest('N' || p_partkey % 7, 'N' || p_partkey % 5) || '|C|Z' AS people FROM part")
def sort_panel(spark, d):
    k = F.col("p_partkey")
    one = lambda name, role: F.struct(name.alias("name"), F.lit(role).alias("role"), F.lit(None).cast("string").alias("note"))
    people = F.array(one(F.lit("Z"), "protokolant"), one(_say("N", (k % 7).cast("string")), "sędzia"), one(F.lit("C"), "członek"), one(_say("Y", (k % 2).cast("string")), "przewodniczący"), one(_say("N", (k % 5).cast("string")), "sędzia"))
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(fields.sort_panel(people.cast(JUDGES)), lambda p: p["name"]), "|").alias("people"))


@query("search_text", f"{J} SELECT source, doc_id, md5(left(concat_ws(' ', signature, nullif(legal_basis, ''), nullif(full_text, '')), 500000)) AS h FROM j")
def search_text(spark, d):
    j = views.judgments(spark, d)
    return j.select(*KEY, F.md5(fields.search_text(F.col("signature"), F.lit(""), F.col("legal_basis"), F.col("full_text"))).alias("h"))


@query("consolidated", f"{A} SELECT publisher, year, pos, EXISTS (SELECT 1 FROM e WHERE e.pos = a.pos AND ref_group IN ('R', 'A')) AS has FROM a")
def consolidated(spark, d):
    return views.acts(spark, d).select(*ACT_KEY, acts.has_consolidated(F.col("act_references"), ["R", "A"]).alias("has"))


@query("reference_ids", f"{A} SELECT a.publisher, a.year, a.pos, coalesce(string_agg(dst_id, '|' ORDER BY CASE ref_group WHEN 'N' THEN 0 ELSE 1 END, ord), '') AS ids FROM a LEFT JOIN e ON e.pos = a.pos AND ref_group IN ('N', 'R') GROUP BY ALL")
def reference_ids(spark, d):
    return views.acts(spark, d).select(*ACT_KEY, F.array_join(acts.reference_ids(F.col("act_references"), ["N", "R"]), "|").alias("ids"))


@query("dates_shown", "SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS dmy, day(o_orderdate) || ' ' || ['stycznia', 'lutego', 'marca', 'kwietnia', 'maja', 'czerwca', 'lipca', 'sierpnia', 'września', 'października', 'listopada', 'grudnia'][month(o_orderdate)] || ' ' || year(o_orderdate) AS shown FROM orders")
def dates_shown(spark, d):
    day = F.to_date("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", fields.dmy(day).alias("dmy"), fields.date_pl(day).alias("shown"))


@query("date_and_finality", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, ['nieprawomocne', 'prawomocne', NULL][o_orderkey % 3 + 1] AS final FROM orders")
def date_and_finality(spark, d):
    said = F.get(F.array(*map(F.lit, [" rozstrzygnięcie NIEPRAWOMOCNE", " prawomocne", ""])), (F.col("o_orderkey") % 3).cast("int"))
    s = fields.date_and_finality(F.concat(F.to_date("o_orderdate").cast("string"), said))
    return read(spark, d, "orders").select("o_orderkey", s["date"].cast("string").alias("day"), s["final"].alias("final"))


@query("first_keywords", "SELECT p_partkey, array_to_string(string_split(p_name || ' ' || p_type || ' x y', ' ')[1:4], '|') AS shown FROM part")
def first_keywords(spark, d):
    words = F.split(F.concat_ws(" ", "p_name", "p_type", F.lit("x y")), " ")
    return read(spark, d, "part").select("p_partkey", F.array_join(fields.first_keywords(words), "|").alias("shown"))


@query("act_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'html' WHEN o_orderkey % 3 = 1 THEN 'pdf' END AS source FROM orders")
def act_text(spark, d):
    k = F.col("o_orderkey") % 3
    s = pages.act_text(F.when(k == 0, F.col("o_orderpriority")).otherwise(""), F.when(k < 2, F.col("o_orderstatus")))
    return read(spark, d, "orders").select("o_orderkey", s["full_text"].alias("text"), s["text_source"].alias("source"))
