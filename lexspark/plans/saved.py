"""Queries over documents of the second and third portal, printed acts, subject trees, and files that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import search, subject_index, tables
from ..schemas import ACT_KEY, KEY, RUNS
from ..session import cut, shared_folder
from ..sources import io, pages
from . import views
from .queries import _day, query
from .views import A, J, S, read


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _say(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _raw(rows: DataFrame, source: str, kinds: dict) -> DataFrame:
    """A raw page of each kind for each row; ``kinds`` gives its page."""
    at = F.array(*[F.struct(F.lit(k).alias("kind"), html.alias("html")) for k, html in kinds.items()])
    each = rows.select(F.lit(source).alias("source"), F.col("doc_id").cast("string").alias("doc_id"), F.explode(at).alias("p"))
    return each.select("source", F.col("p.kind").alias("kind"), "doc_id", F.lit(None).cast("string").alias("url"), F.lit("2020-03-01").cast("timestamp").alias("fetched_at"), F.col("p.html").alias("html"))


_DAY = "(DATE '2015-01-01' + (doc_id % 3000)::INT)"


# -- documents of the other portals --------------------------------------------------------------------
@query("parsed_nsa", f"""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 10 = 9 THEN 'blokada' WHEN doc_id % 10 = 8 THEN 'brak metryki' END AS reason,
CASE WHEN doc_id % 10 < 8 THEN 'II SA/Łd ' || doc_id || '/20' END AS signature, CASE WHEN doc_id % 10 < 8 THEN CASE doc_id % 2 WHEN 0 THEN 'wyrok' ELSE 'postanowienie' END END AS doc_type,
CASE WHEN doc_id % 10 < 8 THEN CASE doc_id % 3 WHEN 0 THEN 'Naczelny Sąd Administracyjny' ELSE 'WSA w Łodzi' END END AS court, CASE WHEN doc_id % 10 < 8 THEN CASE doc_id % 3 WHEN 0 THEN 'NSA' ELSE 'WSA' END END AS court_level,
CASE WHEN doc_id % 10 < 8 THEN {_DAY}::VARCHAR END AS judgment_date, CASE WHEN doc_id % 10 < 8 THEN ({_DAY} - 40)::VARCHAR END AS received_date, CASE WHEN doc_id % 10 < 8 THEN CASE doc_id % 4 WHEN 1 THEN 'nieprawomocne' ELSE 'prawomocne' END END AS final,
CASE WHEN doc_id % 10 < 8 THEN 'przewodniczący:Jan Kowalski:|sędzia:Anna Nowak:sprawozdawca|sędzia:Piotr Zych:' ELSE '' END AS people, CASE WHEN doc_id % 10 < 8 THEN 'Podatki|Opłaty ' || doc_id ELSE '' END AS thematic,
CASE WHEN doc_id % 10 < 8 THEN 'Oddalono skargę' END AS outcome, CASE WHEN doc_id % 10 < 8 THEN 'Dz.U. ' || doc_id END AS legal_basis,
CASE WHEN doc_id % 10 < 8 THEN CASE WHEN doc_id % 3 = 1 THEN 'Teza ' || doc_id || '.' || chr(10) || chr(10) ELSE '' END || 'Sąd oddala skargę ' || doc_id || '.' || chr(10) || chr(10) || 'Powody.' || chr(10) || 'Dalej ' || doc_id || '.' END AS full_text FROM documents""")
def parsed_nsa(spark, d):
    """PA10, PA11: records of the administrative courts; some pages block, some lack their record."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id")
    day = F.date_add(F.lit("2015-01-01").cast("date"), (k % 3000).cast("int"))
    row = lambda label, value: _say('<tr><td class="info-list-label">', label, '</td><td class="info-list-value">', value, "</td></tr>")
    long = lambda label, value: _say('<tr><td><span class="info-list-label">', label, '</span><div class="info-list-value-uzasadnienie">', value, "</div></td></tr>")
    court = F.when(k % 3 == 0, "Naczelny Sąd Administracyjny").otherwise("WSA w Łodzi")
    kind = F.when(k % 2 == 0, "Wyrok").otherwise("Postanowienie")
    html = _say(
        "<title>II  SA/Łd ", n, "/20 - ", kind, " ", F.when(k % 3 == 0, "NSA").otherwise("WSA w Łodzi"), " z ", day.cast("string"), "</title><table>",
        row("Data orzeczenia", _say(day.cast("string"), F.when(k % 4 == 1, " orzeczenie nieprawomocne").otherwise(" orzeczenie prawomocne"))), row("Data wpływu", F.date_sub(day, 40).cast("string")), row("Data zupełnie inna", F.lit("1999-09-09")),
        F.when(k % 5 == 0, "").otherwise(row("Sąd", court)), row("Sędziowie", F.lit("Jan Kowalski /przewodniczący/Anna Nowak /sprawozdawca/Piotr Zych")), row("Hasła tematyczne", _say("Podatki<br>Opłaty ", n)),
        row("Treść wyniku", F.lit("Oddalono skargę")), row("Powołane przepisy", _say("Dz.U. <b>", n, "</b>")), F.when(k % 3 == 1, long("Tezy", _say("Teza ", n, "."))).otherwise(""),
        long("Sentencja", _say("<p>Sąd oddala skargę ", n, ".</p>")), long("Uzasadnienie", _say("Powody.<br>Dalej ", n, ".")), "</table>",
    )
    made = F.when(k % 10 == 9, "captchaform").when(k % 10 == 8, "<p>brak</p>").otherwise(html)
    out = pages.judgments(pages.parsed(_raw(read(spark, d, "documents"), "nsa", {"document": made})))
    people = F.array_join(F.transform("judges", lambda p: F.concat(p["role"], F.lit(":"), p["name"], F.lit(":"), F.coalesce(p["note"], F.lit("")))), "|")
    # Where the record doesn't name the court, the title does.
    court = F.when(F.col("court") == "NSA", "Naczelny Sąd Administracyjny").otherwise(F.col("court"))
    return out.select("doc_id", "reason", "signature", "doc_type", court.alias("court"), "court_level", _day("judgment_date"), _day("received_date"), "final", people.alias("people"), F.array_join("thematic", "|").alias("thematic"), "outcome", "legal_basis", "full_text")


@query("parsed_kio", f"""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 10 = 9 THEN 'blokada' END AS reason, CASE WHEN doc_id % 10 <> 9 OR doc_id % 4 <> 0 THEN 'KIO ' || doc_id || '/20' END AS signature,
CASE WHEN doc_id % 10 <> 9 THEN {_DAY}::VARCHAR END AS judgment_date, CASE WHEN doc_id % 10 <> 9 THEN CASE WHEN doc_id % 2 = 0 THEN 'oddalone; umorzone' ELSE 'oddalone' END END AS outcome,
CASE WHEN doc_id % 10 <> 9 THEN 'Gmina ' || doc_id END AS purchaser, CASE WHEN doc_id % 10 <> 9 THEN 'art. ' || doc_id END AS legal_basis, CASE WHEN doc_id % 10 <> 9 THEN 'wadium|termin ' || doc_id ELSE '' END AS thematic, 'KIO' AS court_level,
'przewodniczący:Jan Kowalski|członek:Anna Nowak|członek:Piotr Zych' AS people, 'Sygn. akt KIO ' || doc_id || '/20' || chr(10) || 'Przewodniczący: Jan Kowalski' || chr(10) || 'Członkowie: Anna Nowak' || chr(10) || 'Piotr Zych' AS full_text FROM documents WHERE doc_id % 20 <> 8""")
def parsed_kio(spark, d):
    """PA12, PA13: details and contents of the appeals chamber meet by id; a case of two numbers, labels in any order."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), (k % 3000).cast("int")), "dd-MM-yyyy")
    cases = _say("<li>KIO ", n, "/20 / oddalone</li>", F.when(k % 2 == 0, _say("<li>KIO ", n, "/20 / umorzone</li>")).otherwise(""))
    boxes = [_say("<div><label>Rodzaj dokumentu:</label> wyrok</div>"), _say("<div><label>Zamawiający:</label><p>Gmina <b>", n, "</b></p></div>"), _say("<div><label>Sygnatura akt / Sposób rozstrzygnięcia</label><ul>", cases, "</ul></div>"), _say("<div><label>Data wydania rozstrzygnięcia:</label> ", day, "</div><div><label>Data zamówienia:</label> 01-01-1999</div>")]
    body = F.when(k % 3 == 0, _say(*boxes)).otherwise(_say(*reversed(boxes)))
    details = _say('<div id="pageContent"><h2 class="section-title">KIO ', n, '/20 Pobierz metrykę PDF</h2><div class="details-metrics">', body, "</div><b>Kluczowe przepisy</b><p>art. ", n, "</p><b>Zagadnienia</b><p>wadium | termin ", n, "</p></div>")
    content = _say("<body><p>Sygn. akt KIO ", n, "/20</p><p><span>Przewodniczący: </span><span>Jan Kowalski</span></p><p>Członkowie: Anna Nowak</p><p>Piotr Zych</p></body>")
    rows = read(spark, d, "documents").where("doc_id % 20 <> 8")
    out = pages.judgments(pages.parsed(_raw(rows, "kio", {"details": F.when(k % 10 == 9, "captchaform").otherwise(details), "content": content})))
    people = F.array_join(F.transform("judges", lambda p: F.concat(p["role"], F.lit(":"), p["name"])), "|")
    return out.select("doc_id", "reason", "signature", _day("judgment_date"), "outcome", "purchaser", "legal_basis", F.array_join("thematic", "|").alias("thematic"), "court_level", people.alias("people"), "full_text")


# -- printed acts --------------------------------------------------------------------------------------
_L = "|| chr(10) ||"


@query("print_columns", f"""SELECT o_orderkey, 'USTAWA' {_L} 'z dnia 3 maja 2020 r.' {_L} 'Podatnik numer ' || o_orderkey || ' płaci.' {_L} CASE WHEN o_orderkey % 3 = 0 THEN 'I' || chr(10) ELSE '' END ||
CASE WHEN o_orderkey % 2 = 0 THEN 'Stawki roczne' || chr(10) ELSE '' END || 'II – ' || o_orderkey || ' 000 zł' {_L} 'III – 1 017 zł' {_L} 'IV – 200–317' {_L} 'dalszy ciąg przepisu numer ' || o_orderkey || ' jest dłuższy' {_L} '1) pierwszy ' || o_orderkey {_L} '2) drugi' {_L} '„3)” trzeci' {_L}
CASE WHEN o_orderkey % 4 = 0 THEN '4)' ELSE '4) koniec' END AS text FROM orders""")
def print_columns(spark, d):
    """TX2-TX4: a print with page furniture, a broken word, a note, a column of labels beside one of values, and lone markers."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    # Labels above the values' number stay alone; a title between the columns comes first.
    text = F.array_join(F.array_compact(F.array(
        _say("Dziennik Ustaw – 2 – Poz. ", n), F.lit("U S T A W A"), F.lit("z dnia 3 maja 2020 r."), _say("Podat-\nnik numer ", n, " płaci."), F.lit("1) Minister Finansów kieruje działem administracji rządowej."),
        F.when(k % 3 == 0, "I"), F.lit("II"), F.lit("III"), F.lit("IV"), F.when(k % 2 == 0, "Stawki roczne"), _say(n, " 000 zł"), F.lit("1 017 zł"), F.lit("200–317"),
        _say("dalszy ciąg przepisu numer ", n, " jest dłuższy"), F.lit("1)"), F.lit("2)"), _say("pierwszy ", n), F.lit("drugi"), _say("Monitor Polski – 5 – Poz. ", n), F.lit("„3)”"), F.lit("trzeci"), F.lit("4)"), F.when(k % 4 != 0, "koniec"),
    )), "\n\n")
    return read(spark, d, "orders").select("o_orderkey", clean.clean_print_text(text, F.lit("Ustawa")).alias("text"))


# -- subjects and acts whose order and rank show --------------------------------------------------------
_TREE = f"""{S}, c AS (SELECT name, count(*) AS n FROM s GROUP BY name UNION ALL SELECT 'Koszty', 0 WHERE (SELECT count(DISTINCT name) FROM s WHERE name LIKE 'Koszty %') >= 2),
r AS (SELECT name, n, CASE WHEN split_part(name, ' ', 1) IN (SELECT name FROM c) THEN split_part(name, ' ', 1) ELSE name END AS root FROM c)"""


@query("subject_children", f"{_TREE} SELECT root, (row_number() OVER (PARTITION BY root ORDER BY lower(name), name) - 1)::INT AS ord, name, n AS count FROM r WHERE name <> root")
def subject_children(spark, d):
    """SO6, ST5: the children of each root in their order."""
    t = subject_index.tree(views.subjects(spark, d))
    return t.select(F.col("name").alias("root"), F.posexplode("children").alias("ord", "c")).select("root", "ord", F.col("c.name").alias("name"), F.col("c.count").alias("count"))


@query("subject_filter_children", f"{_TREE} SELECT root AS name, count(*) FILTER (name <> root) AS n_children FROM r WHERE upper(left(root, 1)) = 'K' GROUP BY root HAVING bool_or(contains(lower(name), 'standard'))")
def subject_filter_children(spark, d):
    """FI19: terms by letter and by a text that only their children hold."""
    t = subject_index.filtered(subject_index.tree(views.subjects(spark, d)), "K", "STANDARD")
    return t.select("name", F.size("children").cast("long").alias("n_children"))


@query("hand_parents", """WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Upadłość' WHEN 1 THEN 'Prawo upadłościowe i naprawcze' WHEN 2 THEN 'Postępowanie upadłościowe' WHEN 3 THEN 'Odrzucenie spadku' ELSE 'Odrzucenie skargi' END AS name, p_partkey % 5 AS k FROM part)
SELECT 'Upadłość' AS name, count(*) FILTER (k = 0) AS count, count(*) FILTER (k < 3) AS total, 'Postępowanie upadłościowe|Prawo upadłościowe i naprawcze' AS children FROM t
UNION ALL SELECT 'Odrzucenie spadku', count(*) FILTER (k = 3), count(*) FILTER (k = 3), '' FROM t UNION ALL SELECT 'Odrzucenie skargi', count(*) FILTER (k = 4), count(*) FILTER (k = 4), '' FROM t""")
def hand_parents(spark, d):
    """TH3: parents set by hand, and a term that stays alone."""
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, "upadłość").when(k == 1, "upadłościowe  prawo").when(k == 2, " Upadłościowe Postępowanie").when(k == 3, '"odrzucenie spadku"').otherwise("Odrzucenie Skargi")
    rows = read(spark, d, "part").select(F.lit("ms").alias("source"), F.col("p_partkey").cast("string").alias("doc_id"), F.array(said).alias("thematic"))
    return subject_index.tree(rows).select("name", "count", "total", F.array_join(F.transform("children", lambda c: c["name"]), "|").alias("children"))


@query("search_acts_by_rank", f"""{A}, m AS (SELECT *, 1 + pos % 4 AS tf FROM a WHERE title ILIKE '%kodeks karny%')
SELECT publisher, year, pos, round(0.5 + tf / (tf + 1.0), 6)::DOUBLE AS rank FROM m ORDER BY rank DESC, m.promulgation_date DESC, year DESC, pos DESC, publisher LIMIT 50""")
def search_acts_by_rank(spark, d):
    """FT8: acts whose texts name the phrase more or less often, best first."""
    text = F.concat(F.col("title"), F.repeat(F.lit(" karny"), (F.col("pos") % 4).cast("int")))
    rows = search.filter_acts(views.acts(spark, d), phrase="karny KODEKS", text=text)
    return search.page(rows, search.act_order(True), 1, 50).select(*ACT_KEY, "rank")


# -- files that are written and read back -------------------------------------------------------------
@query("preview", f"{J} SELECT source, doc_id, signature, CASE WHEN n % 2 = 0 AND trim(full_text) <> '' THEN left(trim(full_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 200) ELSE '(brak)' END AS sentencja, coalesce(nullif(left(full_text, 300), ''), '(brak)') AS full_text FROM j")
def preview(spark, d):
    """PR2."""
    return io.preview(views.judgments(spark, d)).select(*KEY, "signature", "sentencja", "full_text")


@query("year_lists", f"{A} SELECT a.publisher, a.year, a.pos, a.title, a.promulgation_date::VARCHAR AS promulgation_date, count(*) OVER (PARTITION BY a.publisher, a.year) AS stated, EXISTS (SELECT 1 FROM e WHERE e.pos = a.pos) AS refers FROM a")
def year_lists(spark, d):
    """IO4, IO5: a list of each publisher's year, written as pages of JSON and read back as acts."""
    a = views.acts(spark, d)
    item = F.struct("publisher", "year", "pos", F.concat_ws("/", "publisher", "year", "pos").alias("ELI"), "title", F.col("act_type").alias("type"), F.col("in_force").alias("inForce"), F.col("promulgation_date").cast("string").alias("promulgation"), F.col("act_references").alias("references"))
    path = _folder(spark, "lists")
    io.write_year_lists(cut(a.select("publisher", "year", item.alias("item"))), path)
    rows = io.act_rows(io.read_year_lists(spark, f"{path}/*/*", lines=True), "stated").withColumn("refers", F.size("act_references") > 0)
    return rows.select(*ACT_KEY, "title", _day("promulgation_date"), "stated", "refers")


@query("archived", f"{J} SELECT source, doc_id, md5(full_text) AS h FROM j")
def archived(spark, d):
    """IO7, IO9: half of the judgments archived as JSON, then all of them, once each, and read back."""
    j, path = views.judgments(spark, d), _folder(spark, "archive")
    io.archive(j.where(F.col("doc_id").cast("long") % 2 == 0), j.limit(0), path)
    schema = "batch string, source string, doc_id string, full_text string"
    for _ in range(2):
        io.archive(j, spark.read.schema(schema).json(path), path)
    return spark.read.schema(schema).json(path).select(*KEY, F.md5("full_text").alias("h"))


@query("exported_csv", f"{J} SELECT source, doc_id, signature, court, judgment_date::VARCHAR AS judgment_date, ['Emerytura', 'Renta', 'Kara umowna'][g % 3 + 1] || '; ' || ['Emerytura pomostowa', 'Termin'][n % 2 + 1] AS thematic, judge FROM (SELECT *, n // 2 AS g FROM j)")
def exported_csv(spark, d):
    """IO10: judgments without texts as CSV, read back; lists joined, people as JSON."""
    path = _folder(spark, "csv")
    io.write_csv(views.judgments(spark, d).select(*KEY, "signature", "court", "judgment_date", "thematic", "judges"), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*KEY, "signature", "court", "judgment_date", "thematic", F.get_json_object("judges", "$[0].name").alias("judge"))


@query("decoded_rows", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Termin|Kara ' || o_custkey END AS thematic, 'Jan ' || o_custkey || '|Ewa' AS panel, '/orzeczenie/ms/' || o_orderkey AS url FROM orders""")
def decoded_rows(spark, d):
    """IO2: JSON columns of an imported table; broken JSON gives no terms, a missing panel is taken from the judges."""
    o = read(spark, d, "orders")
    k = F.col("o_custkey").cast("string")
    terms = F.when(F.col("o_orderkey") % 5 == 0, "[broken").otherwise(_say('["Termin", "Kara ', k, '"]'))
    judges = _say('[{"name": "Jan ', k, '", "role": "sędzia"}, {"name": "Ewa"}, {"name": ""}]')
    rows = o.select("o_orderkey", F.lit("ms").alias("source"), F.col("o_orderkey").cast("string").alias("doc_id"), terms.alias("thematic"), F.when(F.col("o_orderkey") % 2 == 0, _say('["Jan ', k, '", "Ewa"]')).alias("panel"), judges.alias("judges"))
    return tables.decoded_judgments(rows).select("o_orderkey", F.array_join("thematic", "|").alias("thematic"), F.array_join("panel", "|").alias("panel"), "url")


@query("run_log", "SELECT event_type AS source, count(*) AS runs, sum(length(left(repeat('x', (event_id % 3000)::INT), 2000)))::BIGINT AS chars FROM events GROUP BY event_type")
def run_log(spark, d):
    """IO11: runs appended to a stored log, with details cut to their column's length."""
    e = read(spark, d, "events")
    rows = e.select(F.col("ts").cast("timestamp").alias("started_at"), F.col("event_type").alias("source"), F.repeat(F.lit("x"), (F.col("event_id") % 3000).cast("int")).alias("detail"), "event_id")
    log = spark.createDataFrame([], RUNS)
    for part in (0, 1):
        log = tables.appended_run(log, rows.where(F.col("event_id") % 2 == part).drop("event_id"))
    path = _folder(spark, "runs")
    log.write.parquet(path)
    return spark.read.schema(RUNS).parquet(path).groupBy("source").agg(F.count("*").alias("runs"), F.sum(F.length("detail")).alias("chars"))
