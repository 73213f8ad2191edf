"""Portal pages, files and streams on short inputs of the portals' structure."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lexspark.schemas import ACTS, HITS, JUDGMENTS, RAW_PAGES
from lexspark.sources import html as H
from lexspark.sources import io, pages
from lexspark.streaming import jobs, store

MS_LIST = """<div id="sorting"><span class="big_number">1&nbsp;3</span></div><div class="single_result"><h4><a href="/content/$N/15/1">IV  Ka 352/26</a></h4>
<div class="title"><p>Data rozstrzygnięcia: 2 czerwca 2026</p><p>Data publikacji: 2026-06-10</p><p>Sąd Okręgowy w Łodzi</p><p>wyrok</p></div><div class="excerpt"><blockquote>a  <b>b</b></blockquote></div></div>"""
NSA_LIST = """<div>Znaleziono 763 orzeczeń</div><table><tr><td><a href="/doc/759cc12522">I SA/Łd 269/26 - Wyrok WSA w Łodzi z 2026-08-27</a></td></tr>
<tr><td>oddala <span>skargę</span></td></tr><tr><td><a href="/doc/226B5A6CD0">II FSK 1/26 - Postanowienie NSA z 2026-08-28</a><a href="/doc/226B5A6CD0">x</a></td></tr></table>"""
KIO_LIST = """<p>Liczba znalezionych dokumentów: <b>34 065</b></p><div class="search-list-item"><a href="/Home/Details/77">x</a> Rodzaj dokumentu: wyrok Sygnatura: KIO 3192/26 Data wydania: 02-06-2026</div>"""
MS_DETAILS = """<div id="content"><h2>IV Ka 352/26 - zarządzenie, uzasadnienie Sąd Okręgowy</h2><dl><dt>Sygnatura:<dd>IV Ka 352/26<dt>Sąd:</dt><dd>Sąd Okręgowy w Łodzi</dd><dt>Data rozstrzygnięcia</dt><dd>2 czerwca 2026</dd>
<dt>Przewodniczący</dt><dd>SSO Jan Kowalski</dd><dt>Protokolant</dt><dd>Ewa Mała</dd><dt>Hasła tematyczne</dt><dd>Apelacja, Kara</dd><dt>Podstawa prawna</dt><dd>art. 1 kk</dd></dl></div>"""
MS_CONTENT = """<div id="content"><h2>t</h2><div class="single_wrapper"><div class="single_result"><ul class="tabs"><li>tab</li></ul><p>Sąd orzeka, co następuje:<br>oddala apelację w całości.</p><p>UZASADNIENIE</p><p>Bo&nbsp;<b>tak</b>.</p><script>x</script></div></div></div>"""
NSA_DOC = """<title>I SA/Łd 269/26 - Wyrok WSA w Łodzi z 2026-08-27</title><table>
<tr><td class="info-list-label">Data rozstrzygnięcia</td><td class="info-list-value">2026-08-27 orzeczenie nieprawomocne</td></tr><tr><td class="info-list-label">Sąd</td><td class="info-list-value">Wojewódzki Sąd Administracyjny w Łodzi</td></tr>
<tr><td class="info-list-label">Sędziowie</td><td class="info-list-value">Jan Kowalski /przewodniczący/Anna Nowak /sprawozdawca/Piotr Zych</td></tr><tr><td class="info-list-label">Hasła tematyczne</td><td class="info-list-value">Podatki<br>Opłaty</td></tr>
<tr><td><span class="info-list-label">Sentencja</span><div class="info-list-value-uzasadnienie"><p>Wojewódzki Sąd oddala skargę.</p></div></td></tr><tr><td><span class="info-list-label">Uzasadnienie</span><div class="info-list-value-uzasadnienie">Powody.</div></td></tr></table>"""
KIO_DETAILS = """<div id="pageContent"><h2 class="section-title">KIO 3192/26</h2><div class="details-metrics"><div><label>Rodzaj dokumentu:</label> wyrok</div><div><label>Przewodniczący:</label><p>Jan Kowalski</p></div>
<div><label>Sygnatura akt / Sposób rozstrzygnięcia</label><ul><li>KIO 3192/26 / oddalone</li><li>KIO 3193/26 / oddalone</li></ul></div><div><label>Data wydania rozstrzygnięcia:</label> 02-06-2026</div></div><b>Kluczowe przepisy</b><p>art. 7</p><b>Zagadnienia</b><p>wadium | termin</p></div>"""
KIO_CONTENT = "<body><p><span>Przewodniczący: </span><span>Jan Kowalski</span></p><p>Członkowie: Anna Nowak</p><p>Piotr Zych</p></body>"


def raw(spark, *rows):
    now = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(s, k, i, "u", now, h) for s, k, i, h in rows], RAW_PAGES)


def test_block_text():
    assert H.block_text(H.tree("<div>a\n b<p>c <b>d</b>‑e&nbsp;f</p><style>x</style>g<br>h</div>")) == "a b\nc d-e f\ng\nh"
    assert H.looks_blocked("x" * 7000 + "captchaform") and not H.looks_blocked("x" * 9000 + "captchaform") and not H.looks_blocked(None)


def test_listings(spark):
    df = raw(spark, ("ms", "listing", "p1", MS_LIST), ("nsa", "listing", "p2", NSA_LIST), ("kio", "listing", "p3", KIO_LIST), ("ms", "listing", "p4", "Access Denied " + MS_LIST))
    got = {(r.source, r.doc_id): r for r in pages.listing_hits(df).collect()}
    assert set(got) == {("ms", "1"), ("nsa", "759CC12522"), ("nsa", "226B5A6CD0"), ("kio", "77")}
    m, n, k = got["ms", "1"], got["nsa", "759CC12522"], got["kio", "77"]
    day = dt.date(2026, 6, 2)
    assert (m.signature, m.doc_type, m.court, m.judgment_date, m.publication_date, m.excerpt) == ("IV KA 352/26", "wyrok", "Sąd Okręgowy w Łodzi", day, dt.date(2026, 6, 10), "a b")
    assert (n.signature, n.doc_type, n.court, n.judgment_date, n.excerpt) == ("I SA/Łd 269/26", "wyrok", "WSA w Łodzi", dt.date(2026, 8, 27), "oddala skargę")
    assert got["nsa", "226B5A6CD0"].excerpt is None and (k.signature, k.doc_type, k.judgment_date) == ("KIO 3192/26", "wyrok", day)
    counts = {r.source: r.n for r in df.where("doc_id <> 'p4'").select("source", pages.result_count(F.col("source"), F.col("html")).alias("n")).collect()}
    assert counts == {"ms": 13, "nsa": 763, "kio": 34065}
    assert df.where(pages.blocked(F.col("html"))).count() == 1


def test_documents(spark):
    df = raw(
        spark, ("ms", "details", "1", MS_DETAILS), ("ms", "content", "1", MS_CONTENT), ("nsa", "document", "N", NSA_DOC), ("kio", "details", "77", KIO_DETAILS),
        ("kio", "content", "77", KIO_CONTENT), ("ms", "details", "2", "captchaform"), ("ms", "details", "3", "<p>nothing</p>"),
    )
    got = {(r.source, r.doc_id): r for r in pages.judgments(pages.parsed(df)).collect()}
    m, n, k = got["ms", "1"], got["nsa", "N"], got["kio", "77"]
    assert got["ms", "2"].reason == "blokada" and got["ms", "3"].reason == "brak metryki" and m.reason is None and n.reason is None
    assert (m.signature, m.doc_types, m.doc_type, m.judgment_date, m.chairman) == ("IV Ka 352/26", ["zarządzenie", "uzasadnienie"], "zarządzenie", dt.date(2026, 6, 2), "Jan Kowalski")
    assert m.sentencja == "Sąd orzeka, co następuje:\noddala apelację w całości." and m.uzasadnienie == "Bo tak." and m.thematic == ["Apelacja", "Kara"] and m.court_level == "SO"
    assert [(j.name, j.role) for j in m.judges] == [("Jan Kowalski", "przewodniczący"), ("Ewa Mała", "protokolant")]
    assert (n.signature, n.doc_type, n.court_level, n.final, n.thematic) == ("I SA/Łd 269/26", "wyrok", "WSA", "nieprawomocne", ["Podatki", "Opłaty"])
    assert [(j.name, j.role, j.note) for j in n.judges] == [("Jan Kowalski", "przewodniczący", None), ("Anna Nowak", "sędzia", "sprawozdawca"), ("Piotr Zych", "sędzia", None)]
    assert n.full_text == "Wojewódzki Sąd oddala skargę.\n\nPowody."
    assert (k.signature, k.outcome, k.legal_basis, k.thematic, k.court_level, k.judgment_date) == ("KIO 3192/26", "oddalone", "art. 7", ["wadium", "termin"], "KIO", dt.date(2026, 6, 2))
    assert [(j.name, j.role) for j in k.judges] == [("Jan Kowalski", "przewodniczący"), ("Anna Nowak", "członek"), ("Piotr Zych", "członek")]


def test_act_pages_and_files(spark, tmp_path):
    df = spark.createDataFrame([('<body><div id="toc"><p>Spis</p></div><p>Art. 1.</p></body>', "pdf"), (None, "pdf"), ("<body></body>", None)], "h string, p string")
    got = [r.t for r in df.select(pages.act_text(pages.act_html_text(F.col("h")), F.col("p")).alias("t")).collect()]
    assert [tuple(t) for t in got] == [("Art. 1.", "html"), ("pdf", "pdf"), (None, None)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/9.json").write_text(json.dumps({"count": 7, "items": [{"publisher": "DU", "year": 2025, "pos": 3, "title": "t", "references": {"Tekst jednolity dla aktu": [{"id": "DU/1/2"}]}, "promulgation": "2025-01-02"}, {"publisher": "DU", "year": 2025, "pos": 4}]}))
    items = io.read_year_lists(spark, str(tmp_path / "in"))
    rows = io.act_rows(items).orderBy("pos").collect()
    assert items.first().stated == 7 and rows[0].has_jednolity and rows[0].promulgation_date == dt.date(2025, 1, 2) and rows[1].keywords == [] and rows[1].act_references == {}
    (tmp_path / "p").mkdir()
    (tmp_path / "p/77.html").write_text("<p>x</p>")
    assert [(r.doc_id, r.html) for r in io.read_pages(spark, str(tmp_path / "p"), "kio", "content").collect()] == [("77", "<p>x</p>")]
    assert HITS and ACTS


def judgment(spark, *rows):
    names = ["source", "doc_id", "signature", "court", "judgment_date", "doc_type", "full_text", "sentencja", "uzasadnienie"]
    df = spark.createDataFrame([("ms", i, s, "Sąd", dt.date(2025, 1, 1), k, t, t if k == "wyrok" else None, t if k != "wyrok" else None) for i, s, k, t in rows], ", ".join(f"{n} {'date' if n == 'judgment_date' else 'string'}" for n in names))
    return spark.createDataFrame([], JUDGMENTS).drop("first_seen_at", "last_seen_at").unionByName(df, allowMissingColumns=True)


def test_exports(spark, tmp_path):
    df = judgment(spark, ("a/1", "I C 1/20", "wyrok", "orzeka"))
    r = io.to_text(df).first()
    assert r.name == "I_C_1-20.txt" and r.text.startswith("Sygnatura: I C 1/20\nSąd: Sąd\n") and "Skład: —" in r.text and r.text.endswith("SENTENCJA\norzeka")
    path = str(tmp_path / "arch")
    assert [r.name for r in io.archive(df, df.limit(0), path).collect()] == ["a_1"]
    assert io.archive(df, spark.read.json(path), path).count() == 0 and spark.read.json(path).count() == 1
    io.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().signature == "I C 1/20"
    assert json.loads(io.to_json(df).first().value)["doc_id"] == "a/1" and io.to_hit(df).first().url == "/orzeczenie/ms/a/1" and io.preview(df).first().uzasadnienie == "(brak)"


def test_reasoning_waits_for_its_ruling(spark, tmp_path):
    t = lambda name: f"{tmp_path}/{name}"
    fields = judgment(spark).schema
    now = lambda: F.lit("2025-06-01 00:00:00").cast("timestamp")
    stored, held, skipped = store.judgment_store(spark, t("s")), jobs.waiting(spark, t("h")), jobs.left_out(spark, t("k"))

    def feed(*rows):
        judgment(spark, *rows).coalesce(1).write.mode("append").parquet(t("in"))
        jobs.judgment_stream(spark.readStream.schema(fields).parquet(t("in")), stored, held, skipped, t("c"), now).awaitTermination()

    feed(("u", "I C 1/20", "uzasadnienie", "bo tak"), ("e", "I C 2/20", "wyrok", ""))
    assert stored.last().count() == 0 and [r.doc_id for r in held.last().collect()] == ["u"] and [r.doc_id for r in skipped.last().collect()] == ["e"]
    feed(("w", "I C 1/20", "wyrok", "orzeka"), ("x", "I C 9/20", "wyrok", "inny"))
    rows = {r.doc_id: r for r in stored.last().collect()}
    assert set(rows) == {"w", "x"} and rows["w"].uzasadnienie == "bo tak" and rows["w"].full_text == "orzeka\n\nbo tak"
    assert held.last().count() == 0 and {r.doc_id for r in skipped.last().collect()} == {"e", "u"}


def test_act_changes(spark, tmp_path):
    state = store.act_store(spark, f"{tmp_path}/acts")
    schema = spark.createDataFrame([], ACTS).select("publisher", "year", "pos", "title", "changed_at").schema

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(f"{tmp_path}/feed")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/feed")
        full = spark.createDataFrame([], ACTS).drop("first_seen_at", "last_seen_at")
        for f in full.schema.fields:
            if f.name not in schema.names:
                stream = stream.withColumn(f.name, F.lit(None).cast(f.dataType))
        jobs.act_changes(stream, state, f"{tmp_path}/c", lambda: F.lit("2025-06-01").cast("timestamp")).awaitTermination()

    feed(("DU", 2025, 1, "old", "2025-01-01"), ("DU", 2025, 1, "newer", "2025-01-02"), ("DU", 2025, 2, "b", "2025-01-01"))
    assert {r.pos: r.title for r in state.last().collect()} == {1: "newer", 2: "b"}
    feed(("DU", 2025, 2, "c", "2025-02-01"))
    assert {r.pos: r.title for r in state.last().collect()} == {1: "newer", 2: "c"}


def test_sources_fail_alone():
    def bad():
        raise ValueError("down")

    runs = jobs.isolated({"ms": lambda: 0, "nsa": bad})
    assert runs == [("ms", "ok", 0, ""), ("nsa", "blad", 0, "down")] and jobs.wants_backlog(runs) and not jobs.wants_backlog(runs, "nsa")


def test_labels_of_dates():
    dates = ["data orzeczenia", "Data wydania: 02-06-2026", "Data wydania rozstrzygnięcia:", "data wpływu", "data publikacji", "data zamówienia", "data", ""]
    assert [pages._ruling_date(x) for x in dates] == [True, True, True, False, False, False, False, False]
    assert pages._labelled("Rodzaj dokumentu: wyrok Sygnatura: KIO 1/20", ("Sygnatura", "Rodzaj dokumentu", "Data wydania")) == {"Rodzaj dokumentu": "wyrok", "Sygnatura": "KIO 1/20"}
    assert pages._labelled("", ("Sygnatura",)) == {}
