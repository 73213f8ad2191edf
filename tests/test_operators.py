"""Golden rows of the table jobs, and reruns that change nothing."""

import datetime as dt

from pyspark.sql import functions as F

from lexspark.operators import acts, ingest, layout, merge, reports, search, subject_index, tables
from lexspark.schemas import JUDGMENTS



def at(day):
    return F.lit(f"2025-06-0{day} 00:00:00").cast("timestamp")


FIELDS = [f.strip().split(" ")[0] for f in JUDGMENTS.replace("array<struct<name:string,role:string,note:string>>", "x").split(", ")]


def judgment(doc_id, **more):
    base = {"source": "ms", "doc_id": doc_id, "signature": "II K 971/25", "court": "Sąd Rejonowy w X", "judgment_date": dt.date(2025, 5, 1), "publication_date": dt.date(2025, 5, 10), "judges": [], "thematic": [], "full_text": f"treść {doc_id}"}
    return tuple((base | more).get(f) for f in FIELDS)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), JUDGMENTS)


def test_upserts(spark):
    empty = frame(spark)
    one = frame(spark, judgment("a", thematic=["Kary Umowne", "kara umowna"], judges=[("Jan Nowak", "sędzia", None)]), judgment("a", signature="second"), judgment(None))
    got = tables.upsert_full(empty, tables.prepared_judgments(one), at(1), ["signature"]).collect()
    assert len(got) == 1 and got[0].thematic == ["Kara umowna"] and got[0].panel == ["Jan Nowak"] and got[0].excerpt == "treść a"
    stored = spark.createDataFrame(got, JUDGMENTS)
    again = tables.upsert_full(stored, tables.prepared_judgments(frame(spark, judgment("a", full_text=None), judgment("b"))), at(2), ["signature"])
    rows = {r.doc_id: r for r in again.collect()}
    assert rows["a"].full_text is None and rows["a"].first_seen_at == dt.datetime(2025, 6, 1) and rows["a"].last_seen_at == dt.datetime(2025, 6, 2) and rows["b"].first_seen_at == dt.datetime(2025, 6, 2)
    light = tables.upsert_light(stored, frame(spark, judgment("a", court="other"), judgment("c")), at(2), ["signature"])
    rows = {r.doc_id: r for r in light.collect()}
    assert rows["a"].court == "Sąd Rejonowy w X" and not rows["a"].is_new and rows["c"].is_new
    assert tables.upsert_light(light.drop("is_new"), frame(spark, judgment("c")), at(2), ["signature"]).where("is_new").count() == 0
    assert tables.renormalised(stored).where("changed").count() == 0


def test_skip_list_and_retention(spark):
    schema = "source string, doc_id string, reason string, skipped_at timestamp"
    t = dt.datetime(2025, 1, 1)
    old = spark.createDataFrame([("ms", "a", "first", t)], schema)
    new = spark.createDataFrame([("ms", "a", "second", t), ("ms", "b", "x" * 900, t), ("ms", "b", "y", t + dt.timedelta(1))], schema)
    got = {r.doc_id: r.reason for r in tables.mark_skipped(old, new).collect()}
    assert got == {"a": "first", "b": "x" * 500}
    df = spark.createDataFrame([(1, t), (2, t - dt.timedelta(401)), (3, None)], "i int, ts timestamp")
    assert {r.i for r in tables.retained(df, "ts", F.lit("2025-01-01").cast("timestamp"), 400).collect()} == {1, 3}
    assert tables.retained(df, "ts", at(1), 0).count() == 3


def test_decoding_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("ms", "a", "[]", "bad", '[{"name":"Jan","role":"sędzia"}]')], "source string, doc_id string, panel string, thematic string, judges string")
    r = tables.decoded_judgments(df).first()
    assert r.panel == ["Jan"] and r.thematic == [] and r.url == "/orzeczenie/ms/a"
    path = tables.write_snapshot(df, str(tmp_path), 3, ["source"])
    assert path.endswith("v=00000003") and spark.read.parquet(path).count() == 1


def test_pair_merge(spark):
    w = judgment("w", doc_type="wyrok", sentencja="orzeka", full_text="orzeka", thematic=["A"], judges=[("Jan Nowak", "sędzia", None)])
    u = judgment("u", doc_type="uzasadnienie", uzasadnienie="bo tak", full_text="bo tak", thematic=["A", "B"], judges=[("JAN NOWAK", "sędzia", None), ("Ewa Mała", "sędzia", None)], legal_basis="k.c.")
    out, gone, counts = merge.merge_duplicates(frame(spark, w, u))
    r = out.collect()
    assert len(r) == 1 and r[0].doc_id == "w" and r[0].uzasadnienie == "bo tak" and r[0].full_text == "orzeka\n\nbo tak"
    assert r[0].thematic == ["A", "B"] and [j.name for j in r[0].judges] == ["Jan Nowak", "Ewa Mała"] and r[0].legal_basis == "k.c." and r[0].excerpt == "orzeka"
    assert [x.doc_id for x in gone.collect()] == ["u"]
    assert merge.merge_duplicates(out)[2].count() == 0


def test_eight_rows_in_four_groups(spark):
    g = lambda n: {"signature": f"I C {n}/20"}
    rows = [
        judgment("1w", doc_type="wyrok", sentencja="s", **g(1)), judgment("1u", doc_type="uzasadnienie", uzasadnienie="u", **g(1)),
        judgment("2a", doc_type="wyrok", sentencja="s", **g(2)), judgment("2b", doc_type="wyrok", uzasadnienie="u", **g(2)),
        judgment("3a", doc_type="wyrok", sentencja="s", uzasadnienie="u", **g(3)), judgment("3b", doc_type="wyrok", sentencja="s", **g(3)),
        judgment("4a", doc_type="wyrok", sentencja="s", **g(4)), judgment("4b", doc_type="wyrok", sentencja="s", **g(4)),
    ]
    out, gone, counts = merge.merge_duplicates(frame(spark, *rows))
    assert {r.kind: r.n for r in counts.collect()} == {"scalono": 2, "zastąpiono": 1, "niejednoznaczne": 1}
    assert {r.doc_id for r in out.collect()} == {"1w", "2a", "3a", "4a", "4b"}
    again = merge.merge_duplicates(out)
    assert {r.kind for r in again[2].collect()} == {"niejednoznaczne"} and again[1].count() == 0


def test_named_merge_siblings_and_held_rows(spark):
    w, u = judgment("w", doc_type="wyrok"), judgment("u", doc_type="uzasadnienie", judgment_date=dt.date(2020, 1, 1))
    alone = judgment("x", doc_type="uzasadnienie", signature="other")
    named = spark.createDataFrame([("ms", "w", "u"), ("ms", "w", "nope")], "source string, keep string, absorb string")
    out, gone = merge.merge_named(frame(spark, w, u), named)
    assert [r.doc_id for r in out.collect()] == ["w"] and gone.count() == 1
    assert {(r.doc_id, r.sibling) for r in merge.siblings(frame(spark, w, u, alone)).collect()} == {("w", "u"), ("u", "w")}
    got = {r.doc_id: (r.action, r.sibling) for r in merge.classified(frame(spark, u, alone, judgment("e", full_text=None, signature="z"), judgment("n", doc_type="wyrok", signature="y")), frame(spark, w)).collect()}
    assert got == {"u": ("merge", "w"), "x": ("hold", None), "e": ("skip", None), "n": ("store", None)}


def test_text_of_a_sibling(spark):
    rows = frame(spark, judgment("a", full_text=None), judgment("b"), judgment("c", signature="z", full_text=None))
    got = {r.requested: (r.doc_id, r.full_text) for r in merge.completed(rows).collect()}
    assert got == {"a": ("b", "treść b"), "b": ("b", "treść b"), "c": ("c", None)}


def test_search(spark):
    rows = frame(spark, judgment("a", full_text="Kara umowna i kara", legal_basis="art. 385 k.c."), judgment("b", full_text="kara łagodna", judgment_date=None), judgment("c", full_text="nic", judges=[("Ewa Mała", "sędzia", "sprawozdawca")], court="Sąd Okręgowy"))
    text = F.col("full_text")
    find = lambda **q: [r.doc_id for r in search.search(rows, search.Query(**q), text).collect()]
    assert find(phrase="KARA") == ["a", "b"] and find(phrase="kara umowna") == ["a"] and find(phrase="...") == [] and find(phrase="lagodna") == ["b"]
    assert find(judge="sprawozd") == ["c"] and find(court="sąd okr") == ["c"] and find(court="okr") == [] and find(date_from="2025-01-01", date_to="bad") == ["a", "c"]
    assert find(signature="k  971") == ["a", "c", "b"] and find(signature="K%25") == ["a", "c", "b"] and find(signature="K%25", literal=True) == [] and search.Query().is_empty
    index = search.postings(rows, text)
    direct = {r.doc_id: r["rank"] for r in search.matches(rows, search.Query(phrase="kara"), text).collect()}
    assert {r.doc_id: r["rank"] for r in search.lookup(index, "kara").collect()} == direct
    assert search.suggest(rows, "court", "ąd").count() == 2 and search.suggest(rows, "court", "s").count() == 0
    hits, notes = search.capable(rows.withColumn("source", F.lit("kio")), search.Query(judge="x"))
    assert hits.count() == 0 and len(notes) == 1


def test_subject_tree(spark):
    terms = {"a": ["Emerytura", "Emerytura pomostowa"], "b": ["emerytura pomostowa"], "c": ["Emerytura"], "d": ["Domniemania", "Czynności procesowe"], "e": ["Domniemanie niewinności", "Czynności prawne"], "f": ["Odrzucenie spadku", "Odrzucenie pozwu", "Odrzucenie apelacji"], "g": ["Postępowanie upadłościowe", "Upadłość konsumencka", "Upadłość likwidacyjna"]}
    rows = frame(spark, *[judgment(k, thematic=v) for k, v in terms.items()])
    got = {r.name: r for r in subject_index.tree(rows).collect()}
    e = got["Emerytura"]
    assert (e["count"], e.total, [(c.name, c["count"]) for c in e.children]) == (2, 3, [("Emerytura pomostowa", 2)])
    assert [c.name for c in got["Domniemania"].children] == ["Domniemanie niewinności"]
    assert got["Czynności"]["count"] == 0 and got["Czynności"].total == 2
    assert "Odrzucenie spadku" in got and [c.name for c in got["Odrzucenie"].children] == ["Odrzucenie apelacji", "Odrzucenie pozwu"]
    assert "Postępowanie upadłościowe" in [c.name for c in got["Upadłość"].children]
    index = subject_index.tree(rows)
    assert [r.letter for r in subject_index.letters(index).collect()] == ["C", "D", "E", "O", "U"]
    assert {r.name for r in subject_index.filtered(index, text="pomost").collect()} == {"Emerytura"}


def test_acts(spark):
    schema = "publisher string, year int, pos int, title string, legal string, act_references map<string,array<struct<id:string>>>, has_jednolity boolean"
    refs = {"Inf. o tekście jednolitym": [("DU/2020/5",), ("DU/2021/9",)], "Inne": [("zły",), ("",), ("DU/1/2/3",)]}
    df = spark.createDataFrame([("DU", 2019, 1, "Ustawa - Kodeks cywilny", None, refs, True), ("DU", 2020, 5, "Obwieszczenie", None, {}, False), ("DU", 2020, 6, "o zmianie ustawy - Kodeks cywilny", None, None, False)], schema)
    links = acts.edges(df)
    assert {r.dst_id for r in links.collect()} == {"DU/2020/5", "DU/2021/9", "zły", "DU/1/2/3"}
    assert [r.dst_id for r in acts.existing(links, df).collect()] == ["DU/2020/5"]
    shown = {r.dst_id: r.shown for r in acts.related(links, df).collect()}
    assert shown["DU/2020/5"] == "Obwieszczenie" and shown["zły"] == "zły"
    assert acts.last_of_group(links, "Inf. o tekście jednolitym").first().dst_id == "DU/2021/9"
    assert [r.c for r in df.orderBy("pos").select(acts.code_of(F.col("title")).alias("c")).collect()] == ["kodeks cywilny", None, None]
    assert [r.c for r in df.orderBy("pos").select(acts.has_consolidated(F.coalesce("act_references", F.create_map().cast("map<string,array<struct<id:string>>>"))).alias("c")).collect()] == [True, False, False]
    j = frame(spark, *[judgment(str(i), legal_basis="art. 1 k.p.c. i kc", judgment_date=dt.date(2020, 1, i + 1)) for i in range(9)])
    got = acts.citing(df, j).orderBy("rn").collect()
    assert [r.doc_id for r in got] == ["8", "7", "6", "5", "4", "3"] and got[0].total == 9
    listed = spark.createDataFrame([("DU", 2020, 5), ("DU", 2020, 6), ("DU", 2019, 1), ("DU", 2019, 2)], "publisher string, year int, pos int")
    assert {(r.year, r.missing, r.complete) for r in acts.coverage(listed, df).collect()} == {(2020, 0, True), (2019, 1, False)}
    assert acts.next_year(1918, True, 2026) == 2026 and acts.next_year(1950, False, 2026) == 1950 and acts.next_year(1950, True, 2026) == 1949
    first = acts.reference_ids(F.coalesce("act_references", F.create_map().cast("map<string,array<struct<id:string>>>")), ["Inne", "x"])
    assert df.orderBy("pos").select(first.alias("i")).first().i == ["zły", "DU/1/2/3"]


def test_table_rows(spark):
    rows = [("d", 0, 0, 10.0, ["Lp.", "Na", None]), ("d", 0, 1, 20.0, ["", "zwa", "x"]), ("d", 0, 2, 45.0, [None, "a<b", ""]), ("d", 0, 3, 60.0, ["1", "c", "y\nz"])]
    df = spark.createDataFrame(rows, "doc string, table_id int, row_idx int, center double, cells array<string>")
    near = layout.nearest(layout.anchors(df)).orderBy("row_idx").collect()
    assert [r.anchor_idx for r in near] == [0, 0, 3, 3]
    merged = layout.logical_rows(df)
    assert {r.group_idx: (r.cells, r.header) for r in merged.collect()} == {0: (["Lp.", "Na zwa", "x"], True), 3: (["1", "a<b c", "y z"], False)}
    block = layout.rendered(merged).first().block
    assert block == '@@TABLE@@<div class="pdf-table-wrap"><table class="pdf-table"><thead><tr><th>Lp.</th><th>Na zwa</th><th>x</th></tr></thead><tbody><tr><td>1</td><td>a&lt;b c</td><td>y z</td></tr></tbody></table></div>'
    lone = layout.logical_rows(df.where("row_idx in (1, 2)"))
    assert lone.count() == 2


def test_reports_and_ingest(spark):
    hits = spark.createDataFrame([("nsa", "1", 0), ("nsa", "2", 1), ("ms", "3", 2), ("ms", "4", 3), ("nsa", "5", 4)], "source string, doc_id string, ord int")
    assert [r.doc_id for r in reports.interleaved(hits).collect()] == ["1", "3", "2", "4", "5"]
    assert {(r.source, r.n) for r in reports.per_source(hits).collect()} == {("nsa", 3), ("ms", 2), (None, 5)}
    pages = spark.createDataFrame([(0, '<r total="4"><id>a</id><id>b</id></r>'), (2, "<r><id>c</id><id>a</id></r>")], "offset int, body string")
    assert [r.doc_id for r in ingest.listed_ids(pages).orderBy("ord").collect()] == ["a", "b", "c"] and ingest.listed_total(pages).first().total == 4
    none = hits.limit(0)
    assert [r.doc_id for r in ingest.new_ids(hits, hits.where("doc_id = '5'"), none, 2, newest_first=True).collect()] == ["4", "3"]
    q = spark.createDataFrame([(True, "s", "t"), (False, None, "t"), (False, "s", ""), (False, "s", "t")], "blocked boolean, signature string, full_text string")
    assert [(r.reason, r.permanent) for r in ingest.quality(q).collect()] == [("blokada", False), ("brak metryki", False), ("brak treści w źródle", True), (None, False)]
    empty = spark.createDataFrame([], "first_seen_at timestamp")
    assert reports.freshness(empty, at(1), 24).first().alert
