"""Judgments, acts, subjects and runs derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import search
from ..session import cut, shared_folder

COURTS = ["Sąd Rejonowy w Łodzi", "Sąd Okręgowy w Łodzi", "Sąd Apelacyjny w Krakowie", "Wojewódzki Sąd Administracyjny w Gdańsku"]
BASES = ["art. 385 k.c.", "art. 204 § 2 kk", "art. 98 k.p.c.", None, "art. 2 Konstytucji RP"]


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def judgments(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Documents as judgments; neighbouring ids share a signature, court and mostly a date."""
    rows = read(spark, d, "documents") if rows is None else rows
    g = F.floor(F.col("doc_id") / 2)
    pick = lambda values, k: F.get(F.array(*[F.lit(v).cast("string") for v in values]), k.cast("int"))
    extra = F.when(g % 5 == 4, F.col("doc_id") % 2).otherwise(0)
    judged = F.date_add(F.lit("2015-01-01").cast("date"), (g % 3000 + extra).cast("int"))
    kind = F.when((F.col("doc_id") % 2 == 1) & (g % 7 != 6), "uzasadnienie").otherwise("wyrok")
    return rows.select(
        pick(["ms", "nsa", "kio"], g % 3).alias("source"), F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("I C "), g.cast("string"), F.lit("/20")).alias("signature"), kind.alias("doc_type"),
        F.lit(None).cast("string").alias("doc_type_raw"), pick(COURTS, g % 4).alias("court"),
        judged.alias("judgment_date"), F.date_add(judged, (F.col("doc_id") % 29).cast("int")).alias("publication_date"),
        F.array(pick(["Emerytura", "Renta", "Kara umowna"], g % 3), pick(["Emerytura pomostowa", "Termin"], F.col("doc_id") % 2)).alias("thematic"),
        pick(BASES, g % 5).alias("legal_basis"), F.lit(None).cast("string").alias("importance"),
        F.when(F.col("doc_id") % 2 == 0, F.substring(strip("text"), 1, 200)).alias("sentencja"),
        F.when(F.col("doc_id") % 2 == 1, F.col("text")).alias("uzasadnienie"), F.col("text").alias("full_text"),
        F.array(F.struct(F.concat(F.lit("Jan Nowak-"), F.col("source")).alias("name"), F.lit("sędzia").alias("role"), F.lit(None).cast("string").alias("note"))).alias("judges"),
        F.lit(None).cast("string").alias("excerpt"), F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 3600).alias("first_seen_at"),
        F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 3600).alias("last_seen_at"),
    )


_INDEXES: dict[tuple, str] = {}
_POSTING = "token string, source string, doc_id string, tf long, bucket int"


def _state(spark: SparkSession, d: str) -> tuple:
    """What the stored index depends on: the application, the folder and the files of its table."""
    meta = read(spark, d, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return (spark.sparkContext.applicationId, d, *meta.agg(F.count("*"), F.sum(F.crc32(F.concat_ws(" ", "file_path", "file_size", "file_modification_time")))).first())


def build_index(spark: SparkSession, d: str) -> DataFrame:
    """A stored token index of the judgments, written anew; later searches take it."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    search.write_postings(cut(search.postings(judgments(spark, d), F.col("full_text"))), path)
    _INDEXES[_state(spark, d)] = path
    return spark.read.schema(_POSTING).parquet(path)


def index(spark: SparkSession, d: str) -> DataFrame:
    """The stored token index; written once for each application and state of the table's files."""
    known = _INDEXES.get(_state(spark, d))
    return spark.read.schema(_POSTING).parquet(known) if known else build_index(spark, d)


_PICK = lambda values, k: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][({k}) % {len(values)} + 1]"

#: The same judgments as the first part of a WITH clause.
J = f"""WITH j0 AS (SELECT *, doc_id // 2 AS g FROM documents), j AS (SELECT
  {_PICK(["ms", "nsa", "kio"], "g")} AS source, doc_id::VARCHAR AS doc_id, doc_id AS n, 'I C ' || g || '/20' AS signature,
  CASE WHEN doc_id % 2 = 1 AND g % 7 <> 6 THEN 'uzasadnienie' ELSE 'wyrok' END AS doc_type,
  {_PICK(COURTS, "g")} AS court,
  (DATE '2015-01-01' + (g % 3000 + CASE WHEN g % 5 = 4 THEN doc_id % 2 ELSE 0 END)::INT) AS judgment_date,
  (DATE '2015-01-01' + (g % 3000 + CASE WHEN g % 5 = 4 THEN doc_id % 2 ELSE 0 END)::INT + (doc_id % 29)::INT) AS publication_date,
  {_PICK(BASES, "g")} AS legal_basis, text AS full_text, 'Jan Nowak-' || source AS judge,
  (TIMESTAMP '2020-01-01 00:00:00' + to_hours(doc_id::INT)) AS first_seen_at
FROM j0)"""
#: Tokens of a column in SQL.
TOKENS = "list_filter(regexp_split_to_array(lower(translate(strip_accents({c}), 'łŁ', 'lL')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def acts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as acts whose line items are references, grouped by return flag."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")
    ref = F.struct(F.concat(F.lit("DU/2000/"), F.col("l_partkey").cast("string")).alias("id"))
    groups = lines.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", ref.alias("r")))).alias("rs"))
    maps = groups.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.transform("rs", lambda x: x["r"]).alias("rs")))).alias("act_references"))
    o = read(spark, d, "orders")
    return o.join(maps, o.o_orderkey == maps.l_orderkey, "left").select(
        F.when(F.col("o_orderkey") % 2 == 0, "DU").otherwise("MP").alias("publisher"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("int").alias("pos"),
        F.concat(F.lit("Ustawa - "), F.get(F.array(F.lit("Kodeks cywilny"), F.lit("Kodeks karny"), F.lit("Prawo bankowe"), F.lit("o zmianie ustawy - Kodeks karny")), (F.col("o_orderkey") % 4).cast("int"))).alias("title"),
        F.when(F.col("o_orderstatus") == "F", "IN_FORCE").when(F.col("o_orderstatus") == "O", "NOT_IN_FORCE").alias("in_force"), F.col("o_orderpriority").alias("act_type"),
        F.to_date("o_orderdate").alias("promulgation_date"), F.coalesce("act_references", F.create_map().cast("map<string,array<struct<id:string>>>")).alias("act_references"),
        (F.col("o_totalprice") > 250000).alias("has_jednolity"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("full_text"),
    )


#: The same acts and their references in SQL.
A = """WITH a AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'DU' ELSE 'MP' END AS publisher, year(o_orderdate)::INT AS year, o_orderkey::INT AS pos,
  'Ustawa - ' || ['Kodeks cywilny', 'Kodeks karny', 'Prawo bankowe', 'o zmianie ustawy - Kodeks karny'][o_orderkey % 4 + 1] AS title,
  CASE o_orderstatus WHEN 'F' THEN 'IN_FORCE' WHEN 'O' THEN 'NOT_IN_FORCE' END AS in_force, o_orderpriority AS act_type,
  o_orderdate::DATE AS promulgation_date, o_totalprice > 250000 AS has_jednolity, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS full_text FROM orders),
e AS (SELECT publisher, year, pos, l_returnflag AS ref_group, (row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) - 1)::INT AS ord,
  'DU/2000/' || l_partkey AS dst_id, 'DU' AS dst_publisher, 2000 AS dst_year, l_partkey::INT AS dst_pos FROM a JOIN lineitem ON l_orderkey = pos)"""


def targets(spark: SparkSession, d: str) -> DataFrame:
    """Parts as the acts that references lead to."""
    p = read(spark, d, "part").where("p_size > 25")
    return p.select(F.lit("DU").alias("publisher"), F.lit(2000).alias("year"), F.col("p_partkey").cast("int").alias("pos"), F.col("p_name").alias("title"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", F.col("ts").alias("started_at"), F.col("event_type").alias("source"), F.when(F.col("event_type") == "error", "blad").otherwise("ok").alias("status"), "value")


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """Parts as documents whose terms are their names, the first words of these, and their types, in odd spellings."""
    p = read(spark, d, "part")
    first = F.get(F.split("p_name", " "), 0)
    terms = F.array(F.concat(F.lit(' "'), F.initcap("p_name"), F.lit('" ')), F.when(F.col("p_partkey") % 3 == 0, first), F.concat(F.lit("Koszty "), F.lower("p_type")))
    return p.select(F.col("p_brand").alias("source"), F.col("p_partkey").cast("string").alias("doc_id"), F.filter(terms, lambda t: t.isNotNull()).alias("thematic"))


S = """WITH s AS (SELECT DISTINCT p_brand AS source, p_partkey::VARCHAR AS doc_id, upper(left(t, 1)) || substr(lower(t), 2) AS name
  FROM (SELECT *, unnest([p_name, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[1] END, 'Koszty ' || lower(p_type)]) AS t FROM part) WHERE t IS NOT NULL)"""
