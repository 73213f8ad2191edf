"""Readers of saved responses, the archive and exports (IO1, IO4-IO10, PR1, PR2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled
from ..operators.tables import missing
from ..schemas import KEY
from ..session import cut

_REFS = "map<string,array<struct<id:string>>>"
ACT_JSON = (
    "publisher string, year int, pos int, ELI string, address string, title string, type string, status string, inForce string, "
    "promulgation string, announcementDate string, entryIntoForce string, releasedBy array<string>, keywords array<string>, "
    f"references {_REFS}, changeDate string, textHTML boolean, textPDF boolean"
)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """IO1: a stored table, read in parallel ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def read_pages(spark: SparkSession, path: str, source: str, kind: str) -> DataFrame:
    """IO6: saved files, one page each, as raw pages; the id is the file's name without its extension."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_modification_time").alias("fetched_at"))
    doc_id = F.regexp_extract("url", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(F.lit(source).alias("source"), F.lit(kind).alias("kind"), doc_id.alias("doc_id"), "url", "fetched_at", "html")


#: Items of one page of a written year list, on average.
LIST_PAGE = 1000


def write_year_lists(items: DataFrame, path: str) -> None:
    """Lists of each publisher's year in folders by these: pages as lines of JSON, each with the whole list's count.

    Rows: ``publisher``, ``year`` and ``item``, of a written table, as they are counted first. Items are dealt to pages by the hash of their place, so no
    row or task holds a whole list.
    """
    by = ["publisher", "year"]
    counts = items.groupBy(*by).agg(F.count("*").alias("count"))
    page = F.pmod(F.xxhash64("item.pos"), F.ceil(F.col("count") / LIST_PAGE))
    pages = items.join(counts, by).groupBy(*by, "count", page.alias("page")).agg(F.collect_list("item").alias("items"))
    pages.select(*by, F.to_json(F.struct("count", "items")).alias("value")).write.partitionBy(*by).text(path)


def read_year_lists(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """IO4: items of saved year lists, with the count each list states; a file holds one list, or with ``lines`` a page in each line."""
    lists = spark.read.schema(f"count long, totalCount long, items array<struct<{_struct(ACT_JSON)}>>").json(path, multiLine=not lines)
    return lists.select(F.coalesce("count", "totalCount").alias("stated"), F.inline("items"))


def _struct(ddl: str) -> str:
    """The fields of a schema as those of a struct type."""
    depth, out, names = 0, [], True
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == " " and names and not depth and out and out[-1] not in ", ":
            out.append(":")
            names = False
            continue
        names = names or ch == "," and not depth
        out.append(ch)
    return "".join(out)


def act_rows(details: DataFrame, *more: str) -> DataFrame:
    """IO5: details of acts under our names, and columns named in ``more``; missing lists and maps are empty."""
    strings = F.array().cast("array<string>")
    day = lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.substring(c, 1, 10))
    refs = F.coalesce("references", F.create_map().cast(_REFS))
    from ..operators.acts import has_consolidated

    return details.select(
        "publisher", "year", "pos", F.col("ELI").alias("eli"), "address", "title", F.col("type").alias("act_type"), "status", F.col("inForce").alias("in_force"),
        day("promulgation").alias("promulgation_date"), day("announcementDate").alias("announcement_date"), day("entryIntoForce").alias("entry_into_force_date"),
        F.coalesce("releasedBy", strings).alias("released_by"), F.coalesce("keywords", strings).alias("keywords"), refs.alias("act_references"),
        has_consolidated(refs).alias("has_jednolity"), F.col("changeDate").alias("changed_at"), *more,
    )


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")


def archive(rows: DataFrame, stored: DataFrame, path: str) -> DataFrame:
    """IO7: judgments that the archive lacks, added as JSON by source; returns their keys and file names.

    They go to a folder that is named by their keys and written whole, so a call that is repeated with the same
    input writes the same folder again and adds nothing.
    """
    new = cut(missing(rows, stored))
    mark = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*KEY)).alias("h")).first()
    if mark.n:
        new.write.partitionBy("source").mode("overwrite").json(f"{path.rstrip('/')}/batch={mark.n}-{mark.h & 0xFFFFFFFFFFFFFFFF:016x}")
    return new.select(*KEY, safe_name(F.col("doc_id")).alias("name"))


def to_text(rows: DataFrame, empty: bool = False) -> DataFrame:
    """IO8: a plain-text export of each judgment and its file name; missing values are shown as a dash.

    With ``empty`` a part whose text is empty keeps its heading; without, it is left out as a null one.
    """
    shown = lambda c: F.coalesce(filled(F.col(c).cast("string")), F.lit("—"))
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    people = F.array_join(F.transform(F.coalesce("judges", F.array().cast("array<struct<name:string,role:string,note:string>>")), lambda j: F.concat(j["name"], F.lit(" ("), F.coalesce(j["role"], F.lit("—")), F.lit(")"))), ", ")
    said = lambda c: F.col(c) if empty else filled(F.col(c))
    part = lambda label, c: F.when(said(c).isNotNull(), F.concat(F.lit(f"\n{label}\n"), F.col(c)))
    body = F.when(said("sentencja").isNull() & said("uzasadnienie").isNull(), part("TREŚĆ", "full_text"))
    text = F.concat_ws(
        "\n", line("Sygnatura", shown("signature")), line("Sąd", shown("court")), line("Z dnia", shown("judgment_date")), line("Rodzaj", shown("doc_type")),
        line("Skład", F.coalesce(filled(people), F.lit("—"))), line("Hasła", F.coalesce(filled(F.array_join("thematic", ", ")), F.lit("—"))), line("Podstawa prawna", shown("legal_basis")),
        part("SENTENCJA", "sentencja"), part("UZASADNIENIE", "uzasadnienie"), body,
    )
    name = F.concat(F.replace(F.replace(F.coalesce(filled(F.col("signature")), F.col("doc_id")), F.lit("/"), F.lit("-")), F.lit(" "), F.lit("_")), F.lit(".txt"))
    return rows.select(*KEY, name.alias("name"), text.alias("text"))


def to_json(rows: DataFrame) -> DataFrame:
    """IO9."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """IO10: arrays are joined by '; '; nested people by their names."""
    cols = []
    for f in rows.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        cols.append(F.array_join(c, "; ").alias(f.name) if kind == "array<string>" else F.to_json(c).alias(f.name) if kind.startswith(("array", "map", "struct")) else c)
    rows.select(*cols).write.option("header", True).csv(path)


def to_hit(rows: DataFrame) -> DataFrame:
    """PR1: a stored judgment as a listing row."""
    return rows.select(*KEY, "signature", "doc_type", "court", "judgment_date", "publication_date", "thematic", "excerpt", F.concat_ws("/", F.lit("/orzeczenie"), *KEY).alias("url"))


def preview(rows: DataFrame, chars: int = 300) -> DataFrame:
    """PR2: key fields and the beginnings of the texts."""
    head = lambda c: F.coalesce(filled(F.substring(c, 1, chars)), F.lit("(brak)")).alias(c)
    return rows.select(*KEY, "signature", "court", "judgment_date", *map(head, ("sentencja", "uzasadnienie", "full_text")))
