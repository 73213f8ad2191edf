"""A corpus pipeline of five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back
as the next stage's docs. All but the last return the columns of ``docs``, whatever their names are.

In every stage a null text counts as empty, rows with equal id and text are decided alike, ties go by id and
then by the text's hash, texts are read whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import byte_bpe, minhash_dedup, mixing, quality_classifier, quality_rules
from lexspark.llm.shared import materialise, read_table

#: SQL can't express the classifier's fit, the sketches or the encoder.
ORACLE_SQL = None


def _row(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _paired(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``decided`` on the id and the text's hash, beside each other, so that no column names clash.

    Docs are one struct column ``d`` here. Only ids and 64-bit hashes of the texts are compared.
    """
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    left = left.withColumn("k_id", F.col("d.doc_id")).withColumn("k_row", _row("d.text"))
    right = decided.withColumnRenamed("doc_id", "r_id").withColumnRenamed("row", "r_row")
    return left.join(right, F.col("k_id").eqNullSafe(F.col("r_id")) & (F.col("k_row") == F.col("r_row")), how)


def _kept(docs: DataFrame, decided: DataFrame, keep) -> DataFrame:
    """The rows of docs that aren't decided to go; equal rows are decided alike. Those to go are the smaller side as a rule."""
    gone = decided.where(~keep).select("doc_id", "row").distinct()
    return _paired(docs, gone, "left_anti").select("d.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects: a score below 0.5, empty texts among them if they score so."""
    decided = quality_classifier.classify(docs, read_table(spark, sf_dir, "labels"))
    return _kept(docs, decided, F.col("predicted") == 1)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject; null and empty texts fail the base rules."""
    return _kept(docs, quality_rules.assess(docs, with_row=True), F.col("kept"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates, and one row of it.

    Null and wordless texts are classes of their own. Rows that share the representative's id but not its
    text stay only if they represent a class themselves.
    """
    decided = minhash_dedup.near_duplicates(docs, with_row=True)
    once = _kept(docs, decided, F.col("representative"))
    # Rows that still share their id: copies of the representative itself.
    again = decided.where("representative").groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    single = _paired(once, again, "left_anti").select("d.*")
    several = _paired(once, again, "left_semi").select("d.*")
    return single.unionByName(several.dropDuplicates(["doc_id", "text"]))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; documents that it doesn't take go, empty ones always."""
    taken = mixing.mix(docs, with_row=True).where("times > 0")
    taken = taken.groupBy("doc_id", "row").agg(F.max("times").alias("r_times"))
    found = _paired(docs, taken, "inner")
    return found.select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r_times")))).select("d.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, for each row; null texts as empty ones."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=("source",))


STAGES = [
    ("quality_classifier", quality_stage),
    ("quality_rules", rules_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
