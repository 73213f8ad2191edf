"""Quality rules: word and line statistics of each document, and lines that many documents of a host share.

*Base rules* look at one document: too few words, or too many words inside repeated three-word windows.

*Cross-document rule.* Lines are normalised (words joined by single spaces) and hashed. For each host
and line the distinct documents that hold it are counted, by the hash of their text: exact copies would
make a whole text look like boilerplate, so they are one document, here and in the host's total. Lines
counted in more than ``share`` of the host's documents, and in more than ``least`` of them, are removed;
a document that loses more than ``depleted`` of its words is rejected.

Lines leave the text pass as 64-bit hashes with their numbers of words, so the shuffles are narrow.
Counts are combined before they are shuffled; the lookup of frequent lines is a plain equi-join, whose
frequent keys adaptive execution may split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .shared import materialise

MIN_WORDS, MOST_REPEATED = 50, 0.5
SHARE, LEAST, DEPLETED = 0.05, 10, 0.5
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def statistics(t: X.Texts) -> dict[str, np.ndarray]:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and its lines with a word.

    Lines: document, hash of the normalised line, number of words, in order.
    """
    found = X.words(t)
    n_words = found.counts(t.n)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[t.offsets[1:]] - total[t.offsets[:-1]]

    word_chars = per_doc(~X._SPACE[t.data] & ((t.data & 0xC0) != 0x80))
    n_symbols = per_doc(_SYMBOL[t.data])

    # Words inside three-word windows that their document has at least twice.
    at, h = X.windows(found, 3)
    key = X.mix(h + found.doc[at].astype(X.U64) * X.U64(0x9E3779B97F4A7C15))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[count[inverse.ravel()] > 1] if len(at) else at
    covered = np.zeros(len(found.start), bool)
    for k in range(3):
        covered[hit + k] = True
    n_repeat = np.bincount(found.doc[covered], minlength=t.n)

    # A line is the run of words between two line feeds of one document.
    feeds = np.flatnonzero(t.data == 0x0A)
    line = np.searchsorted(feeds, found.start)
    fresh = np.ones(len(line), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (found.doc[1:] != found.doc[:-1])
    first = np.flatnonzero(fresh)
    nth = np.cumsum(fresh) - 1
    line_doc, line_words = found.doc[first], np.bincount(nth, minlength=len(first))
    line_hash = X.sequence_hash(found.hash, nth, len(first))

    # Raw lines, with their white space, compared with earlier ones of the document.
    edge = np.zeros(len(t.data) + 2, bool)
    edge[t.offsets], edge[feeds], edge[feeds + 1], edge[-1] = True, True, True, False
    edges = np.flatnonzero(edge)
    slot = np.searchsorted(edges, found.start[first], "right") - 1
    raw = X.span_hash(t.data, edges[slot], edges[slot + 1]) if len(first) else line_hash
    raw = X.mix(raw + line_doc.astype(X.U64) * X.U64(0x9E3779B97F4A7C15))
    _, once = np.unique(raw, return_index=True)
    repeated = np.ones(len(first), bool)
    repeated[once] = False
    n_dup = np.bincount(line_doc[repeated], minlength=t.n)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat, "line_doc": line_doc, "line_hash": line_hash, "line_words": line_words,
    }


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = (
    "row long, host string, doc_id long, key long, " + ", ".join(f"{c} long" for c in _BASE)
    + ", lines array<long>, line_words array<int>"
)


def _scan(batches):
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for t in X.slices(batch.column("text")):
            s = statistics(t)
            # Each distinct line once, with all its words.
            key = X.mix(s["line_hash"] + s["line_doc"].astype(X.U64) * X.U64(0x9E3779B97F4A7C15))
            _, once, inverse = np.unique(key, return_index=True, return_inverse=True)
            words = np.bincount(inverse.ravel(), s["line_words"], minlength=len(once)).astype(np.int64)
            doc, line = s["line_doc"][once], s["line_hash"][once]
            order = np.lexsort((line, doc))
            doc, line, words = doc[order], line[order], words[order]
            edges = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=t.n))])
            lists = [pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(v)) for v in (line.view(np.int64), words.astype(np.int32))]
            cols = [pa.array(np.arange(row, row + t.n)), batch.column("host").slice(t.first, t.n), batch.column("doc_id").slice(t.first, t.n), batch.column("key").slice(t.first, t.n)]
            row += t.n
            yield pa.RecordBatch.from_arrays(
                [*cols, *(pa.array(s[c].astype(np.int64)) for c in _BASE), *lists],
                names=["row", "host", "doc_id", "key", *_BASE, "lines", "line_words"],
            )


def assess(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    share: float = SHARE, least: int = LEAST, depleted: float = DEPLETED, with_row: bool = False,
) -> DataFrame:
    """One row for each row: the statistics, ``n_removed_words``, ``base_failed`` and ``kept``.

    with_row adds ``row``, the 64-bit hash of the text.

    Null texts count as empty: no words, hence base_failed. A null host is a host of its own. Repeated
    rows are judged alike. An empty table gives an empty table. Other columns are not read.
    """
    rows = docs.select(
        F.col(host_col).cast("string").alias("host"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
    )
    scanned = materialise(rows.mapInArrow(_scan, _SCHEMA), "lines")
    lines = scanned.select("row", "host", "key", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    lines = lines.select("row", F.xxhash64("host", "l.lines").alias("line"), "host", "key", F.col("l.line_words").alias("words"))
    # Distinct documents, and (line, document) pairs, first, then their number: all are combined before the shuffle.
    hosts = scanned.groupBy("host", "key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("n_docs"))
    pairs = lines.groupBy("host", "line", "key").agg(F.lit(1).alias("one"))
    counts = pairs.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    limit = hosts.select(F.col("host").alias("_h"), F.greatest(F.lit(float(least)), F.col("n_docs") * share).alias("most"))
    frequent = counts.join(limit, F.col("host").eqNullSafe(F.col("_h"))).where(F.col("n") > F.col("most")).select(F.col("line").alias("_line"))
    frequent = materialise(frequent, "frequent")
    removed = lines.select("row", "line", "words").join(frequent, F.col("line") == F.col("_line")).groupBy("row").agg(F.sum("words").alias("removed"))
    removed = removed.withColumnRenamed("row", "_row")
    out = scanned.drop("lines", "line_words").join(removed, F.col("row") == F.col("_row"), "left")
    out = out.withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MOST_REPEATED) * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("n_removed_words") <= depleted * F.col("n_words"))
    return out.select("doc_id", *_BASE, "n_removed_words", "base_failed", kept.alias("kept"), *([F.col("key").alias("row")] if with_row else []))


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return assess(read_table(spark, sf_dir, "documents"))


#: The same rules in DuckDB's SQL.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    string_split(coalesce(text, ''), chr(10)) AS raw
  FROM documents
), w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
tri AS (
  SELECT a.doc_id, a.i, a.word || ' ' || b.word || ' ' || c.word AS gram
  FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN w c ON a.doc_id = c.doc_id AND c.i = a.i + 2
), twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
raw AS (SELECT doc_id, source, unnest(raw) AS line FROM d),
with_word AS (
  SELECT doc_id, source, line, array_to_string(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), ' ') AS norm,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM with_word GROUP BY doc_id),
line AS (SELECT doc_id, source, norm, sum(n) AS words FROM with_word GROUP BY ALL),
frequent AS (
  SELECT f.source, f.norm FROM (
    SELECT l.source, l.norm, count(DISTINCT d.text) AS n FROM line l JOIN d USING (doc_id) GROUP BY ALL
  ) f JOIN (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source) h ON f.source IS NOT DISTINCT FROM h.source
  WHERE n > greatest({LEAST}, {SHARE} * docs)
),
removed AS (
  SELECT l.doc_id, sum(l.words) AS n FROM line l JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.doc_id
),
s AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {round(100 * MOST_REPEATED)} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {round(100 * MOST_REPEATED)} * n_words) AND n_removed_words <= {DEPLETED} * n_words AS kept
FROM s
"""
