"""Quality classifier: document statistics, random Fourier features, ridge regression, isotonic calibration.

Statistics of each document (shares of letters, symbols, repeated words and so on) are standardised and
mapped to ``features`` random cosines, whose inner products approximate a Gaussian kernel. Ridge scores
come from the normal equations: every task sums the products of its labelled rows, the sums are added by
Spark, and the driver solves one system of that fixed size. Scores of labelled rows, counted in fixed
bins, give the isotonic calibration.

Only statistics are joined with labels and only they are shuffled; texts are read once. Every labelled
row takes part. What reaches the driver has a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .quality_rules import statistics
from .shared import materialise

FEATURES, WIDTH, RIDGE, SEED = 192, 4.0, 1.0, 11
BINS, LOW, HIGH = 2048, -0.5, 1.5
N_STATS = 18


def measure(t: X.Texts) -> np.ndarray:
    """One row of statistics for each document. Shares are of bytes, words or lines; empty texts give zeros."""
    s = statistics(t)
    found = X.words(t)
    n = np.maximum(s["n_words"], 1).astype(float)
    size = np.maximum(np.diff(t.offsets), 1).astype(float)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[t.offsets[1:]] - total[t.offsets[:-1]]) / of

    b = t.data
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    stop, comma = (b == 46) | (b == 63), (b == 44) | (b == 59)
    shout, bar, wide = b == 33, b == 124, b >= 0x80
    other = ~(upper | lower | digit | stop | comma | shout | bar | wide | X._SPACE[b])
    key = X.mix(found.hash + found.doc.astype(X.U64) * X.U64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    distinct = np.bincount(found.doc[first], minlength=t.n)
    long = found.end - found.start
    lines = np.bincount(s["line_doc"], minlength=t.n)
    at = np.maximum(lines, 1)
    mean = np.bincount(found.doc, long, minlength=t.n) / n
    spread = np.sqrt(np.maximum(np.bincount(found.doc, long.astype(float) ** 2, minlength=t.n) / n - mean**2, 0))
    one = np.bincount(found.doc[long == 1], minlength=t.n) / n
    rows = [
        np.log1p(s["n_words"]), share(upper, size), share(lower, size), share(digit, size), share(stop, n), share(comma, n),
        share(shout, n), share(bar, n), share(wide, size), share(other, n), s["n_symbols"] / n, s["n_repeat_words"] / n,
        distinct / n, mean, spread, one, s["n_dup_lines"] / at, np.log1p(s["n_words"] / at),
    ]
    return np.stack(rows, axis=1)


def _measured(batches):
    for batch in batches:
        for t in X.slices(batch.column("text")):
            f = measure(t)
            edges = pa.array(np.arange(t.n + 1) * N_STATS, pa.int32())
            kept = [batch.column("doc_id").slice(t.first, t.n), batch.column("row").slice(t.first, t.n)]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(edges, pa.array(f.ravel()))], names=["doc_id", "row", "stats"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``row`` (a hash of the text), ``stats`` of every row, written once."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).cast("string").alias("text")
    )
    return materialise(rows.mapInArrow(_measured, "doc_id long, row long, stats array<double>"), "stats")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), N_STATS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.RandomState(SEED)
        w = rng.normal(size=(N_STATS, FEATURES)) / WIDTH
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(value: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and levels of the blocks, for interpolation between them."""
    blocks: list[list[float]] = []
    for v, s, w in zip(value, total, weight, strict=True):
        blocks.append([v * w, s, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id") -> Model:
    """Fit on all rows of ``stats`` whose id has a label; several labels of an id count by their mean.

    Null ids and null labels are left out. Without any label the model scores 0.5.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
    known = known.agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    train = materialise(stats.join(known, F.col("doc_id") == F.col("_id")).select("stats", "y"), "labelled")
    empty = Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    stat = [F.col("stats")[k] for k in range(N_STATS)]
    row = train.agg(F.count("*"), *[F.avg(c) for c in stat], *[F.stddev_pop(c) for c in stat]).first()
    if not row[0]:
        return empty
    mean, scale = np.array(row[1 : N_STATS + 1], float), np.array(row[N_STATS + 1 :], float)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), empty.weights, empty.knots, empty.levels)
    m = FEATURES + 1
    upper = np.triu_indices(m)

    def products(batches):
        a, c = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            z, y = model.cosines(_matrix(batch.column("stats"))), np.asarray(batch.column("y"))
            a, c = a + z.T @ z, c + z.T @ y
        value = np.concatenate([a[upper], c])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value)), pa.int32()), pa.array(value)], names=["k", "v"])

    # Every task gives one row for each entry of the system; Spark adds them up.
    sums = train.mapInArrow(products, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    value = sums.sort_values("k").v.to_numpy()
    a = np.zeros((m, m))
    a[upper] = value[: len(upper[0])]
    a = a + np.triu(a, 1).T
    model.weights = np.linalg.solve(a + RIDGE * np.eye(m), value[len(upper[0]) :])

    def binned(batches):
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column("stats"))), LOW, HIGH - 1e-9)
            k = ((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column("y")], names=["k", "y"])

    counts = train.mapInArrow(binned, "k int, y double").groupBy("k").agg(F.sum("y").alias("s"), F.count("*").alias("n")).toPandas().sort_values("k")
    centre = LOW + (counts.k.to_numpy() + 0.5) * (HIGH - LOW) / BINS
    model.knots, model.levels = isotonic(centre, counts.s.to_numpy(float), counts.n.to_numpy(float))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``row``, ``score`` (0 to 1) of every row of ``stats``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.score(_matrix(batch.column("stats")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(s)], names=["doc_id", "row", "score"])

    return stats.mapInArrow(run, "doc_id long, row long, score double")


def held_out(id_col: str, parts: int, part: int):
    """Rows whose labels aren't learned: crc32 of the id as text leaves ``part``. A null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", parts: int = 3, part: int = 1) -> DataFrame:
    """``doc_id``, ``row``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Null texts count as empty and are scored like others. Repeated rows are scored alike. Labels without
    a document and documents without a label are fine. An empty table gives an empty table. Only the id
    and the text are read.
    """
    stats = measured(docs)
    model = fit(stats, labels.where(~held_out("doc_id", parts, part)), label_col)
    out = score(stats, model)
    return out.select("doc_id", "row", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("row")
