"""Hard negatives by a vertical scan (BOND: branch and bound on decomposed data).

*Columns.* Vectors are stored dimension by dimension, in blocks of at most ``BLOCK`` rows: a block holds one column of
integers for each dimension, and the smallest and largest value of each.

*Scan.* An anchor reads a block's columns in descending order of its own components' magnitudes. After some columns,
a row's score lies between its partial sum plus the smallest, and plus the largest, contributions that the columns
left can still make. Rows that can't matter any more leave the set of candidates, so later columns are read for few
rows. A row matters to

- the positives (the k best rows of the anchor's label) while its upper end reaches the k-th best lower end,
- a positive's window of negatives while its range meets the window, and its upper end reaches the n-th best lower
  end of rows that are surely inside.

What a task has found in earlier blocks raises these floors for the later ones. Scores are sums of integers and exact.

Anchors are taken in blocks of at most ``ANCHORS``, sent to all tasks; a block makes two scans, one for the positives and
one for the windows that they define, and its rows are written before the next block starts. Blocks of rows never meet each other, rows of one label or of equal vectors are
spread over all blocks, and of each task only the best few rows of each anchor or window are shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_turns, materialise

BLOCK, ANCHORS, STEPS = 4096, 4096, (4, 8, 16, 32)
POSITIVES, NEGATIVES = 5, 10
#: Scores of a negative, in hundredths of its positive's.
LOWEST, HIGHEST = 30, 90
SCALE = 256
_NULL = 2**63 - 1
_BLOCKS = "dim int, n int, size int, row binary, id binary, label binary, anchor binary, columns binary, low binary, high binary"


class Columns:
    """One block: ``x[d]`` is the column of dimension d."""

    def __init__(self, r: dict):
        get = lambda name, kind: np.frombuffer(r[name], kind)
        self.row, self.id, self.label, self.anchor = get("row", "<i8"), get("id", "<i8"), get("label", "<i8"), get("anchor", "?")
        self.x = get("columns", f"<i{r['size']}").reshape(r["dim"], r["n"])
        self.low, self.high = get("low", "<i8"), get("high", "<i8")
        self._wide: dict[bool, np.ndarray] = {}

    def wide(self, exact_double: bool) -> np.ndarray:
        """The columns as doubles, where all sums stay below 2**53, or as 64-bit integers."""
        if exact_double not in self._wide:
            self._wide[exact_double] = self.x.astype(np.float64 if exact_double else np.int64)
        return self._wide[exact_double]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as integers. Components that don't fit 62 bits raise an error."""
    y = np.floor(SCALE * x.astype(np.float64))
    if len(y) and np.abs(y).max(initial=0) >= 2.0**62:
        raise ValueError("a component is too large for 64-bit scores")
    return y.astype(np.int64)


def _stored(dim: int, x: np.ndarray, row, ids, label, anchor) -> dict:
    """A row of the table of blocks; ``x`` has a row for each vector."""
    most = int(np.abs(x).max(initial=0))
    size = 2 if most < 2**15 else 4 if most < 2**31 else 8
    t = np.ascontiguousarray(x.T)
    return {
        "dim": dim, "n": len(ids), "size": size, "row": row.astype("<i8").tobytes(), "id": ids.astype("<i8").tobytes(), "label": label.astype("<i8").tobytes(),
        "anchor": anchor.astype(bool).tobytes(), "columns": t.astype(f"<i{size}").tobytes(), "low": t.min(axis=1).astype("<i8").tobytes(), "high": t.max(axis=1).astype("<i8").tobytes(),
    }


def vertical(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """The table of blocks, written to the shared folder."""
    spark = vectors.sparkSession
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), x.alias("x"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & fine)

    def build(batches):
        for batch in batches:
            lists = batch.column("x")
            size = lists.value_lengths().to_numpy()
            flat, first = lists.flatten().to_numpy(), np.cumsum(size) - size
            part = {c: batch.column(c).fill_null(_NULL).to_numpy(zero_copy_only=False) for c in ("row", "id", "label")}
            part["anchor"] = batch.column("anchor").to_numpy(zero_copy_only=False)
            out = []
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                for i in range(0, len(at), BLOCK):
                    few = at[i : i + BLOCK]
                    v = whole(flat[first[few][:, None] + np.arange(dim)])
                    out.append(_stored(int(dim), v, *[part[c][few] for c in ("row", "id", "label", "anchor")]))
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    ints, names = {"dim", "n", "size"}, [c.split()[0] for c in _BLOCKS.split(", ")]
    kinds = pa.schema([(c, pa.int32() if c in ints else pa.binary()) for c in names])
    # Vectors are dealt evenly once, so that the scans keep all tasks busy whatever the files of the input are.
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialise(rows.repartition(parts).mapInArrow(build, _BLOCKS), "vertical")


class Anchors:
    """Some anchors with their integer vectors, by dimension."""

    def __init__(self, table: pa.Table):
        self.row, self.id, self.label = (table.column(c).to_numpy() for c in ("row", "id", "label"))
        self.x = [np.frombuffer(b, "<i8") for b in table.column("x").to_pylist()]
        self.of_dim: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(self.x):
            self.of_dim[len(x)].append(i)


def scan(block: Columns, a: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of the rows that stay candidates to the end: (places in the block, scores).

    ``alive`` are the places of the candidates; ``keep(lower, upper)`` says for ranges of scores which rows still matter.
    """
    order = np.argsort(-np.abs(a), kind="stable")
    c = a[order]
    ends = np.stack([c * block.low[order], c * block.high[order]]) if len(a) else np.zeros((2, 0), np.int64)
    most = int(sum(int(v) for v in np.abs(c).tolist()) * max(int(np.abs(block.low).max(initial=0)), int(np.abs(block.high).max(initial=0))))
    if most >= 2**62:
        raise ValueError("a score is too large for 64 bits")
    # What the columns from the k-th on can contribute.
    left = [np.concatenate([np.cumsum(e[::-1])[::-1], [0]]) for e in (ends.min(axis=0), ends.max(axis=0))]
    exact_double = most < 2**53
    x = block.wide(exact_double)
    c = c.astype(x.dtype)
    partial, done = np.zeros(len(alive), x.dtype), 0
    for upto in [s for s in STEPS if s < len(a)] + [len(a)]:
        if not len(alive):
            break
        read = order[done:upto]
        part = x[read] if len(alive) == x.shape[1] else x[np.ix_(read, alive)]
        partial = partial + c[done:upto] @ part
        done = upto
        stays = keep(partial + left[0][done], partial + left[1][done])
        if not stays.all():
            alive, partial = alive[stays], partial[stays]
    return alive, partial.astype(np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -math.inf


class Best:
    """The n best rows met so far: highest score first, then smallest id, then smallest row number."""

    def __init__(self, n: int):
        self.n, self.rows = n, np.zeros((3, 0), np.int64)

    @property
    def floor(self) -> float:
        return self.rows[0, -1] if self.rows.shape[1] == self.n else -math.inf

    def add(self, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if len(score):
            rows = np.concatenate([self.rows, np.stack([score, ids, row])], axis=1)
            self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.n]]


def _positives(blocks: DataFrame, sent, k: int) -> DataFrame:
    """``anchor`` (its place), ``n``, ``id``, ``score`` of the k best rows of the anchor's label, but itself."""

    def run(batches):
        anchors, best = sent.value, {}
        for batch in batches:
            for r in batch.to_pylist():
                block = Columns(r)
                for i in anchors.of_dim.get(r["dim"], []):
                    mine = best.setdefault(i, Best(k))
                    keep = lambda low, high, mine=mine: high >= max(mine.floor, _kth(low, k))
                    same = np.flatnonzero((block.label == anchors.label[i]) & (block.row != anchors.row[i]))
                    at, score = scan(block, anchors.x[i], same, keep)
                    mine.add(score, block.id[at], block.row[at])
        yield _rows([(i, 0, b) for i, b in best.items()])

    found = blocks.mapInArrow(run, "anchor int, window int, score long, id long, row long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("anchor", "n", "id", "score")


def _rows(found: list[tuple[int, int, Best]]) -> pa.RecordBatch:
    size = [b.rows.shape[1] for _, _, b in found]
    all_rows = np.concatenate([np.zeros((3, 0), np.int64), *[b.rows for _, _, b in found]], axis=1)
    place = [pa.array(np.repeat(np.array([f[c] for f in found], np.int32), size)) for c in (0, 1)]
    return pa.RecordBatch.from_arrays([*place, *map(pa.array, all_rows)], names=["anchor", "window", "score", "id", "row"])


def _negatives(blocks: DataFrame, sent, windows: dict[int, list[tuple[int, int, int]]], k: int) -> DataFrame:
    """``anchor``, ``window``, ``id``, ``score``, ``rank`` of the k best rows of other labels in each window (n, low, high)."""

    def run(batches):
        anchors, best = sent.value, {}
        for batch in batches:
            for r in batch.to_pylist():
                block = Columns(r)
                for i in anchors.of_dim.get(r["dim"], []):
                    mine = [(low, high, best.setdefault((i, n), Best(k))) for n, low, high in windows.get(i, [])]
                    if not mine:
                        continue

                    def keep(low, high, mine=mine):
                        out = np.zeros(len(low), bool)
                        for first, last, b in mine:
                            sure = low[(low >= first) & (high <= last)]
                            out |= (high >= max(first, b.floor, _kth(sure, k))) & (low <= last)
                        return out

                    at, score = scan(block, anchors.x[i], np.flatnonzero(block.label != anchors.label[i]), keep)
                    for first, last, b in mine:
                        inside = (score >= max(first, b.floor)) & (score <= last)
                        b.add(score[inside], block.id[at[inside]], block.row[at[inside]])
        yield _rows([(i, n, b) for (i, n), b in best.items()])

    found = blocks.mapInArrow(run, "anchor int, window int, score long, id long, row long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor", "window", "id", "score", "rank")


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` and ``label`` are expressions over the columns of ``vectors``. Rows with a null label, a null vector or a
    null or non-finite component take no part. Every other row is a row of its own, repeated ids and vectors included:
    an anchor meets all rows but itself, and a repeated anchor gives its rows again. A vector meets those of its own
    length; null ids come last among equal scores. Scores of more than 62 bits raise an error. Fewer rows come where there
    are fewer; positives whose score is negative have no window. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    blocks = vertical(vectors, is_anchor, id_col, vector_col, label)

    def chosen(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Columns(r)
                at = np.flatnonzero(b.anchor)
                x = np.ascontiguousarray(b.x[:, at].T.astype("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(b.row[at]), pa.array(b.id[at]), pa.array(b.label[at]), pa.array([v.tobytes() for v in x], pa.binary())], names=["row", "id", "label", "x"])

    anchors = materialise(blocks.mapInArrow(chosen, "row long, id long, label long, x binary"), "anchors")
    turns = math.ceil(anchors.count() / ANCHORS)
    back = lambda c: F.when(F.col(c) != _NULL, F.col(c))

    def found():
        for turn in range(turns):
            # Dealt by hash: about ANCHORS of them.
            some = Anchors(anchors.where(F.pmod(F.xxhash64("row"), F.lit(turns)) == turn).toArrow())
            sent = spark.sparkContext.broadcast(some)
            near = _positives(blocks, sent, positives).collect()  # at most ``positives`` rows for each anchor of the turn
            windows = defaultdict(list)
            for p in near:
                low, high = -((-lowest * p.score) // 100), (highest * p.score) // 100
                if low <= high:
                    windows[p.anchor].append((p.n, low, high))
            named = spark.createDataFrame([(p.anchor, p.n, int(some.id[p.anchor]), p.id, p.score) for p in near], "anchor int, window int, a long, p long, positive_score long")
            met = _negatives(blocks, sent, dict(windows), negatives).join(named, ["anchor", "window"])
            yield met.select(back("a").alias("anchor_id"), back("p").alias("positive_id"), F.col("rank").cast("int").alias("rank"), back("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            sent.destroy()

    return in_turns(spark, found(), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", "mined")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


SQL = """
WITH r AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, b AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    (row_number() OVER (PARTITION BY a, p ORDER BY score DESC, vec_id, b))::INT AS rank
  FROM p JOIN s USING (a, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
