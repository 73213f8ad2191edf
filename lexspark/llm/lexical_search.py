"""Ranked lexical search with hashed max-sketches.

*Index.* Each document becomes one row: a sketch, and its distinct terms with their counts. The sketch hashes terms to
``WIDTH`` coordinates and keeps the largest impact of each coordinate; only coordinates that are not empty are stored.
Within one document an impact is a growing function of the term's count (see ``impact``), so a coordinate stores the
count that gives the largest impact, as one byte (255: as large as an impact gets). The term's weight comes from
the query, so the sketch doesn't depend on what other documents hold. A vocabulary table counts the documents of a term.

*Bounds.* Queries are taken in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_TERMS`` terms. A block looks up
all its coordinates in all sketches of a batch at once: the sum of weight x impact over an item's coordinates is an
upper bound of the item's score, as a coordinate's maximum is no less than the impact of any term hashed to it.

*Rescoring.* Every task keeps the k largest bounds of each item; the k largest of all tasks are scored exactly, and the
k-th best of these scores is the item's threshold. A second scan rescores, by the exact terms and in descending
order of their bounds, the documents whose bounds reach the threshold; a task raises its own threshold as it
finds better documents, and stops at the first bound below it. Documents under the threshold can't be among the k
best, so the result is that of scoring all documents. No text and no posting is shuffled.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_turns, scratch_path

K, WIDTH = 50, 1 << 20
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 100_000
#: Cells of documents x items that are bounded at once.
CELLS = 1_000_000
#: Terms counted in a task before they are handed on.
HELD_TERMS = 300_000
_MOST = 1_000_000  # what impacts stay below
_NULL = -(2**63)

#: ASCII letters and digits and all bytes of other characters belong to terms; A to Z become a to z.
_PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

INDEX = "row long, doc_id long, n long, at binary, most binary, terms binary, counts binary"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_PLAIN).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied with, for its count and the document's length measure."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _sketch(found: list[bytes], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates that aren't empty, ascending, and the largest count of each, 255 for all above 254."""
    at = np.fromiter(map(zlib.crc32, found), np.uint32, len(found)).astype(np.int64) % width
    order = np.argsort(at, kind="stable")
    at, most = at[order], np.minimum(counts[order], 255)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return at[first].astype(np.uint32), np.maximum.reduceat(most, first).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Writes the sketches with the exact terms, and the vocabulary, below ``path``; returns both tables."""
    spark = docs.sparkSession

    def build(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                out: list[list] = [[], [], [], [], []]
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    c = Counter(terms(text or b""))
                    found, counts = list(c), np.fromiter(c.values(), np.int64, len(c))
                    at, most = _sketch(found, counts, width)
                    for column, value in zip(out, (int(counts.sum()), at.tobytes(), most.tobytes(), b" ".join(found), counts.astype("<u4").tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=["row", "doc_id", "n", "at", "most", "terms", "counts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(build, INDEX).write.option("compression", "zstd").parquet(f"{path}/sketches")
    index = spark.read.schema(INDEX).parquet(f"{path}/sketches")

    def count(batches):
        held: Counter = Counter()

        def handed():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])
            held.clear()
            return batch

        for batch in batches:
            for found in batch.column("terms").to_pylist():
                held.update(found.split())
                if len(held) > HELD_TERMS:
                    yield handed()
        yield handed()

    counted = index.select("terms").mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    counted.write.option("compression", "zstd").parquet(f"{path}/vocabulary")
    return index, spark.read.schema("term binary, df long").parquet(f"{path}/vocabulary")


class Block:
    """Some items with their weighted terms, in arrays: by query term, and by coordinate, the items and weights."""

    def __init__(self, rows: list[tuple], n_docs: int, length: int, width: int):
        self.ids = list(dict.fromkeys(r[0] for r in rows))
        place = {x: i for i, x in enumerate(self.ids)}
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(r[1] for r in rows))}
        self.n_docs, self.length = n_docs, length
        item = np.array([place[r[0]] for r in rows], np.int64)
        term = np.array([self.terms[r[1]] for r in rows], np.int64)
        w = np.array([weight(r[2], n_docs) for r in rows], np.int64)
        at = np.array([zlib.crc32(r[1]) % width for r in rows], np.int64)
        self.by_term = self._lists(term, item, w, len(self.terms))
        some, coordinate = np.unique(at, return_inverse=True)
        self.by_at = self._lists(coordinate, item, w, len(some))
        self.coordinate = np.full(width, -1, np.int32)
        self.coordinate[some] = np.arange(len(some))

    @staticmethod
    def _lists(key: np.ndarray, item: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        size = np.bincount(key, minlength=n)
        return np.cumsum(size) - size, size, item[order], w[order]

    def measure(self, n: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * n * self.n_docs) // max(self.length, 1)

    def _sums(self, lists, doc: np.ndarray, key: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """A matrix of documents by items: the sums of weight x value over each document's keys."""
        start, size, item, w = lists
        total = np.zeros(n_docs * len(self.ids), np.int64)
        many = size[key]
        from_ = np.repeat(start[key] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        np.add.at(total, np.repeat(doc * len(self.ids), many) + item[from_], np.repeat(value, many) * w[from_])
        return total.reshape(n_docs, len(self.ids))

    def bounds(self, n: np.ndarray, at: list[bytes], most: list[bytes]) -> np.ndarray:
        """Upper bounds of all items' scores, for each document of the batch."""
        size = np.array([len(x) for x in most], np.int64)
        doc = np.repeat(np.arange(len(n)), size)
        c = self.coordinate[np.frombuffer(b"".join(at), np.uint32)]
        hit = np.flatnonzero(c >= 0)
        doc, c, tf = doc[hit], c[hit], np.frombuffer(b"".join(most), np.uint8)[hit].astype(np.int64)
        value = np.where(tf < 255, impact(tf, self.measure(n)[doc]), _MOST)
        return self._sums(self.by_at, doc, c, value, len(n))

    def scores(self, n: np.ndarray, terms: list[bytes], counts: list[bytes]) -> np.ndarray:
        """Exact scores of all items, for each document of the batch."""
        doc, key, tf = [], [], []
        for i, (found, c) in enumerate(zip(terms, counts, strict=True)):
            k = [self.terms.get(t, -1) for t in found.split()]
            k = np.array(k, np.int64)
            hit = np.flatnonzero(k >= 0)
            doc.append(np.full(len(hit), i))
            key.append(k[hit])
            tf.append(np.frombuffer(c, "<u4")[hit].astype(np.int64))
        if not doc:
            return np.zeros((0, len(self.ids)), np.int64)
        doc, key, tf = np.concatenate(doc), np.concatenate(key), np.concatenate(tf)
        return self._sums(self.by_term, doc, key, impact(tf, self.measure(n)[doc]), len(n))

    def parts(self, batch: pa.RecordBatch):
        """Slices of a batch with as many documents as may be bounded at once."""
        step = max(1, min(1000, CELLS // max(len(self.ids), 1)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def _largest_bounds(index: DataFrame, sent, k: int) -> DataFrame:
    """``item`` (its place in the block), ``row``: the documents with the k largest bounds of each item."""

    def run(batches):
        block = sent.value
        n_items = len(block.ids)
        best, rows = np.zeros((n_items, 0), np.int64), np.zeros((n_items, 0), np.int64)
        for batch in batches:
            for part in block.parts(batch):
                b = block.bounds(part.column("n").to_numpy(), part.column("at").to_pylist(), part.column("most").to_pylist()).T
                best = np.concatenate([best, b], axis=1)
                rows = np.concatenate([rows, np.broadcast_to(part.column("row").to_numpy(), b.shape)], axis=1)
                if best.shape[1] > k:
                    top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    best, rows = np.take_along_axis(best, top, 1), np.take_along_axis(rows, top, 1)
        i, j = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(rows[i, j]), pa.array(best[i, j])], names=["item", "row", "bound"])

    found = index.select("row", "n", "at", "most").mapInArrow(run, "item int, row long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "row")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("item", "row")


def _thresholds(index: DataFrame, few: DataFrame, sent, k: int) -> dict[int, int]:
    """The k-th best exact score of the few documents of each item, where there are as many: one number for each item."""

    def run(batches):
        block = sent.value
        for batch in batches:
            for part in block.parts(batch):
                s = block.scores(part.column("n").to_numpy(), part.column("terms").to_pylist(), part.column("counts").to_pylist())
                items = part.column("items").to_pylist()
                item = np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in items]])
                doc = np.repeat(np.arange(len(items)), [len(x) for x in items])
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(s[doc, item])], names=["item", "score"])

    # At most k rows for each item of the block.
    wanted = F.broadcast(few.groupBy("row").agg(F.collect_list("item").alias("items")))
    scored = index.select("row", "n", "terms", "counts").join(wanted, "row").mapInArrow(run, "item int, score long")
    kth = scored.groupBy("item").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    return {r.item: r.score for r in kth.where(F.size("s") >= k).select("item", F.element_at("s", k).alias("score")).collect()}


def _rescored(index: DataFrame, sent, thresholds: dict[int, int], k: int) -> DataFrame:
    """``item_id``, ``doc_id``, ``score``: each task's k best documents of each item that reach its threshold."""

    def run(batches):
        block = sent.value
        floor = np.ones(len(block.ids), np.int64)
        for item, score in thresholds.items():
            floor[item] = max(score, 1)
        heaps: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        for batch in batches:
            for part in block.parts(batch):
                n, ids = part.column("n").to_numpy(), part.column("doc_id").to_pylist()
                bounds = block.bounds(n, part.column("at").to_pylist(), part.column("most").to_pylist())
                doc, item = np.nonzero(bounds >= floor)
                bound = bounds[doc, item]
                order = np.argsort(-bound, kind="stable")
                doc, item, bound = doc[order], item[order], bound[order]
                terms, counts = part.column("terms"), part.column("counts")
                exact: dict[int, np.ndarray] = {}
                while len(doc):
                    step = min(len(doc), 512)
                    fresh = [d for d in dict.fromkeys(doc[:step].tolist()) if d not in exact]
                    take = pa.array(fresh, pa.int64())
                    found = block.scores(n[fresh], terms.take(take).to_pylist(), counts.take(take).to_pylist())
                    exact.update(zip(fresh, found, strict=True))
                    for d, i in zip(doc[:step].tolist(), item[:step].tolist(), strict=True):
                        score = int(exact[d][i])
                        if score < floor[i]:
                            continue
                        entry = (score, _NULL if ids[d] is None else -ids[d])
                        if len(heaps[i]) < k:
                            heapq.heappush(heaps[i], entry)
                        else:
                            heapq.heappushpop(heaps[i], entry)
                        if len(heaps[i]) == k:
                            floor[i] = max(floor[i], heaps[i][0][0])
                    # Bounds descend, so what is left of an item goes at once when its threshold has passed them.
                    left = bound[step:] >= floor[item[step:]]
                    doc, item, bound = doc[step:][left], item[step:][left], bound[step:][left]
        out = [(block.ids[i], None if d == _NULL else -d, s) for i, h in enumerate(heaps) for s, d in h]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of each item with a score above 0.

    ``items`` has ``item_id`` and ``text``, ``docs`` has ``doc_id`` and ``text``; other columns are not read. Terms of
    all rows with one item_id are one query, each term once; an item without terms has no rows. Every row of ``docs``
    is a document, repeated ids and texts included; null and empty texts have no terms and don't count. Equal
    scores go by doc_id, null ids last. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "lexical")
    index, vocabulary = write_index(docs, path, width=width)
    n_docs, length = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def asked(batches):
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = list(dict.fromkeys(terms(text or b"")))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(asked, "item_id long, term binary").distinct().write.parquet(f"{path}/asked")
    pairs = spark.read.schema("item_id long, term binary").parquet(f"{path}/asked")
    n_items, n_terms = pairs.agg(F.count_distinct(F.coalesce("item_id", F.lit(_NULL))), F.count("*")).first()
    blocks = max(math.ceil(n_items / BLOCK_ITEMS), math.ceil(n_terms / BLOCK_TERMS))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def found():
        for b in range(blocks if n_docs else 0):
            # One block's terms: bounded, as items are dealt to blocks by hash. All rows of an item are in its block.
            mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
            known = [tuple(r) for r in vocabulary.join(F.broadcast(mine), "term").select("item_id", "term", "df").collect()]
            if not known:
                continue
            sent = spark.sparkContext.broadcast(Block([(i, bytes(t), df) for i, t, df in known], n_docs, length, width))
            thresholds = _thresholds(index, _largest_bounds(index, sent, k), sent, k)
            ranked = _rescored(index, sent, thresholds, k).withColumn("rank", F.row_number().over(best).cast("int"))
            yield ranked.where(F.col("rank") <= k)
            sent.destroy()

    return in_turns(spark, found(), "item_id long, rank int, doc_id long, score long", "ranked")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(t="text")} AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS length FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
v AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format(t="text")}) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN v USING (term), s),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(ts)::BIGINT * n_docs) // length) AS m FROM d, s WHERE len(ts) > 0),
f AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM w JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM f WHERE score > 0
QUALIFY rank <= 50
"""
