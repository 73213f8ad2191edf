"""Approximate nearest neighbours by cosine: a forest of random-projection trees and exact reranking.

*Forest.* The top of every tree is fitted on a bounded sample (``SAMPLE`` vectors): a node splits by the
plane between two random vectors of its sample, at the median. Its size is bounded by the sample, so it
may be broadcast. Below, where a fitted leaf holds more than ``LEAF`` indexed vectors, planes are drawn
from the leaf's number, one for each further level, so depth follows the data and nothing else is sent.

*Index.* Every vector is stored in one leaf of every tree. Vectors are scaled by a power of two first, so that their
largest component lies between 1/2 and 1: this changes no bit of a cosine, and multiples of a vector by powers of two
become equal. Equal vectors are one entry with their smallest ids, combined before the shuffle; no query needs more
than k + 1 of them.

*Search.* A query descends all trees through one priority queue: whichever branch, of any tree, lies
nearest across a plane is followed next, until the visited leaves hold ``VISIT`` of the forest's entries.
A branch is followed when no unfollowed one is nearer, so these are the leaves of the smallest bounds, found for many queries at once.
Neighbouring leaves of a tree are one chunk of about ``CHUNK`` bytes of vectors. A query goes to a chunk once, with a bit for each of
its leaves, instead of once to each leaf; each leaf and the queries that visit it are one matrix product.
Whatever comes within ``NEAR`` of a query's (k + 1)-th product is scored by sums in one order,
so that a pair has the same score wherever it was met, and the k + 1 entries of the highest scores, equal ones by their
smallest ids, are kept for each query and chunk, and then of all chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

TREES, SAMPLE, FIT_LEAF, LEAF, VISIT, SEED = 8, 16_384, 32, 128, 0.2, 5
#: Bytes of vectors of a chunk and of the queries that meet it at once; cells of a table of queries by leaves.
CHUNK, CELLS = 16 << 20, 4_000_000
#: More than what a product of unit vectors and their score may differ by.
NEAR = 1e-9


class Forest:
    """Trees fitted on a sample of unit vectors; leaf numbers count through all trees."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int):
        rng = np.random.RandomState(SEED)
        self.roots, self.planes, self.cuts, self.children, self.n_leaves = [], [], [], [], 0
        self.starts: list[int] = []  # the first leaf of each tree

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(3):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    size = np.linalg.norm(a - b)
                    if size < 1e-9:
                        continue
                    side = sample[rows] @ ((a - b) / size)
                    cut = np.median(side)
                    if (side > cut).any():
                        k = len(self.planes)
                        self.planes.append((a - b) / size)
                        self.cuts.append(cut)
                        self.children.append(None)
                        self.children[k] = (grow(rows[side <= cut]), grow(rows[side > cut]))
                        return k
            self.n_leaves += 1
            return -self.n_leaves

        for _ in range(trees):
            self.starts.append(self.n_leaves)
            self.roots.append(grow(np.arange(len(sample))))
        self.planes = np.array(self.planes).reshape(len(self.planes), sample.shape[1])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                k, rows = todo.pop()
                if k < 0:
                    out[rows, t] = -k - 1
                else:
                    right = x[rows] @ self.planes[k] > self.cuts[k]
                    todo += [(self.children[k][0], rows[~right]), (self.children[k][1], rows[right])]
        return out

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """How far across planes each leaf lies from each unit vector: the largest distance on its path; -1 for the vector's own leaves."""
        z = x @ self.planes.T - np.array(self.cuts) if len(self.planes) else np.zeros((len(x), 0))
        nodes, out = np.empty((len(self.planes), len(x))), np.empty((self.n_leaves, len(x)))
        at = lambda k: (nodes, k) if k >= 0 else (out, -k - 1)
        for root in self.roots:
            into, k = at(root)
            into[k] = -1.0
        for k, pair in enumerate(self.children):  # a node comes before its children
            right, across = z[:, k] > 0, np.maximum(nodes[k], np.abs(z[:, k]))
            for child, far in zip(pair, (np.where(right, across, nodes[k]), np.where(right, nodes[k], across)), strict=True):
                into, c = at(child)
                into[c] = far
        return out.T


def _deeper(leaf: int, dim: int, levels: int) -> np.ndarray:
    """The planes drawn below a fitted leaf, one for each level."""
    return np.random.RandomState((SEED * 1_000_003 + leaf) % 2**32).normal(size=(levels, dim))


def _levels(count: int, most: int) -> int:
    return max(0, int(np.ceil(np.log2(max(count, 1) / most))))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, their largest magnitudes between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if x.size else x


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, each by sums in one order."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", visit: float = VISIT) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest others of each row where ``is_query`` holds.

    ``is_query`` is a condition on the id column, named ``vec_id``. Vectors that are null, zero, empty or of
    another length than most, or that hold null or non-finite components, and rows without an id, take no
    part. Repeated rows of an id and vector count once. An id with several vectors asks with the smallest of
    them and is found by each. Fewer than k
    rows come where there are fewer candidates; an empty table gives an empty one. Equal scores go by id.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    rows = materialise(rows, "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = sizes.d

    def scaled(batches):
        for batch in batches:
            x = _scaled(_vectors(batch.column("x"))).reshape(batch.num_rows, dim)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], names=["vec_id", "x"])

    rows = rows.where(F.size("x") == dim).mapInArrow(scaled, "vec_id long, x array<double>")
    rows = materialise(rows.withColumn("key", F.xxhash64("x")), "scaled")

    # Entries: distinct vectors with their k + 1 smallest ids, at first within each batch.
    def few(batches):
        for batch in batches:
            f = pd.DataFrame({"key": batch.column("key").to_numpy(), "vec_id": batch.column("vec_id").to_numpy()})
            f = f.drop_duplicates().sort_values(["key", "vec_id"])
            f = f[f.groupby("key").cumcount() <= k]
            taken = batch.take(pa.array(f.index))
            kept = pc.if_else(pa.array(~f.key.duplicated().to_numpy()), taken.column("x"), pa.scalar(None, taken.column("x").type))
            yield pa.RecordBatch.from_arrays([taken.column("key"), taken.column("vec_id"), kept], names=["key", "vec_id", "x"])

    nth = Window.partitionBy("key").orderBy("vec_id")
    some = rows.select("key", "vec_id", "x").mapInArrow(few, "key long, vec_id long, x array<double>")
    some = some.groupBy("key", "vec_id").agg(F.max("x").alias("x")).withColumn("n", F.row_number().over(nth)).where(F.col("n") <= k + 1)
    entries = materialise(some.groupBy("key").agg(F.max("x").alias("x"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")

    sample = entries.orderBy(F.xxhash64("key", F.lit(SEED)), "key").limit(SAMPLE).select("x").toArrow()
    forest = Forest(_unit(_vectors(sample.column("x"))), TREES, FIT_LEAF)
    sent = vectors.sparkSession.sparkContext.broadcast(forest)  # at most 2 * TREES * SAMPLE / FIT_LEAF planes

    def place(batches):
        for batch in batches:
            u = _unit(_vectors(batch.column("x")))
            f = sent.value.leaves(u)
            n, t = f.shape
            take = pa.array(np.repeat(np.arange(n), t))
            yield pa.RecordBatch.from_arrays([pa.array(f.ravel()), batch.column("key").take(take)], names=["fit", "key"])

    placed = entries.select("key", "x").mapInArrow(place, "fit long, key long")
    counts = placed.groupBy("fit").count().toPandas()  # one row for each fitted leaf
    levels = {int(a): _levels(int(b), LEAF) for a, b in zip(counts.fit, counts["count"], strict=True)}
    total = float(counts["count"].sum())
    share = {int(a): int(b) / 2 ** levels[int(a)] for a, b in zip(counts.fit, counts["count"], strict=True)}

    def bits(leaf: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = u @ _deeper(leaf, dim, levels.get(leaf, 0)).T
        return (side > 0) @ (1 << np.arange(side.shape[1], dtype=np.int64)), side

    def index(batches):
        for batch in batches:
            u = _unit(_vectors(batch.column("x")))
            f = sent.value.leaves(u)
            part = np.zeros_like(f)
            for leaf in np.unique(f):
                r, c = np.nonzero(f == leaf)
                part[r, c] = bits(int(leaf), u[r])[0]
            take = pa.array(np.repeat(np.arange(len(u)), f.shape[1]))
            leaf = (first[f] + part).ravel()
            cols = [pa.array(chunk[leaf]), pa.array(leaf - edges[chunk[leaf]]), *[batch.column(c).take(take) for c in ("key", "low", "x")]]
            yield pa.RecordBatch.from_arrays(cols, names=["chunk", "leaf", "key", "low", "x"])

    # Leaves below the fitted ones are numbered through all of these; chunks are runs of them within a tree.
    below = np.array([1 << levels.get(leaf, 0) for leaf in range(forest.n_leaves)])
    first = np.cumsum(below) - below
    held = np.repeat([share.get(leaf, 0.0) for leaf in range(forest.n_leaves)], below)
    per = max(1, CHUNK // (8 * dim))
    chunk = np.zeros(len(held), np.int64)
    for start, end in zip(first[forest.starts], [*first[forest.starts[1:]], len(held)], strict=True):
        chunk[start:end] = (np.cumsum(held[start:end]) - held[start:end]) // per + (chunk[start - 1] + 1 if start else 0)
    edges = np.searchsorted(chunk, np.arange(chunk[-1] + 2))

    def visited(u: np.ndarray) -> np.ndarray:
        """Whether each query visits each leaf."""
        far = sent.value.bounds(u)
        out = np.empty((len(u), len(held)))
        out[:, first] = far
        for leaf in np.nonzero(below > 1)[0]:
            planes = _deeper(int(leaf), dim, levels[int(leaf)])
            own = u @ planes.T
            size, parts, most = np.abs(own) / np.linalg.norm(planes, axis=1), np.arange(below[leaf]), np.repeat(far[:, leaf, None], below[leaf], axis=1)
            for b in range(own.shape[1]):
                other = (own[:, b, None] > 0) != (parts >> b & 1).astype(bool)
                most = np.maximum(most, np.where(other, size[:, b, None], -1.0))
            out[:, first[leaf] : first[leaf] + below[leaf]] = most
        order = np.argsort(out, axis=1, kind="stable")
        size = held[order]
        taken = np.zeros(out.shape, bool)
        np.put_along_axis(taken, order, np.cumsum(size, axis=1) - size < visit * total, axis=1)
        return taken & (held > 0)

    def visits(batches):
        step = max(1, CELLS // len(held))
        for batch in batches:
            x = _vectors(batch.column("x"))
            for i in range(0, len(x), step):
                taken, rows, ids = visited(_unit(x[i : i + step])), batch.column("x").slice(i, step), batch.column("vec_id").slice(i, step)
                found, bits = [], []
                for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    who = np.nonzero(taken[:, a:b].any(axis=1))[0]
                    found.append((np.full(len(who), c), who))
                    bits += [m.tobytes() for m in np.packbits(taken[who, a:b], axis=1)]
                to, who = (np.concatenate(f) for f in zip(*found, strict=True))
                cols = [pa.array(to), ids.take(pa.array(who)), rows.take(pa.array(who)), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "query_id", "qx", "seen"])

    leaves = entries.select("key", F.get("ids", 0).alias("low"), "x").mapInArrow(index, "chunk long, leaf long, key long, low long, x array<double>")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    spread = max(1, vectors.sparkSession.sparkContext.defaultParallelism * 4)
    asked = queries.repartition(spread, "vec_id").mapInArrow(visits, "chunk long, query_id long, qx array<double>, seen binary")
    leaves, asked = materialise(leaves, "leaves"), materialise(asked, "visits")
    # Blocks of bounded size: a chunk of n entries is dealt into n / per salts, and so are its queries.
    stored = leaves.groupBy("chunk").agg(F.ceil(F.count("*") / per).alias("salts"))
    wanted = asked.groupBy("chunk").agg(F.ceil(F.count("*") / per).alias("turns"))
    grid = stored.join(wanted, "chunk")
    left = leaves.join(grid, "chunk").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts"))).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    right = asked.join(grid, "chunk").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns"))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))

    def compare(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(q):
            return pd.DataFrame({"query_id": [], "key": [], "low": [], "score": []})
        a = a.sort_values("leaf")
        x, y = np.stack(a.x.to_numpy()), np.stack(q.qx.to_numpy())
        ux, uy = _unit(x), _unit(y)
        seen = np.frombuffer(b"".join(q.seen), np.uint8).reshape(len(q), -1)
        numbers, starts = np.unique(a.leaf.to_numpy(), return_index=True)
        top, found = np.full((len(q), k + 1), -np.inf), []  # the best products so far; a key is in one leaf of a chunk
        for leaf, start, end in zip(numbers, starts, [*starts[1:], len(a)], strict=True):
            who = np.nonzero(seen[:, leaf >> 3] >> (7 - (leaf & 7)) & 1)[0]
            for w in np.array_split(who, 1 + len(who) * (end - start) // CELLS):
                near = uy[w] @ ux[start:end].T
                better = (near > top[w, :1]).any(axis=1)
                few = min(k + 1, end - start)
                best = np.partition(near[better], end - start - few, axis=1)[:, end - start - few :]
                top[w[better]] = np.sort(np.concatenate([top[w[better]], best], axis=1), axis=1)[:, few:]
                i, j = np.nonzero(near >= top[w, :1] - NEAR)
                found.append((w[i], start + j, near[i, j]))
        i, j, near = (np.concatenate(c) for c in zip(*found, strict=True))
        kept = near >= top[i, 0] - NEAR
        i, j = i[kept], j[kept]
        out = pd.DataFrame({"query_id": q.query_id.to_numpy()[i], "key": a.key.to_numpy()[j], "low": a.low.to_numpy()[j], "score": _cosines(x[j], y[i])})
        out = out.sort_values(["query_id", "score", "low"], ascending=[True, False, True])
        return out[out.groupby("query_id").cumcount() <= k]

    by = ["chunk", "salt", "turn"]
    met = left.select(*by, "leaf", "key", "low", "x").groupBy(*by).cogroup(right.select(*by, "query_id", "qx", "seen").groupBy(*by)).applyInPandas(compare, "query_id long, key long, low long, score double")
    met = met.groupBy("query_id", "key", "low").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "low")
    met = materialise(met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r", "low"), "met")
    scored = met.join(entries.select("key", "ids"), "key").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
