"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is a weighted set: its distinct runs of five words, weighted by how often they occur. The
similarity of two documents is the probability Jaccard index of these weights,
``J(a, b) = sum over i of 1 / sum over j of max(a_j / a_i, b_j / b_i)``.

1. *Sketch.* Every shingle sends arrivals of a Poisson process, whose rate is its weight, to random
   registers; a register keeps the shingle that arrives first. A shingle stops as soon as its next
   arrival comes after the latest of all registers (early termination), so a long document costs about
   one draw for each shingle instead of one for each shingle and register. Two documents agree in a
   register with probability J.
2. *Banding.* Documents that agree in all registers of a band are candidates. Bands are met through one
   centre for each bucket, never as all pairs: the member that meets most others in all its buckets, its
   *hub*. Texts of buckets that hold several classes after that meet the text of their hub's group that is
   nearest to the group's common shingles. What is in different classes even then is joined exactly, on
   early shingles, with a bound for texts of one group: `_early`, `_between`.
3. *Verification.* J is computed from both texts; links have J >= ``threshold``.
4. *Classes* are the connected components of the links.

Equal texts share a node from the start, so a group of copies costs one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .graph import components
from .shared import materialise

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 5
#: Shingles of centres that a task keeps; beyond these it starts afresh. This bounds memory, not results.
HELD = 1_000_000


def prob_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The item that arrives first in each register, for n documents; 0 for documents without items."""
    best = np.full(n * registers, np.inf)
    won = np.zeros(n * registers, X.U64)
    clock = np.zeros(len(item))
    active = np.arange(len(item))
    k = 0
    while len(active):
        seed = item[active] + X.U64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)
        draw = (X.mix(seed) >> X.U64(11)).astype(np.float64) + 0.5
        clock[active] -= np.log(draw * 2.0**-53) / weight[active]
        slot = doc[active] * registers + (X.mix(seed ^ X.U64(0x5851F42D4C957F2D)) % X.U64(registers)).astype(np.int64)
        now = clock[active]
        np.minimum.at(best, slot, now)
        first = best[slot] == now
        won[slot[first]] = item[active[first]]
        alive = np.flatnonzero(np.bincount(doc[active], minlength=n))
        latest = np.full(n, -np.inf)
        latest[alive] = best.reshape(n, registers)[alive].max(axis=1)
        active = active[now < latest[doc[active]]]
        k += 1
    return won.reshape(n, registers)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard index of two weighted sets given as sorted distinct items and weights."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    if not both.any():
        return 0.0
    x, y = wa[both].astype(float), wb[at[both]].astype(float)
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, "right")
    sum_x, sum_y = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    only_a, only_b = wa.sum() - sum_x[-1], wb.sum() - sum_y[-1]
    # Items with a ratio up to i's count by their weight in a, the others by that in b.
    total = (only_a + sum_x[upto]) / x + (only_b + sum_y[-1] - sum_y[upto]) / y
    return float((1 / total).sum())


def _sketch(batches):
    for batch in batches:
        key = batch.column("key")
        for t in X.slices(batch.column("text")):
            doc, item, weight, n_words = X.shingles(t, WIDTH)
            won = prob_minhash(doc, item, weight, t.n, BANDS * ROWS).reshape(t.n, BANDS, ROWS)
            has = n_words > 0
            band = np.zeros((t.n, BANDS), X.U64)
            for r in range(ROWS):
                band = band * X._STEP + won[:, :, r]
            band = X.mix(band + np.arange(1, BANDS + 1, dtype=X.U64) * X.U64(0xA0761D6478BD642F))
            edges = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(t.first, t.n),
                    key.slice(t.first, t.n),
                    pa.array(n_words, pa.int64()),
                    pa.ListArray.from_arrays(edges, pa.array(band[has].ravel().view(np.int64))),
                ],
                names=["id", "key", "n_words", "bands"],
            )


def _verify(batches):
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # the last centres' sorted items and weights
    n_held = 0
    for batch in batches:
        keys, centres = batch.column("key").to_pylist(), batch.column("centre").to_pylist()
        tb = batch.column("centre_text")
        for t in X.slices(batch.column("text")):
            doc, item, weight, _ = X.shingles(t, WIDTH)
            order = np.lexsort((item, doc))
            doc, item, weight = doc[order], item[order], weight[order]
            edge = np.searchsorted(doc, np.arange(t.n + 1))
            scores = np.zeros(t.n)
            for i in range(t.n):
                c = centres[t.first + i]
                if c not in held:
                    if n_held > HELD:
                        held, n_held = {}, 0
                    one = next(X.slices(tb.slice(t.first + i, 1)))
                    _, ci, cw, _ = X.shingles(one, WIDTH)
                    o = np.argsort(ci)
                    held[c] = ci[o], cw[o]
                    n_held += len(ci)
                s = slice(edge[i], edge[i + 1])
                scores[i] = similarity(item[s], weight[s], *held[c])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[t.first : t.first + t.n], pa.int64()),
                    pa.array(centres[t.first : t.first + t.n], pa.int64()),
                    pa.array(scores),
                ],
                names=["a", "b", "similarity"],
            )


def _shares(batches):
    for batch in batches:
        kept = [batch.column(c) for c in ("key", "label", "hub")]
        for t in X.slices(batch.column("text")):
            doc, item, weight, _ = X.shingles(t, WIDTH)
            total = np.bincount(doc, weight, minlength=t.n)[doc]
            at = pa.array(doc + t.first)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in kept), pa.array(item.view(np.int64)), pa.array(weight / total), pa.array(total)],
                names=["key", "label", "hub", "item", "share", "total"],
            )


def _hubs(links: DataFrame) -> DataFrame:
    """``node``, ``label`` for the first ends of ``links``: nodes of one label are connected, not always the other way round.

    Each node takes the second end that has most links, and then the label of that one.
    """
    sizes = links.groupBy("b").agg(F.count("*").alias("n")).withColumnRenamed("b", "_b")
    own = links.join(sizes, F.col("b") == F.col("_b")).groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    up = own.select(F.col("a").alias("_a"), F.col("b").alias("_up"))
    return own.join(up, F.col("b") == F.col("_a"), "left").select(F.col("a").alias("node"), F.coalesce("_up", "b").alias("label"))


def _early(members: DataFrame, hubs: DataFrame, texts: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """The early shingles of the texts of mixed buckets, with what `_nearest` and `_between` need.

    Let s and u be the shares of the two texts' weights that lie on common shingles. J is at most
    1 / (1 / s + 1 / u - 1), so 1 / s + 1 / u <= 1 + 1 / threshold: both are ``threshold`` at least, and
    one is 2 threshold / (1 + threshold). Shingles are ordered alike in all texts, those of one class
    first, then the rare ones. From their first common shingle on, both texts have at least s and u of
    their weight left, which is ``rest``; so every pair of ``threshold`` or more between two classes has
    an early shingle in common. Among texts with one hub, the shingles that most of them have (``inside``)
    come last: ``rest_hub``. ``out`` is a text's weight outside these, ``n_in`` the number of those it has.
    """
    label = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    named = members.select("bucket", "key").join(label, F.col("key") == F.col("_n"), "left").select("bucket", "key", F.coalesce("_l", "key").alias("label"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    named = named.join(mixed.select(F.col("bucket").alias("_b")), F.col("bucket") == F.col("_b"))
    named = materialise(named.select("key", "label").distinct().join(hubs, "key"), "open")
    items = named.join(texts, "key").select("key", "label", "hub", "text").mapInArrow(_shares, "key long, label long, hub long, item long, share double, total double")
    items = materialise(items, "items")
    # Shingles of one class lead to no other; they only use up weight.
    marks = items.groupBy("item", "hub").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    common = marks.groupBy(F.col("item").alias("_i")).agg(F.sum("n").alias("rank"), F.min("low").alias("low"), F.max("high").alias("high"))
    # Written first, so that the join below is dealt by itself and a shingle of very many groups can be split.
    common = materialise(common.where("low <> high").select("_i", "rank"), "common")
    sizes = named.groupBy(F.col("hub").alias("_h")).agg(F.count("*").alias("size"))
    marks = marks.select("item", "hub", "n").join(common, F.col("item") == F.col("_i"), "left").join(sizes, F.col("hub") == F.col("_h"))
    marks = marks.select(F.col("item").alias("_i"), F.col("hub").alias("_h"), F.coalesce("rank", F.lit(0)).alias("rank"), F.col("rank").isNotNull().alias("open"), (2 * F.col("n") > F.col("size")).alias("inside"))
    rows = items.join(materialise(marks, "marks"), (F.col("item") == F.col("_i")) & (F.col("hub") == F.col("_h")))
    order = [F.desc("rank"), F.desc("item")]
    upto = lambda *by: F.sum(F.when(F.col("open"), F.col("share")).otherwise(0.0)).over(Window.partitionBy("key").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("key")
    rows = rows.withColumn("rest", upto(*order)).withColumn("rest_hub", upto(F.desc("inside"), *order))
    rows = rows.withColumn("out", F.sum(F.when(~F.col("inside"), F.col("share")).otherwise(0.0)).over(whole))
    rows = rows.withColumn("n_in", F.sum(F.col("inside").cast("int")).over(whole)).withColumn("one", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("inside"), *order)) == 1)
    early = F.col("open") & (F.greatest("rest", "rest_hub") >= threshold - 1e-9)
    rows = rows.withColumn("early", early).where("early or one")
    return materialise(rows.select("key", "label", "hub", "item", "total", "inside", "rest", "rest_hub", "out", "n_in", "one", "early"), "early")


def _nearest(early: DataFrame) -> DataFrame:
    """``key``, ``centre`` and their labels: each text and the one of its hub's group that is nearest to the inside shingles."""
    texts = early.where("one").select("key", "label", "hub", (F.col("n_in") - F.col("out") * F.col("total")).alias("fit"))
    best = texts.groupBy(F.col("hub").alias("_h")).agg(F.max(F.struct("fit", "key", "label")).alias("c"))
    met = texts.join(best, F.col("hub") == F.col("_h")).where(F.col("label") != F.col("c.label"))
    return met.select("key", "label", F.col("c.key").alias("centre"), F.col("c.label").alias("_label"))


def _between(early: DataFrame, threshold: float) -> DataFrame:
    """``key < centre``: all pairs of different classes that may reach the threshold.

    If the first common shingle of two texts with one hub lies inside, none outside is common. So each
    text's weight outside counts against the pair, and so do the inside shingles that only one of them
    lacks, each with a share of 1 / total at least. With s and u as above, (1 - s) + (1 - u) is
    2 (1 - threshold) / (1 + threshold) at most.
    """
    late = 2 * (1 - threshold) / (1 + threshold) + 1e-9
    early = early.where("early").drop("one", "early")
    # Texts of a shingle's largest class meet the others only, so a large class costs no more than its size.
    sizes = early.groupBy("item", "label").agg(F.count("*").alias("n")).groupBy(F.col("item").alias("_i"))
    tops = materialise(sizes.agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("k")).where("k > 1").select("_i", F.col("top.label").alias("top")), "tops")
    early = early.join(tops, F.col("item") == F.col("_i")).drop("_i")
    other = early.where(F.col("label") != F.col("top")).drop("top")
    other = other.select([F.col(c).alias(f"_{c}") for c in other.columns])
    reach = lambda c: 1 / F.col(c) + 1 / F.col(f"_{c}") <= 1 + 1 / threshold + 1e-9
    lost = F.col("out") + F.col("_out") + F.abs(F.col("n_in") - F.col("_n_in")) / F.greatest("total", "_total")
    near = F.when(F.col("hub") == F.col("_hub"), reach("rest_hub") & (~F.col("inside") | (lost <= late))).otherwise(reach("rest"))
    met = early.join(other, (F.col("item") == F.col("_item")) & (F.col("label") != F.col("_label")) & near)
    return met.select(F.least("key", "_key").alias("key"), F.greatest("key", "_key").alias("centre")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, with_row: bool = False) -> DataFrame:
    """``doc_id``, ``class_id``, ``class_size``, ``representative`` for every row of ``docs``.

    class_id is the smallest id of the class (null if all its ids are null); representative marks the
    rows that have it. Equal texts are one node, by a 64-bit hash. Null and wordless texts are no one's
    duplicates: each such row's class is its own id, of size 1. Repeated rows are rows of one class.
    Texts of fewer than five words have one shingle of all their words. An empty table gives an empty
    table. Other columns are not read. with_row adds ``row``, the 64-bit hash of the text.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    sketches = materialise(rows.mapInArrow(_sketch, "id long, key long, n_words long, bands array<long>"), "sketches")
    # Equal texts become one node; buckets are counted before anything meets in them.
    nodes = sketches.where("n_words > 0").groupBy("key").agg(F.any_value("bands").alias("bands"))
    in_bands = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("bucket", "_b")
    members = materialise(in_bands.join(shared, F.col("bucket") == F.col("_b")).select("bucket", "key", "n"), "members")
    wide = members.groupBy("key").agg(F.sum("n").alias("met")).withColumnRenamed("key", "_k")
    # Equal texts are reduced to one before the shuffle; only those in a shared bucket are kept.
    one = rows.groupBy("key").agg(F.max("text").alias("text"))
    texts = materialise(one.join(wide, F.col("key") == F.col("_k"), "left_semi"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        centre = texts.select(F.col("key").alias("centre"), F.col("text").alias("centre_text"))
        full = pairs.join(texts, "key").join(centre, "centre").select("key", "centre", "text", "centre_text")
        found = full.mapInArrow(_verify, "a long, b long, similarity double")
        return materialise(found.where(F.col("similarity") >= threshold).select("a", "b"), "verified")

    best = members.join(wide, F.col("key") == F.col("_k")).groupBy("bucket").agg(F.max(F.struct("met", "key")).alias("c"))
    met = members.join(best.select(F.col("bucket").alias("_b"), "c.*").withColumnRenamed("key", "centre"), F.col("bucket") == F.col("_b"))
    met = materialise(met.select("key", "centre", "met").distinct(), "met")
    hubs = met.groupBy("key").agg(F.max(F.struct("met", "centre")).alias("c")).select("key", F.col("c.centre").alias("hub"))
    links = verified(met.where("key <> centre").select("key", "centre"))
    early = _early(members, hubs, texts, materialise(_hubs(links), "hubs"), threshold)
    nearest = _nearest(early)
    more = verified(nearest.select("key", "centre"))
    # Classes that the nearest text links are one from here on.
    joined = nearest.join(more, (F.col("key") == F.col("a")) & (F.col("centre") == F.col("b")))
    joined = materialise(joined.groupBy(F.col("label").alias("_l")).agg(F.min("_label").alias("_to")), "joined")
    early = early.join(joined, F.col("label") == F.col("_l"), "left").withColumn("label", F.coalesce("_to", "label")).drop("_l", "_to")
    links = links.unionByName(more).unionByName(verified(_between(materialise(early, "early"), threshold)))
    labels = components(links)
    out = _classes(sketches, labels)
    return out if with_row else out.drop("row")


def _classes(sketches: DataFrame, labels: DataFrame) -> DataFrame:
    named = sketches.select("id", "key", "n_words").join(labels, F.col("key") == F.col("node"), "left")
    named = named.select("id", "key", "n_words", F.coalesce("label", "key").alias("label"))
    named = materialise(named, "labelled")
    by = named.where("n_words > 0").groupBy("label").agg(F.min("id").alias("low"), F.count("*").alias("size"))
    # Written first, so that the join below is dealt by itself and a class of very many rows can be split.
    by = materialise(by.withColumnRenamed("label", "_label"), "classes")
    out = named.join(by, (F.col("label") == F.col("_label")) & (F.col("n_words") > 0), "left")
    own = F.col("n_words") == 0
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(own, F.col("id")).otherwise(F.col("low")).alias("class_id"),
        F.when(own, F.lit(1)).otherwise(F.col("size")).cast("long").alias("class_size"),
        F.when(own, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("low"))).alias("representative"),
        F.col("key").alias("row"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return near_duplicates(read_table(spark, sf_dir, "documents"))
