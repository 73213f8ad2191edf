"""Toxicity: a support vector machine with a gapped subsequence kernel and Nystroem landmarks.

*Kernel.* A word, with a mark at each end, is the set of its ordered triples within ``SPAN`` places, each
weighted by ``DECAY`` to the length it covers; the kernel of two words is a power of the cosine of these
weights. Letters in between only make a triple longer, so gapped words and words with inserted letters
stay close to the word they hide. Signs inside a word are dropped, single letters in a row are one word, and long words are read
in overlapping windows.

*Landmarks.* The words that best tell toxic from other labelled documents, and the most frequent other
words, are the landmarks; their number is fixed. A sentence is represented by its largest kernel value
with each landmark, mapped by the inverse square root of the landmarks' kernel matrix (Nystroem).

*Training.* On the labelled documents with the smallest hashes of their ids, at most ``SAMPLE`` rows. All
their sentences are represented and written once. Every document gives one sentence, with the document's
label, to a linear machine with squared hinge loss: at first the one nearest to the toxic landmarks, then,
twice, the one that the machine finds worst. A document's score is that of its worst sentence, as a
probability fitted on the same sample. Scoring reads every word of every text: one table lookup for each triple bounds a word's
kernel values from above, and only words whose bound reaches ``CUT`` are compared with the landmarks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .quality_classifier import held_out
from .shared import materialise

SPAN, DECAY, CUT, POWER = 5, 0.7, 0.5, 2
SAMPLE, TOXIC_WORDS, OTHER_WORDS = 20_000, 160, 40
LONG, STEP = 24, 8
REMEMBERED = 1_000_000
COST = 10_000.0
SLICE = 600_000
PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]

_LETTER = np.array([chr(c).isalnum() for c in range(0x3000)])
_SPACE = np.zeros(0x3000, bool)
_SPACE[[0, 0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_END = np.zeros(0x3000, bool)
_END[[0, 0x0A, ord("."), ord("!"), ord("?")]] = True


def _code(letters: np.ndarray) -> np.ndarray:
    """Six bits for each letter; a to z have codes of their own. 0 and 63 are the marks of a word's ends."""
    latin = (letters >= 97) & (letters <= 122)
    return np.where(latin, letters - 96, 27 + letters % 36).astype(np.int32)


@dataclass
class Words:
    """Words of a slice as runs of lower-case letters, with the document and the sentence of each."""

    letters: np.ndarray
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    hash: np.ndarray

    def text(self, i: int) -> str:
        return self.letters[self.start[i] : self.start[i] + self.size[i]].astype("<u4").tobytes().decode("utf-32-le")


def read_words(t: X.Texts) -> Words:
    docs = [t.data[a:b].tobytes().replace(b"\0", b" ") for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)]
    text = b"\0".join(docs).decode("utf-8", "replace").lower()
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    low = np.minimum(cp, 0x2FFF)
    space = _SPACE[low]
    kept = np.flatnonzero(_LETTER[low] | (cp >= 0x3000) & (cp < 0xFE00))
    none = np.zeros(0, np.int64)
    if not len(kept):
        return Words(none, none, none, none, none, none.astype(X.U64))
    word = np.cumsum(space)[kept]
    doc = np.cumsum(cp == 0)[kept]
    # An end sign counts only before white space, so that dotted words stay in one sentence.
    after = np.append(space[1:], True)
    sentence = np.cumsum(_END[low] & (space | after))[kept]
    fresh = np.append(True, word[1:] != word[:-1])
    size = np.diff(np.append(np.flatnonzero(fresh), len(kept)))
    single = np.repeat(size == 1, size)
    joined = fresh & single & np.append(False, single[:-1]) & np.append(False, doc[1:] == doc[:-1])
    start = np.flatnonzero(fresh & ~joined)
    size = np.diff(np.append(start, len(kept)))
    if (size > LONG).any():
        many = np.where(size > LONG, (size - LONG + STEP - 1) // STEP + 1, 1)
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        end = np.repeat(start + size, many)
        start = np.repeat(start, many) + nth * STEP
        size = np.minimum(end - start, LONG)
    letters = cp[kept]
    at = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(at, size)
    value = X.mix(letters[np.repeat(start, size) + pos].astype(X.U64) + X.U64(1)) * X.factors(LONG + 1)[pos]
    h = X.mix(np.add.reduceat(value, at) + size.astype(X.U64))
    return Words(letters, start, size, doc[start], sentence[start], h)


def triples(letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, code and weight of every triple of the words."""
    size = size + 2
    at = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(at, size)
    word = np.repeat(np.arange(len(size)), size)
    flat = np.zeros(len(pos), np.int32)
    left = np.repeat(size, size) - pos
    inner = (pos > 0) & (left > 1)
    flat[inner] = _code(letters[(np.repeat(start - 1, size) + pos)[inner]])
    flat[left == 1] = 63
    out_w, out_c, out_v = [], [], []
    for a, b in PAIRS:
        i = np.flatnonzero(left > b)
        out_w.append(word[i])
        out_c.append((flat[i] << 12) | (flat[i + a] << 6) | flat[i + b])
        out_v.append(np.full(len(i), DECAY ** (b + 1), np.float32))
    return np.concatenate(out_w), np.concatenate(out_c), np.concatenate(out_v)


def _vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples of single words with equal codes added up, scaled to length one: word, code, weight."""
    letters = np.array([ord(c) for w in words for c in w], np.int64)
    size = np.array([len(w) for w in words], np.int64)
    w, c, v = triples(letters, np.cumsum(size) - size, size)
    return _unit(w, c, v, len(words))


def _unit(w: np.ndarray, c: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, inverse = np.unique(w.astype(np.int64) << 18 | c, return_inverse=True)
    v = np.bincount(inverse.ravel(), v, minlength=len(key))
    w, c = key >> 18, (key & 0x3FFFF).astype(np.int32)
    norm = np.sqrt(np.bincount(w, v**2, minlength=n))
    return w, c, v / norm[w]


class Landmarks:
    def __init__(self, words: list[str], n_toxic: int):
        self.words, self.n_toxic = words, n_toxic
        w, c, v = _vectors(words)
        self.row = np.full(1 << 18, -1, np.int32)
        used = np.unique(c)
        self.row[used] = np.arange(len(used))
        self.table = np.zeros((len(used), len(words)), np.float32)
        self.table[self.row[c], w] = v
        self.most = np.zeros(1 << 18, np.float32)
        if len(used):
            self.most[used] = self.table.max(axis=1)
        self.forget()
        self.gram = (self.table.T @ self.table).astype(float) ** POWER

    def forget(self) -> None:
        self.seen, self.slot = np.zeros(0, X.U64), np.zeros(0, np.int32)
        #: Kernel values of the near words that aren't 0: the landmark and value of each, and where a word's begin.
        self.cols, self.vals, self.start = np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "slot", "cols", "vals", "start")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def near(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """Index of the words that are near a landmark, and their kernel values with all landmarks."""
        word, col, value = self.pairs(found)
        index, row = np.unique(word, return_inverse=True)
        values = np.zeros((len(index), len(self.words)), np.float32)
        values[row.ravel(), col] = value
        return index, values

    def pairs(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, landmark and kernel value of every pair that is near (a cosine of ``CUT`` or more), by word.

        A worker compares each distinct word once; it starts afresh after ``REMEMBERED`` words, which
        bounds memory and changes no result.
        """
        if len(self.seen) > REMEMBERED or len(self.cols) > REMEMBERED:
            self.forget()
        key, first, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.seen, key)
        fresh = np.ones(len(key), bool)
        inside = at < len(self.seen)
        fresh[inside] = self.seen[at[inside]] != key[inside]
        if fresh.any():
            hot, values = self._compare(found.letters, found.start[first[fresh]], found.size[first[fresh]])
            slot = np.full(int(fresh.sum()), -1, np.int32)
            slot[hot] = len(self.start) - 1 + np.arange(len(hot))
            row, col = np.nonzero(values)
            self.start = np.concatenate([self.start, len(self.cols) + np.cumsum(np.bincount(row, minlength=len(hot)))])
            self.cols, self.vals = np.concatenate([self.cols, col.astype(np.int32)]), np.concatenate([self.vals, values[row, col]])
            self.seen, self.slot = np.insert(self.seen, at[fresh], key[fresh]), np.insert(self.slot, at[fresh], slot)
        which = self.slot[np.searchsorted(self.seen, key)][inverse.ravel()]
        index = np.flatnonzero(which >= 0)
        begin = self.start[which[index]]
        size = self.start[which[index] + 1] - begin
        pos = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
        return np.repeat(index, size), self.cols[pos], self.vals[pos]

    def _compare(self, letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are near a landmark, and their kernel values."""
        w, c, v = triples(letters, start, size)
        bound = np.bincount(w, v * self.most[c], minlength=len(start))
        # Equal triples of a word only make it longer, so this never drops a word that reaches the cut.
        length = np.sqrt(np.bincount(w, v**2, minlength=len(start)))
        hot = np.flatnonzero((bound > 0.999 * CUT * length) & (length > 0))
        values = np.zeros((len(hot), len(self.words)), np.float32)
        if len(hot):
            w, c, v = triples(letters, start[hot], size[hot])
            w, c, v = _unit(w, c, v, len(hot))
            known = self.row[c] >= 0
            w, c, v = w[known], c[known], v[known]
            edge = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else w
            # A few thousand triples at a time, cut between words.
            cuts = edge[np.unique(np.searchsorted(edge, np.arange(0, len(w), 8192), "right") - 1)] if len(w) else edge
            for a, b in zip(cuts, [*cuts[1:], len(w)], strict=True):
                own = edge[(edge >= a) & (edge < b)]
                values[w[own]] = np.add.reduceat(self.table[self.row[c[a:b]]] * v[a:b, None].astype(np.float32), own - a)
        values = np.where(values < CUT, 0, values) ** POWER
        near = values.any(axis=1)
        return hot[near], values[near]

    def sentences(self, t: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The document of each sentence with a word near a landmark; and sentence, landmark and largest kernel value, by sentence."""
        found = read_words(t)
        none = np.zeros(0, np.int64)
        if not len(found.hash) or not self.words:
            return none, none, none, none.astype(np.float32)
        word, col, value = self.pairs(found)
        if not len(word):
            return none, none, none, value
        fresh = np.append(True, np.diff(found.sentence[word]) != 0)
        doc = found.doc[word[fresh]]
        key = (np.cumsum(fresh) - 1) * len(self.words) + col
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return doc, key[first] // len(self.words), key[first] % len(self.words), np.maximum.reduceat(value[order], first)


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    slope: float
    level: float

    def margins(self, values: np.ndarray) -> np.ndarray:
        return values @ self.weights + self.bias

    def score(self, t: X.Texts) -> np.ndarray:
        best = np.full(t.n, self.bias)
        doc, sentence, col, value = self.landmarks.sentences(t)
        np.maximum.at(best, doc, np.bincount(sentence, self.weights[col] * value, minlength=len(doc)) + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.level, -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST, rounds: int = 30) -> np.ndarray:
    """Linear machine by Newton steps on the rows inside the margin; the last column is the bias."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    inside = np.ones(len(y), bool)
    for _ in range(rounds):
        a, s = x[inside], weight[inside, None] * cost
        w = np.linalg.solve(penalty + a.T @ (a * s), a.T @ (y[inside, None] * s)[:, 0])
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of the probability of y given a margin, with Platt's targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2), a.T @ (p - target))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample`` labelled rows, one for each id. Without toxic or without other labels every text scores alike."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
    known = known.agg((F.avg(label_col) >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # Broadcast: at most ``sample`` pairs of an id and a label.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), F.col("id") == F.col("_id"))
    # One row for each id, the same in every run, so that a repeated id brings no more.
    train = materialise(rows.groupBy("id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")

    def counted(batches):
        for batch in batches:
            y = np.asarray(batch.column("y"))
            for t in X.slices(batch.column("text"), SLICE):
                found = read_words(t)
                if not len(found.hash):
                    continue
                key = X.mix(found.hash + found.doc.astype(X.U64) * X.U64(0x9E3779B97F4A7C15))
                _, once = np.unique(key, return_index=True)
                label = y[t.first + found.doc[once]]
                _, first, inverse = np.unique(found.hash[once], return_index=True, return_inverse=True)
                n1 = np.bincount(inverse.ravel(), label, minlength=len(first)).astype(np.int64)
                n = np.bincount(inverse.ravel(), minlength=len(first))
                word = [found.text(i) for i in once[first]]
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n1), pa.array(n, pa.int64())], names=["word", "n1", "n"])

    counts = train.mapInArrow(counted, "word string, n1 long, n long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    counts = materialise(counts.where((F.col("n") >= 2) & (F.length("word") >= 3)), "words")
    totals = train.groupBy().agg(F.sum("y"), F.count("*")).first()
    n1, n = int(totals[0] or 0), int(totals[1])
    if not n1 or n1 == n:
        return Model(Landmarks([], 0), np.zeros(0), 0.0, 0.0, -30.0 if not n1 else 30.0)
    # Chi-square of presence against label, for words that toxic documents prefer.
    p, q = F.col("n1") / n1, (F.col("n") - F.col("n1")) / (n - n1)
    mean = F.col("n") / n
    chi = F.when(p > q, (p - q) ** 2 / (mean * (1 - mean) + 1e-9)).otherwise(0.0)
    toxic = counts.where((p > 3 * q) & (F.col("n1") >= 2)).orderBy(chi.desc(), "word").limit(TOXIC_WORDS).collect()
    other = counts.where(p < 1.5 * q).orderBy(F.desc("n"), "word").limit(OTHER_WORDS).collect()
    marks = Landmarks([r.word[:LONG] for r in [*toxic, *other]], len(toxic))

    m = len(marks.words)

    def represented(batches):
        """The kernel values of every sentence near a landmark that aren't 0, and a row without any for each document."""
        for batch in batches:
            for t in X.slices(batch.column("text"), SLICE):
                doc, sentence, col, value = marks.sentences(t)
                doc = np.concatenate([doc, np.arange(t.n)])
                edges = pa.array(np.searchsorted(sentence, np.arange(len(doc) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(v)) for v in (col.astype(np.int16), value.astype(np.float32))]
                kept = [batch.column(c).take(pa.array(doc + t.first)) for c in ("id", "y")]
                yield pa.RecordBatch.from_arrays([*kept, *lists], names=["id", "y", "cols", "vals"])

    sentences = materialise(train.mapInArrow(represented, "id long, y int, cols array<short>, vals array<float>"), "sentences")

    def dense(table) -> np.ndarray:
        out = np.zeros((table.num_rows, m), np.float32)
        size = np.asarray(pc.list_value_length(table.column("cols")))
        out[np.repeat(np.arange(len(size)), size), np.asarray(pc.list_flatten(table.column("cols")))] = np.asarray(pc.list_flatten(table.column("vals")))
        return out

    def chosen(mark) -> tuple[np.ndarray, np.ndarray]:
        """Label and values of each document's sentence with the largest mark: at most ``sample`` rows reach the driver."""

        def marked(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mark(dense(batch)).astype(float))], names=[*batch.schema.names, "mark"])

        one = sentences.mapInArrow(marked, "id long, y int, cols array<short>, vals array<float>, mark double")
        best = one.groupBy("id", "y").agg(F.max(F.struct("mark", "cols", "vals")).alias("s")).select("id", "y", "s.cols", "s.vals")
        got = best.toArrow().sort_by("id")
        return np.asarray(got.column("y")), dense(got)

    scale, basis = np.linalg.eigh(marks.gram + 0.05 * np.eye(m))
    root = basis @ np.diag(scale**-0.5) @ basis.T
    y, values = chosen(lambda v: v[:, : marks.n_toxic].max(axis=1, initial=0))
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
    for _ in range(3):
        x = np.hstack([values @ root, np.ones((len(y), 1))])
        w = squared_hinge(x, np.where(y > 0, 1.0, -1.0), weight)
        model = Model(marks, root @ w[:-1], float(w[-1]), 1.0, 0.0)
        y, values = chosen(model.margins)
    margins = model.margins(values)
    model.slope, model.level = logistic(margins, y.astype(float))
    return model


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", parts: int = 4, part: int = 2, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Null texts count as empty; texts without a word near a landmark share the lowest score. Repeated rows
    score alike; several labels of an id count by their mean; null ids and null labels are left out of
    training. An empty table gives an empty table. Other columns are not read.
    """
    model = fit(docs, labels.where(~held_out("doc_id", parts, part)), label_col)

    def run(batches):
        for batch in batches:
            for t in X.slices(batch.column("text"), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(t.first, t.n), pa.array(model.score(t))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
