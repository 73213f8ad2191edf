"""Byte-level BPE over Arrow batches with the tokenizers library.

A vocabulary is a ``tokenizers`` JSON file or a rank file (``.tiktoken``), given by path. For a rank
file every split of a token into two tokens is a merge, ordered by the rank of what it makes, and a
piece that is itself a token stays whole; this is the rank file's own rule.

Encoding never crosses a place where white space follows a word, because every piece of the split
pattern ends there. So texts are cut at these places (where ASCII white space follows anything that is no
white space of any kind), equal cuts are encoded once for each worker, and whole texts are put together
from the results. Cuts are found by a hash and then compared byte by byte, so no collision changes an id.

Decoding looks bytes up by id. Characters whose bytes lie in several tokens come together again because
bytes are joined first and decoded afterwards; ``char_offsets`` gives such tokens the span of the whole
character.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X

#: Cuts, and bytes of cuts, that a worker remembers; beyond these it starts afresh. This bounds memory, not results.
REMEMBERED, REMEMBERED_BYTES = 3_000_000, 64_000_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def from_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that encodes as the rank file prescribes."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    chars = byte_characters()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for k in range(1, len(token)):
            if token[:k] in ranks and token[k:] in ranks:
                merges.append((shown[token[:k]], shown[token[k:]]))
    model = models.BPE({shown[t]: i for t, i in ranks.items()}, merges, ignore_merges=True)
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return out


def _put(store: np.ndarray, n: int, new: np.ndarray) -> tuple[np.ndarray, int]:
    """``new`` after the first n of ``store``, which grows by doubling."""
    if n + len(new) > len(store):
        store = np.concatenate([store[:n], np.zeros((max(len(store), len(new)), *store.shape[1:]), store.dtype)])
    store[n : n + len(new)] = new
    return store, n + len(new)


class Encoder:
    """Encodes slices of documents; remembers the ids of each distinct cut."""

    def __init__(self, path: str, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = from_ranks(path, pattern) if pattern else Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab()
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        for shown, i in vocab.items():
            known = all(c in back for c in shown)
            self.token_bytes[i] = bytes(back[c] for c in shown) if known else shown.encode()
        self.size = np.array([len(t) for t in self.token_bytes], np.int64)
        self.byte_start = np.cumsum(self.size) - self.size
        self.all_bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.keys, self.entry = np.zeros(0, X.U64), np.zeros(0, np.int64)
        self.flat, self.n_flat = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.n_raw = np.zeros(1 << 18, np.uint8), 0
        #: For each remembered cut: where its ids start, their number, where its bytes start, their number.
        self.known, self.n = np.zeros((1 << 14, 4), np.int64), 0

    @staticmethod
    def _odd(data: np.ndarray) -> np.ndarray:
        """The last bytes of white space and separators other than ASCII's six."""
        odd = (data >= 0x1C) & (data <= 0x1F)
        lead = np.flatnonzero(data >= 0xC2)
        lead = lead[np.isin(data[lead], [0xC2, 0xE1, 0xE2, 0xE3])]
        if len(lead):
            pad = np.concatenate([data, np.zeros(2, np.uint8)])
            a, b, c = pad[lead], pad[lead + 1], pad[lead + 2]
            odd[lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))] + 1] = True
            three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            three |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            odd[lead[three] + 2] = True
        return odd

    def cuts(self, texts: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each cut, and whether it may stand before another when encoded."""
        data, offs = texts.data, texts.offsets
        begin = offs[:-1][np.diff(offs) > 0]
        if not len(begin):
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(bool)
        space = X._SPACE[data]
        blank = space | self._odd(data)
        first = np.zeros(len(data), bool)
        first[1:] = space[1:] & ~blank[:-1]
        first[begin] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))
        return start, end, X.doc_of(texts, start), space[start] & ~blank[end - 1]

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """Encode cuts and remember them; returns their entries. Loose cuts follow each other in one text; the others stand alone."""
        at, rest = np.flatnonzero(loose), np.flatnonzero(~loose)
        order = np.concatenate([at, rest])
        size = (end - start)[order]
        raw = data[np.repeat(start[order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        ids, counts = [], []
        if len(at):
            upto = np.cumsum(size[: len(at)])
            joined = raw[: upto[-1]].tobytes().decode("utf-8", "replace")
            ids.append(np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.int64))
            counts.append(np.diff(np.searchsorted(np.cumsum(self.size[ids[0]]), upto, "left") + 1, prepend=0))
        if len(rest):
            texts = [data[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in rest]
            alone = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            ids += alone
            counts.append(np.array([len(x) for x in alone]))
        n = np.concatenate(counts).astype(np.int64)
        rows = np.stack([self.n_flat + np.cumsum(n) - n, n, self.n_raw + np.cumsum(size) - size, size], axis=1)
        self.flat, self.n_flat = _put(self.flat, self.n_flat, np.concatenate(ids).astype(np.uint32))
        self.raw, self.n_raw = _put(self.raw, self.n_raw, raw)
        self.known, self.n = _put(self.known, self.n, rows)
        entries = np.empty(len(order), np.int64)
        entries[order] = self.n - len(rows) + np.arange(len(rows))
        return entries

    def cut_entries(self, texts: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The remembered entry, the document and the start of each cut."""
        if self.n > REMEMBERED or self.n_flat > 8 * REMEMBERED or self.n_raw > REMEMBERED_BYTES:
            self.forget()
        start, end, doc, loose = self.cuts(texts)
        if not len(start):
            return start, doc, start
        key, first, inverse = np.unique(X.span_hash(texts.data, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        fresh = self.keys[at] != key if len(self.keys) else np.ones(len(key), bool)
        if fresh.any():
            f = first[fresh]
            added = self._add(texts.data, start[f], end[f], loose[f])
            where = np.searchsorted(self.keys, key[fresh])
            self.keys, self.entry = np.insert(self.keys, where, key[fresh]), np.insert(self.entry, where, added)
        entry = self.entry[np.searchsorted(self.keys, key)][inverse.ravel()]
        # Equal hashes prove nothing: the cuts, which make up the texts, are compared with what is remembered.
        size = end - start
        other = self.known[entry, 3] != size
        if not other.any():
            same = self.raw[np.repeat(self.known[entry, 2] - start, size) + np.arange(len(texts.data))] == texts.data
            if not same.all():
                other[np.searchsorted(start, np.flatnonzero(~same), "right") - 1] = True
        else:
            other |= [not o and not np.array_equal(self.raw[a : a + n], texts.data[b : b + n]) for o, a, b, n in zip(other, self.known[entry, 2], start, size, strict=True)]
        if other.any():
            entry[other] = self._add(texts.data, start[other], end[other], loose[other])
        return entry, doc, start

    def encode(self, texts: X.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, one after another, and the number of ids of each document."""
        entry, doc, _ = self.cut_entries(texts)
        size = self.known[entry, 1]
        counts = np.bincount(doc, size, minlength=texts.n).astype(np.int64)
        at = np.cumsum(size) - size
        pos = np.arange(int(size.sum())) - np.repeat(at, size)
        return self.flat[np.repeat(self.known[entry, 0], size) + pos], counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, joined."""
        size = self.size[ids]
        at = np.cumsum(size) - size
        pos = np.arange(int(size.sum())) - np.repeat(at, size)
        return self.all_bytes[np.repeat(self.byte_start[ids], size) + pos]

    def char_offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last, counted in code points."""
        raw = self.decode(ids)
        nth = np.cumsum((raw & 0xC0) != 0x80)
        end = np.cumsum(self.size[ids])
        start = end - self.size[ids]
        return nth[start] - 1, nth[end - 1]


_held: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary."""
    if (path, pattern) not in _held:
        _held[path, pattern] = Encoder(path, pattern)
    return _held[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids``, ``starts``, ``ends``: token ids and their spans in code points, one row for each row.

    Null and empty texts have no ids. Other columns are not read; repeated rows are kept.
    """

    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            for t in X.slices(batch.column("text")):
                ids, counts = e.encode(t)
                edges = np.concatenate([[0], np.cumsum(counts)])
                spans = [e.char_offsets(ids[edges[i] : edges[i + 1]]) if counts[i] else ([], []) for i in range(t.n)]
                starts, ends = (np.concatenate([np.asarray(s[k], np.int32) for s in spans]) for k in (0, 1))
                lists = [pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(v.astype(np.int32))) for v in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(t.first, t.n), *lists], names=["doc_id", "ids", "starts", "ends"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """``doc_id``, ``text`` from ``doc_id``, ``ids``; bytes that form no character become U+FFFD."""

    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            texts = [e.decode(np.asarray(i or [], np.int64)).tobytes().decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` for each row, after encoding and decoding.

    Only digests leave the task, so nothing but the input's columns in ``keep`` travels with them.
    """

    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            for t in X.slices(batch.column("text")):
                ids, counts = e.encode(t)
                raw = e.decode(ids)
                edges = np.concatenate([[0], np.cumsum(counts)])
                size = np.concatenate([[0], np.cumsum(e.size[ids])])[edges]
                wide = ids.astype("<u4")
                a = [hashlib.sha256(wide[edges[i] : edges[i + 1]]).hexdigest() for i in range(t.n)]
                b = [hashlib.sha256(raw[size[i] : size[i + 1]]).hexdigest() for i in range(t.n)]
                kept = [batch.column(c).slice(t.first, t.n) for c in ["id", *keep]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"doc_id long{extra}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import read_table

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
