"""Vectorised text primitives: an Arrow string column becomes one byte array with document offsets.

All functions work on slices of a few megabytes, so a task's memory doesn't depend on the batch size.
Only a single document longer than a slice is held as a whole. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of MurmurHash3)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_STEP = U64(0xD6E8FEB86659FD93)
_factors = np.zeros(0, U64)


def factors(n: int) -> np.ndarray:
    """n odd multipliers, one for each place of a run, without a relation between them.

    Powers of one multiplier would make certain runs of two letters collide modulo 2**64.
    """
    global _factors
    if len(_factors) < n:
        _factors = mix(np.arange(1, max(n, 4096, 2 * len(_factors)) + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)
    return _factors[:n]


@dataclass
class Texts:
    """Bytes of some documents, one after another; document i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of whole documents of about ``most`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offs, raw = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), len(column))
        yield Texts(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], start)
        start = end


@dataclass
class Spans:
    """Runs of bytes with the document each lies in and a 64-bit hash of its bytes."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n)


def _edges(mask: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``mask``; no run crosses a document's edge."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    inner = texts.offsets[:-1]
    before[inner[inner < len(mask)]] = False
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    last = texts.offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each non-empty run; equal runs have equal hashes."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    at = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(at, size)
    value = _BYTE[data[pos + np.repeat(start, size)]] * factors(int(size.max()))[pos]
    return mix(np.add.reduceat(value, at) + size.astype(U64))


def doc_of(texts: Texts, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(texts.offsets, at, "right") - 1


def words(texts: Texts) -> Spans:
    """Runs of anything but the six ASCII white-space characters."""
    start, end = _edges(~_SPACE[texts.data], texts)
    return Spans(start, end, doc_of(texts, start), span_hash(texts.data, start, end))


def sequence_hash(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """One hash for each group of consecutive values (0 for groups without any)."""
    out = np.zeros(n, U64)
    if len(values):
        size = np.bincount(group, minlength=n)
        full = np.flatnonzero(size)
        at = (np.cumsum(size) - size)[full]
        pos = np.arange(len(values)) - np.repeat(at, size[full])
        out[full] = mix(np.add.reduceat(values * factors(int(size.max()))[pos], at) + size[full].astype(U64))
    return out


def windows(spans: Spans, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and the hash, of each run of ``width`` words of one document."""
    n = len(spans.hash)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(spans.doc[: n - width + 1] == spans.doc[width - 1 :])
    h = np.zeros(len(at), U64)
    for k in range(width):
        h = h * _STEP + spans.hash[at + k]
    return at, mix(h)


def shingles(texts: Texts, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: document, hash, count; and each document's number of words.

    A document of fewer words than ``width`` has one shingle of all its words; one without words has none.
    """
    found = words(texts)
    counts = found.counts(texts.n)
    at, h = windows(found, width)
    doc = found.doc[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = sequence_hash(found.hash, found.doc, texts.n)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole[short]])
    key = mix(h + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key, doc, h = key[order], doc[order], h[order]
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(fresh, len(key)))
    return doc[fresh], h[fresh], count, counts
