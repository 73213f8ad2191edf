"""Token ids in binary shards of independent Zstandard frames, read document by document.

A shard is a series of frames, each the ids (unsigned 32-bit, little-endian) of some whole documents and
ended before it grows past ``FRAME_TOKENS``; a longer document has a frame of its own. Directory frames
follow: for each document its id, whether it has one, its frame, its place there and its number of ids,
``DIRECTORY_DOCS`` documents to a frame. The last frame is the index: the lowest and highest id of each
directory frame. A skippable frame with the seek table ends the file, laid out as in Zstandard's public
seekable format: compressed size, decompressed size and the low 32 bits of XXH64 of the content for each
frame.

A reader takes the footer, the index, the directory frames that may hold the documents it wants and then
only those documents' frames, and checks the checksum of each frame it takes. Paths may be of any file
system that pyarrow knows.

A task writes to a name of its own and reports it; names of tasks that were lost or repeated are in no
manifest, so they are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .byte_bpe import encoder
from .shared import materialise, scratch_path

FRAME_TOKENS, SHARD_TOKENS, SHARD_DOCS, DIRECTORY_DOCS, LEVEL = 1 << 16, 1 << 26, 1 << 21, 1 << 12, 3
READERS = 50_000
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DIRECTORY = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4"), ("has_id", "u1")])
_INDEX = np.dtype([("low", "<i8"), ("high", "<i8"), ("n", "<u4"), ("n_ids", "<u4")])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; documents come in the order they are to be read in."""

    def __init__(self, uri: str):
        import zstandard

        files, path = _open(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out = uri, files.open_output_stream(path)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.directories: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.held).astype("<u4").tobytes())
        self.held, self.n_held = [], 0

    def _shelve(self) -> None:
        if self.rows:
            self.directories.append(np.array(self.rows, _DIRECTORY))
        self.rows = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and (self.n_held + len(ids) > FRAME_TOKENS or len(self.held) >= DIRECTORY_DOCS):
            self._flush()
        if len(self.rows) >= DIRECTORY_DOCS:
            self._shelve()
        self.rows.append((doc_id or 0, len(self.frames), self.n_held, len(ids), doc_id is not None))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1

    def full(self) -> bool:
        return self.n_tokens > SHARD_TOKENS or self.n_docs >= SHARD_DOCS

    def close(self) -> None:
        self._flush()
        self._shelve()
        index = []
        for d in self.directories:
            named = d["doc_id"][d["has_id"] > 0]
            index.append((named.min(initial=2**63 - 1), named.max(initial=-(2**63)), len(d), len(named)))
            self._frame(d.tobytes())
        self._frame(np.array(index, _INDEX).tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class ShardReader:
    """Reads single documents of a shard, or all of them in order, one frame at a time."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        self.file.seek(self.file.size() - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(self.file.size() - 9 - 12 * n)
        self.frames = np.frombuffer(self.file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.cumsum(self.frames[:, 0]) - self.frames[:, 0]
        self.frames_read = 0  # of documents
        self.index = np.frombuffer(self.frame(n - 1), _INDEX)
        self.first_directory = n - 1 - len(self.index)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        packed, size, check = self.frames[k]
        self.file.seek(int(self.begin[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(packed)), max_output_size=int(size))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def _documents(self, rows: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
        last, ids = -1, None
        for d in rows:
            if d["frame"] != last:
                last, ids = d["frame"], np.frombuffer(self.frame(int(d["frame"])), "<u4")
                self.frames_read += 1
            yield int(d["doc_id"]) if d["has_id"] else None, ids[d["at"] : d["at"] + d["n"]]

    def directory(self, k: int) -> np.ndarray:
        return np.frombuffer(self.frame(self.first_directory + k), _DIRECTORY)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self._documents(self.directory(k))

    def read(self, doc_ids: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
        wanted = np.unique(np.array(list(doc_ids), np.int64))
        at = np.searchsorted(wanted, self.index["low"])
        for k in np.flatnonzero((self.index["n_ids"] > 0) & (at < np.searchsorted(wanted, self.index["high"], "right"))):
            rows = self.directory(int(k))
            yield from self._documents(rows[(rows["has_id"] > 0) & np.isin(rows["doc_id"], wanted)])


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents into shards below ``folder``; returns the manifest, a row for each shard.

    Rows are sorted by id (null first; rows of one id by a hash of the text); rows of one id may lie in several tasks. Null texts count as empty, so they hold
    the end id alone. Manifest: ``shard`` (uri), ``nth`` (order), ``n_docs``, ``n_tokens``, ``start``
    (ids in all shards before). An empty table gives an empty manifest and no files.
    """

    def run(batches):
        from pyspark import TaskContext

        e, part, nth, out = encoder(path), TaskContext.get().partitionId(), 0, None

        def done(w):
            w.close()
            columns = [[w.uri], [part * (1 << 32) + nth], [w.n_docs], [w.n_tokens]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "nth", "n_docs", "n_tokens"])

        for batch in batches:
            names = batch.column("id").to_pylist()
            for t in X.slices(batch.column("text")):
                ids, counts = e.encode(t)
                edges = np.concatenate([[0], np.cumsum(counts)])
                for i in range(t.n):
                    if out is not None and out.full():
                        yield done(out)
                        nth, out = nth + 1, None
                    out = out or ShardWriter(f"{folder}/{uuid.uuid4().hex}.tokens")
                    out.add(names[t.first + i], np.append(ids[edges[i] : edges[i + 1]], np.uint32(end_id)))
        if out is not None:
            yield done(out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("nth"))
    rows = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = ["id", "hash", "nth"]  # nth tells repeated rows apart, so that many of them can be dealt out
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    shards = materialise(dealt.mapInArrow(run, "shard string, nth long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document of the shards, from the files."""

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = []
                for doc_id, ids in ShardReader(uri):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    def pack(rows):
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    starts = materialise(manifest, "starts")
    n = starts.count()  # a partition for each shard, up to a number that a driver can still track
    return starts.repartition(min(max(n, 1), READERS)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import read_table

    folder = scratch_path(spark, "tokens")
    docs = read_table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
