import struct
import zlib

import numpy as np
import pytest

from lexspark.llm import token_store as S

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def test_reads_only_the_frames_asked_for(tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FRAME_TOKENS", 100)
    rng = np.random.default_rng(0)
    docs = {i: rng.integers(0, 50000, n).astype(np.uint32) for i, n in enumerate([5, 0, 60, 50, 500, 1, 99, 100])}
    uri = f"file://{tmp_path}/a/x.tokens"
    w = S.ShardWriter(uri)
    for i, ids in docs.items():
        w.add(i, ids)
    w.add(None, np.array([9], np.uint32))
    w.close()
    r = S.ShardReader(uri)
    assert len(r.frames) > 5
    got = dict(r.read([4, 6]))
    assert r.frames_read == 2 and {k: v.tolist() for k, v in got.items()} == {k: docs[k].tolist() for k in (4, 6)}
    assert [k for k, _ in r] == [*docs, None]
    raw = bytearray((tmp_path / "a/x.tokens").read_bytes())
    raw[20] ^= 1
    (tmp_path / "a/x.tokens").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017  zstandard's own error or ours
        list(S.ShardReader(uri))


def test_frames_are_plain_zstandard(tmp_path):
    import zstandard

    w = S.ShardWriter(f"file://{tmp_path}/y.tokens")
    w.add(1, np.arange(10, dtype=np.uint32))
    w.close()
    with zstandard.ZstdDecompressor().stream_reader((tmp_path / "y.tokens").read_bytes()) as f:
        assert struct.unpack("<10I", f.read(40)) == tuple(range(10))


def test_query_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(5, "word " * 40000, "x"), (1, "Żółć the of", "x"), (3, None, "y"), (4, "", "y"), (None, "a b", None), (9, "z", "q"), (9, "z", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    tok, want, start = Tokenizer.from_file(PATH), [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = S.read_tokens(S.write_tokens(df, f"file://{tmp_path}", PATH, 2)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert S.read_tokens(S.write_tokens(df.limit(0), f"file://{tmp_path}", PATH, 2)).collect() == []
