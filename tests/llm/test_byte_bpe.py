import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lexspark.llm import byte_bpe as B
from lexspark.llm import textops as X

P = pytest.importorskip("public_tokenizers")
RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ALPHABET = list("abcdeiostn'  \n\t.,!?0123żółćé–’…  　\u0085\x1c漢字🙂👩‍👩‍👧") + ["'s", "'re", "aaa", "   ", "\r\n", "the", " of", "<|endoftext|>", "ção", "ing"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 3, 20, 200]))) for _ in range(n)] + ["a" * 5000, "ab" * 3000, " " * 777, "\n\n \n", "é" * 900]


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


def encoded(e, values):
    out = []
    for t in X.slices(pa.array(values, pa.string()), 3000):
        ids, counts = e.encode(t)
        out += np.split(ids, np.cumsum(counts)[:-1])
    return [x.tolist() for x in out]


def test_rank_file_encodes_as_tiktoken():
    want = tiktoken_encoding()
    e = B.Encoder(RANKS, P.PATTERN)
    for seed in range(3):
        got = texts(1500, seed)
        for t, ids in zip(got, encoded(e, got), strict=True):
            assert ids == want.encode_ordinary(t), repr(t)


def test_cuts_encode_as_whole_texts():
    e = B.Encoder(JSON)
    got = texts(2000, 7)
    want = [x.ids for x in e.tokenizer.encode_batch(got, add_special_tokens=False)]
    assert encoded(e, got) == want
    e.forget()
    assert encoded(e, got[::-1]) == want[::-1]


def test_offsets_and_decoding():
    e = B.Encoder(RANKS, P.PATTERN)
    for t in texts(300, 3):
        ids = np.array(encoded(e, [t])[0], np.int64)
        assert e.decode(ids).tobytes().decode() == t
        if len(ids):
            start, end = e.char_offsets(ids)
            assert start[0] == 0 and end[-1] == len(t) and (start[1:] <= end[:-1]).all() and (end > start).all()
            for i, s, f in zip(ids, start, end, strict=True):
                assert e.token_bytes[i] in t[s:f].encode()


def test_query_rows(spark):
    rows = [(1, "Żółć 漢字 🙂 the of", "x"), (2, None, "y"), (2, "", "y"), (None, "a b", None), (5, "word " * 50000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = tiktoken_encoding()
    got = sorted(map(tuple, B.round_trip(df, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = B.decode_documents(B.encode_documents(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t, _ in rows)
    assert B.round_trip(df.limit(0), RANKS, P.PATTERN).collect() == []


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_runs_that_powers_would_confuse(n):
    import tiktoken  # noqa: F401

    pair = [thue_morse(n, "a", "b"), thue_morse(n, "b", "a")]
    want, e, j = tiktoken_encoding(), B.Encoder(RANKS, P.PATTERN), B.Encoder(JSON)
    assert encoded(e, pair) == [want.encode_ordinary(t) for t in pair]
    assert encoded(j, pair) == [x.ids for x in j.tokenizer.encode_batch(pair, add_special_tokens=False)]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(X, "span_hash", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    e, got = B.Encoder(JSON), texts(300, 9)
    want = [x.ids for x in e.tokenizer.encode_batch(got, add_special_tokens=False)]
    assert encoded(e, got) == want and encoded(e, got) == want
