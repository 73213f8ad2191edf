import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexspark.llm import textops as X
from lexspark.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def brute(a, b):
    def vector(w):
        v, w = {}, f"^{w}$"
        for i in range(len(w)):
            for k in range(i + 2, min(len(w), i + T.SPAN + 1)):
                for j in range(i + 1, k):
                    v[w[i] + w[j] + w[k]] = v.get(w[i] + w[j] + w[k], 0) + T.DECAY ** (k - i + 1)
        return v

    va, vb = vector(a), vector(b)
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    return sum(x * vb.get(u, 0) for u, x in va.items()) / (norm(va) * norm(vb))


def one(*texts):
    return next(X.slices(pa.array(texts)))


def test_kernel_matches_its_definition():
    words = ["idiot", "idxiot", "worthless", "banana", "worth"]
    marks = T.Landmarks(words, 2)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert marks.gram[i, j] == pytest.approx(brute(a, b) ** T.POWER, abs=1e-5)
    found = T.read_words(one("Idiot! xidiot  WORTHLESS\nother bandana"))
    index, values = marks.near(found)
    for i, v in zip(index, values, strict=True):
        for j, b in enumerate(words):
            k = brute(found.text(i), b)
            assert v[j] == pytest.approx(k**T.POWER if k >= T.CUT else 0, abs=1e-5)
    assert set(range(len(found.hash))) - set(index) == {i for i in range(len(found.hash)) if max(brute(found.text(i), w) for w in words) < T.CUT}


def test_words_are_seen_through_signs_gaps_and_long_runs():
    found = T.read_words(one("an i.d-i*o_t and i d i o t. Next", "", "z" * 30 + "idiot" + "q" * 60))
    words = [found.text(i) for i in range(len(found.hash))]
    assert words[1] == "idiot" and "idiot" in words[3] and found.doc.tolist()[-1] == 2
    assert any("idiot" in w for w in words[5:]) and max(map(len, words)) <= T.LONG
    assert found.sentence[4] > found.sentence[3]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = T.fit(docs, labels.where(~T.held_out("doc_id", 4, 2)), "toxic")
    got = T.query(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == 10000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got.join(labels.toPandas().set_index("doc_id"), how="inner")
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in both.held_out.items())
    out = both[both.held_out]
    tp = ((out.predicted == 1) & (out.toxic == 1)).sum()
    print("precision", tp / max(1, (out.predicted == 1).sum()), "recall", tp / (out.toxic == 1).sum(), len(out))
    assert tp / (out.predicted == 1).sum() > 0.8 and tp / (out.toxic == 1).sum() > 0.85
    plain = "The thnd of erha and this tion was heed by thblere onand."
    for w in ("idiot", "i.d.i.o.t", "i d i o t", "idxiot", "loser", "worth-less", "woorthless", "patheetic", "stuupid", "mo_ron"):
        assert model.score(one(plain + " You are " + w + " here. " + plain))[0] >= 0.3, w
    assert model.score(one(plain))[0] < 0.3


def test_edge_cases(spark):
    rows = [(i, "fine words here. nice idea" if i % 2 else "fine words here. you nasty creature", "s") for i in range(40)]
    rows += [(100, None, "s"), (101, "", None), (102, "nasty creature " * 30000, "s"), (None, "You NASTY cre-ature!", "s"), (0, rows[0][1], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    got = T.classify(df, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 45 and all(by[i].predicted == 1 - i % 2 for i in range(40)) and by[102].predicted == 1 and by[None].predicted == 1
    assert by[100].predicted == 0 and by[100].score == by[101].score and np.isfinite(by[100].score)
    assert all(r.predicted == 0 for r in T.classify(df, labels.limit(0)).collect())
    assert T.classify(df.limit(0), labels).collect() == []
