import random

import pyarrow as pa
import pytest

from lexspark.llm import byte_bpe as B
from lexspark.llm import edit_counts as C
from lexspark.llm import textops as X

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


PROSE = ["the ", "of", " ", "\n", "\n\n", "żółć", "it's", "123 ", "!!", "", "word", "   ", "\xa0", "漢字 "]
#: Pieces without white space, in several scripts and at the edges of the classes of the split.
DENSE = ["漢字かな", "カナ。", "，한글", "1,2", "(a)", "'", "''s", "don't'll", "Ж7", "é9", "x", "~", "²", "½", "\u0301", "ª", "_a", " 's", "«»", "٣", "ß"]


@pytest.mark.parametrize("pieces", [PROSE, DENSE])
def test_edits_count_as_whole_texts(pieces):
    e = B.Encoder(PATH)
    whole = lambda t: len(e.tokenizer.encode(t, add_special_tokens=False).ids)
    counter = lambda bs: [n for t in X.slices(pa.array(bs, pa.large_string())) for n in e.encode(t)[1].tolist()]
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choices(pieces[:-2], k=rng.choice([0, 1, 5, 400])))
        tree = C.EditableCount(text, counter)
        assert tree.total == whole(text)
        for _ in range(8):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 60]))
            new = "".join(rng.choices(pieces, [9] * (len(pieces) - 2) + [1, 3], k=rng.choice([0, 1, 4])))
            text = text[:a] + new + text[b:]
            assert tree.replace(a, b, new) == whole(text) and tree.text() == text


@pytest.mark.parametrize("part", ["漢字仮名交文，日本語文章。", "12,345,", "слово-слово;"])
def test_texts_without_white_space(part):
    """Fifty edits of a long text encode less than the text once."""
    e = B.Encoder(PATH)
    counter = lambda bs: [n for t in X.slices(pa.array(bs, pa.large_string())) for n in e.encode(t)[1].tolist()]
    text = part * (48_000 // len(part))
    tree = C.EditableCount(text, counter)
    built = tree.encoded
    for i in range(50):
        at = 900 * i + 7
        tree.replace(at, at + 5, "新x7")
        text = text[:at] + "新x7" + text[at + 5 :]
    assert tree.text() == text and tree.total == len(e.tokenizer.encode(text, add_special_tokens=False).ids)
    assert tree.encoded - built < len(text)


def test_an_edit_encodes_little():
    e = B.Encoder(PATH)
    counter = lambda bs: [n for t in X.slices(pa.array(bs, pa.large_string())) for n in e.encode(t)[1].tolist()]
    tree = C.EditableCount("some words here " * 5000, counter)
    built = tree.encoded
    tree.replace(40000, 40003, "new")
    assert 0 < tree.encoded - built < 1000


def test_many_edits_and_other_white_space_encode_little():
    e = B.Encoder(PATH)
    whole = lambda t: len(e.tokenizer.encode(t, add_special_tokens=False).ids)
    counter = lambda bs: [n for t in X.slices(pa.array(bs, pa.large_string())) for n in e.encode(t)[1].tolist()]
    for gap in (" ", "\u00a0 ", "\u2003"):
        text = f"some{gap}words mail me@example.com here and more " * 1000
        tree = C.EditableCount(text, counter)
        built = tree.encoded
        edits = C.clean_up(text)
        for start, end, new in reversed(edits):
            tree.replace(start, end, new)
        assert len(edits) == 1000 and tree.total == whole(tree.text())
        # Every edit reads its own leaf and one on either side, and no leaf grows.
        assert tree.encoded - built < 1000 * 3 * 2 * len(text) / len(tree.leaves)


def test_query_rows(spark):
    rows = [(1, "a line\nmail me@example.com now\na line\n\n\nend", "x"), (2, None, "x"), (2, "", "y"), (None, "a\na", None), (5, "word " * 60000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    tok = B.Encoder(PATH).tokenizer
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = {(r.doc_id, r.n_chars): r for r in C.counts(df, PATH).collect()}
    assert len(got) == 4
    r = got[1, len(rows[0][1])]
    assert r.n_edits == 2 and r.n_tokens == n(rows[0][1]) and r.n_tokens_after == n("a line\nmail <masked> now\n\n\nend")
    assert got[None, 3].n_tokens_after == n("a") and got[2, 0].n_tokens == 0 and got[5, 300000].n_tokens == n(rows[4][1])
    assert C.counts(df.limit(0), PATH).collect() == []
