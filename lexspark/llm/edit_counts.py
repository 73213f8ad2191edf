"""Token counts that follow edits: segment trees of counts over each document's pre-token blocks.

A document is cut into pre-tokens: where white space follows anything else (see ``byte_bpe``), and between letters,
digits and signs, in any script of ``_LETTERS``. The tokenizer's own split has an end at each of these places, whatever
stands before or after, so no token crosses one, and a piece between two of them has the same tokens alone as in its
text. One very long pre-token, such as a line of letters without a sign, is a piece of its own. Runs
of ``BLOCK`` pieces are the leaves of a segment tree that holds their numbers of tokens. An edit replaces a
span of characters: only the blocks it touches are cut and encoded again, with one block of context on
either side so that words which the edit joins or splits come out as in the whole text, and the sums on
the way to the root are updated. The blocks after an edit are dealt evenly to the leaves that held them
before, so leaves keep their size unless an edit brings in much new text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .byte_bpe import encoder

BLOCK = 16
_WHITE = " \t\n\x0b\x0c\r"
#: White space and separators of other kinds: a place after one is no cut (see ``byte_bpe``).
_OTHER = "\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Classes of the split pattern, as far as all versions of Unicode agree on them: Latin, Cyrillic, CJK, kana and Hangul letters; ASCII
# digits; ASCII and CJK signs. An apostrophe may begin a piece but not end one, as 's and 'll are pre-tokens.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SIGNS = r"!-&(-/:-@\[-`{-~\u3001\u3002\u3008-\u3011\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_TURN = re.compile(
    f"(?<=[^{_WHITE}{_OTHER}])(?=[{_WHITE}])|(?<=[{_LETTERS}])(?=[0-9'{_SIGNS}])|(?<=[0-9])(?=[{_LETTERS}'{_SIGNS}])|(?<=[{_SIGNS}])(?=[{_LETTERS}0-9])"
)


class EditableCount:
    """The number of tokens of a text under edits; ``encoded`` counts the characters encoded so far."""

    def __init__(self, text: str, counter):
        self.counter, self.encoded = counter, 0
        self.leaves = self._blocks(text)
        width = 1
        while width < len(self.leaves):
            width *= 2
        self.width = width
        self.tokens = np.zeros(2 * width, np.int64)
        self.chars = np.zeros(2 * width, np.int64)
        self.tokens[width : width + len(self.leaves)] = self._count(self.leaves)
        self.chars[width : width + len(self.leaves)] = [len(b) for b in self.leaves]
        for tree in (self.tokens, self.chars):
            level = width
            while level > 1:
                tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(axis=1)
                level //= 2

    @staticmethod
    def _blocks(text: str) -> list[str]:
        turns = [m.start() for m in _TURN.finditer(text)][BLOCK - 1 :: BLOCK]
        return [text[a:b] for a, b in zip([0, *turns], [*turns, len(text)], strict=True)]

    def _count(self, blocks: list[str]) -> list[int]:
        self.encoded += sum(map(len, blocks))
        return self.counter(blocks)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and the characters before it; the last for the end."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1] > 0:
                before += int(self.chars[node])
                node += 1
        return node - self.width, before

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.width
        grow = tokens - self.tokens[node], len(text) - self.chars[node]
        while node:
            self.tokens[node] += grow[0]
            self.chars[node] += grow[1]
            node //= 2

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of the characters from ``start`` to ``end``; returns the new total."""
        first, before = self._leaf(start)
        last, _ = self._leaf(max(end - 1, start))
        # Context: the filled leaves next to the touched ones.
        low = first - 1
        while low >= 0 and not self.leaves[low]:
            low -= 1
        high = last + 1
        while high < len(self.leaves) and not self.leaves[high]:
            high += 1
        before -= len(self.leaves[low]) if low >= 0 else 0
        low, high = max(low, 0), min(high, len(self.leaves) - 1)
        joined = "".join(self.leaves[low : high + 1])
        joined = joined[: start - before] + new + joined[end - before :]
        blocks = self._blocks(joined)
        edges = [k * len(blocks) // (high - low + 1) for k in range(high - low + 2)]
        parts = ["".join(blocks[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for leaf, part, tokens in zip(range(low, high + 1), parts, self._count(parts), strict=True):
            self._set(leaf, part, tokens)
        return self.total

    def text(self) -> str:
        return "".join(self.leaves)


#: Edits of the query: e-mail addresses, long numbers and keys are masked, and repeated lines removed.
_MASK = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b[0-9a-f]{32,}\b|\+?\d[\d ()./-]{5,}\d")


def clean_up(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, new text) in order, not overlapping: masks and removals of repeated lines."""
    seen, edits, at = set(), [], 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip(" \t\x0b\x0c\r") and line in seen:
            edits.append((max(at - 1, 0), end, ""))
        else:
            seen.add(line)
            edits += [(at + m.start(), at + m.end(), "<masked>") for m in _MASK.finditer(line)]
        at = end + 1
    return edits


def counts(docs: DataFrame, path: str, edits=clean_up, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` before, ``n_edits``, ``n_tokens_after``, ``n_chars``, ``n_encoded_again``.

    All texts of a slice are counted at once; a tree is built only for documents with edits, which are
    applied from the last to the first. n_encoded_again counts the characters that the edits made the
    encoder read. Null texts count as empty, with no tokens and no edits; repeated rows are kept. An empty
    table gives an empty table. Other columns are not read.
    """

    def run(batches):
        e = encoder(path)

        def counter(blocks: list[str]) -> list[int]:
            out: list[int] = []
            for part in X.slices(pa.array(blocks, pa.large_string())):
                out += e.encode(part)[1].tolist()
            return out

        for batch in batches:
            for t in X.slices(batch.column("text")):
                _, before = e.encode(t)
                n_edits, after, again, chars = (np.zeros(t.n, np.int64) for _ in range(4))
                for i in range(t.n):
                    text = t.data[t.offsets[i] : t.offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    todo = edits(text)
                    chars[i], n_edits[i], after[i] = len(text), len(todo), before[i]
                    if todo:
                        tree = EditableCount(text, counter)
                        built = tree.encoded
                        for start, end, new in reversed(todo):
                            tree.replace(start, end, new)
                        after[i], again[i] = tree.total, tree.encoded - built
                cols = [pa.array(x, pa.int64()) for x in (before, n_edits, after, chars, again)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(t.first, t.n), *cols], names=names)

    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars", "n_encoded_again"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import read_table

    return counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
