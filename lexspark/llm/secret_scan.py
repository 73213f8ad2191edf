"""Secret scans by assignment-aware lexing.

A document is read as source or configuration: every place where a name gets a value (``name = "x"``,
``"name": "x"``, ``name: x``, ``NAME=x``, ``obj["name"] = "x"``, ``<name>x</name>``, ``setName("x")``) becomes a
binding of the name to literals and to other names. Sensitive names collect the literals that reach them, through
any chain of constants, interpolations and concatenations, in whatever order the bindings stand. A literal scores
by the words of the sensitive name it reaches and by its own make-up; those of ``THRESHOLD`` or more are findings:

- ``name``: a literal that a sensitive name is bound to directly,
- ``flow``: a literal that reaches a sensitive name through another name.

Findings of known shape come first and always stay: ``assign`` (a sensitive word, a separator, a value), ``access``
(access key ids) and ``hex`` (long runs of hexadecimal digits). A literal that lies inside one of them isn't listed
again. Places count code points, ends are exclusive.

Every text is read whole, in one pass; no document meets another, so there is no shuffle and no skew by key.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which findings of one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "name", "flow")
THRESHOLD = 0.5

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words of names and how much each says that the value is secret.
WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "cred": 0.9, "bearer": 0.8, "jwt": 0.8, "auth": 0.5, "oauth": 0.5, "private": 0.5, "salt": 0.6,
    "key": 0.4, "api": 0.4, "access": 0.3, "signing": 0.4, "encryption": 0.4, "session": 0.3, "cookie": 0.4, "webhook": 0.4, "dsn": 0.5,
}
#: Words that say that the value is something about a secret.
ABOUT = {"count", "length", "len", "name", "id", "url", "uri", "path", "file", "expiry", "expires", "ttl", "type", "field", "label", "limit", "max", "min", "hint", "public", "policy", "format", "size"}

# What may hold a finding at all, tested on whole columns before any text is read one by one.
_MAY_BASE = r"(?i:passw(?:or)?d|secret|token|api_?key)|AKIA|[0-9a-f]{24}"
_MAY_NAME = r"(?i)pass|pwd|secret|token|key|cred|bearer|jwt|auth|private|salt|dsn|webhook|cookie|session"

# Possessive and bounded on the left, so that every text is read in linear time.
_TARGET = re.compile(
    r"""(?<![\w$.-])(?P<name>[^\W\d][\w$]*+(?:[.-][\w$]++)*+)["'`]?[ \t]*+\]?[ \t]*+"""
    r"""(?::[ \t]*+[A-Za-z_][\w.]*+(?:\[[\w., ]*+\])?[ \t]*+(?==))?(?P<op>:=|=>|=(?![=~])|:(?![:/=]))[ \t]*+"""
)
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*+)(?:\s[^<>]*+)?>(?P<value>[^<>\s]++)</(?P=name)>")
_CALL = re.compile(r"""(?<![\w$])(?:set|with|use|put)_?(?P<name>[A-Za-z_]\w*+)\([ \t]*+(?=["'])""")
_STRING = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*+){q}") for q in "\"'`"}
_PREFIX = re.compile(r"[rbfuRBFU]{1,2}(?=[\"'])")
_REFERENCE = re.compile(r"\$\{(\w++)(?::?-[^}]*+)?\}|\$(\w++)|\{\{\s*+([\w.]++)\s*+\}\}|%\((\w++)\)s")
_NAME = re.compile(r"[^\W\d][\w$]*+(?:\.[\w$]++)*+")
# Ends before the next name's value, so that a chain of assignments is read once.
_BARE = re.compile(r"""[^\s"'`,;<>(){}\[\]:=]++(?::(?=[^\s:=])[^\s"'`,;<>(){}\[\]:=]++(?![:=]))?=*+""")
_JOIN = re.compile(r"[ \t]*+(?:\+|\|\||\.(?=[ \t]*[\"'])|(?=[\"']))[ \t]*+(?:\\?\n[ \t]*+)?")
_NEXT = re.compile(r"[ \t]*+,[ \t]*+")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_HOLDER = re.compile(
    r"(?i)(?:x+|\*+|\.+|-+|_+|<.*>|[$%]?[({].*[)}]s?|change_?me.*|your[_-].*|my[_-].*|example.*|sample.*|dummy.*|placeholder.*|none|null|nil|true|false|undefined|todo.*|redacted|<?masked>?|test(?:ing)?)"
)


def name_score(name: str) -> float:
    """How sensitive a name is, from its words: 1 - the product of (1 - weight); names about a secret count less."""
    words = [w.lower() for w in _WORD.findall(name)]
    left = 1.0
    for w in words:
        left *= 1.0 - WORDS.get(w, WORDS.get(w.removesuffix("s"), 0.0))
    return (1.0 - left) * (0.3 if words and words[-1] in ABOUT else 1.0)


def literal_score(value: str, bare: bool = False) -> float:
    """How much a literal looks like a secret: its information in bits, up to 24, less for words, prose and paths."""
    if len(value) < 6 or _HOLDER.fullmatch(value) or re.fullmatch(r"[A-Z]+(?:_[A-Z0-9]+)+", value):
        return 0.0
    n = len(value)
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    out = min(1.0, bits / 24)
    if value.isalpha():
        out *= 0.44 if bare else 0.55
    elif value.isdigit():
        out *= 0.7
    if any(c.isspace() for c in value):
        out *= 0.3
    return out * (0.2 if re.match(r"https?://|\.{0,2}/", value) else 1.0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the known shapes: leftmost and not overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Bindings:
    """Names of one text and what each is bound to: literals (start, end, bare) and other names."""

    def __init__(self, text: str):
        self.text, self.literals, self.names = text, defaultdict(list), defaultdict(list)
        self.dead = dict.fromkeys(_STRING, (-1, -1))
        for m in _TARGET.finditer(text):
            self._value(m["name"], m.end(), m["op"])
        for m in _ELEMENT.finditer(text):
            self._bind(m["name"], m.start("value"), m.end("value"), True)
        for m in _CALL.finditer(text):
            self._value(m["name"], m.end(), "(")

    def _string(self, at: int) -> tuple[int, int] | None:
        """The inside of a quoted string that opens here. A quote that its line doesn't close makes the later ones of that kind on the line plain characters."""
        q = self.text[at : at + 1]
        if q not in self.dead or self.dead[q][0] <= at < self.dead[q][1]:
            return None
        m = _STRING[q].match(self.text, at)
        if not m:
            end = self.text.find("\n", at)
            self.dead[q] = (at, len(self.text) if end < 0 else end)
            return None
        return m.span(1)

    def _bind(self, name: str, start: int, end: int, bare: bool) -> None:
        inside = self.text[start:end]
        refs = [next(filter(None, g)) for g in _REFERENCE.findall(inside)] if "$" in inside or "%(" in inside or "{{" in inside else []
        self.names[name] += refs
        if not refs or not _REFERENCE.fullmatch(inside):
            self.literals[name].append((start, end, bare))

    def _value(self, name: str, at: int, op: str) -> None:
        """Binds the parts of the value at ``at``: strings, names, bare values, joined by + or set side by side, or given to a call."""
        inside = False
        while True:
            p = _PREFIX.match(self.text, at)
            at = p.end() if p else at
            s = self._string(at)
            if s:
                self._bind(name, *s, False)
                at = s[1] + 1
            else:
                ref = _REFERENCE.match(self.text, at)
                word = None if ref else _NAME.match(self.text, at)
                bare = ref or _BARE.match(self.text, at)
                if not bare:
                    return
                if ref:
                    self.names[name].append(next(filter(None, ref.groups())))
                elif word and word.end() == bare.end():
                    if self.text[word.end() : word.end() + 1] == "(":
                        at, inside = word.end() + 1, True
                        continue
                    # A name of its own, or a value without quotes; which of them is known once all bindings are.
                    self.names[name].append(word[0])
                    if op in ("=", ":"):
                        self.literals[name].append((*word.span(), True))
                else:
                    self._bind(name, *bare.span(), True)
                at = bare.end()
            more = _JOIN.match(self.text, at) or (inside and _NEXT.match(self.text, at))
            if not more:
                return
            at = more.end()

    def sources(self, name: str) -> list[tuple[int, int, bool]]:
        """Literals that ``name`` is bound to: start, end, without quotes. A bare word that is a name here is no literal."""
        here = lambda a, b: self.text[a:b] in self.literals or self.text[a:b] in self.names
        return [(a, b, bare) for a, b, bare in self.literals.get(name, []) if not (bare and here(a, b))]


def named_spans(text: str) -> list[tuple[int, int, int, str, float]]:
    """(start, kind's place in KINDS, end, name, score) of literals that reach sensitive names; the heaviest name of each literal.

    Constants are followed from the heaviest name on, and no name is passed twice: a lighter name could add nothing
    there. So every binding is looked at once, and cycles end where they close.
    """
    bindings = Bindings(text)
    names = {*bindings.literals, *bindings.names}
    heavy = sorted((-w, n) for n in names if (w := name_score(n)) >= THRESHOLD)
    found: dict[tuple[int, int], tuple[int, str, float]] = {}

    def add(kind: int, owner: str, weight: float, source: str) -> None:
        for start, end, bare in bindings.sources(source):
            score = round(weight * literal_score(text[start:end], bare), 6)
            if score >= THRESHOLD and (start, end) not in found:
                found[start, end] = (kind, owner, score)

    for w, name in heavy:
        add(3, name, -w, name)
    seen: set[str] = set()
    for w, name in heavy:
        todo = [name]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += bindings.names.get(n, [])
                if n != name:
                    add(4, name, -w, n)
    return sorted((a, kind, b, name, score) for (a, b), (kind, name, score) in found.items())


def spans(text: str, base: bool = True, lex: bool = True) -> list[dict]:
    """All findings of a text, by start and then by kind. ``base`` and ``lex``: which part may find something."""
    known = base_spans(text) if base else []
    out = [(a, k, b, None, 1.0) for a, k, b in known]
    if lex:
        ends, top = [], 0
        for _, _, b in known:
            top = max(top, b)
            ends.append(top)
        at = 0
        for x in named_spans(text):
            # Known spans that start at or before this one: the literal is inside one of them if the farthest end covers it.
            while at < len(known) and known[at][0] <= x[0]:
                at += 1
            if not (at and ends[at - 1] >= x[2]):
                out.append(x)
    return [{"kind": KINDS[k], "start": a, "end": b, "name": name, "score": score} for a, k, b, name, score in sorted(out, key=lambda x: x[:3])]


FINDING = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``findings``: kind, start, end, the sensitive name (of lexed kinds) and the score of each.

    One row comes for each row of ``docs``, repeated and null ids included. Null and empty texts have no findings,
    an empty table gives an empty table, other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            base = pc.match_substring_regex(texts, _MAY_BASE).to_numpy(zero_copy_only=False)
            lex = pc.match_substring_regex(texts, _MAY_NAME).to_numpy(zero_copy_only=False)
            found = [spans(texts[i].as_py(), bool(b), bool(n)) if b or n else [] for i, (b, n) in enumerate(zip(base, lex, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(FINDING))], names=["doc_id", "findings"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, findings array<struct<kind: string, start: int, end: int, name: string, score: double>>")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    found = scan(read_table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    listed = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE_KINDS)), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))
