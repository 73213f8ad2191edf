"""White space, accents and tokens (SC1-SC3, SC21), as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s ​]+"


def _accents() -> tuple[str, str]:
    """Letters that decompose into one letter and combining marks, and those letters."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(cp):
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def squash(c: Column) -> Column:
    """SC1: runs of white space, no-break and zero-width spaces become one space; trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^[\s ]+|[\s ]+$", "")


def strip_accents(c: Column) -> Column:
    """SC2: combining marks are dropped; letters without a decomposition, such as l with stroke, stay."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")


def unaccent(c: Column) -> Column:
    """SC3: as strip_accents, and l with stroke becomes l."""
    return F.translate(strip_accents(c), "łŁ", "lL")


def tokens(c: Column) -> Column:
    """SC21: lower-case unaccented runs of letters and digits."""
    return F.filter(F.split(F.lower(unaccent(F.coalesce(c, F.lit("")))), r"(?U)[^\p{L}\p{N}]+"), lambda x: x != "")


def filled(c: Column) -> Column:
    """Null for empty strings."""
    return F.nullif(c, F.lit(""))
