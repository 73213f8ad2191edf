"""Subject terms: one spelling for each, and their stems (SC15-SC17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squash

# Quotation marks that may stand around a term.
QUOTES = "\"'„”»«"
# Acronyms kept in capitals.
ACRONYMS = "oc ac ure uke zus krus rp ena krs nfz vat pit cit bhp sn nsa tk tsue ue pfron".split()
# Endings cut from a word, in this order; the letters they are compared after folding.
ENDINGS = ["ami", "ach", "om", "ie", "ia", "y", "i", "e", "a", "o", "u"]
FOLD = ("óąćęłńśźż", "oacelnszz")
# Variants of a term and the name they are kept under.
CANONICAL = {
    "tym. ar. lub zatrzym.": "Tymczasowe aresztowanie lub zatrzymanie",
    "odszk. za niesłuszne skaz.": "Odszkodowanie za niesłuszne skazanie",
    "przestępstwa przeciwko mieniu": "Przestępstwo przeciwko mieniu",
    "przestępstwa przeciwko życiu": "Przestępstwo przeciwko życiu",
    "przestępstwa przeciwko zdrowiu": "Przestępstwo przeciwko zdrowiu",
    "przestępstwa przeciwko wolności": "Przestępstwo przeciwko wolności",
    "przestępstwa przeciwko porządkowi publicznemu": "Przestępstwo przeciwko porządkowi publicznemu",
    "przestępstwa gospodarcze": "Przestępstwo gospodarcze",
    "składki na ubezpieczenia społeczne": "Składki na ubezpieczenie społeczne",
    "ubezpieczenia społeczne": "Ubezpieczenie społeczne",
    "świadczenia przedemerytalne": "Świadczenie przedemerytalne",
    "kary umowne": "Kara umowna",
    "szkody górnicze": "Szkoda górnicza",
    "szkody na osobie": "Szkoda na osobie",
    "terminy": "Termin",
    "dowody (przepisy ogólne)": "Dowód (przepisy ogólne)",
    "renta z tytułu niezdolności do pracy w związku z choroba zawodową": "Renta z tytułu niezdolności do pracy w związku z chorobą zawodową",
    "podstawa wymiary składek": "Podstawa wymiaru składki",
    "podstawa wymiaru składek": "Podstawa wymiaru składki",
    "nienależne wykonanie umowy": "Nienależyte wykonanie umowy",
    "przestępstwa karnoskarbowe": "Przestępstwo karno-skarbowe",
    "przestępstwa karno-skarbowe": "Przestępstwo karno-skarbowe",
    "europejski nakaz aresztowania (ena)": "Europejski nakaz aresztowania",
    "zatrzymanie": "Tymczasowe aresztowanie lub zatrzymanie",
    "tymczasowe aresztowanie": "Tymczasowe aresztowanie lub zatrzymanie",
    "energetyczne prawo": "Prawo energetyczne",
    "bankowe prawo": "Prawo bankowe",
    "telekomunikacyjne prawo": "Prawo telekomunikacyjne",
    "prasowe prawo": "Prawo prasowe",
    "przewozowe prawo": "Prawo przewozowe",
    "autorskie prawo": "Prawo autorskie",
    "międzynarodowe prawo": "Prawo międzynarodowe",
    "upadłościowe prawo": "Prawo upadłościowe i naprawcze",
    "prawo upadłościowe": "Prawo upadłościowe i naprawcze",
    "prawo restrukturyzacyjne": "Prawo upadłościowe i naprawcze",
    "prawo upadłościowe i restrukturyzacyjne": "Prawo upadłościowe i naprawcze",
    "dyscyplinarne postępowanie": "Postępowanie dyscyplinarne",
    "dowodowe postępowanie": "Postępowanie dowodowe (przepisy ogólne)",
    "upadłościowe postępowanie": "Postępowanie upadłościowe",
    "klauzule abuzywne": "Klauzule niedozwolone",
    "koszty procesowe": "Koszty procesu",
    "uchwała wspólnoty": "Uchwały wspólnoty mieszkaniowej",
    "zwolnienie od kosztów": "Zwolnienie od kosztów sądowych",
    "czynności cywilnoprawne": "Czynności prawne",
}


def _word(w: Column) -> Column:
    """A word in small letters, but for acronyms: those of the list and words of two and more capitals only."""
    small, bare = F.lower(w), F.regexp_replace(w, r"\P{L}", "")
    shouted = bare.rlike(r"^\p{Lu}{2,}$")
    listed = F.btrim(small, F.lit(QUOTES + "().,;:-–—")).isin(*ACRONYMS)
    return F.when(shouted | listed, F.upper(w)).otherwise(small)


def _capital(words: Column) -> Column:
    """The first letter in upper case, wherever it stands."""
    first = r"(?s)^(\P{L}*)(\p{L})(.*)$"
    part = lambda k: F.regexp_extract(words, first, k)
    return F.when(words.rlike(first), F.concat(part(1), F.upper(part(2)), part(3))).otherwise(words)


def _normalized(terms: Column) -> Column:
    """SC15 for each term of an array. Every step is a pass of its own over the array, so that none is worked out again for each mention in the next."""
    table = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    text = F.transform(terms, lambda t: squash(F.btrim(squash(t), F.lit(QUOTES))))
    words = F.transform(text, lambda t: F.array_join(F.transform(F.split(t, " "), _word), " "))
    return F.transform(F.transform(words, _capital), lambda name: F.coalesce(F.try_element_at(table, F.lower(name)), name))


def normalize_thematic(c: Column) -> Column:
    """SC15: squashed, without outer quotes, in lower case but for acronyms and the first letter, one name for variants."""
    return F.get(_normalized(F.array(c)), F.lit(0))


def canonical_terms(c: Column) -> Column:
    """SC17: every term normalised, empty ones dropped, the first of equal ones kept."""
    named = _normalized(F.coalesce(c, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(named, lambda x: x != ""))


def stem(c: Column) -> Column:
    """SC16: folded letters, digits and hyphens, without the first matching ending that leaves four."""
    w = F.regexp_replace(F.translate(F.lower(c), *FOLD), r"(?U)[^\p{L}\p{N}-]", "")
    # The longest ending that leaves four letters; endings of one length exclude each other.
    return F.regexp_replace(w, rf"^(.{{4,}}?)(?:{'|'.join(ENDINGS)})$", "$1")
