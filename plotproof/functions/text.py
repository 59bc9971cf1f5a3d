"""Text folding, keyword hits, names, identifiers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotproof.functions.geometry import bind


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Replacement tables derived from the Unicode compatibility decomposition."""
    single: dict[str, str] = {}
    dropped: list[str] = []
    expanded: dict[str, str] = {}
    for block in (range(0x80, 0x3100), range(0xFB00, 0xFB07), range(0xFF01, 0xFFEF)):
        for code in block:
            ch = chr(code)
            base = "".join(p for p in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(p)).lower()
            if base == ch:
                continue
            if not base:
                dropped.append(ch)
            elif len(base) == 1:
                single[ch] = base
            else:
                expanded[ch] = base
    return "".join(single) + "".join(dropped), "".join(single.values()), expanded


_SOURCE, _TARGET, _EXPANDED = _fold_tables()
_EXPANDED_CHARS = "".join(_EXPANDED)


#: Stands for a character that expands; a text that holds it already is taken as one with such characters.
_WIDE = "\uffff"
#: Pattern of a whole word of a folded text.
WORD = "(?<![0-9a-z])%s(?![0-9a-z])"


def fold(c: Column) -> Column:
    """Compatibility-decompose, drop combining marks, lower-case.

    ASCII texts only need ``lower``. Others take one dictionary ``translate``;
    the few characters that expand (ligatures, fractions) are looked up only in
    texts that hold one. Inside ``bind`` the dictionary is built once per task.
    """
    # A foldable literal: the optimizer turns it into one constant map.
    table = F.str_to_map(
        F.lit("\1".join(k + "\2" + v for k, v in _EXPANDED.items())), F.lit("\1"), F.lit("\2")
    )

    def mapped(text: Column) -> Column:
        wide = F.array_join(F.transform(F.split(text, ""), lambda ch: F.coalesce(table[ch], ch)), "")
        plain = F.translate(text, _EXPANDED_CHARS + _SOURCE, _WIDE * len(_EXPANDED_CHARS) + _TARGET)
        return F.lower(bind(plain, lambda p: F.when(p.contains(_WIDE), F.translate(wide, _SOURCE, _TARGET)).otherwise(p)))

    text = F.coalesce(c, F.lit(""))
    return bind(text, lambda t: F.when(F.octet_length(t) != F.length(t), mapped(t)).otherwise(F.lower(t)))


def fold_name(c: Column) -> Column:
    """Folded name: letters and single spaces only."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z]+", " "))


def fold_upper(c: Column) -> Column:
    return F.upper(F.trim(fold(c)))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def format_cpf(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{3})(\d{3})(\d{3})(\d{2}).*$", "$1.$2.$3-$4")


def words(folded: Column) -> Column:
    """Distinct alphanumeric words of a folded text."""
    return F.array_distinct(F.split(folded, "[^0-9a-z]+"))


def keyword_target(keyword: str) -> tuple[str, str | None, bool]:
    """Folded keyword, the pattern of a short one with signs inside, and whether it has to be a whole word."""
    target = fold_literal(keyword).strip()
    if len(target) > 5 or " " in target:
        return target, None, False
    if re.fullmatch("[0-9a-z]*", target):
        return target, None, True
    return target, WORD % re.sub(r"([^0-9a-z])", r"\\\1", target), False


def keyword_hit(folded: Column, word_set: Column, keyword: str) -> Column:
    """Short single words match whole words only, longer phrases match as substrings.

    ``word_set`` is ``words(folded)``, computed once per text, so the many short
    keywords cost a set lookup instead of one regular expression each.
    """
    target, pattern, word = keyword_target(keyword)
    return keyword_found(folded, word_set, F.lit(target), F.lit(pattern).cast("string"), F.lit(word))


def keyword_found(folded: Column, word_set: Column, target: Column, pattern: Column, word: Column) -> Column:
    """:func:`keyword_hit` of a keyword that comes as columns, from :func:`keyword_target`."""
    found = folded.contains(target) & (target != "")
    return F.when(word, F.array_contains(word_set, target) & (target != "")).when(pattern.isNull(), found).otherwise(found & F.rlike(folded, pattern))


def fold_literal(value: str) -> str:
    decomposed = unicodedata.normalize("NFKD", value)
    return "".join(c for c in decomposed if not unicodedata.combining(c)).lower()


def names_alike(a: Column, b: Column) -> Column:
    """At least two shared tokens, or all of the shorter name; an empty side passes."""

    def tokens(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.translate(fold(c), ".", " "), r"\s+"), lambda t: t != ""))

    ta, tb = tokens(a), tokens(b)
    shared = F.size(F.array_intersect(ta, tb))
    empty = (F.size(ta) == 0) | (F.size(tb) == 0)
    return empty | (shared >= F.least(F.lit(2), F.size(ta), F.size(tb)))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null, blank nor an empty list."""
    return F.coalesce(*[F.when((c != "") & (c != "[]"), c) for c in cols])
