"""Sentences, summaries and normalised labels of the evidence report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal scales and the category map of the domain vocabulary.
RESULT_RANK = {"conforme": 0, "excecao": 1, "bloqueio": 2}
STATUS_BY_RANK = {0: "verde", 1: "atencao", 2: "bloqueado"}
STATUS_RANK = {v: k for k, v in STATUS_BY_RANK.items()}
CATEGORIES_BY_CODE = {
    "01": ["A"],
    "02": ["b", "d"],
    "03": ["a", "b"],
    "04": ["d", "f", "g"],
    "05": [],
    "06": ["h"],
    "07": ["e", "f"],
}


def lookup(c: Column, table: dict, default=None) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(c == F.lit(key), F.lit(value)) if out is None else out.when(c == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default))


def result_rank(c: Column) -> Column:
    return lookup(c, RESULT_RANK, 0)


def result_name(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in RESULT_RANK.items()})


def status_name(rank: Column) -> Column:
    return lookup(rank, STATUS_BY_RANK)


def leg(perna: Column, codigo: Column) -> Column:
    """Stored leg when valid, else by check code, else B."""
    stored = F.upper(F.trim(perna))
    return F.when(stored.isin("A", "B"), stored).when(codigo == "01", "A").otherwise("B")


def severity(c: Column) -> Column:
    value = F.upper(F.trim(c))
    return F.when(value.isin("B", "F"), value).otherwise("")


def categories(categoria: Column, codigo: Column) -> Column:
    """Category letters of a check row, falling back to its code."""
    listed = F.filter(F.split(F.coalesce(categoria, F.lit("")), "[,;/ ]+"), lambda p: p != "")
    fallback = F.create_map(
        *[x for k, v in CATEGORIES_BY_CODE.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]
    )[codigo]
    return F.when(F.size(listed) > 0, listed).otherwise(F.coalesce(fallback, F.array().cast("array<string>")))


def sentence(compared: Column, base: Column, when: Column, result: Column, conclusion: Column) -> Column:
    """Five-part check report. The consultation date is mandatory: null fails the job."""
    day = F.coalesce(
        F.date_format(when, "yyyy-MM-dd"), F.raise_error(F.lit("a check report needs its date")).cast("string")
    )
    return F.format_string(
        "Comparado: %s. Base consultada: %s. Data da consulta: %s. Resultado: %s. Conclusao: %s",
        compared, base, day, result, conclusion,
    )


def shorten(c: Column, limit: int | None = None) -> Column:
    """The trimmed text; with a ``limit``, cut at a sentence end past the middle, else at a word boundary."""
    text = F.trim(F.coalesce(c, F.lit("")))
    if limit is None:
        return text
    piece = F.substring(text, 1, limit)
    back = F.reverse(piece)
    stop_at = F.locate(" .", back)
    space_at = F.locate(" ", back)
    stop = F.when(stop_at > 0, F.lit(limit - 1) - stop_at).otherwise(-1)
    space = F.when(space_at > 0, F.lit(limit) - space_at).otherwise(limit - 1)
    keep = F.when(stop > limit * 0.5, stop + 1).otherwise(space)
    cut = F.rtrim(F.substring(piece, F.lit(1), keep.cast("int")), F.lit(" ,;"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(" […]")))


def evidence_line(c: Column, limit: int | None = None, raw_limit: int | None = None) -> Column:
    """Evidence JSON as ``k = v; …``, up to ``limit`` characters; text that is no object as it is, up to ``raw_limit``."""
    fields = F.from_json(c, "map<string,string>")

    def head(text: Column, most: int | None) -> Column:
        return text if most is None else F.substring(text, 1, most)

    pairs = F.transform(F.map_entries(fields), lambda e: F.concat_ws(" = ", e["key"], e["value"]))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "")
        .when(fields.isNull(), head(c, raw_limit))
        .otherwise(head(F.array_join(pairs, "; "), limit))
    )
