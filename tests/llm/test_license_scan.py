"""License scan against word-by-word search and edited wordings."""

import random
import re

import pytest
from pyspark.sql import types as T

from plotproof.llm.license_scan import PHRASES, TEMPLATES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("n_palavras", "n_frases", "primeira", "ultima", "rotulos_frases")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(text):
    w = words(text)
    places = [(i, label) for label, p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted({label for _, label in places})


def check(documento, rows, **more):
    out = {}
    for r in scan_licenses(documento(rows, **more)).collect():
        out.setdefault(r["id"], []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    for i, text, *_ in rows:
        for r in out[i]:
            assert tuple(r[c] for c in COLUMNS) == brute(text), text
            assert set(r["rotulos_frases"]) <= set(r["rotulos"]) and r["rotulos"] == sorted(set(r["rotulos"]))
            assert 0 <= r["nota"] <= 1 and (r["nota"] > 0) == bool(r["rotulos"])
    return {i: found[0] for i, found in out.items()}


def test_phrases_match_brute_force(documento):
    rng = random.Random(2)
    texts = [None, "", " .,;\n", "cc", "CC BY", "cc-by", "ccby", "cc  by-cc/by cc by", "éall rights reserved", "ALL. Rights, RESERVED all rights"]
    texts += [" ".join(rng.choices(["cc", "by", "general", "public", "license", "all", "rights", "reserved", "ação", "2.0"], k=rng.randint(1, 60))) for _ in range(60)]
    texts.append("palavra " * 60_000 + "All rights reserved. " + "outra, " * 60_000)
    rows = [(str(i), t) for i, t in enumerate(texts)]
    check(documento, rows)


@pytest.mark.parametrize("label,text", TEMPLATES)
def test_whole_wordings_are_found(documento, label, text):
    row = check(documento, [("a", "Notas da cooperativa. " + text.upper().replace(" ", ",\n ") + ". Fim do documento.")])["a"]
    assert label in row["rotulos"] and row["nota"] == 1.0


def test_edited_wordings_are_one_span(documento):
    text = next(t for r, t in TEMPLATES if r == "mit" and len(t.split()) > 20)
    w = text.split()
    put_in = w[:10] + ["hereby", "also"] + w[10:]
    left_out = w[:8] + w[10:]
    half, words_only = w[: len(w) // 2], sorted(w)
    far = w[: len(w) // 2] + ["palavra"] * 80 + w[len(w) // 2 :]
    rows = [(n, " ".join(x)) for n, x in (("in", put_in), ("out", left_out), ("half", half), ("sorted", words_only), ("far", far))]
    out = check(documento, rows)
    assert {i for i, r in out.items() if "mit" in r["rotulos"]} == {"in", "out"}
    assert out["in"]["nota"] == 1.0 and out["out"]["nota"] >= 0.75


def test_own_wordings(documento):
    found = scan_licenses(documento([("a", "sob a licença de uso da cooperativa, versão 2")]), modelos=(("coop", "licença de uso da cooperativa"),), frases=())
    row = found.first()
    assert row["rotulos"] == ["coop"] and row["nota"] == 1.0 and row["n_frases"] == 0


def test_repeated_rows_nulls_and_clashing_columns(documento):
    rows = [("a", "cc by cc by", 7, "x"), ("a", "cc by cc by", 7, "x"), ("a", "nada", 7, "x"), (None, "all rights reserved", 7, None), (None, None, None, None)]
    docs = documento(rows, linha=T.LongType(), rotulos=T.StringType())
    got = sorted((repr(r["id"]), r["n_palavras"], r["n_frases"]) for r in scan_licenses(docs).collect())
    assert got == sorted([("'a'", 4, 2), ("'a'", 4, 2), ("'a'", 1, 0), ("None", 3, 1), ("None", 0, 0)])
    assert scan_licenses(docs.limit(0)).count() == 0


def test_no_python_worker_on_the_main_path(documento, spark):
    from plotproof.llm import license_scan as L

    source = open(L.__file__).read()
    assert not any(x in source for x in ("mapIn", "applyIn", "udf", "pandas", "pyarrow", ".rdd", "collect()"))
