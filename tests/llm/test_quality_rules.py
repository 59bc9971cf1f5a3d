import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotproof.llm.quality_rules import CUTOFFS, RULES, _binomial_tail, choose_cutoffs, measure, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, dup, len(covered), failed


NAMES = ("n_palavras", "n_caracteres", "n_simbolos", "n_linhas_repetidas", "n_palavras_repetidas", "reprovado_base")


def test_measures_match_brute_force(documento):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a b c d e", "a b c d e " * 3, "x\n\nx\n \nx", "|é#| ação\x0b\x0cfim", "a a a a a a a"]
    texts += ["".join(rng.choices(["um ", "dois\n", "tres\t", "# ", "é | "], k=rng.randint(1, 80))) for _ in range(60)]
    texts.append("certidao negativa " * 3000)
    got = {r["id"]: r for r in measure(documento([(str(i), t) for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[str(i)][n] for n in NAMES) == brute(text), text


@pytest.mark.parametrize("n,k,p", [(500, 0, 0.01), (900, 3, 0.01), (5000, 20, 0.01), (40, 12, 0.3)])
def test_binomial_tail_is_exact(spark, n, k, p):
    row = spark.createDataFrame([(k, n)], "k long, n long").select(_binomial_tail(F.col("k"), F.col("n"), p)).first()
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert row[0] == pytest.approx(math.log(exact), rel=1e-9)


def prose(rng, n=40):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def labelled(documento, spark, good, poor):
    rng = random.Random(1)
    rows = [(i, prose(rng), "pt") for i in range(good)]
    rows += [(good + i, " ".join(w + "***" for w in prose(rng).split()), "pt") for i in range(poor)]
    docs = documento(rows, T.LongType(), idioma=T.StringType())
    labels = spark.createDataFrame([(r[0], int(r[0] < good)) for r in rows], "id long, qualidade int")
    return docs, labels


def test_cutoffs_reject_poor_and_keep_good_when_labels_suffice(spark, documento):
    docs, labels = labelled(documento, spark, 1500, 60)
    rows = quality_rules(docs, labels).collect()
    assert {r["mantido"] for r in rows if r["id"] < 1500} == {True}
    assert {r["mantido"] for r in rows if r["id"] >= 1500} == {False}
    assert all("simbolos" in r["regras_violadas"] for r in rows if r["id"] >= 1500)


def test_too_few_labels_leave_only_the_base_rule(spark, documento):
    docs, labels = labelled(documento, spark, 200, 60)
    assert {r["mantido"] for r in quality_rules(docs, labels).collect()} == {True}
    # No cutoff can pass: even no rejection among 200 is likely enough at a rate of 1 %.
    assert 200 * math.log(1 - 0.01) > math.log(0.05 / (len(RULES) * len(CUTOFFS)))


def test_edge_rows(spark, documento):
    rows = [(1, None, None, True), (1, None, None, True), (None, "a " * 20, "pt", None)]
    docs = documento(rows, T.LongType(), idioma=T.StringType(), mantido=T.BooleanType())
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1)], "id long, qualidade int")
    out = quality_rules(docs, labels).collect()
    assert len(out) == 2 + 1 + 0
    assert all(not r["mantido"] for r in out)
    assert quality_rules(docs.limit(0), labels).count() == 0
    assert quality_rules(docs, labels.limit(0)).count() == 3


def test_rules_together_reject_no_more_good_documents_than_one_may(spark):
    def row(i, quality, **high):
        counts = {name: 0 for pair in RULES.values() for name in pair} | {"n_caracteres": 1000, "n_palavras": 1000, "n_linhas": 1000}
        return {"id": i, "idioma": "pt", "qualidade": quality, "reprovado_base": False} | counts | high

    columns = ("n_simbolos", "n_linhas_repetidas", "n_palavras_repetidas", "n_maiusculas", "n_barras")
    n, each = 20_000, 140  # 0.7 % for every rule, 3.5 % for all five
    rows = [row(i, 1, **({columns[i // each]: 950} if i < each * len(columns) else {})) for i in range(n)]
    rows += [row(n + i, 0, **{c: 950}) for i, c in enumerate(columns) for _ in range(40 - 5 * i)]
    got = choose_cutoffs(spark.createDataFrame(rows), "idioma").collect()
    assert [(r["regra"], r["n_recusadas"], r["n_ruins"]) for r in got] == [("simbolos", each, 40)]


def brute_choice(rows, rate_bound=0.01, confidence=0.95):
    """The joint choice in plain Python: {(stratum, rule): cutoff}."""
    levels = lambda r: [sum(1000 * r[a] / max(r[b], 1) > c for c in CUTOFFS) for a, b in RULES.values()]
    strata = {r["idioma"] or "" for r in rows}
    rules, out = list(RULES), {}

    def log_tail(k, n):
        return math.log(math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate_bound) + (n - i) * math.log(1 - rate_bound)) for i in range(k + 1)))

    for s in strata:
        good, poor = ([levels(r) for r in rows if (r["idioma"] or "") == s and r["qualidade"] == q] for q in (1, 0))
        n, error = len(good), math.log((1 - confidence) / len(strata))
        holds = lambda k, share: k < rate_bound * n and log_tail(k, n) <= share
        valid, share = {}, 0.0
        for r in range(len(rules)):
            counts = [(sum(x[r] > c for x in poor), c, sum(x[r] > c for x in good)) for c in range(len(CUTOFFS))]
            distinct = {b for b, _, _ in counts if b > 0}
            share -= math.log(len(distinct) + 1) if distinct else 0.0
            fits = [x for x in counts if n > 0 and x[0] > 0 and holds(x[2], error - math.log(len(rules) * len(CUTOFFS)))]
            if fits:
                valid[r] = sorted(fits, reverse=True)
        taken = {}
        for r in sorted(valid, key=lambda r: (-valid[r][0][0], r)):
            for _, c, _ in valid[r]:
                gone = sum(x[r] > c or any(x[q] > t for q, t in taken.items()) for x in good)
                if holds(gone, error + share):
                    taken[r] = c
                    break
        out.update({(s, rules[r]): CUTOFFS[c] for r, c in taken.items()})
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_joint_choice_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(6000):
        quality = int(rng.random() < 0.9)
        r = {"id": i, "idioma": rng.choice(["pt", "pt", "es", None]), "qualidade": quality, "reprovado_base": False, "n_caracteres": 1000, "n_palavras": 1000, "n_linhas": 1000}
        for top in ("n_simbolos", "n_linhas_repetidas", "n_palavras_repetidas", "n_maiusculas", "n_barras"):
            r[top] = rng.choice([8, 60, 250, 950]) if rng.random() < (0.002 if quality else 0.3) else rng.randint(0, 4)
        rows.append(r)
    got = {(r["estrato"], r["regra"]): r["corte"] for r in choose_cutoffs(spark.createDataFrame(rows), "idioma").collect()}
    want = brute_choice(rows)
    assert got == want and len(want) > 4
