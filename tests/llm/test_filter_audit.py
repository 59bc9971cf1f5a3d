"""Audit of filters against counting row by row, order by order."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotproof.llm.filter_audit import audit_filters

COLUMNS = ("mantidos", "removidos", "redundantes", "falhas_unicas", "bons_perdidos", "toxicos_perdidos", "shapley")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    out = []
    for i, t, part in rows:
        t = t or ""
        w, f = WORD.findall(t), ""
        f += "A" * (len(w) < 100)
        f += "B" * (100 * len(set(w)) < 80 * len(w))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        f += "D" * bool(re.search("[#$%&*|]", t))
        f += "E" * (i is not None and smallest[t] < i)
        out.append((i, part or "", f))
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    failed, out = failures(rows), {}
    shapley = {}
    for part in {p for _, p, _ in failed}:
        own = [(i, f) for i, p, f in failed if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                redundant = sum(letter in f for _, f in own) - len(gone)
                alone = sum(f == letter for _, f in own)
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def check(spark, documento, rows, labels, **more):
    docs = documento([(i, t, p, *[None] * len(more)) for i, t, p in rows], T.LongType(), idioma=T.StringType(), **more)
    said = spark.createDataFrame(labels, "id long, qualidade int, toxico int")
    out = audit_filters(docs, said).collect()
    got = {(r["parte"], r["ordem"], r["passo"]): tuple(r[c] for c in COLUMNS) for r in out}
    assert len(got) == len(out) and got == brute(rows, labels)


def test_all_orders_match_brute_force(spark, documento):
    rng = random.Random(4)

    def text():
        w = [rng.choice(["Lote", "AÇÃO", "a", "de", "#", "100 %", "pé"]) + str(rng.randint(0, rng.choice([3, 900]))) for _ in range(rng.choice([5, 99, 100, 130]))]
        return " ".join(w)

    texts = [text() for _ in range(40)] + ["", None, " ", "ABC " * 120, "palavra " * 30_000]
    rows = [(i, rng.choice(texts), rng.choice(["pt", "en", None, ""])) for i in range(150)]
    rows += rows[:5] + [(3, rng.choice(texts), "pt"), (None, texts[0], "pt"), (None, texts[0], "pt")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)]
    labels += [(4, 1, 0), (4, 1, 1), (None, 1, 1), (999, 1, 1)]
    check(spark, documento, rows, labels, chave=T.StringType(), n=T.LongType(), antes=T.LongType())


def test_copies_alone(spark, documento):
    good = " ".join(f"palavra{i}" for i in range(100))
    check(spark, documento, [(i, good, "pt") for i in range(60)] + [(0, good, "pt")], [(59, 1, 1)])


def test_zeros_are_rows_and_an_empty_table_has_none(spark, documento):
    good = " ".join(f"palavra{i}" for i in range(100))
    check(spark, documento, [(1, good, "pt")], [])
    docs = documento([], T.LongType(), idioma=T.StringType())
    assert audit_filters(docs, spark.createDataFrame([], "id long, qualidade int, toxico int")).count() == 0


def test_own_filters_and_part(spark, documento):
    docs = documento([(1, "laudo", "CAR"), (2, "laudo", "CAR"), (3, "", None)], T.LongType(), tipo=T.StringType())
    out = audit_filters(docs, spark.createDataFrame([(2, 1, 0)], "id long, qualidade int, toxico int"), "tipo", {"V": F.col("texto") == ""})
    got = {(r["parte"], r["ordem"], r["passo"]): (r["mantidos"], r["removidos"], r["bons_perdidos"]) for r in out.collect()}
    assert got["CAR", "VE", 1] == (2, 0, 0) and got["CAR", "VE", 2] == (1, 1, 1) and got["", "EV", 2] == (0, 1, 0) and len(got) == 8
