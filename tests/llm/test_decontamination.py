import random
import re

from pyspark.sql import types as T

from plotproof.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window):
    patterns = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for text in texts:
        w, found = words(text), set()
        hit = [False] * len(w)
        for p, of in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    found |= of
                    hit[i : i + len(p)] = [True] * len(p)
        out.append((len(w), sum(hit), sorted(found)))
    return out


def test_matches_brute_force_on_contracts_with_planted_passages(spark, documento):
    rng = random.Random(3)
    vocabulary = ["Lote", "talhão", "cacau", "CAR", "nota", "fiscal", "kg", "2021", "posse", "é"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([14, 25, 10, 3, 1, 0, 12])]
    items += [(7, None), (8, items[0][1])]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)]
    texts += [f"antes, {items[0][1].upper()}; depois", items[1][1], None, "", "!!! ...", " ".join(vocabulary * 400)]
    docs = documento([(str(i), t) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "id long, texto string")
    got = {r["id"]: r for r in decontaminate(docs, bench).collect()}
    for i, (n, hit, found) in enumerate(brute(texts, items, 10)):
        r = got[str(i)]
        assert (r["n_palavras"], r["n_atingidas"], r["itens"]) == (n, hit, found)
        assert sum(t["fim"] - t["inicio"] for t in r["trechos"]) == hit
        assert r["contaminado"] == (hit > 0) and r["n_itens"] == len(found)


def test_empty_tables_extra_columns_and_repeated_rows(spark, documento):
    none = spark.createDataFrame([], "id long, texto string")
    docs = documento([("a", "x y", 5), ("a", "x y", 5), (None, None, None)], n_palavras=T.LongType())
    rows = decontaminate(docs, none).collect()
    assert [r["n_atingidas"] for r in rows] == [0, 0, 0]
    assert sorted(r["n_palavras"] for r in rows) == [0, 2, 2]
    assert decontaminate(docs.limit(0), none).count() == 0


def test_refuses_item_sets_beyond_the_bound(spark, documento):
    import pytest

    bench = spark.createDataFrame([(1, "um dois tres")], "id long, texto string")
    with pytest.raises(ValueError):
        decontaminate(documento([("a", "x")]), bench, max_caracteres=5)
