import random
import re

import pytest
from pyspark.sql import types as T

from plotproof.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (id_, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, id_), id_)
    out = []
    for (id_, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < id_:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["lote", "talhão", "kg", "cacau", "CAR", "é"]
    passages = [rng.choices(vocabulary, k=k) for k in (8, 9, 12, 30, 60)]
    texts = []
    for _ in range(50):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.random()}" for _ in range(rng.randint(1, 15))]
        texts.append(rng.choice([" ", "\n", "\t  "]).join(w))
    return texts + texts[:5] + ["lote " * 500, "lote " * 40, None, "", " \x0b\x0c "]


@pytest.mark.parametrize("seed,lot,window", [(1, 2_000_000, 8), (2, 300, 8), (3, 1, 9), (4, 500, 2)])
def test_matches_brute_force(documento, seed, lot, window):
    rows = [(f"d{i:03}", t) for i, t in enumerate(corpus(seed))]
    random.Random(seed).shuffle(rows)
    got = {r["id"]: r for r in dedup_substrings(documento(rows), window, lot, 4 * lot).collect()}
    for (id_, _), want in zip(rows, brute(rows, window), strict=True):
        r = got[id_]
        assert (r["n_palavras"], r["n_removidas"], r["texto"]) == want
        assert sum(t["fim"] - t["inicio"] for t in r["trechos"]) == want[1]
        assert all(a["fim"] < b["inicio"] for a, b in zip(r["trechos"], r["trechos"][1:]))


def test_numeric_order_nulls_repeated_ids(documento):
    text = "um dois tres quatro"
    rows = [(10, text, 1), (9, text, 2), (None, text, 3), (9, text, 4), (9, text + " cinco", 5), (None, None, 6)]
    out = dedup_substrings(documento(rows, T.LongType(), n_palavras=T.IntegerType()), 3).collect()
    assert sorted((r["id"] or 0, r["texto"]) for r in out) == sorted(
        [(10, ""), (9, text), (0, ""), (9, text), (9, text + " cinco"), (0, "")]
    )
    assert dedup_substrings(documento(rows, T.LongType(), x=T.IntegerType()).limit(0), 3).count() == 0
