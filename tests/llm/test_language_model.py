import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from plotproof.llm import language_model as L


def corpus(seed, n=150):
    rng = random.Random(seed)
    order = {"lote": "de", "de": "cacau", "cacau": "em", "em": "kg", "kg": "lote"}
    texts = []
    for _ in range(n):
        w = [rng.choice(list(order))]
        for _ in range(rng.randint(3, 60)):
            w.append(order[w[-1]] if w[-1] in order and rng.random() < 0.9 else rng.choice(["Talhão", "lote", f"r{rng.randint(0, 40)}"]))
        texts.append(" ".join(w))
    return texts + ["", None, " \n", "nunca visto antes"]


@pytest.mark.parametrize("lot", [4_000_000, 700])
def test_counts_match_brute_force_and_the_model_learns(documento, lot):
    texts = corpus(1)
    train = [i % 5 != 0 for i in range(len(texts) - 1)] + [None]
    rows = [(str(i), t, y) for i, (t, y) in enumerate(zip(texts, train))]
    got = {r["id"]: r for r in L.score_texts(documento(rows, treino=T.BooleanType()), caracteres_por_lote=lot, caracteres_por_balde=2 * lot).collect()}
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    counts = Counter(x for t, y in zip(tokens, train) if y for x in t)
    total, distinct = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        r = got[str(i)]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in t)
        assert (r["n_palavras"], r["n_conhecidas"], r["total_treino"]) == (len(t), sum(counts[x] > 0 for x in t), total)
        assert r["nota_base"] == pytest.approx(base) and math.isfinite(r["nota"]) and r["nota"] < 0
        assert r["treino"] == bool(train[i])
    held = [got[str(i)] for i in range(len(texts)) if not train[i] and len(tokens[i]) > 5]
    assert sum(r["nota"] for r in held) > 0.8 * sum(r["nota_base"] for r in held)


def model(texts, seed=0):
    """A model with counts of some texts and random weights, without Spark."""
    t = L.tokens_of([x.encode() for x in texts])
    n, v = (np.zeros((L.CLASSES, L.MEMBERS), np.int64) for _ in range(2))
    seen = {}
    for h, c, g in zip(t.hash.tolist(), t.cls.tolist(), t.group.tolist()):
        seen.setdefault(h, [0, c, g])[0] += 1
    heads = {}
    for h, (k, c, g) in sorted(seen.items(), key=lambda x: -x[1][0]):
        slot = sum(1 for x in heads.values() if x[0] == c)
        if k > 2 and slot < L.HEADS:
            heads[h] = (c, slot)
            n[c, slot] += k
        else:
            n[c, L.HEADS + g] += k
            v[c, L.HEADS + g] += 1
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.3, (1 << b, L.ROW)).astype(np.float32) for b in (L.CLASS_BITS, L.MEMBER_BITS)]
    names = np.array(sorted(heads), np.uint64)
    return L.Model(int(n.sum()), int(v.sum()), n, v, names, np.array([heads[int(x)][1] for x in names]), *weights), seen


def test_probabilities_of_the_whole_vocabulary_add_up_to_one():
    texts = [t for t in corpus(3, 40) if t]
    m, seen = model(texts)
    context = "lote de cacau".encode()
    t = L.tokens_of([context])
    total = 0.0
    for h, (k, c, g) in seen.items():
        # The third token is exchanged for every known one in turn.
        t.hash[2], t.tail[2] = np.uint64(h), np.uint64(c + L.CLASSES * g)
        total += math.exp(L.log_probabilities(m, t, np.array([0.0, 0.0, k, 0.0]))[2])
    for c in range(L.CLASSES):
        for g in range(L.GROUPS):  # one unknown token of each group
            t.hash[2], t.tail[2] = np.uint64(1), np.uint64(c + L.CLASSES * g)
            total += math.exp(L.log_probabilities(m, t, np.zeros(4))[2])
    assert total == pytest.approx(1, abs=1e-4)


def test_context_stays_inside_a_text():
    alone = L.context(L.tokens_of([b"um dois tres"]))
    after = L.context(L.tokens_of([b"outro texto", b"um dois tres"]))
    assert (alone == after[3:]).all()
    assert len(np.unique(alone[:, 0])) == 4


def test_empty_table_repeated_rows_and_no_training(documento):
    rows = [("a", "um dois", False), ("a", "um dois", False), (None, None, None)]
    docs = documento(rows, treino=T.BooleanType())
    out = L.score_texts(docs).collect()
    assert [r["total_treino"] for r in out] == [0, 0, 0] and all(r["n_conhecidas"] == 0 for r in out)
    assert sorted(r["n_palavras"] for r in out) == [1, 3, 3]
    assert L.score_texts(docs.limit(0)).count() == 0
