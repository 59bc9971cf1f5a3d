"""Prefix trie of event histories against a plain Python trie."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import types as T

from plotproof.llm import history_trie as H

COLUMNS = ("no", "nivel", "pai", "n_historias", "n_filhos", "n_folhas", "poupados", "fins_sha256")


def evento(spark, rows, kind=None):
    schema = T.StructType(
        [T.StructField("entidade_id", kind or T.StringType()), T.StructField("timestamp", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("ator", "detalhe")]
    )
    return spark.createDataFrame(rows, schema)


def brute_branch(rows, plan):
    own = {}
    for e, t, a, d in rows:
        if e is not None:
            own.setdefault(e, []).append(((t is not None, t or 0), a or "", d or ""))
    own = {e: [x[1:] for x in sorted(v)] for e, v in own.items()}
    return {e: own.get(o, [])[: h or 0] + own.get(e, [])[h or 0 :] for e, o, h in plan}


def brute(histories):
    members = {}
    for e, h in histories.items():
        for d in range(len(h) + 1):
            members.setdefault(tuple(h[:d]), []).append(e)
    out = set()
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        childless = [q for q in below if not any(r[:-1] == q and len(r) == len(q) + 1 for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(e) for e in sorted(ids) if len(histories[e]) == len(p))
        children = sum(len(q) == len(p) + 1 for q in below)
        parent = min(members[p[:-1]]) if p else None
        out.add((min(ids), len(p), parent, len(ids), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def histories(spark, given, kind=None):
    schema = T.StructType([T.StructField("entidade_id", kind or T.StringType()), T.StructField("nivel", T.LongType())])
    schema.add("ator", T.StringType()).add("detalhe", T.StringType())
    rows = [(e, k, *x) for e, h in given.items() for k, x in enumerate([(None, None), *h])]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_perfect_hash_is_minimal_and_checked(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
    table = H.PerfectHash(a, b)
    assert sorted(table.slots(a, b).tolist()) == list(range(n))
    assert (table.slots(a + np.uint64(1), b) == -1).all() and (table.slots(a, b ^ np.uint64(1)) == -1).all()


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        H.PerfectHash(np.array([3, 3], np.uint64), np.array([4, 4], np.uint64))


@pytest.mark.parametrize("shard", [40, 4096])
def test_trie_matches_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(H, "SHARD_ROWS", shard)
    rng = random.Random(3)
    acts = [("sistema", "verificar"), ("humano", "aprovar"), ("humano", "ação"), ("", ""), ("sistema", "")]
    given = {f"lote-{i:03d}": [rng.choice(acts) for _ in range(rng.randint(0, 6))] for i in range(150)}
    given |= {f"zz-{i}": [acts[0], acts[1]] * 3 for i in range(60)}  # one history that many share
    assert got(H.history_trie(histories(spark, given))) == brute(given)


def test_fields_do_not_run_together(spark):
    given = {1: [("ab", "c")], 2: [("a", "bc")], 3: [("a", "bc"), ("x", "y")], 4: [("x", "y"), ("a", "bc")], 5: []}
    assert got(H.history_trie(histories(spark, given, T.LongType()))) == brute(given)


def test_branches_match_brute_force(spark):
    rng = random.Random(9)
    ids = [*range(30), 41, 57, -3]
    rows = [
        (rng.choice(ids), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "sistema", "humano"]), rng.choice([None, "", "criar", "não"]))
        for _ in range(160)
    ]
    rows += [(None, 1, "sistema", "sem entidade")] + rows[:4]  # events of nobody, repeated rows
    present = sorted({r[0] for r in rows if r[0] is not None})
    plan = [(e, e - e % 5, crc32(str(e).encode()) % 9) for e in present] + [(900, 901, 3), (902, present[0], None)]
    branches = spark.createDataFrame(plan, "entidade_id long, origem_id long, herdados long")
    out = H.history_trie(H.branch(evento(spark, rows, T.LongType()), branches))
    assert got(out) == brute(brute_branch(rows, plan))


def test_long_history_many_ends_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK_BYTES", 64)
    given = {i: [("sistema", "a" * (i % 3 == 0))] for i in range(400)}
    given[7] = [("humano", f"passo {k}") for k in range(700)] + [("humano", "texto " * 50_000)]
    frame = histories(spark, given, T.LongType())
    for name in ("a", "b", "bytes", "lote", "no", "membros", "codigo"):
        frame = frame.selectExpr("*", f"'outro' as {name}")
    rows = {(r["no"], r["nivel"]): r for r in H.history_trie(frame).collect()}
    ends = {True: [], False: []}
    for i in range(400):
        if i != 7:
            ends[i % 3 == 0].append(str(i))
    for first, full in ((0, True), (1, False)):
        assert rows[first, 1]["fins_sha256"] == hashlib.sha256(",".join(ends[full]).encode()).hexdigest()
    assert rows[7, 1]["n_folhas"] == 1 and rows[7, 701]["n_filhos"] == 0 and rows[0, 0]["n_folhas"] == 3
    assert rows[0, 0]["poupados"] == len(ends[True]) - 1


def test_empty_table(spark):
    none = histories(spark, {"a": []}).limit(0)
    assert H.history_trie(none).count() == 0
    no_plan = spark.createDataFrame([], "entidade_id string, origem_id string, herdados long")
    assert H.branch(evento(spark, [("a", 1, "x", "y")]), no_plan).count() == 0
