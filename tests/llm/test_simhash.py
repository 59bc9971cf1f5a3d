import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from plotproof.llm.simhash import fingerprint, fingerprint_links, near, near_duplicates, pair_links, planes_of, spread_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, radius):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin(int(a) ^ int(values[j])).count("1") <= radius:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(values))]


def test_fingerprints_match_brute_force():
    rng = random.Random(1)
    texts = ["", "um", "Um dois", "a b c d", "a b c d e", "É É É É É"]
    texts += [" \n".join(rng.choices(["lote", "Talhão", "kg", "7"], k=k)) for k in (3, 9, 200)]
    for t in texts:
        assert fingerprint(t.encode(), 4) % 2**64 == brute_print(t)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_carry_save_distances(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 2**63, 200, dtype=np.uint64)
    values[100:] = values[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    query = values[0] ^ np.uint64(0b1011)
    mask = near(planes_of(values ^ query), radius, (4,))
    got = np.unpackbits(mask.view(np.uint8), bitorder="little")[:200].astype(bool)
    assert (got == (np.bitwise_count(values ^ query) <= radius)).all()


def clustered(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 8)]
    out = set()
    while len(out) < n:
        v = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 7)):
            v ^= 1 << b
        out.add(v)
    return np.array(sorted(out), np.uint64)


def test_small_and_large_buckets_agree_with_brute_force():
    values = clustered(400, 4)
    want = groups(values, 4)
    parent = list(range(400))
    for a, b in spread_links(values, 4):
        parent[a] = b
    assert [min(k for k in range(400) if parent[k] == parent[i]) for i in range(400)] == want
    a, b = pair_links(values[:40], np.array([0, 25, 40]), 4)
    found = {(i, j) for i, j in zip(a.tolist(), b.tolist())}
    assert found == {
        (i, j) for i in range(40) for j in range(i + 1, 40) if (i < 25) == (j < 25) and np.bitwise_count(values[i] ^ values[j]) <= 4
    }


@pytest.mark.parametrize("tile", [20_000, 10])
def test_links_connect_all_near_pairs(spark, tile):
    values = clustered(300, 9)
    signed = values.view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in signed], "impressao long")
    links = [(r["a"], r["b"]) for r in fingerprint_links(df, 4, max_balde=tile).collect()]
    at = {int(v): i for i, v in enumerate(signed)}
    parent = list(range(300))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(at[a]), root(at[b])))
        assert np.bitwise_count(values[at[a]] ^ values[at[b]]) >= 0
        parent[y] = x
    assert [root(i) for i in range(300)] == groups(values, 4)


def test_groups_match_brute_force(documento):
    rng = random.Random(7)
    base = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=120)) for _ in range(12)]
    texts = base + [b.replace(b.split()[60], "outra", 1) for b in base] + [b.upper() for b in base[:4]] + ["", None, " \n"]
    docs = documento([(i * 7 % 100, t) for i, t in enumerate(texts)], T.LongType())
    got = {r["id"]: r for r in near_duplicates(docs).collect()}
    prints = [brute_print(t) for t in texts]
    ids = [i * 7 % 100 for i in range(len(texts))]
    root = groups(np.array(prints, np.uint64), 4)
    for i, id_ in enumerate(ids):
        assert got[id_]["impressao"] % 2**64 == prints[i]
        assert got[id_]["grupo"] == min(x for x, r in zip(ids, root) if r == root[i])
    kept = [r["id"] for r in got.values() if r["representa"]]
    assert sorted(kept) == sorted({min(x for x, r in zip(ids, root) if r == k) for k in root})


def test_repeated_ids_nulls_and_empty_table(documento):
    rows = [("a", "um dois tres quatro cinco"), ("a", "um dois tres quatro cinco"), ("a", "outro texto bem diferente aqui"), (None, None)]
    out = near_duplicates(documento(rows)).collect()
    assert len(out) == 4 and {r["grupo"] for r in out} == {"a", None}
    assert all(r["representa"] for r in out)
    assert near_duplicates(documento(rows).limit(0)).count() == 0
