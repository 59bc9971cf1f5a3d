import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from plotproof.llm.packing import combinations_for, pack, packing_plan, solve_repeats

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def check(rows, encoded, size):
    """Every id in one piece, sums right, sequences gapless and within the size."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        ids = encoded[r["id"]]
        piece = ids[r["inicio"] : r["inicio"] + r["comprimento"]]
        assert len(piece) == r["comprimento"] > 0 and r["n_tokens"] == len(ids)
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["crc32"]
        by_sequence.setdefault(r["sequencia"], []).append((r["posicao"], r["comprimento"]))
        by_doc.setdefault(r["id"], []).append((r["inicio"], r["comprimento"]))
    for parts in [*by_sequence.values(), *by_doc.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert all(sum(n for _, n in p) <= size for p in by_sequence.values())
    assert {k: sum(n for _, n in p) for k, p in by_doc.items()} == {k: len(v) for k, v in encoded.items()}
    return len(by_sequence)


WORDS = ["Talhão", "cacau!", "don't", "12345", "日本語", "á", "l'été", "TALHÃO", "Ifé", "x" * 90, " ", "\x1f"]
MARKED = ["H\u0331I\u0307", "t\u0308", "T\u0308", "E\u0301"]
SPECIAL = ["<|endoftext|>", "<|ENDOFTEXT|>"]


@pytest.mark.parametrize("vocabulary", [WORDS, WORDS + MARKED, WORDS + SPECIAL])
@pytest.mark.parametrize("whole", [False, True])
def test_round_trip(documento, whole, vocabulary):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 90))) for _ in range(60)] + ["", None, " \n\t", "kg " * 500]
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    encoded = {str(i): tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    rows = pack(documento([(str(i), t) for i, t in enumerate(texts)]), PATH, 2, 256, por_texto=whole).collect()
    used = check(rows, encoded, 256)
    assert used <= -(-sum(map(len, encoded.values())) // 256) + 2


def test_repeated_rows_empty_table_and_extra_columns(documento):
    rows = [(None, None, 1), (None, None, 1), ("a", "lote", 2), ("a", "lote", 2)]
    docs = documento(rows, comprimento=T.LongType())
    out = pack(docs, PATH, 2, 16).collect()
    assert len(out) == 4 and len({(r["sequencia"], r["posicao"]) for r in out}) == 4
    assert pack(docs.limit(0), PATH, 2, 16).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_up(seed):
    rng = np.random.default_rng(seed)
    size = 128
    lengths = rng.integers(1, size + 1, 5000) if seed % 2 else np.minimum(rng.geometric(0.03, 5000), size)
    counts = np.bincount(lengths, minlength=size + 1)
    plan = packing_plan(counts, size)
    used = np.zeros(size + 1, np.int64)
    for fill, times in plan:
        assert sum(fill) <= size and times > 0
        for n in fill:
            used[n] += times
    assert (used == counts).all()
    sequences = sum(times for _, times in plan)
    best = lengths.sum() / size
    halves = counts[size // 2 + 1 :].sum()  # no two of these share a sequence
    assert sequences <= 1.03 * max(best, halves) + 2


def test_least_squares_solution_is_optimal():
    counts = np.zeros(101, np.int64)
    counts[[30, 70, 20, 50]] = [40, 40, 60, 30]
    combos = combinations_for(counts, 100)
    assert {tuple(sorted(c[c > 0].tolist())) for c in combos} == {(30, 70), (50, 50), (20, 30, 50)}
    x = solve_repeats(combos, counts)
    used = np.zeros(101)
    for c, times in zip(combos, x):
        for n in c[c > 0]:
            used[n] += times
    slope = np.array([(used - counts)[c[c > 0]].sum() for c in combos])
    # The conditions of the least squares solution under x >= 0.
    assert (x >= 0).all() and (slope > -0.5).all() and np.abs(slope * x).max() < 20
