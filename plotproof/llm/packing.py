"""Packing of tokenised documents into sequences of one size.

A document is cut into whole sequences and a rest. How the rests go together is
solved on the histogram of their lengths alone: combinations of two or three
lengths that fill a sequence are enumerated, non-negative least squares tells how
often to use each, and what rounding leaves is packed greedily. The histogram
and the plan are bounded by the sequence size, not by the number of documents.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotproof.llm import batches as B
from plotproof.session import materialise

#: Words a worker remembers the ids of, some 40 bytes a word in flat arrays, and ids it holds a word on average.
REMEMBERED = 1 << 19
IDS_A_WORD = 8
SLICE_BYTES = 1 << 20
DENSE = 48
ROUNDS = 300


class _Memory:
    """Token ids of known words in flat arrays: two 64-bit hashes, place and number of the ids, last use.

    New words gather beside the sorted ones and are merged when they are many. When words
    or ids outgrow their bounds, the half used least recently goes.
    """

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.key, self.check = (np.zeros(0, np.uint64) for _ in range(2))
        self.first, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, "<u4")
        self.new, self.clock = [], 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Place of each word, -1 where it is unknown."""
        if not len(self.key):
            return np.full(len(key), -1)
        self.clock += 1
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        at = np.where((self.key[at] == key) & (self.check[at] == check), at, -1)
        self.used[at[at >= 0]] = self.clock
        return at

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.new.append((key, check, ids, size))
        fresh = sum(len(n[0]) for n in self.new)
        if fresh > 4096 + len(self.key) // 16:
            self._merge()

    def _merge(self) -> None:
        key, check, ids, size = (np.concatenate(c) for c in zip(*self.new, strict=True))
        self.new = []
        key, check = np.concatenate([self.key, key]), np.concatenate([self.check, check])
        first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        size, used = np.concatenate([self.size, size]), np.concatenate([self.used, np.full(len(size), self.clock)])
        ids = np.concatenate([self.ids, ids])
        keep = np.unique(key, return_index=True)[1]  # of two words of one hash, one is remembered
        if len(keep) > self.most or size[keep].sum() > self.most * IDS_A_WORD:
            keep = np.sort(keep[np.argsort(-used[keep], kind="stable")[: len(keep) // 2]])
            keep = keep[np.argsort(key[keep], kind="stable")]
        self.key, self.check, self.size, self.used = key[keep], check[keep], size[keep], used[keep]
        self.first = np.cumsum(self.size) - self.size
        self.ids = ids[_ranges(first[keep], self.size)]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges first, first + 1, ... of the given sizes, one after another."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - size), size)


class _Encoder:
    """Token ids of texts; a word between ASCII blanks is encoded once while it is remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its words in a row; ``whole`` encodes texts as they are, for tokenizers
    of another kind. Words are told apart by two 64-bit hashes.
    """

    def __init__(self, path: str, whole: bool, most: int = REMEMBERED):
        # A task is one core's work; the library's own threads would only spin.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.whole, self.memory = whole, _Memory(most)
        described = json.loads(tokenizer.to_str())
        self.lowers = "Lowercase" in re.findall('"type": ?"([A-Za-z]+)"', json.dumps(described["normalizer"]))
        self.special = [t["content"].lower().encode() for t in described["added_tokens"]]

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their numbers."""
        flat, sizes = [], []
        for i in range(0, len(texts), 8192):
            coded = [c.ids for c in self.encode([t.decode() for t in texts[i : i + 8192]], add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(coded), "<u4"))
            sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
        return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((flat, "<u4"), (sizes, np.int64)))

    def _may_lower(self, texts: list[bytes]) -> bool:
        """Whether A-Z may be lower-cased beforehand, which makes fewer words distinct.

        Only if the tokenizer does so itself, and no special token, which it looks for
        before, nor a combining mark, which could compose with a small letter alone, is near.
        """
        if not self.lowers or any(mark in t for t in texts for mark in (b"\xcc", b"\xcd")):
            return False
        return not any(special in t.lower() for special in self.special for t in texts)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.whole:
            ids, sizes = self._ids(texts)
            return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []
        words = B.words_of(texts, B.LOWER if self._may_lower(texts) else B.PLAIN)
        hashes, check = words.hashes(), words.hashes(1)
        _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not (check[at][which] == check).all():  # two words of one hash: tell all words apart by themselves
            at, which = np.arange(len(hashes)), np.arange(len(hashes))
        key, other, memory = hashes[at], check[at], self.memory
        place = memory.find(key, other)
        known, missing = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        data = words.data
        spans = zip(words.start[at[missing]].tolist(), words.end[at[missing]].tolist(), strict=True)
        new, size = self._ids([data[a:b].tobytes() for a, b in spans])
        sizes, first = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        sizes[known], first[known] = memory.size[place[known]], memory.first[place[known]]
        sizes[missing], first[missing] = size, len(memory.ids) + np.cumsum(size) - size
        table = np.concatenate([memory.ids, new])
        ids = table[_ranges(first[which], sizes[which])]
        if len(missing):
            memory.add(key[missing], other[missing], new, size)
        bounds = np.concatenate([[0], np.cumsum(sizes[which])])[words.first].tolist()
        return [ids[a:b] for a, b in pairwise(bounds)]


@cache
def _encoder(path: str, whole: bool, most: int) -> _Encoder:
    """One for all tasks of a worker process, so that what it remembers outlives a task."""
    return _Encoder(path, whole, most)


def combinations_for(counts: np.ndarray, size: int) -> np.ndarray:
    """Length combinations that fill ``size`` exactly: all pairs, and triples of the most frequent lengths.

    Rows of three lengths, 0 for none; only lengths that occur.
    """
    have = counts > 0
    have[0] = False
    low = np.flatnonzero(have[: size // 2 + 1])
    pairs = low[have[size - low]]
    rows = [np.stack([pairs, size - pairs, np.zeros_like(pairs)], axis=1)]
    dense = np.sort(np.argsort(-counts, kind="stable")[:DENSE])
    dense = dense[have[dense]]
    a, b = (x.ravel() for x in np.meshgrid(dense, np.flatnonzero(have), indexing="ij"))
    c = size - a - b
    ok = (a <= b) & (c >= b)
    ok[ok] = have[c[ok]]
    rows.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
    return np.concatenate(rows)


def solve_repeats(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative least squares: repeats x minimising |A x - counts|, by accelerated projected gradient."""
    if not len(combos):
        return np.zeros(0)
    n = len(counts)

    def apply(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, k], weights=x, minlength=n) for k in range(3))
        out[0] = 0
        return out

    degree = apply(np.ones(len(combos)))
    step = 1.0 / (3 * max(degree.max(), 1))
    target = counts.astype(float)
    target[0] = 0
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(ROUNDS):
        rest = apply(y) - target
        new = np.maximum(y - step * rest[combos].sum(axis=1), 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def packing_plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, repeats) that use up a histogram of lengths exactly.

    ``counts[n]``: pieces of length n, up to ``size``. Each greedy step uses up a length
    or halves into a smaller fill, so the plan has a few rows per length.
    """
    left = counts.copy()
    plan = []
    if left[size]:
        plan.append(((size,), int(left[size])))
        left[size] = 0
    combos = combinations_for(left, size)
    repeats = np.rint(solve_repeats(combos, left)).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable").tolist():
        lengths, often = np.unique(combos[i][combos[i] > 0], return_counts=True)
        times = int(min(repeats[i], (left[lengths] // often).min()))
        if times > 0:
            left[lengths] -= times * often
            plan.append((tuple(sorted(combos[i][combos[i] > 0].tolist(), reverse=True)), times))
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return plan
        room, fill = size, []
        used: dict[int, int] = {}
        while True:
            fits = present[: np.searchsorted(present, room, "right")]
            fits = fits[::-1]
            pick = next((int(n) for n in fits if left[n] > used.get(int(n), 0)), 0)
            if not pick:
                break
            fill.append(pick)
            used[pick] = used.get(pick, 0) + 1
            room -= pick
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
        plan.append((tuple(fill), times))


def _slots(plan: list[tuple[tuple[int, ...], int]], size: int):
    """Sorted by length and first rank: the slot (first sequence, offset) of every stretch of equal pieces."""
    used = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(documento: DataFrame, tokenizador: str, fim: int, tamanho: int = 4096, por_texto: bool = False, lembradas: int = REMEMBERED) -> DataFrame:
    """Pieces of all ``documento`` rows (``id``, ``texto``) in sequences of at most ``tamanho`` tokens.

    ``tokenizador``: path of a tokenizer file that every executor can read; ``fim``: id
    appended to every document; ``por_texto`` encodes texts as wholes, which tokenizers
    that keep white space need; ``lembradas``: words a worker remembers at most. Returns per piece ``id``, ``inicio`` (the document's ids
    before it), ``comprimento``, ``crc32`` (of its ids, unsigned, little-endian 32-bit),
    ``n_tokens`` (of the document, with the end), ``sequencia`` and ``posicao`` in it.

    Null and empty texts are one end token. Every id lies in exactly one piece; rows of a
    repeated id are packed each for itself. An empty table gives no rows; further input
    columns are ignored.

    Texts are read once and give pieces; only these are shuffled. The driver sees the
    histogram of ``tamanho`` lengths, and the plan it sends out is bounded by it. Ranks
    among equal lengths are counted within salts, so a length that a large part of all
    documents share is spread over many tasks.
    """
    kind = documento.schema["id"].dataType.simpleString()

    def cut(rows):
        encode = _encoder(tokenizador, por_texto, lembradas)
        for batch in rows:
            texts = B.utf8(batch.column("texto"))
            owner, cols = [], ([], [], [], [])
            for a, b in B.slices(texts, SLICE_BYTES):
                for i, ids in enumerate(encode(texts[a:b]), a):
                    ids = np.append(ids, np.array([fim], "<u4"))
                    for start in range(0, len(ids), tamanho):
                        piece = ids[start : start + tamanho]
                        owner.append(i)
                        for col, v in zip(cols, (start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owner, pa.int32())), *[pa.array(c, pa.int64()) for c in cols]],
                names=["id", "inicio", "comprimento", "crc32", "n_tokens"],
            )

    schema = f"id {kind}, inicio long, comprimento long, crc32 long, n_tokens long"
    pieces = materialise(documento.select("id", "texto").mapInArrow(cut, schema), "pedacos")
    counts = np.zeros(tamanho + 1, np.int64)
    for r in pieces.groupBy("comprimento").count().collect():  # one row per length at most
        counts[r["comprimento"]] = r["count"]
    salts = int(counts.max() // 100_000) + 1
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(packing_plan(counts, tamanho), tamanho))
    salted = pieces.withColumn("_sal", F.pmod(F.xxhash64("id", "inicio", "crc32"), F.lit(salts)))
    before = Window.partitionBy("comprimento").orderBy("_sal").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        salted.groupBy("comprimento", "_sal")
        .agg(F.count("*").alias("_n"))
        .select("comprimento", "_sal", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_antes"))
    )
    inside = Window.partitionBy("comprimento", "_sal").orderBy("id", "inicio", "crc32")
    ranked = (
        salted.withColumn("_n", F.row_number().over(inside))
        .join(ahead, ["comprimento", "_sal"])
        .select("id", "inicio", "comprimento", "crc32", "n_tokens", (F.col("_antes") + F.col("_n") - 1).alias("_n"))
    )

    def place(rows):
        table = slots.value
        # Length and rank in one ordered number pair: search by length first, then by rank.
        starts = np.searchsorted(table[:, 0], np.arange(tamanho + 2))
        for batch in rows:
            length, rank = (batch.column(c).to_numpy() for c in ("comprimento", "_n"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                part = table[starts[n] : starts[n + 1], 1]
                at[own] = starts[n] + np.searchsorted(part, rank[own], "right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(table[at, 3])],
                names=[*batch.schema.names[:-1], "sequencia", "posicao"],
            )

    return ranked.mapInArrow(place, f"{schema}, sequencia long, posicao long")
