"""Substring dedup: exact repeats of long word runs, found by fixed-block anchors.

Every text gives its non-overlapping blocks of half a window as references, and all
its rolling runs of that length as probes. A window that stands elsewhere holds a
whole reference block of the other place, so only windows around a hit can repeat.
These are then compared by a 96-bit hash of the whole window, and neighbouring ones
that prove repeated join to maximal repeats.

Lots of texts pack their hashes, one entry for equal ones, into buckets. Buckets
answer each lot by one bit per entry, so neither texts nor pairs travel, and
something that stands in many texts costs an entry per lot, not per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotproof.llm import batches as B
from plotproof.llm.lots import bits, characters, from_bits, from_planes, in_lots, planes, with_order

_PACKED = "balde int, lote int, a binary, b binary, c binary"
_ANSWER = "lote int, passo int, balde int, marcas binary"


class _Lot:
    """Words and hashes of one lot; entries are sorted by hash, so the order in which rows arrive does not matter."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        self.table, self.window, self.buckets = table, window, buckets
        self.texts = B.utf8(table.column("texto").combine_chunks())
        self.order = table.column("ordem").to_numpy()
        self.words = B.words_of(self.texts, B.PLAIN)
        self.hashes = self.words.hashes()

    def blocks(self):
        """Probes: places, whether they are reference blocks, and the slot of each among the distinct (bucket, hash)."""
        length = (self.window + 1) // 2
        at, h = B.window_hashes(self.words, self.hashes, length)
        owner = self.words.owner[at]
        long = self.words.counts[owner] >= self.window
        at, h, owner = at[long], h[long], owner[long]
        reference = (at - self.words.first[owner]) % length == 0
        low = np.uint64(32)
        bucket = ((h >> low) * np.uint64(self.buckets)) >> low
        codes, slot = np.unique(bucket << low | h & np.uint64(0xFFFFFFFF), return_inverse=True)
        return at, reference, codes, slot

    def candidates(self, answers: list[dict]):
        """Windows that hold a hit block: places, and distinct (bucket, hash, hash) with the slot of each window."""
        at, _, codes, slot = self.blocks()
        hit = _answers(codes >> np.uint64(32), answers)[slot]
        n = len(self.hashes)
        hits = np.zeros(n + 1, np.int64)
        hits[at[hit] + 1] = 1
        hits = np.cumsum(hits)
        starts, first = B.window_hashes(self.words, self.hashes, self.window, 1)
        reach = self.window - (self.window + 1) // 2 + 1
        near = hits[np.minimum(starts + reach, n)] > hits[starts]
        starts, first = starts[near], first[near]
        second = B.range_hashes(self.hashes, starts, starts + self.window, 2).astype(np.uint32)
        by = np.lexsort((second, first))
        a, b = first[by], second[by]
        new = np.ones(len(by), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        slot = np.empty(len(by), np.int64)
        slot[by] = np.cumsum(new) - 1
        a, b = a[new], b[new]
        order = self.order[self.words.owner[starts]]
        smallest = np.minimum.reduceat(order[by], np.flatnonzero(new)) if len(by) else order
        bucket = ((a >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        return starts, slot, order, bucket, a, b, smallest


def _answers(bucket: np.ndarray, answers: list[dict]) -> np.ndarray:
    """One flag per distinct entry, laid out by bucket."""
    flags = np.zeros(len(bucket), bool)
    edges = {int(x["balde"]): x["marcas"] for x in answers}
    names, first = np.unique(bucket, return_index=True)
    stops = np.append(first, len(bucket))[1:]
    for name, i, j in zip(names.tolist(), first.tolist(), stops.tolist(), strict=True):
        if name in edges:
            flags[i:j] = from_bits(edges[name], j - i)
    return flags


def _rows(bucket: np.ndarray, lot: int, parts) -> pa.Table:
    """A packed row for each bucket that has entries; ``parts`` turn a stretch of entries into bytes."""
    names, first = np.unique(bucket, return_index=True)
    stops = np.append(first, len(bucket))[1:]
    packed = [[part(i, j) for i, j in zip(first.tolist(), stops.tolist(), strict=True)] for part in parts]
    return pa.table(
        {
            "balde": pa.array(names.astype(np.int32)),
            "lote": pa.array(np.full(len(names), lot, np.int32)),
            **{k: pa.array(v, pa.binary()) for k, v in zip("abc", packed, strict=True)},
        }
    )


def _answer_rows(table: pa.Table, step: int, flags: np.ndarray, sizes: np.ndarray) -> pa.Table:
    stops = np.cumsum(sizes)
    marks = [bits(flags[e - n : e]) for n, e in zip(sizes.tolist(), stops.tolist(), strict=True)]
    n = len(marks)
    return pa.table(
        {
            "lote": table.column("lote"),
            "passo": pa.array(np.full(n, step, np.int32)),
            "balde": table.column("balde"),
            "marcas": pa.array(marks, pa.binary()),
        }
    )


def _block_answers(table: pa.Table) -> pa.Table:
    """Hit: a hash that is a reference block somewhere and stands at two places or more."""
    keys = [from_planes(x, "u4") for x in table.column("a").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    key = np.concatenate(keys)
    reference, repeated = (
        np.concatenate([from_bits(x, n) for x, n in zip(table.column(c).to_pylist(), sizes.tolist(), strict=True)])
        for c in "bc"
    )
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
    count = np.diff(np.append(first, len(key)))
    good = np.logical_or.reduceat(reference[by], first) & ((count > 1) | np.logical_or.reduceat(repeated[by], first))
    flags = np.empty(len(key), bool)
    flags[by] = np.repeat(good, count)
    return _answer_rows(table, 1, flags, sizes)


def _window_answers(table: pa.Table) -> pa.Table:
    """True where another lot has the window in a row that comes before this lot's first."""
    first = [from_planes(x, "u8") for x in table.column("a").to_pylist()]
    sizes = np.array([len(k) for k in first])
    a = np.concatenate(first)
    b = np.concatenate([from_planes(x, "u4") for x in table.column("b").to_pylist()])
    order = np.concatenate([from_planes(x, "u8") for x in table.column("c").to_pylist()]).view(np.int64)
    by = np.lexsort((b, a))
    x, y = a[by], b[by]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    smallest = np.minimum.reduceat(order[by], first)
    flags = np.empty(len(a), bool)
    flags[by] = np.repeat(smallest, np.diff(np.append(first, len(a)))) < order[by]
    return _answer_rows(table, 2, flags, sizes)


def dedup_substrings(
    documento: DataFrame, janela: int = 50, caracteres_por_lote: int = 2_000_000, caracteres_por_balde: int = 16_000_000
) -> DataFrame:
    """Words of each ``documento`` row (``id``, ``texto``) in runs that an earlier row has too.

    Words stand between ASCII white space. A run of ``janela`` words of a row is repeated
    when it stands, anywhere, in a row of a smaller ``id``; judged on the input, for all
    rows. Returns for every input row ``id``, ``n_palavras``, ``n_removidas``, ``trechos``
    (the maximal repeats as word ranges, end exclusive) and ``texto``: the other words,
    joined by one space.

    A null or empty text has no words; fewer than ``janela`` words repeat nothing. Null
    ids come last. Rows of a repeated id are equals and remove nothing from each other,
    nor does a row from itself. An empty table gives no rows; further columns are ignored.

    Lots and buckets are counted by the measured volume, so a task's share stays as it
    is when the input grows; beyond some TB both sizes should be raised together, as
    every lot writes one row to every bucket. Texts are dealt to lots once, by a hash of
    id and text, and read from that shuffle in three passes of one plan.
    """
    if janela < 2:
        raise ValueError("janela must be 2 or more")
    kind = documento.schema["id"].dataType.simpleString()
    volume = characters(documento)
    lots, buckets = volume // caracteres_por_lote + 1, volume // caracteres_por_balde + 1
    texts = in_lots(with_order(documento.select("id", F.coalesce("texto", F.lit("")).alias("texto"))), lots)
    texts = texts.select("lote", "id", "ordem", "texto")

    def probes(table: pa.Table) -> pa.Table:
        lot = _Lot(table, janela, buckets)
        _, reference, codes, slot = lot.blocks()
        repeated = np.bincount(slot, minlength=len(codes)) > 1
        referenced = np.zeros(len(codes), bool)
        referenced[slot[reference]] = True
        low = codes.astype(np.uint32)
        return _rows(
            codes >> np.uint64(32),
            table.column("lote")[0].as_py(),
            [lambda i, j: planes(low[i:j]), lambda i, j: bits(referenced[i:j]), lambda i, j: bits(repeated[i:j])],
        )

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _packed_types()})
        lot = _Lot(left, janela, buckets)
        _, _, _, bucket, a, b, smallest = lot.candidates(right.to_pylist())
        order = smallest.view(np.uint64)
        return _rows(
            bucket,
            left.column("lote")[0].as_py(),
            [lambda i, j: planes(a[i:j]), lambda i, j: planes(b[i:j]), lambda i, j: planes(order[i:j])],
        )

    out = f"id {kind}, n_palavras long, n_removidas long, trechos array<struct<inicio:long,fim:long>>, texto string"

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        lot = _Lot(left, janela, buckets)
        answers = right.to_pylist()
        starts, slot, order, bucket, _, _, smallest = lot.candidates([x for x in answers if x["passo"] == 1])
        elsewhere = _answers(bucket, [x for x in answers if x["passo"] == 2])
        gone = starts[(order > smallest[slot]) | elsewhere[slot]]
        edges = np.zeros(len(lot.hashes) + 1, np.int64)
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + janela, -1)
        covered = np.cumsum(edges)[:-1] > 0
        first, removed, ranges, kept = lot.words.first, [], [], []
        for d, text in enumerate(lot.texts):
            own = covered[first[d] : first[d + 1]]
            n, words = int(own.sum()), text.split()
            turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist() if n else []
            ranges.append([{"inicio": x, "fim": y} for x, y in zip(turns[::2], turns[1::2], strict=True)])
            edges_of = [0, *turns, len(words)]
            parts = [w for x, y in zip(edges_of[::2], edges_of[1::2], strict=True) for w in words[x:y]] if n else words
            removed.append(n)
            kept.append(b" ".join(parts))
        return pa.table(
            {
                "id": lot.table.column("id"),
                "n_palavras": pa.array(lot.words.counts),
                "n_removidas": pa.array(removed, pa.int64()),
                "trechos": pa.array(ranges, pa.list_(pa.struct([("inicio", pa.int64()), ("fim", pa.int64())]))),
                "texto": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    packed = texts.groupBy("lote").applyInArrow(probes, _PACKED)
    hits = packed.groupBy("balde").applyInArrow(_block_answers, _ANSWER)
    whole = texts.groupBy("lote").cogroup(hits.groupBy("lote")).applyInArrow(windows, _PACKED)
    earlier = whole.groupBy("balde").applyInArrow(_window_answers, _ANSWER)
    return texts.groupBy("lote").cogroup(hits.unionByName(earlier).groupBy("lote")).applyInArrow(remove, out)


def _packed_types():
    return [("balde", pa.int32()), ("lote", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
