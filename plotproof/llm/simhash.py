"""Near-duplicate documents by SimHash, compared bit plane by bit plane.

Fingerprints within ``raio`` bits leave at least two of ``raio + 2`` bit blocks
alike, so they meet in a bucket keyed by such a pair of blocks. In a bucket the
fingerprints are stored vertically, one machine word holding the same bit of 64
of them; distances to all are counted at once by carry-save counters, and a block
is left as soon as every member is beyond the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotproof.llm import batches as B
from plotproof.llm.components import components
from plotproof.session import materialise

# Fixed value: seed of the shingle hash.
SEED = 42
BITS = 64
LANES = 4096
QUERIES = 64
SMALL = 48
PAIRS = 1 << 16
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits over the XXH64 of every run of ``shingle`` words, A-Z lower-cased; 0 without words."""
    words = b" ".join(text.lower().split())
    if not words:
        return 0
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == B.SPACE)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(words)]
    reach = min(shingle, len(starts)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(words[s:e], SEED) for s, e in zip(starts, ends[reach:])], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def planes_of(values: np.ndarray) -> np.ndarray:
    """Vertical store: row b holds bit b of every value, 64 values to a word."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    padded = np.zeros((BITS, -(-bits.shape[1] // 64) * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def near(differences, radius: int, shape) -> np.ndarray:
    """Lanes whose differing bits number ``radius`` at most, as a bit mask."""
    counters = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(shape, np.uint64)

    def beyond() -> np.ndarray:
        more, equal = over, np.full(shape, _ONES)
        for k in reversed(range(len(counters))):
            if radius >> k & 1:
                equal = equal & counters[k]
            else:
                more, equal = more | (equal & counters[k]), equal & ~counters[k]
        return more

    for b, carry in enumerate(differences):
        for k in range(len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7 and b >= 2 * radius and (beyond() == _ONES).all():
            return np.zeros(shape, np.uint64)
    return ~beyond()


def _members(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def spread_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (position, position of its group's first member) of one large bucket, a star for each group."""
    n, links = len(values), []
    blocks = [planes_of(values[i : i + LANES]) for i in range(0, n, LANES)]
    todo = [np.zeros(p.shape[1], np.uint64) for p in blocks]
    for t, i in zip(todo, range(0, n, LANES), strict=True):
        t.view(np.uint8)[:] = np.packbits(np.arange(i, i + len(t) * 64) < n, bitorder="little")
    seen = np.zeros(n, bool)
    for seed in range(n):
        if seen[seed]:
            continue
        seen[seed], frontier = True, [seed]
        todo[seed // LANES][seed % LANES // 64] &= ~np.uint64(1 << seed % 64)
        while frontier:
            asked, frontier = frontier[:QUERIES], frontier[QUERIES:]
            query = planes_of(values[asked])[:, 0]
            flips = [np.where((q >> np.arange(len(asked), dtype=np.uint64)) & np.uint64(1), _ONES, np.uint64(0)) for q in query]
            for k, planes in enumerate(blocks):
                if not todo[k].any():
                    continue
                shape = (len(asked), planes.shape[1])
                mask = near((planes[b][None, :] ^ flips[b][:, None] for b in range(BITS)), radius, shape)
                fresh = np.bitwise_or.reduce(mask, axis=0) & todo[k]
                todo[k] &= ~fresh
                for m in (_members(fresh) + k * LANES).tolist():
                    seen[m] = True
                    frontier.append(m)
                    links.append((m, seed))
    return links


def pair_links(values: np.ndarray, offsets: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of linked members of many small buckets laid end to end."""
    sizes = np.diff(offsets)
    last = np.repeat(offsets[1:], sizes)
    at, found = np.arange(len(values)), []
    for lag in range(1, int(sizes.max(initial=0))):
        a = at[at + lag < last]
        for i in range(0, len(a), PAIRS):
            part = a[i : i + PAIRS]
            planes = planes_of(values[part] ^ values[part + lag])
            hit = _members(near(planes, radius, planes.shape[1:]))
            hit = part[hit[hit < len(part)]]
            found.append((hit, hit + lag))
    if not found:
        return at[:0], at[:0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bucket_masks(radius: int) -> list[int]:
    edges = np.linspace(0, BITS, radius + 3).round().astype(int).tolist()
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def fingerprint_links(impressoes: DataFrame, raio: int, max_balde: int = 20_000) -> DataFrame:
    """Links (``a``, ``b``) that connect all pairs of distinct ``impressao`` values within ``raio`` bits.

    A bucket of more than ``max_balde`` members is cut into tiles, and every pair of
    tiles is a bucket of its own, so no task holds more than two tiles and no pair is lost.
    """
    keys = F.array(
        *[F.struct(F.lit(t).alias("t"), F.col("impressao").bitwiseAND(_signed(m)).alias("k")) for t, m in enumerate(_bucket_masks(raio))]
    )
    placed = impressoes.select("impressao", F.explode(keys).alias("c")).select("impressao", "c.t", "c.k")
    sizes = placed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / max_balde).cast("int")
    own = F.pmod(F.xxhash64("impressao"), tiles.cast("long")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), tiles - 1),
        lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")),
    )
    tiled = placed.join(sizes, ["t", "k"]).select("impressao", "t", "k", F.explode(others).alias("p"))
    buckets = tiled.groupBy("t", "k", "p").agg(F.collect_list("impressao").alias("v")).where("size(v) > 1").select("v")

    def compare(rows):
        for batch in rows:
            lists = batch.column("v")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            sizes = np.diff(offsets)
            small = np.flatnonzero(sizes <= SMALL)
            keep = np.repeat(sizes <= SMALL, sizes)
            part = values[keep]
            a, b = pair_links(part, np.concatenate([[0], np.cumsum(sizes[small])]), raio)
            yield _links(part[a], part[b])
            for g in np.flatnonzero(sizes > SMALL).tolist():
                own = values[offsets[g] : offsets[g + 1]]
                pairs = np.array(spread_links(own, raio), np.int64).reshape(-1, 2)
                yield _links(own[pairs[:, 0]], own[pairs[:, 1]])

    return buckets.mapInArrow(compare, "a long, b long").distinct()


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = a.view(np.int64), b.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def near_duplicates(documento: DataFrame, palavras: int = 4, raio: int = 4) -> DataFrame:
    """Groups of ``documento`` rows (``id``, ``texto``) whose SimHash fingerprints chain within ``raio`` bits.

    Returns for every input row ``id``, ``chave`` (a hash of the text, which tells rows
    of a repeated id apart), ``impressao`` (64 bits as a signed number), ``grupo`` (the
    smallest id reachable, itself included) and ``representa``: true for the rows of the
    first (id, chave) of each group, so true on all repetitions of one identical row.

    A null, empty or wordless text has fingerprint 0 and is linked like any other; a
    text of fewer than ``palavras`` words is one shingle. Null ids are ignored as group
    names, a group of null ids has none, and they represent only such a group. An empty
    table gives no rows; further input columns are ignored.

    Texts are read once. Copies shrink to one fingerprint before any comparison; what is
    shuffled are fingerprints, ids and links, and links form stars, never all pairs.
    """
    source = documento.select("id", F.xxhash64("texto").alias("chave"), F.coalesce("texto", F.lit("")).alias("texto"))

    def prints(rows):
        for batch in rows:
            marks = [fingerprint(t, palavras) for t in B.utf8(batch.column("texto"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("chave"), pa.array(marks, pa.int64())], names=["id", "chave", "impressao"]
            )

    kind = documento.schema["id"].dataType.simpleString()
    printed = materialise(source.mapInArrow(prints, f"id {kind}, chave long, impressao long"), "impressoes")
    distinct = printed.groupBy("impressao").agg(F.min("id").alias("primeiro"))
    roots = components(fingerprint_links(distinct.select("impressao"), raio)).withColumnRenamed("no", "impressao")
    grouped = distinct.join(roots, "impressao", "left").withColumn("raiz", F.coalesce("raiz", "impressao"))
    names = grouped.groupBy("raiz").agg(F.min("primeiro").alias("grupo"))
    of_print = grouped.join(names, "raiz").select("impressao", "raiz", "grupo")
    rows = printed.join(of_print, "impressao")
    # The row that stands for a group: of the rows with its smallest id, the smallest text hash.
    first = rows.where("id <=> grupo").groupBy("raiz").agg(F.min("chave").alias("_chave"))
    return rows.join(first, "raiz").select(
        "id",
        "chave",
        "impressao",
        "grupo",
        (F.col("id").eqNullSafe(F.col("grupo")) & (F.col("chave") == F.col("_chave"))).alias("representa"),
    )
