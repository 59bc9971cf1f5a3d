"""One text of each group of similar texts, by word shingles.

SimHash finds all fingerprints within a few bits of each other, by buckets of pairs of
blocks and bit planes; alone that reaches the closest copies only. So texts of a given
similarity of shingle sets also meet in buckets of min-hash bands; there the
bit-sliced distance of their fingerprints sorts out chance meetings. Of both the
shingle sets themselves decide. Buckets compare their texts with few leaders first,
then what is left within tasks, so no pairs of a group are listed but similar ones.
"""

from __future__ import annotations

from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plotproof.llm import batches as B
from plotproof.llm.simhash import BITS, _members, fingerprint_links, near, planes_of
from plotproof.session import materialise

BANDS = 12
#: Chance that two texts of just the wanted similarity meet in a band.
MEETS = 0.99
#: Differing bits within which all fingerprints are searched.
CLOSE = 4
#: Fingerprints of fewer words are too coarse to tell texts apart.
FEW_WORDS = 24
#: Leaders of a bucket, round by round, before all that is left is compared.
LEADERS = (1, 4)
#: Words of a tile of a bucket, whose shingles a task holds twice.
TILE_WORDS = 100_000
SLICE_BYTES = 1 << 19

_RANDOM = np.random.default_rng(20_261_201)
_FACTORS = _RANDOM.integers(1, 2**63, (BANDS, 32), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes_of_a_band(similarity: float) -> int:
    """Most min-hashes a band may hold so that texts of ``similarity`` meet; 5 at 0.8."""
    fit = [r for r in range(1, 33) if 1 - (1 - similarity**r) ** BANDS >= MEETS]
    return max(fit, default=1)


def radius_of(similarity: float) -> int:
    """Differing bits that texts of ``similarity`` stay within: mean of the angle between their sets, and 4.5 deviations; 23 at 0.8."""
    share = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    return min(BITS - 1, ceil(BITS * share + 4.5 * sqrt(BITS * share * (1 - share))) + 1)


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of all texts, A-Z lower-cased, in a row, and where each text's begin.

    A text of fewer words is one run; one without words has none.
    """
    words = B.words_of(texts, B.LOWER)
    hashes, counts = words.hashes(), words.counts
    at, runs = B.window_hashes(words, hashes, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = B.range_hashes(hashes, words.first[short], words.first[short + 1], 1)
    owner = np.concatenate([words.owner[at], short])
    order = np.argsort(owner, kind="stable")
    values = np.concatenate([runs, whole])[order]
    return values, np.searchsorted(owner[order], np.arange(len(texts) + 1))


def sketches(texts: list[bytes], size: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash fingerprints, and the keys of the min-hash bands (texts, BANDS); texts without words share a key."""
    values, first = shingle_hashes(texts, size)
    prints = np.zeros(len(texts), np.uint64)
    keys = np.zeros((len(texts), BANDS), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        start, counts = first[some], np.diff(first)[some]
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        prints[some] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for factor in _FACTORS[band, :hashes]:
                key = B.mix(key ^ np.minimum.reduceat(values * factor, start))
            keys[some, band] = key
    return prints, keys


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _written(documento: DataFrame, size: int, hashes: int) -> DataFrame:
    """Input rows in one column, their text, and per row a number, a 128-bit name of its words, fingerprint and bands."""
    rest = [F.col(c) for c in documento.columns if c != "texto"]
    rows = documento.select(F.struct(*rest).alias("linha_dada"), "texto", F.monotonically_increasing_id().alias("linha"))
    out = T.StructType(list(rows.schema)).add("r1", T.LongType()).add("r2", T.LongType()).add("n", T.LongType())
    out = out.add("impressao", T.LongType()).add("faixas", T.ArrayType(T.LongType()))
    arrow = to_arrow_schema(out)

    def sketch(batches):
        for batch in batches:
            texts = B.utf8(batch.column("texto"))
            parts = []
            for a, b in B.slices(texts, SLICE_BYTES):
                words = B.words_of(texts[a:b], B.LOWER)
                own = words.hashes()
                names = [B.range_hashes(own, words.first[:-1], words.first[1:], k) for k in (1, 2)]
                parts.append((*names, words.counts.astype(np.int64), *sketches(texts[a:b], size, hashes)))
            if not parts:
                continue
            r1, r2, n, prints, keys = (np.concatenate(c) for c in zip(*parts, strict=True))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), _signed(keys.ravel()))
            yield B.attach(batch, arrow, {"r1": _signed(r1), "r2": _signed(r2), "n": pa.array(n), "impressao": _signed(prints), "faixas": bands})

    return materialise(rows.mapInArrow(sketch, out), "semelhantes-linhas")


def _shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """Rows (``linha``, ``trechos``): the distinct shingle hashes of each text."""

    def sets(batches):
        for batch in batches:
            texts, lists = B.utf8(batch.column("texto")), []
            for a, b in B.slices(texts, SLICE_BYTES):
                values, first = shingle_hashes(texts[a:b], size)
                lists += [np.unique(values[s:e]).view(np.int64) for s, e in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("linha"), pa.array(lists, pa.list_(pa.int64()))], names=["linha", "trechos"])

    return rows.select("linha", "texto").mapInArrow(sets, "linha long, trechos array<long>")


def _near_pairs(pairs: DataFrame, radius: int) -> DataFrame:
    """Pairs whose fingerprints ``impressao`` and ``outra`` differ in ``radius`` bits at most, by bit planes."""

    def compare(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("impressao", "outra"))
            if len(a):
                planes = planes_of(a ^ b)
                hit = _members(near(planes, radius, planes.shape[1:]))
                hit = hit[hit < len(a)]
                yield batch.take(pa.array(hit)).select(["linha", "chefe"])

    return pairs.mapInArrow(compare, "linha long, chefe long")


def _alike(pairs: DataFrame, sets: DataFrame, similaridade: float) -> DataFrame:
    """Of pairs (``linha``, ``chefe``) those whose sets are as similar as that."""
    both = pairs.join(sets, "linha").join(sets.select(F.col("linha").alias("chefe"), F.col("trechos").alias("deles")), "chefe")
    common = both.select("linha", "chefe", F.size(F.array_intersect("trechos", "deles")).alias("_c"), (F.size("trechos") + F.size("deles")).alias("_t"))
    return common.where(F.col("_c") >= similaridade * (F.col("_t") - F.col("_c"))).select("linha", "chefe")


def _bucket_links(similarity: float, radius: int):
    """Arrow function of one bucket, or two tiles of one: links of all its similar texts, the one that comes first as ``chefe``.

    A pair that met in an earlier band is left to that one. The bit planes say which texts can be near
    any other; for these the common shingles with all others are counted exactly, a text at a time.
    """

    def run(table: pa.Table) -> pa.Table:
        # Stored order: the text that meets most first, then the random number.
        table = table.sort_by([("vistos", "descending"), ("ordem", "ascending"), ("linha", "ascending")])
        band, tiles = table.column("t")[0].as_py(), table.column("i").to_numpy() != table.column("j").to_numpy()
        prints = table.column("impressao").to_numpy().view(np.uint64)
        few = table.column("n").to_numpy() < FEW_WORDS
        own, line = table.column("azulejo").to_numpy(), table.column("linha").to_numpy()
        lists = table.column("trechos").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        known, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(sizes)])
        earlier = table.column("faixas").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, :band]
        planes, n, links = planes_of(prints), len(prints), []
        mark = np.zeros(len(known), bool)
        for q in range(n - 1):
            flip = np.where((prints[q] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
            near_by = _members(near((planes[b] ^ flip[b] for b in range(BITS)), radius, planes.shape[1:]))
            other = np.union1d(near_by[near_by < n], np.flatnonzero(few)) if not few[q] else np.arange(n)
            other = other[other > q]
            # Of two different tiles only what lies across them: within a tile it has a row group of its own.
            other = other[(own[other] != own[q]) | ~tiles[q]]
            if band:
                other = other[~(earlier[other] == earlier[q]).any(axis=1)]
            if not len(other):
                continue
            mark[ids[first[q] : first[q + 1]]] = True
            if 8 * len(other) > n:  # all at once; no text here is without shingles
                counts = np.add.reduceat(mark[ids], first[:-1], dtype=np.int64)[other]
            else:
                counts = np.array([np.count_nonzero(mark[ids[first[o] : first[o + 1]]]) for o in other])
            mark[ids[first[q] : first[q + 1]]] = False
            hit = other[counts >= similarity * (sizes[q] + sizes[other] - counts)]
            links += [(int(line[o]), int(line[q])) for o in hit]
        a, b = zip(*links) if links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["linha", "chefe"])

    return run


def bucket_links(alive: DataFrame, sets: DataFrame, similaridade: float) -> DataFrame:
    """Links (``linha``, ``chefe``) of all similar texts that share a bucket, each once.

    A bucket with many words is cut into tiles, and each two of them are compared in a task of
    their own, so a task holds the shingles of two tiles at most, and no pair is lost or listed unless it is similar.
    """
    sizes = alive.groupBy("t", "k").agg(F.count("*").alias("_n"), F.sum("n").alias("_palavras")).where("_n > 1")
    tiles = F.ceil(F.col("_palavras") / TILE_WORDS).cast("int")
    own = F.pmod(F.xxhash64("linha"), tiles.cast("long")).cast("int")
    others = F.transform(F.sequence(F.lit(0), tiles - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    placed = alive.join(sizes, ["t", "k"]).select("linha", "ordem", "impressao", "n", "t", "k", own.alias("azulejo"), F.explode(others).alias("p"))
    bands = alive.groupBy("linha").agg(F.sort_array(F.collect_list(F.struct("t", "k")))["k"].alias("faixas"))
    full = placed.join(bands, "linha").join(sets, "linha").select(
        "linha", (-F.col("ordem.v")).alias("vistos"), F.col("ordem.ordem").alias("ordem"), "impressao", "n", "t", "k", "azulejo", "p.i", "p.j", "faixas", "trechos"
    )
    return full.groupBy("t", "k", "i", "j").applyInArrow(_bucket_links(similaridade, radius_of(similaridade)), "linha long, chefe long").distinct()


def close_pairs(distintos: DataFrame) -> DataFrame:
    """Pairs (``linha``, ``chefe``) of texts whose fingerprints link within ``CLOSE`` bits.

    Of texts with one and the same fingerprint each meets the first, and the first meets those of other fingerprints.
    """
    prints = distintos.groupBy("impressao").agg(F.min("linha").alias("chefe"))
    same = distintos.join(prints, "impressao").where("linha <> chefe").select("linha", "chefe")
    first = lambda name, line: prints.select(F.col("impressao").alias(name), F.col("chefe").alias(line))
    others = fingerprint_links(prints.select("impressao"), CLOSE).join(first("a", "linha"), "a").join(first("b", "chefe"), "b")
    return materialise(same.unionByName(others.select("linha", "chefe")), "semelhantes-proximos")


def similar_lines(distintos: DataFrame, textos: DataFrame, palavras: int, similaridade: float) -> DataFrame:
    """Numbers of the texts that are similar to one that stays.

    ``distintos``: ``linha``, ``ordem`` (a random number), ``n`` (words), ``impressao``, ``faixas``.
    Links of close fingerprints are known from the start and count in every step beside those of the buckets. Texts are ordered by how many they meet, so the middle of a group comes first. First, in a
    few rounds, the texts that are among the first of all their buckets lead: what is similar to one
    of them goes, so large groups shrink to what is unlike their middle. Then all texts that are left
    are compared within their buckets, and of linked texts one after another stays.
    """
    placed = distintos.select("linha", "ordem", "impressao", "n", F.posexplode("faixas").alias("t", "k"))
    shared = placed.groupBy("t", "k").agg(F.count("*").alias("_n")).where("_n > 1")
    close = close_pairs(distintos)
    ends = close.select("linha").unionByName(close.select(F.col("chefe").alias("linha"))).select("linha", F.lit(1).cast("long").alias("_n"))
    met_at = placed.join(shared, ["t", "k"]).select("linha", "_n").unionByName(ends)
    meeting = materialise(met_at.groupBy("linha").agg(F.sum("_n").alias("_vistos")), "semelhantes-encontros")
    sets = materialise(_shingle_sets(textos.join(meeting, "linha", "left_semi"), palavras), "semelhantes-trechos")
    order = F.struct((-F.col("_vistos")).alias("v"), "ordem", F.col("linha").alias("l"))
    alive = materialise(placed.join(meeting, "linha").select("linha", order.alias("ordem"), "impressao", "n", "t", "k"), "semelhantes-vivos")
    known = materialise(_alike(close, sets, similaridade), "semelhantes-conhecidos")
    known = known.unionByName(known.select(F.col("chefe").alias("linha"), F.col("linha").alias("chefe")))
    gone = []
    for few in LEADERS:
        # Tasks drop what is not among their own first few of a bucket before they exchange rows.
        first = alive.withColumn("_r", F.row_number().over(Window.partitionBy("t", "k").orderBy("ordem"))).where(F.col("_r") <= few)
        # Every text stands in one bucket of each band, so one that is among the first in so many is in all.
        leads = first.groupBy("linha").agg(F.count("*").alias("_b")).where(F.col("_b") == BANDS).select("linha")
        leaders = materialise(alive.join(leads, "linha"), "semelhantes-chefes")
        met = leaders.select("t", "k", F.col("linha").alias("chefe"), F.col("impressao").alias("outra"), F.col("n").alias("m"))
        pairs = alive.join(met, ["t", "k"]).where("linha <> chefe")
        coarse = F.least("n", "m") < FEW_WORDS
        pairs = pairs.select("linha", "impressao", "chefe", F.when(coarse, F.col("impressao")).otherwise(F.col("outra")).alias("outra")).distinct()
        found = _alike(_near_pairs(pairs, radius_of(similaridade)), sets, similaridade)
        led = known.join(leads.withColumnRenamed("linha", "chefe"), "chefe", "left_semi").join(alive.select("linha"), "linha", "left_semi")
        alike = materialise(found.unionByName(led.select("linha", "chefe")).distinct(), "semelhantes-pares")
        place = leaders.select("linha", "ordem").distinct()
        ranked = alike.join(place, "linha").join(place.select(F.col("linha").alias("chefe"), F.col("ordem").alias("_antes")), "chefe")
        waits = ranked.where("_antes < ordem").select("linha").distinct()
        stays = materialise(place.select("linha").join(waits, "linha", "left_anti"), "semelhantes-ficam")
        now = materialise(alike.join(stays.select(F.col("linha").alias("chefe")), "chefe", "left_semi").select("linha").distinct(), "semelhantes-saem")
        gone.append(now)
        alive = materialise(alive.join(now.unionByName(stays), "linha", "left_anti"), "semelhantes-vivos")
    left = alive.select("linha", "ordem").distinct()
    pairs = known.join(left, "linha").join(left.select(F.col("linha").alias("chefe"), F.col("ordem").alias("_antes")), "chefe").where("_antes < ordem")
    links = materialise(bucket_links(alive, sets, similaridade).unionByName(pairs.select("linha", "chefe")).distinct(), "semelhantes-ligacoes")
    while not links.isEmpty():
        ends = links.select(F.col("chefe").alias("linha"))
        stays = materialise(ends.join(links.select("linha"), "linha", "left_anti").distinct(), "semelhantes-ficam")
        now = materialise(links.join(stays.select(F.col("linha").alias("chefe")), "chefe", "left_semi").select("linha").distinct(), "semelhantes-saem")
        gone.append(now)
        out = now.unionByName(stays)
        left = links.join(out, "linha", "left_anti").join(out.select(F.col("linha").alias("chefe")), "chefe", "left_anti")
        links = materialise(left.select("linha", "chefe"), "semelhantes-ligacoes")
    return _all_of(gone)


def _all_of(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def distinct_texts(documento: DataFrame, palavras: int = 5, similaridade: float = 0.8) -> DataFrame:
    """``documento`` rows (``id``, ``texto``) with one of each group of similar texts.

    Similarity is the share of common runs of ``palavras`` words, A-Z lower-cased, among
    all runs of both texts, as sets; a text of fewer words is one run. Two texts of at
    least ``similaridade`` do not both stay, but for pairs that neither meet in a band (1 in 100 at
    0.8 do not, less above) nor link by close fingerprints; a text goes only when one that stays has that similarity to it.

    Of rows with the same words the one with the smallest ``id`` may stay, then the first;
    null ids come last. Which of several similar texts stays is fixed by their words. Null,
    empty and wordless texts are alike. Rows return as they came, further columns too,
    whatever their names; an empty table gives no rows.

    Texts are read and written once with their sketches; what is compared are hashes. A group
    of any size meets its leader only, and a text is in a fixed number of buckets.
    """
    if not 0 < similaridade <= 1:
        raise ValueError("similaridade must be above 0 and at most 1")
    rows = _written(documento, palavras, hashes_of_a_band(similaridade))
    place = F.struct(F.col("linha_dada.id").isNull(), F.col("linha_dada.id"), F.col("linha"))
    same = rows.groupBy("r1", "r2").agg(F.min(place).alias("p"), *[F.any_value(c).alias(c) for c in ("n", "impressao", "faixas")])
    order = F.xxhash64("r1", "r2").alias("ordem")
    unlike = materialise(same.select(F.col("p.linha").alias("linha"), order, "n", "impressao", "faixas"), "semelhantes-distintos")
    gone = similar_lines(unlike, rows.select("linha", "texto"), palavras, similaridade)
    stay = unlike.select("linha").join(gone, "linha", "left_anti")
    kept = rows.select("linha", "linha_dada", "texto").join(stay, "linha", "left_semi")
    return kept.select(*[F.col("texto") if c == "texto" else F.col("linha_dada")[c].alias(c) for c in documento.columns])


