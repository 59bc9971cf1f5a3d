"""Prefix trie of event histories, on minimal-perfect-hash node tables.

A node is a distinct sequence of first events. Histories are dealt in shards; a shard
enumerates its distinct prefix digests, gives each a slot by a minimal perfect hash
that is checked against the stored digest, scatters counts into flat arrays and
adds them up through the parent slots, deepest first. Shards are joined by sums per digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotproof.session import materialise, spread

#: Rows (history, depth) of a shard: grown with the input so that a node is in few shards, and bounded.
SHARD_ROWS, MOST_SHARDS, MOST_ROWS = 4_096, 4_096, 2_000_000
#: Cells of the hash per key still without a slot.
ROOM = 2
CHUNK_BYTES = 1 << 16

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def _cells(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    h = a ^ (b + np.uint64((level + 1) * _STEP & (1 << 64) - 1))
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return ((h ^ (h >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 of n distinct 128-bit keys, in two halves.

    Level by level, a key alone in its cell has it; the others go to the next level. A
    slot is the rank of its cell. Every slot keeps its key, and a lookup compares it.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, total = [], 0
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        rest = np.arange(len(a))
        while len(rest):
            size = ROOM * len(rest) + 1
            cell = _cells(a[rest], b[rest], len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + total
            own = alone[cell]
            slots = rank[cell[own]]
            self.a[slots], self.b[slots] = a[rest[own]], b[rest[own]]
            self.levels.append((size, alone, rank))
            total += int(alone.sum())
            rest = rest[~own]
            if len(self.levels) > 200:
                raise ValueError("keys are not distinct")

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 for one that is not in the table."""
        out, rest = np.full(len(a), -1), np.arange(len(a))
        for level, (size, alone, rank) in enumerate(self.levels):
            cell = _cells(a[rest], b[rest], level, size)
            own = alone[cell]
            out[rest[own]] = rank[cell[own]]
            rest = rest[~own]
        found = out >= 0
        found[found] = (self.a[out[found]] == a[found]) & (self.b[out[found]] == b[found])
        return np.where(found, out, -1)


class _Nodes:
    """Node table of one shard: flat arrays by slot, filled from its rows in (history, depth) order."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("codigo", "ascending"), ("nivel", "ascending")])
        self.a, self.b = (table.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        self.depth, self.code = table.column("nivel").to_numpy(), table.column("codigo").to_numpy()
        keys = np.unique(np.stack([self.a, self.b], axis=1), axis=0)
        self.hash = PerfectHash(keys[:, 0].copy(), keys[:, 1].copy())
        self.n = len(keys)
        self.row = self.hash.slots(self.a, self.b)
        # The row before belongs to the same history, one event shorter: its slot is the parent's.
        above = np.where(self.depth > 0, np.concatenate([[0], self.row[:-1]]), -1)
        self.parent, self.level, self.bytes = (np.zeros(self.n, np.int64) for _ in range(3))
        size = table.column("bytes").to_numpy()
        for slots, values in ((self.parent, above), (self.level, self.depth), (self.bytes, size)):
            slots[self.row] = values
            if not (slots[self.row] == values).all():
                raise ValueError("two sequences of events have the same digest")
        self.ends = np.concatenate([self.depth[1:] == 0, [True]]) if len(self.row) else np.zeros(0, bool)

    def deepest_first(self):
        """Slots of each depth above the root's, deepest first."""
        order = np.argsort(-self.level, kind="stable")
        edges = np.flatnonzero(np.diff(self.level[order])) + 1
        return [part for part in np.split(order, edges) if len(part) and self.level[part[0]] > 0]

    def climb(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over whole subtrees within the shard."""
        total = values.copy()
        for part in self.deepest_first():
            np.add.at(total, self.parent[part], total[part])
        return total


def branch(evento: DataFrame, ramos: DataFrame) -> DataFrame:
    """Histories that begin with events of another: rows (``entidade_id``, ``nivel``, ``ator``, ``detalhe``).

    ``evento``: ``entidade_id``, ``timestamp``, ``ator``, ``detalhe``. ``ramos``: one row per
    resulting history, ``entidade_id``, ``origem_id`` and ``herdados``. It has the first ``herdados``
    events of ``origem_id`` (all if fewer, none if absent), then its own events after its first
    ``herdados``. Levels count from 1, and every history has a row of level 0.

    Events are ordered by time, null first, ties by actor and detail; a null actor or detail is
    empty. Events without an entity belong to no history; a null ``herdados`` is 0.
    """
    order = Window.partitionBy("entidade_id").orderBy(F.col("timestamp").asc_nulls_first(), "ator", "detalhe")
    clean = evento.where("entidade_id is not null").select(
        "entidade_id", "timestamp", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("ator", "detalhe")]
    )
    events = clean.select(F.col("entidade_id").alias("_de"), F.row_number().over(order).cast("long").alias("_k"), "ator", "detalhe")
    counts = clean.groupBy(F.col("entidade_id").alias("_de")).agg(F.count("*").alias("_n"))
    plan = ramos.select("entidade_id", "origem_id", F.coalesce(F.col("herdados"), F.lit(0)).cast("long").alias("_h"))
    plan = plan.join(counts, F.col("origem_id") == F.col("_de"), "left").select(
        "entidade_id", "origem_id", "_h", F.least("_h", F.coalesce("_n", F.lit(0).cast("long"))).alias("_antes")
    )
    taken = plan.join(events, (F.col("origem_id") == F.col("_de")) & (F.col("_k") <= F.col("_h"))).select(
        "entidade_id", F.col("_k").alias("nivel"), "ator", "detalhe"
    )
    own = plan.join(events, (F.col("entidade_id") == F.col("_de")) & (F.col("_k") > F.col("_h"))).select(
        "entidade_id", (F.col("_k") - F.col("_h") + F.col("_antes")).alias("nivel"), "ator", "detalhe"
    )
    none = F.lit(None).cast("string")
    roots = plan.select("entidade_id", F.lit(0).cast("long").alias("nivel"), none.alias("ator"), none.alias("detalhe"))
    return taken.unionByName(own).unionByName(roots)


def prefix_digests(historias: DataFrame) -> DataFrame:
    """Rows (``id``, ``nivel``, ``a``, ``b``, ``bytes``): 128-bit digest of the first ``nivel`` events.

    Each event, with its level, gives 128 bits; a prefix is their exclusive or, so digests are a
    running aggregate and the events themselves go no further.
    """
    event = F.sha2(F.concat(F.length("ator").cast("string"), F.lit(":"), "ator", "detalhe"), 256)
    zero = F.lit(0).cast("long")
    marked = historias.select(
        F.col("entidade_id").alias("id"),
        "nivel",
        F.coalesce(F.xxhash64(event, "nivel"), zero).alias("_a"),
        F.coalesce(F.xxhash64("nivel", F.reverse(event)), zero).alias("_b"),
        F.coalesce(F.octet_length("detalhe").cast("long"), zero).alias("bytes"),
    )
    root = F.col("nivel") == 0
    so_far = Window.partitionBy("id").orderBy("nivel").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select(
        "id", "nivel", *[F.bit_xor(F.when(root, zero).otherwise(F.col(f"_{c}"))).over(so_far).alias(c) for c in "ab"], "bytes"
    )


def _ends_digest(caminhos: DataFrame) -> DataFrame:
    """Per node (``a``, ``b``): SHA-256 of the ids of histories that end there, ascending, comma-joined.

    Sorted ranges of ids are joined to chunks by all tasks; only chunks meet, in order, and are hashed as a stream.
    """
    last = Window.partitionBy("id").orderBy(F.desc("nivel"))
    ends = caminhos.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("a", "b", "id")
    spark = ends.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ends.repartitionByRange(parts, "a", "b", "id").sortWithinPartitions("a", "b", "id")
    kind = caminhos.schema["id"].dataType.simpleString()

    def chunks(rows):
        for batch in rows:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            ids = batch.column("id").to_pylist()
            texts = [str(x).encode() for x in ids]
            cuts = [0, *(np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1).tolist(), len(ids)] if ids else [0]
            out = []
            for s, e in zip(cuts, cuts[1:]):
                while s < e:
                    stop, size = s, 0
                    while stop < e and size < CHUNK_BYTES:
                        size += len(texts[stop]) + 1
                        stop += 1
                    out.append((a[s], b[s], ids[s], b",".join(texts[s:stop])))
                    s = stop
            yield _batch(out, ("a", "b", "primeiro", "parte"), (pa.int64(), pa.int64(), batch.schema.field("id").type, pa.binary()))

    joined = ordered.mapInArrow(chunks, f"a long, b long, primeiro {kind}, parte binary")
    grouped = spread(joined, "a", "b").sortWithinPartitions("a", "b", "primeiro")

    def digests(rows):
        now, state = None, None
        for batch in rows:
            out = []
            for a, b, part in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "parte")), strict=True):
                if (a, b) == now:
                    state.update(b"," + part)
                    continue
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256(part)
            yield _batch(out, ("a", "b", "fins"), (pa.int64(), pa.int64(), pa.string()))
        if now:
            yield _batch([(*now, state.hexdigest())], ("a", "b", "fins"), (pa.int64(), pa.int64(), pa.string()))

    return grouped.mapInArrow(digests, "a long, b long, fins string")


def _batch(rows, names, kinds) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def history_trie(historias: DataFrame) -> DataFrame:
    """Node table of the trie of ``historias`` (``entidade_id``, ``nivel``, ``ator``, ``detalhe``, as :func:`branch` gives them).

    One row per distinct sequence of first events, the root without any too: ``no`` (smallest
    id of the histories that begin so, which with ``nivel`` names the node), ``nivel``,
    ``pai`` (``no`` of its parent; null for the root), ``n_historias``, ``n_filhos``, ``n_folhas``
    (childless nodes in its subtree), ``poupados`` (over its subtree, itself included: histories
    beyond the first times UTF-8 bytes of the last ``detalhe``) and ``fins_sha256`` (of the decimal
    ids of histories that end here, ascending, comma-joined; none: of the empty string).

    Works on any rows of that form: events of an entity in the order of the audit log. Equal
    histories share all nodes; a history without events belongs to the root; an empty table has no
    nodes, not even the root. Ids order as their type does. Further columns are ignored.

    A node that a third of all histories pass has one row per shard, whatever its size, and these
    are added up by partial sums. Per task: one shard's rows, some 100 bytes each; a history's
    digests, not its texts, must fit with them.
    """
    kind = historias.schema["entidade_id"].dataType.simpleString()
    paths = materialise(prefix_digests(historias), "caminhos")
    total = paths.count()
    rows = min(max(SHARD_ROWS, total // MOST_SHARDS), MOST_ROWS)
    lots = total // rows + 1
    # Codes, not ids, are compared in numpy: places of ids within a shard's own order.
    coded = paths.withColumn("lote", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int"))

    def prepared(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        ids, codes = np.unique(table.column("id").to_numpy(), return_inverse=True)
        return table.append_column("codigo", pa.array(codes, pa.int64())), ids

    def enumerate_nodes(table: pa.Table) -> pa.Table:
        lot = table.column("lote")[0].as_py()
        coded_rows, ids = prepared(table)
        nodes = _Nodes(coded_rows)
        members, first = np.zeros(nodes.n, np.int64), np.full(nodes.n, len(ids), np.int64)
        np.add.at(members, nodes.row, 1)
        np.minimum.at(first, nodes.row, nodes.code)
        goes_on = np.zeros(nodes.n, bool)
        goes_on[nodes.row[~nodes.ends]] = True
        columns = [
            pa.array(np.full(nodes.n, lot, np.int32)),
            pa.array(nodes.hash.a.view(np.int64)),
            pa.array(nodes.hash.b.view(np.int64)),
            pa.array(nodes.level),
            pa.array(nodes.bytes),
            pa.array(members),
            pa.array(ids[first]).cast(table.schema.field("id").type),
            pa.array(goes_on),
        ]
        return pa.table(columns, names=["lote", "a", "b", "nivel", "bytes", "membros", "no", "segue"])

    shard_nodes = materialise(
        coded.groupBy("lote").applyInArrow(
            enumerate_nodes, f"lote int, a long, b long, nivel long, bytes long, membros long, no {kind}, segue boolean"
        ),
        "nos-por-lote",
    )
    everywhere = shard_nodes.groupBy("a", "b").agg(
        F.min("nivel").alias("nivel"),
        F.max("nivel").alias("_nivel"),
        F.min("bytes").alias("bytes"),
        F.max("bytes").alias("_bytes"),
        F.sum("membros").alias("membros"),
        F.min("no").alias("no"),
        F.max("segue").alias("segue"),
    )
    # Shards must agree on what a digest stands for.
    agree = F.assert_true((F.col("nivel") == F.col("_nivel")) & (F.col("bytes") == F.col("_bytes")), F.lit("two sequences of events have the same digest"))
    nodes = materialise(everywhere.where(agree.isNull()).drop("_nivel", "_bytes"), "nos")
    told = shard_nodes.select("lote", "a", "b").join(nodes.select("a", "b", "membros", "no", "segue"), ["a", "b"])

    def accumulate(key, table: pa.Table, known: pa.Table) -> pa.Table:
        del key
        id_type = table.schema.field("id").type
        coded_rows, ids = prepared(table)
        nodes = _Nodes(coded_rows)
        slot = nodes.hash.slots(*(known.column(c).to_numpy().view(np.uint64) for c in ("a", "b")))
        members, goes_on = np.zeros(nodes.n, np.int64), np.zeros(nodes.n, bool)
        members[slot] = known.column("membros").to_numpy()
        goes_on[slot] = known.column("segue").to_numpy(zero_copy_only=False)
        names = np.empty(nodes.n, known.column("no").to_numpy().dtype)
        names[slot] = known.column("no").to_numpy()
        # A node counts in the one shard that holds its smallest history.
        here = np.zeros(nodes.n, bool)
        place = np.searchsorted(ids, names)
        place[place == len(ids)] = 0
        here[:] = ids[place] == names
        children = np.zeros(nodes.n, np.int64)
        below = here & (nodes.level > 0)
        np.add.at(children, nodes.parent[below], 1)
        leaves = nodes.climb((here & ~goes_on).astype(np.int64))
        saved = nodes.climb(np.where(here, (members - 1) * nodes.bytes, 0))
        parent = pa.array(names[np.maximum(nodes.parent, 0)], mask=~below).cast(id_type)
        columns = [pa.array(x.view(np.int64)) for x in (nodes.hash.a, nodes.hash.b)]
        return pa.table([*columns, pa.array(children), pa.array(leaves), pa.array(saved), parent], names=["a", "b", "filhos", "folhas", "poupados", "pai"])

    sums = (
        coded.groupBy("lote")
        .cogroup(told.groupBy("lote"))
        .applyInArrow(accumulate, f"a long, b long, filhos long, folhas long, poupados long, pai {kind}")
        .groupBy("a", "b")
        .agg(*[F.sum(c).alias(c) for c in ("filhos", "folhas", "poupados")], F.max("pai").alias("pai"))
    )
    out = nodes.join(sums, ["a", "b"]).join(_ends_digest(paths), ["a", "b"], "left")
    return out.select(
        "no",
        "nivel",
        "pai",
        F.col("membros").alias("n_historias"),
        F.col("filhos").alias("n_filhos"),
        F.col("folhas").alias("n_folhas"),
        "poupados",
        F.coalesce("fins", F.lit(hashlib.sha256(b"").hexdigest())).alias("fins_sha256"),
    )
