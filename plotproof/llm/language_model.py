"""Language model: hashed maximum entropy with a class-factored softmax.

A token's probability is that of its class given the context, times that of its
member in the class given the context, times its smoothed share of the member. A
member is a frequent token or one of the class's groups of all other tokens. Both
softmaxes see hashed features of the words before: single, pairs and skips.

Token counts are exact over all training texts. Lots of texts send their distinct
tokens to buckets, which add up and answer each lot. The weights are trained in
rounds: every task makes gradient steps on its part of the texts from the same
start, and the steps are averaged feature by feature.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotproof.llm import batches as B
from plotproof.llm.lots import characters, from_planes, in_lots, planes
from plotproof.session import materialise

CLASSES, HEADS, GROUPS = 32, 16, 8
MEMBERS = HEADS + GROUPS
FEATURES = 5
CLASS_BITS, MEMBER_BITS = 12, 13
STEP, SMOOTH = 4096, 0.1
#: Weights are rows of this many numbers in both tables.
ROW = max(CLASSES, MEMBERS)
#: Hash that stands for the end of a text; words mix bytes and cannot be told to equal it.
END = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Tokens:
    """Tokens of some texts in a row, an end after each: hashes, ending, owner, place of each text's first."""

    hash: np.ndarray
    check: np.ndarray
    tail: np.ndarray
    owner: np.ndarray
    first: np.ndarray

    @property
    def cls(self) -> np.ndarray:
        return (self.tail % np.uint64(CLASSES)).astype(np.int64)

    @property
    def group(self) -> np.ndarray:
        return (self.tail // np.uint64(CLASSES) % np.uint64(GROUPS)).astype(np.int64)


def tokens_of(texts: list[bytes]) -> Tokens:
    words = B.words_of(texts, B.LOWER)
    bytes_hash = B._BYTE[words.data]
    n, docs = len(words.start), len(texts)
    at = np.arange(n) + words.owner
    ends = words.first[1:] + np.arange(docs)
    total = n + docs
    out = []
    short = np.maximum(words.end - 3, words.start)
    for start, which in ((words.start, 0), (words.start, 1), (short, 2)):
        column = np.full(total, END, np.uint64)
        column[at] = B.range_hashes(bytes_hash, start, words.end, which)
        out.append(column)
    owner = np.empty(total, np.int64)
    owner[at], owner[ends] = words.owner, np.arange(docs)
    first = words.first + np.arange(docs + 1)
    return Tokens(out[0], out[1].astype(np.uint32), B.mix(out[2]), owner, first)


def context(t: Tokens) -> np.ndarray:
    """Hashes of each token's context features, (tokens, FEATURES); before a text begins there is its start."""
    n = len(t.hash)
    since = np.arange(n) - t.first[t.owner]

    def before(values: np.ndarray, k: int) -> np.ndarray:
        shifted = np.zeros(n, np.uint64)
        shifted[k:] = values[: n - k] if k < n else values[:0]
        return np.where(since >= k, shifted, np.uint64(k))

    last, two, three, four = (before(t.tail, k) for k in (1, 2, 3, 4))
    parts = (before(t.hash, 1), last * np.uint64(3) + two * np.uint64(5), two, three, four)
    return np.stack([B.mix(p + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) for i, p in enumerate(parts)], axis=1)


@dataclass
class Model:
    """Counts by class and member, frequent tokens, and the two weight tables."""

    total: int
    distinct: int
    member_count: np.ndarray  # (classes, members): training tokens
    member_types: np.ndarray  # (classes, members): distinct ones
    heads: np.ndarray  # sorted hashes of the frequent tokens
    head_member: np.ndarray
    by_class: np.ndarray
    by_member: np.ndarray

    def members(self, t: Tokens) -> np.ndarray:
        """Member number, inside its class, of every token."""
        member = HEADS + t.group
        if len(self.heads):
            at = np.minimum(np.searchsorted(self.heads, t.hash), len(self.heads) - 1)
            member = np.where(self.heads[at] == t.hash, self.head_member[at], member)
        return member

    def biases(self) -> tuple[np.ndarray, np.ndarray]:
        mass = self.member_count + SMOOTH * (self.member_types + 1)
        present = np.zeros_like(mass, bool)
        present[:, HEADS:] = True
        if len(self.heads):
            present[:, :HEADS] = self.member_count[:, :HEADS] > 0
        mass = np.where(present, mass, 0)
        whole = mass.sum(axis=1)
        with np.errstate(divide="ignore"):
            return np.log(whole / whole.sum()).astype(np.float32), np.log(mass / whole[:, None]).astype(np.float32)

    @staticmethod
    def rows(hashes: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight rows of features: by feature, and by feature and class."""
        one = (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
        both = B.mix(hashes + cls[:, None].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        return one, (both >> np.uint64(64 - MEMBER_BITS)).astype(np.int64)


def softmax(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, width: int) -> np.ndarray:
    z = np.take(weights, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, k], axis=0)
    z = z[:, :width] + bias
    np.exp(np.minimum(z, 60, out=z), out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def log_probabilities(model: Model, t: Tokens, count: np.ndarray) -> np.ndarray:
    """Natural log probability of every token; ``count``: its training count."""
    out = np.empty(len(t.hash))
    bias, inner = model.biases()
    cls, member = t.cls, model.members(t)
    features = context(t)
    # What a frequent token's member leaves to it, and a group's to one of its tokens.
    share = (count + SMOOTH) / (model.member_count + SMOOTH * (model.member_types + 1))[cls, member]
    share[member < HEADS] = 1.0
    for i in range(0, len(out), STEP):
        s = slice(i, i + STEP)
        c, m = cls[s], member[s]
        one, both = model.rows(features[s], c)
        at = np.arange(len(c))
        p = softmax(model.by_class, one, bias, CLASSES)[at, c]
        q = softmax(model.by_member, both, inner[c], MEMBERS)[at, m]
        out[s] = np.log(np.maximum(p, 1e-30)) + np.log(np.maximum(q, 1e-30)) + np.log(share[s])
    return out


def _descend(weights, squares, counts, rows, error, rate: float) -> None:
    """Adaptive gradient step on the rows that occur; ``error``: probabilities less what happened."""
    n, width = len(weights), error.shape[1]
    flat = np.ascontiguousarray(rows.T).ravel()
    columns = np.ascontiguousarray(error.T, dtype=np.float64)
    gradient = np.stack([np.bincount(flat, weights=np.tile(c, rows.shape[1]), minlength=n) for c in columns])
    gradient = gradient.T.astype(np.float32)
    squares[:, :width] += gradient * gradient
    weights[:, :width] -= rate * gradient / np.sqrt(1 + squares[:, :width])
    counts += np.bincount(flat, minlength=n)


class Trainer:
    """Gradient steps of one task, from the weights of the round's start."""

    def __init__(self, model: Model, rate: float):
        self.start, self.rate = (model.by_class, model.by_member), rate
        self.model = replace(model, by_class=model.by_class.copy(), by_member=model.by_member.copy())
        self.squares = [np.zeros_like(w) for w in self.start]
        self.counts = [np.zeros(len(w), np.int64) for w in self.start]
        self.bias, self.inner = model.biases()

    def learn(self, t: Tokens) -> None:
        model = self.model
        cls, member, features = t.cls, model.members(t), context(t)
        for i in range(0, len(cls), STEP):
            s = slice(i, i + STEP)
            c, m = cls[s], member[s]
            one, both = model.rows(features[s], c)
            at = np.arange(len(c))
            p = softmax(model.by_class, one, self.bias, CLASSES)
            q = softmax(model.by_member, both, self.inner[c], MEMBERS)
            p[at, c] -= 1
            q[at, m] -= 1
            _descend(model.by_class, self.squares[0], self.counts[0], one, p, self.rate)
            _descend(model.by_member, self.squares[1], self.counts[1], both, q, self.rate)

    def steps(self):
        """(table, row, occurrences, occurrences times change) of all rows that were used."""
        for k, now in enumerate((self.model.by_class, self.model.by_member)):
            used = np.flatnonzero(self.counts[k])
            n = self.counts[k][used]
            yield k, used, n, ((now[used] - self.start[k][used]) * n[:, None]).astype(np.float32)


def _lot_entries(texts: list[bytes], train: np.ndarray):
    """Distinct tokens of a lot, sorted by bucket and hash: hash, check, class and group, training count, slots."""
    t = tokens_of(texts)
    by = np.lexsort((t.check, t.hash))
    a, b = t.hash[by], t.check[by]
    new = np.ones(len(by), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    slot = np.empty(len(by), np.int64)
    slot[by] = np.cumsum(new) - 1
    keep = by[new]
    count = np.bincount(slot, weights=train[t.owner], minlength=len(keep)).astype(np.uint64)
    return t, slot, a[new], b[new], (t.cls * GROUPS + t.group)[keep].astype(np.uint8), count


def _stretches(hashes: np.ndarray, buckets: int):
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    names, first = np.unique(bucket, return_index=True)
    return zip(names.tolist(), first.tolist(), np.append(first, len(bucket))[1:].tolist(), strict=True)


_ENTRIES = "balde int, lote int, a binary, b binary, c binary, n binary"
_COUNTS = (
    "lote int, balde int, contagens binary, grupos array<struct<g:int,n:long,v:long>>,"
    " frequentes array<struct<classe:int,a:long,n:long,g:int>>"
)


def _bucket_counts(table: pa.Table) -> pa.Table:
    """Training count of every entry for its lot, and, in the first row, what the bucket adds to the totals."""
    parts = {k: [from_planes(x, kind) for x in table.column(k).to_pylist()] for k, kind in (("a", "u8"), ("b", "u4"), ("c", "u1"), ("n", "u8"))}
    sizes = [len(x) for x in parts["a"]]
    a, b, c, n = (np.concatenate(parts[k]) for k in "abcn")
    by = np.lexsort((b, a))
    x, y = a[by], b[by]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    sums = np.add.reduceat(n[by], first)
    counts = np.empty(len(a), np.uint64)
    counts[by] = np.repeat(sums, np.diff(np.append(first, len(a))))
    known = sums > 0
    group, total, name = c[by][first][known].astype(np.int64), sums[known].astype(np.int64), x[first][known]
    n_of = np.bincount(group, weights=total, minlength=CLASSES * GROUPS).astype(np.int64)
    v_of = np.bincount(group, minlength=CLASSES * GROUPS)
    order = np.lexsort((name, -total, group // GROUPS))
    cls = group[order] // GROUPS
    begin = np.searchsorted(cls, np.arange(CLASSES))
    top = order[np.arange(len(cls)) - begin[cls] < HEADS]
    heads = [
        {"classe": int(group[i]) // GROUPS, "a": int(name[i].astype(np.int64)), "n": int(total[i]), "g": int(group[i])} for i in top
    ]
    groups = [{"g": g, "n": int(n_of[g]), "v": int(v_of[g])} for g in np.flatnonzero(v_of).tolist()]
    stops = np.cumsum(sizes).tolist()
    empty = [[] for _ in sizes[1:]]
    return pa.table(
        {
            "lote": table.column("lote"),
            "balde": table.column("balde"),
            "contagens": pa.array([planes(counts[e - s : e]) for s, e in zip(sizes, stops, strict=True)], pa.binary()),
            "grupos": pa.array([groups, *empty], pa.list_(pa.struct([("g", pa.int32()), ("n", pa.int64()), ("v", pa.int64())]))),
            "frequentes": pa.array(
                [heads, *empty],
                pa.list_(pa.struct([("classe", pa.int32()), ("a", pa.int64()), ("n", pa.int64()), ("g", pa.int32())])),
            ),
        }
    )


def _counted_model(counts: DataFrame) -> Model:
    """Model without weights; the driver gets one row per group and the most frequent tokens of each class."""
    groups = counts.select(F.explode("grupos").alias("x")).groupBy("x.g").agg(F.sum("x.n").alias("n"), F.sum("x.v").alias("v"))
    top = Window.partitionBy("classe").orderBy(F.col("n").desc(), "a")
    heads = counts.select(F.explode("frequentes").alias("x")).select("x.*")
    heads = heads.withColumn("lugar", F.row_number().over(top)).where(F.col("lugar") <= HEADS).collect()
    n, v = (np.zeros((CLASSES, MEMBERS), np.int64) for _ in range(2))
    for r in groups.collect():
        at = r["g"] // GROUPS, HEADS + r["g"] % GROUPS
        n[at], v[at] = r["n"], r["v"]
    total, distinct = int(n.sum()), int(v.sum())
    for r in heads:
        tail = r["classe"], HEADS + r["g"] % GROUPS
        n[tail] -= r["n"]
        v[tail] -= 1
        n[r["classe"], r["lugar"] - 1] = r["n"]
    rows = sorted((r["a"] % 2**64, r["lugar"] - 1) for r in heads)
    return Model(
        total,
        distinct,
        n,
        v,
        np.array([r[0] for r in rows], np.uint64),
        np.array([r[1] for r in rows], np.int64),
        np.zeros((1 << CLASS_BITS, ROW), np.float32),
        np.zeros((1 << MEMBER_BITS, ROW), np.float32),
    )


def _train(texts: DataFrame, model: Model, rounds: int, rate: float) -> None:
    """Every training text is read in one of the rounds; weights move by the averaged steps of all tasks."""
    session = texts.sparkSession
    for r in range(rounds):
        shared = session.sparkContext.broadcast(model)
        part = texts.where("treino").where(F.pmod(F.xxhash64("texto", F.lit(5)), F.lit(rounds)) == r).select("texto")

        def steps(rows, shared=shared):
            trainer = Trainer(shared.value, rate)
            for batch in rows:
                read = B.utf8(batch.column("texto"))
                for i, j in B.slices(read):
                    trainer.learn(tokens_of(read[i:j]))
            for table, row, n, change in trainer.steps() if trainer.counts[0].any() else ():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), table, np.int32)),
                        pa.array(row.astype(np.int32)),
                        pa.array(n),
                        pa.FixedSizeListArray.from_arrays(pa.array(change.ravel()), ROW).cast(pa.list_(pa.float32())),
                    ],
                    names=["tabela", "linha", "n", "passo"],
                )

        moved = part.mapInArrow(steps, "tabela int, linha int, n long, passo array<float>")
        summed = moved.groupBy("tabela", "linha").agg(
            F.sum("n").alias("n"), *[F.sum(F.get("passo", F.lit(k))).alias(f"p{k}") for k in range(ROW)]
        )
        for x in summed.collect():  # one row per weight row: a fixed number
            weights = (model.by_class, model.by_member)[x["tabela"]]
            weights[x["linha"]] += np.array(x[3:], np.float64) / x["n"]
        shared.destroy()


def score_texts(
    documento: DataFrame,
    rodadas: int = 3,
    passo: float = 0.3,
    caracteres_por_lote: int = 4_000_000,
    caracteres_por_balde: int = 16_000_000,
) -> DataFrame:
    """Log10 probability of every ``documento`` row's ``texto`` under a model of the rows with ``treino``.

    ``documento``: ``id``, ``texto`` and boolean ``treino`` (null: false). Tokens are words
    between ASCII white space, A-Z lower-cased, and one end after each text. Returns for
    every input row ``id``, ``treino``, ``n_palavras`` (tokens, the end included),
    ``n_conhecidas`` (seen in training), ``total_treino`` (training tokens),
    ``nota_base`` (tokens by their smoothed counts alone) and ``nota`` (the model).

    A null or empty text is its end alone. Rows of a repeated id are texts of their own,
    each counted. Without training texts all tokens are unknown. An empty table gives no
    rows; further input columns are ignored.

    All training texts count and train, each in one of ``rodadas`` rounds. Lots and
    buckets are counted by the measured volume; a lot sends an entry per distinct
    token. What reaches the driver are the sums of a fixed number of classes, their most frequent tokens
    and a fixed number of weights.
    """
    kind = documento.schema["id"].dataType.simpleString()
    source = documento.select(
        "id", F.coalesce("treino", F.lit(False)).alias("treino"), F.coalesce("texto", F.lit("")).alias("texto")
    )
    volume = characters(source)
    lots, buckets = volume // caracteres_por_lote + 1, volume // caracteres_por_balde + 1
    texts = in_lots(source, lots).select("lote", "id", "treino", "texto")

    def entries(table: pa.Table) -> pa.Table:
        train = np.array(table.column("treino").to_pylist(), float)
        _, _, a, b, c, n = _lot_entries(B.utf8(table.column("texto").combine_chunks()), train)
        lot, rows = table.column("lote")[0].as_py(), []
        for bucket, i, j in _stretches(a, buckets):
            rows.append((bucket, lot, planes(a[i:j]), planes(b[i:j]), planes(c[i:j]), planes(n[i:j])))
        return pa.table(
            [
                pa.array(x, t)
                for x, t in zip(zip(*rows, strict=True), [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)
            ],
            names=["balde", "lote", "a", "b", "c", "n"],
        )

    packed = texts.groupBy("lote").applyInArrow(entries, _ENTRIES)
    counts = materialise(packed.groupBy("balde").applyInArrow(_bucket_counts, _COUNTS), "contagens")
    model = _counted_model(counts)
    _train(source, model, rodadas, passo)
    shared = documento.sparkSession.sparkContext.broadcast(model)
    out = f"id {kind}, treino boolean, n_palavras long, n_conhecidas long, total_treino long, nota_base double, nota double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        model = shared.value
        t, slot, a, _, _, _ = _lot_entries(B.utf8(left.column("texto").combine_chunks()), np.zeros(left.num_rows))
        answers = {r["balde"]: r["contagens"] for r in right.to_pylist()}
        count = np.concatenate([from_planes(answers[b], "u8") for b, _, _ in _stretches(a, buckets)])[slot].astype(float)
        base = np.log10((count + SMOOTH) / (model.total + SMOOTH * (model.distinct + 1)))
        ours = log_probabilities(model, t, count) / np.log(10)
        first = t.first[:-1]
        return pa.table(
            {
                "id": left.column("id"),
                "treino": left.column("treino"),
                "n_palavras": pa.array(np.diff(t.first)),
                "n_conhecidas": pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                "total_treino": pa.array(np.full(left.num_rows, model.total, np.int64)),
                "nota_base": pa.array(np.add.reduceat(base, first)),
                "nota": pa.array(np.add.reduceat(ours, first)),
            }
        )

    answers = counts.select("lote", "balde", "contagens")
    return texts.groupBy("lote").cogroup(answers.groupBy("lote")).applyInArrow(score, out)
