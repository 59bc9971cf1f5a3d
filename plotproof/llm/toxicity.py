"""Toxicity by a small recurrent network over overlapping windows of words.

A word enters as the embedding of its hash slot and the mean embedding of the runs of
three and of five bytes it is made of. A gated recurrent network reads a window in both directions,
attention pools its states, and the highest window is the document's score.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotproof.llm import batches as B
from plotproof.llm.samples import labelled_texts

WORD_BITS, GRAM_BITS = 18, 15
WIDTH, HIDDEN, ATTENTION = 8, 8, 8
WINDOW, STRIDE = 24, 12
CHUNK = 4096
CANDIDATES = 4
#: Words, or pairs of a text and a word, whose byte runs are held at once.
PAIRS = 1 << 14


@dataclass
class Inputs:
    """Distinct words of some texts: slot and byte runs of each; windows as places in the word stream."""

    slot: np.ndarray
    gram: np.ndarray
    gram_first: np.ndarray
    stream: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first_window: np.ndarray


def prepare(texts: list[bytes]) -> Inputs:
    words = B.words_of(texts, B.ALNUM)
    hashes = np.zeros(len(words.start), np.uint64)
    for i in range(0, len(hashes), PAIRS):
        begin, end = words.start[i : i + PAIRS], words.end[i : i + PAIRS]
        hashes[i : i + PAIRS] = replace(words, data=words.data[begin[0] : end[-1]], start=begin - begin[0], end=end - begin[0]).hashes()
    distinct, at, stream = np.unique(hashes, return_index=True, return_inverse=True)
    slot = (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    # Byte runs of each distinct word, begun one byte before it; past its end all bytes are blank.
    begin, end = words.start[at], words.end[at]
    sizes = end - begin
    bytes_first = np.concatenate([[0], np.cumsum(sizes)])
    place = np.repeat(begin - bytes_first[:-1], sizes) + np.arange(bytes_first[-1])
    stop = np.repeat(end, sizes)
    data = np.concatenate([np.array([B.SPACE], np.uint8), words.data])  # data[i]: the byte before place i
    last = len(data) - 1
    run = np.zeros(len(place), np.uint64)
    kinds = []
    for k in range(5):
        byte = np.where(place + k <= stop, data[np.minimum(place + k, last)], np.uint8(B.SPACE)).astype(np.uint64)
        run = run << np.uint64(8) | byte
        if k in (2, 4):
            kinds.append(B.mix(run * np.uint64(8) + np.uint64(k)) >> np.uint64(64 - GRAM_BITS))
    gram = np.stack(kinds, axis=1).ravel().astype(np.int64)
    gram_first = 2 * bytes_first
    counts = words.counts
    windows = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    first_window = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(len(texts)), windows)
    k = np.arange(first_window[-1]) - first_window[:-1][owner]
    inside = np.minimum(k * STRIDE, np.maximum(counts[owner] - WINDOW, 0))
    return Inputs(slot, gram, gram_first, stream, words.owner, words.first[:-1][owner] + inside, np.minimum(counts[owner], WINDOW), first_window)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class ToxicityModel:
    """Weights: ``words``, ``grams`` embed; ``in*``, ``rec*``, ``bias*`` are the two directions; the rest pools."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    moments: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fresh(cls, seed: int = 0) -> ToxicityModel:
        random = np.random.default_rng(seed)
        two, h = 2 * WIDTH, HIDDEN

        def normal(*shape, scale):
            return random.normal(0, scale, shape).astype(np.float32)

        w = {
            "words": np.zeros((1 << WORD_BITS, WIDTH), np.float32),
            "grams": normal(1 << GRAM_BITS, WIDTH, scale=0.1),
            "attend": normal(2 * h, ATTENTION, scale=0.3),
            "query": normal(ATTENTION, scale=0.5),
            "out": normal(2 * h, scale=0.3),
            "base": np.array([-1.0], np.float32),
        }
        for d in "fb":
            w[f"in{d}"] = normal(two, 3 * h, scale=0.35)
            w[f"rec{d}"] = normal(h, 3 * h, scale=0.3)
            w[f"bias{d}"] = np.zeros(3 * h, np.float32)
        return cls(w)

    def embed(self, x: Inputs) -> np.ndarray:
        """Input vector of every distinct word."""
        w = self.weights
        out = np.empty((len(x.slot), 2 * WIDTH), np.float32)
        # A block of words at a time: the vectors of all byte runs are never there at once.
        for i in range(0, len(x.slot), PAIRS):
            first = x.gram_first[i : i + PAIRS + 1]
            grams = w["grams"][x.gram[first[0] : first[-1]]]
            out[i : i + PAIRS, :WIDTH] = w["words"][x.slot[i : i + PAIRS]]
            out[i : i + PAIRS, WIDTH:] = np.add.reduceat(grams, first[:-1] - first[0], axis=0) / np.diff(first)[:, None]
        return out

    def forward(self, vectors: np.ndarray, place: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logit of each window; ``place``: word of every step and window, ``length``: real steps."""
        w, h = self.weights, HIDDEN
        steps, n = place.shape
        real = (np.arange(steps)[:, None] < length[None, :]).astype(np.float32)[:, :, None]
        states = np.zeros((steps, n, 2 * h), np.float32)
        tape = {}
        for side, d in enumerate("fb"):
            fed = vectors @ w[f"in{d}"] + w[f"bias{d}"]
            rec = w[f"rec{d}"]
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if d == "f" else reversed(range(steps)):
                x = fed[place[t]]
                gates = _sigmoid(x[:, : 2 * h] + state @ rec[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(x[:, 2 * h :] + (r * state) @ rec[:, 2 * h :])
                before, state = state, state + real[t] * z * (new - state)
                states[t, :, side * h : side * h + h] = state
                if keep:
                    tape[d, t] = (before, z, r, new)
        hidden = np.tanh(states @ w["attend"])
        weight = np.where(real[:, :, 0] > 0, hidden @ w["query"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        logit = pooled @ w["out"] + w["base"][0]
        return (logit, (real, states, tape, hidden, weight, pooled)) if keep else logit

    def gradients(self, vectors, place, length, label):
        """Mean logistic loss, its gradient in every dense weight, and in ``vectors``."""
        w, h = self.weights, HIDDEN
        logit, (real, states, tape, hidden, weight, pooled) = self.forward(vectors, place, length, keep=True)
        p = _sigmoid(logit)
        loss = -np.mean(label * np.log(p + 1e-9) + (1 - label) * np.log(1 - p + 1e-9))
        slope = ((p - label) / len(label)).astype(np.float32)
        g = {"out": pooled.T @ slope, "base": np.array([slope.sum()], np.float32)}
        d_pooled = slope[:, None] * w["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["query"] = np.einsum("tna,tn->a", hidden, d_score)
        d_hidden = d_score[:, :, None] * w["query"] * (1 - hidden * hidden)
        g["attend"] = np.einsum("tns,tna->sa", states, d_hidden)
        d_states = d_states + d_hidden @ w["attend"].T
        d_vectors = np.zeros_like(vectors)
        for side, d in enumerate("fb"):
            rec, given = w[f"rec{d}"], w[f"in{d}"]
            d_rec, d_fed = np.zeros_like(rec), np.zeros((len(vectors), 3 * h), np.float32)
            carry = np.zeros((place.shape[1], h), np.float32)
            order = range(place.shape[0])
            for t in reversed(order) if d == "f" else order:
                before, z, r, new = tape[d, t]
                total = carry + d_states[t, :, side * h : side * h + h]
                live = total * real[t]
                d_new = live * z * (1 - new * new)
                d_mixed = d_new @ rec[:, 2 * h :].T
                d_gates = np.hstack([live * (new - before) * z * (1 - z), d_mixed * before * r * (1 - r)])
                d_rec[:, 2 * h :] += (r * before).T @ d_new
                d_rec[:, : 2 * h] += before.T @ d_gates
                carry = total - live * z + d_mixed * r + d_gates @ rec[:, : 2 * h].T
                np.add.at(d_fed, place[t], np.hstack([d_gates, d_new]))
            g[f"rec{d}"], g[f"bias{d}"] = d_rec, d_fed.sum(axis=0)
            g[f"in{d}"] = vectors.T @ d_fed
            d_vectors += d_fed @ given.T
        return loss, g, d_vectors

    def _adam(self, name: str, rows, g: np.ndarray, rate: float) -> None:
        m, v, t = self.moments.setdefault(name, [np.zeros_like(self.weights[name]), np.zeros_like(self.weights[name]), 0])
        self.moments[name][2] = t = t + 1
        m[rows] = 0.9 * m[rows] + 0.1 * g
        v[rows] = 0.99 * v[rows] + 0.01 * g * g
        self.weights[name][rows] -= rate * (m[rows] / (1 - 0.9**t)) / (np.sqrt(v[rows] / (1 - 0.99**t)) + 1e-6)

    def learn(self, x: Inputs, windows: np.ndarray, label: np.ndarray, rate: float) -> float:
        """One gradient step on some windows."""
        place, length = self._places(x, windows)
        used, local = np.unique(place, return_inverse=True)
        sizes = np.diff(x.gram_first)[used]
        grams = x.gram[np.concatenate([np.arange(x.gram_first[u], x.gram_first[u + 1]) for u in used])]
        first = np.concatenate([[0], np.cumsum(sizes)])
        part = Inputs(x.slot[used], grams, first, local, x.owner, x.start, x.length, x.first_window)
        vectors = self.embed(part)
        loss, g, d_vectors = self.gradients(vectors, local.reshape(place.shape), length, label)
        for name, own in g.items():
            self._adam(name, slice(None), own.astype(np.float32), rate)
        for name, rows, own in (
            ("words", part.slot, d_vectors[:, :WIDTH]),
            ("grams", grams, np.repeat(d_vectors[:, WIDTH:] / sizes[:, None], sizes, axis=0)),
        ):
            rows, back = np.unique(rows, return_inverse=True)
            summed = np.zeros((len(rows), WIDTH), np.float32)
            np.add.at(summed, back, own)
            self._adam(name, rows, summed, rate)
        return loss

    @staticmethod
    def _places(x: Inputs, windows) -> tuple[np.ndarray, np.ndarray]:
        length = x.length[windows]
        at = x.start[windows][None, :] + np.minimum(np.arange(WINDOW)[:, None], length[None, :] - 1)
        return x.stream[at], length

    def windows(self, x: Inputs) -> np.ndarray:
        """Logit of every window."""
        if not len(x.start):
            return np.zeros(0, np.float32)
        vectors = self.embed(x)
        parts = (np.arange(i, min(i + CHUNK, len(x.start))) for i in range(0, len(x.start), CHUNK))
        return np.concatenate([self.forward(vectors, *self._places(x, p)) for p in parts])

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability for every text, by its highest window; a text without words gets that of an empty window."""
        x = prepare(texts)
        logits, first = self.windows(x), x.first_window
        best = np.full(len(texts), self.weights["base"][0], np.float64)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            best[some] = np.maximum.reduceat(logits, first[:-1][some])
        return _sigmoid(self.scale * best + self.shift)


def fit(texts: list[bytes], labels: np.ndarray, share: float, epochs: int = 12, seed: int = 0) -> ToxicityModel:
    """Train on labelled texts; ``share``: part of label 1 among all labels, for the calibration.

    Only some windows of a text labelled 1 are toxic. Word log odds start the word
    embeddings and name the candidate windows; each epoch the network itself then
    picks the window of such a text that it learns from.
    """
    model, random = ToxicityModel.fresh(seed), np.random.default_rng(seed)
    x, n = prepare(texts), len(texts)
    windows = np.diff(x.first_window)
    if not n or labels.min() == labels.max() or not windows.any():
        model.weights["out"][:] = 0
        model.weights["base"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    words = len(x.slot)
    owner = x.owner
    pairs = np.unique(owner * words + x.stream)
    doc, word = pairs // words, pairs % words
    seen = np.bincount(word, minlength=words)
    bad = np.bincount(word, weights=labels[doc], minlength=words)
    rate = labels.mean()
    odds = np.log((bad + 4 * rate) / (seen - bad + 4 * (1 - rate))) - np.log(rate / (1 - rate))
    odds[seen < 3] = 0
    model.weights["words"][x.slot, 0] = np.clip(odds, -1.5, 4) / 2
    model.weights["grams"][:, 0] = np.clip(_gram_odds(x, doc, word, labels), -1, 4)
    known = x.slot[seen >= 3]
    model.weights["words"][known, 1:] = random.normal(0, 0.05, (len(known), WIDTH - 1))
    # Evidence of a window: its largest log odds; the best few of each text are its candidates.
    del pairs, doc, word, seen, bad
    hint = odds + np.maximum(model.embed(x)[:, WIDTH], 0)
    parts = (np.arange(i, min(i + CHUNK, len(x.start))) for i in range(0, len(x.start), CHUNK))
    evidence = np.concatenate([hint[ToxicityModel._places(x, p)[0]].max(axis=0) for p in parts])
    window_owner = np.repeat(np.arange(n), windows)
    order = np.lexsort((-evidence, window_owner))
    rank = np.arange(len(order)) - x.first_window[:-1][window_owner[order]]
    chosen = order[rank < CANDIDATES]
    chosen = chosen[np.argsort(window_owner[chosen], kind="stable")]
    of = window_owner[chosen]
    some, first = np.unique(of, return_index=True)
    score = evidence[chosen]
    for epoch in range(epochs):
        top = np.zeros(len(chosen), bool)
        best = np.maximum.reduceat(score, first)
        top[score >= np.repeat(best, np.diff(np.append(first, len(chosen))))] = True
        use = np.flatnonzero((labels[of] == 0) | top)
        random.shuffle(use)
        step = 0.01 if epoch < epochs - 4 else 0.003
        for i in range(0, len(use), 128):
            part = use[i : i + 128]
            model.learn(x, chosen[part], labels[of[part]].astype(np.float32), step)
        vectors = model.embed(x)
        score = np.concatenate(
            [model.forward(vectors, *model._places(x, chosen[i : i + CHUNK])) for i in range(0, len(chosen), CHUNK)]
        )
    full = model.windows(x)
    best = np.full(n, float(model.weights["base"][0]))
    best[some] = np.maximum.reduceat(full, x.first_window[:-1][some])
    _calibrate(model, best, labels, share)
    model.moments = {}
    return model


def _gram_odds(x: Inputs, doc: np.ndarray, word: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log odds of the texts that hold a byte run, zero for those in few texts; ``doc``, ``word``: which holds which."""
    sizes = np.diff(x.gram_first)
    # Whole texts at a time, some PAIRS of them: a run counts once in a text.
    ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))
    seen, bad, i = np.zeros(1 << GRAM_BITS), np.zeros(1 << GRAM_BITS), 0
    while i < len(word):
        j = ends[np.searchsorted(ends, min(i + PAIRS, len(word)))]
        w = word[i:j]
        s = sizes[w]
        inside = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        grams = x.gram[np.repeat(x.gram_first[w], s) + inside]
        pairs = np.unique(np.repeat(doc[i:j], s) << GRAM_BITS | grams)
        grams, of = pairs & ((1 << GRAM_BITS) - 1), pairs >> GRAM_BITS
        seen += np.bincount(grams, minlength=1 << GRAM_BITS)
        bad += np.bincount(grams, weights=labels[of], minlength=1 << GRAM_BITS)
        i = j
    rate = labels.mean()
    odds = np.log((bad + 4 * rate) / (seen - bad + 4 * (1 - rate))) - np.log(rate / (1 - rate))
    return np.where(seen < 5, 0, odds)


def _calibrate(model: ToxicityModel, best: np.ndarray, labels: np.ndarray, share: float) -> None:
    """Logistic scale and shift on the texts' highest logits, each label weighted to its share of all labels."""
    rate = labels.mean()
    weight = np.where(labels > 0, share / rate, (1 - share) / (1 - rate))
    z = np.stack([best, np.ones(len(best))], axis=1)
    w, prior = np.array([1.0, 0.0]), np.array([20.0, 0.5])
    for _ in range(50):
        p = _sigmoid(z @ w)
        slope = z.T @ (weight * (p - labels)) + prior * (w - [1.0, 0.0])
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ z + np.diag(prior)
        w -= np.clip(np.linalg.solve(curve, slope), -0.5, 0.5)
    model.scale, model.shift = max(float(w[0]), 0.05), float(w[1])


def train_toxicity(
    documento: DataFrame, rotulo: DataFrame, max_por_classe: int = 1_500, max_caracteres: int = 40_000
) -> ToxicityModel:
    """Model from ``documento`` (``id``, ``texto``) and ``rotulo`` (``id``, ``toxico``: 1 toxic, 0 not).

    At most 1.5 times ``max_por_classe`` ids of each label are fitted, of these the texts with
    at most ``max_caracteres`` characters; they come to the driver, so both bounds
    hold their size at any input. Null texts and labels teach nothing. With one label only,
    or without rows, the model knows no more than its share.
    """
    known = rotulo.where("toxico in (0, 1)")
    sizes = {int(r["toxico"]): r["count"] for r in known.groupBy("toxico").count().collect()}
    short = documento.where(F.length("texto") <= max_caracteres)
    rows = sorted((r["texto"], int(r["toxico"])) for r in labelled_texts(short, known, "toxico", max_por_classe).collect())
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    labels = np.array([y for _, y in rows], np.float64)
    # Each text is held once, as bytes, while the network is fitted.
    texts = [t.encode() for t, _ in rows]
    del rows
    return fit(texts, labels, share)


def score_toxicity(documento: DataFrame, modelo: ToxicityModel, corte: float = 0.7) -> DataFrame:
    """``toxicidade`` (0 to 1) and ``toxico`` (1 at ``corte`` and above) of every ``documento`` row.

    The whole ``texto`` is read in overlapping windows of words; the highest decides. Null,
    empty and wordless texts get the score of an empty window. Returns the input columns
    without ``texto``; columns named like a result are replaced. Rows are independent, so
    repeated rows repeat their result; an empty table gives no rows. The model that is sent
    to the tasks has a fixed size.
    """
    names = ["toxicidade", "toxico"]
    columns = [c for c in documento.columns if c.lower() not in (*names, "texto")]
    shared = documento.sparkSession.sparkContext.broadcast(modelo)

    def judge(rows):
        for batch in rows:
            texts = B.utf8(batch.column("texto"))
            parts = [shared.value.score(texts[i:j]) for i, j in B.slices(texts)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            out = [batch.column(c) for c in columns] + [pa.array(score), pa.array((score >= corte).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=columns + names)

    schema = documento.select(*columns).withColumns({"toxicidade": F.lit(0.0), "toxico": F.lit(0)}).schema
    return documento.select(*columns, "texto").mapInArrow(judge, schema)
