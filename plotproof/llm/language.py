"""Language identification in two steps: family first, then the languages of the family.

All classifiers are linear support vector machines on hashed byte n-grams. Families
and, inside a family, languages are told apart one against one: every pair votes.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotproof.llm import batches as B
from plotproof.llm.samples import bounded_sample

DIMENSION = 4096
TEXTS = 256
UNDETERMINED = "und"

# Languages by family; a language of no family here is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[b for b in range(128) if not 97 <= b <= 122]] = B.SPACE


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors of log counts of two- and three-byte runs of the lower-cased texts."""
    coded = [t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    data = _LETTERS[np.frombuffer(b"".join(coded), np.uint8)].astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in coded])
    counts = np.zeros(len(texts) * DIMENSION)
    for size in (2, 3):
        n = len(data) - size + 1
        if n <= 0:
            continue
        gram = np.full(n, size, np.uint32)
        for k in range(size):
            gram = gram * np.uint32(2654435761) + data[k : k + n] * np.uint32(40503 + 2 * k)
        gram ^= gram >> np.uint32(15)
        gram = gram * np.uint32(2246822519)
        # A run that starts in a gap says nothing and could reach into the next text.
        real = (data[:n] != B.SPACE) | (data[1 : n + 1] != B.SPACE)
        real &= owner[:n] == owner[size - 1 :]
        cell = owner[:n][real] * DIMENSION + (gram[real] >> np.uint32(20)).astype(np.int64)
        counts += np.bincount(cell, minlength=len(counts))
    matrix = np.log1p(counts).reshape(-1, DIMENSION).astype(np.float32)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 25) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent; y is -1 or 1. Weights, then the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))) * cost
    squares, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    random = np.random.default_rng(0)
    for _ in range(epochs):
        for i in random.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Duels:
    """One machine for every pair of ``names``; the most votes win, then the largest sum of margins."""

    names: list[str]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Duels:
        names = sorted(set(labels.tolist()))
        rows = [
            fit_svm(x[m := (labels == a) | (labels == b)], np.where(labels[m] == a, 1.0, -1.0))
            for a, b in combinations(names, 2)
        ]
        return cls(names, np.array(rows).reshape(-1, x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and how sure its duels were, 0 to 1."""
        n, k = len(x), len(self.names)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, sums, sure = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
        for j, (a, b) in enumerate(combinations(range(k), 2)):
            m = margin[:, j]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            sums[:, a] += m
            sums[:, b] -= m
            likely = 1 / (1 + np.exp(-3 * np.clip(m, -20, 20)))
            sure[:, a] += likely / (k - 1)
            sure[:, b] += (1 - likely) / (k - 1)
        winner = np.argmax(votes + 1e-3 * np.tanh(sums), axis=1)
        return winner, sure[np.arange(n), winner]


@dataclass
class LanguageModel:
    """Duels between families, and between the languages of each family."""

    families: Duels | None
    languages: dict[str, Duels]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        if self.families is None or not lettered:
            return names, scores
        x = features([texts[i] for i in lettered])
        family, sure = self.families.predict(x)
        for f in np.unique(family).tolist():
            own = np.flatnonzero(family == f)
            duels = self.languages[self.families.names[f]]
            language, within = duels.predict(x[own])
            for i, k, s in zip(own.tolist(), language.tolist(), (sure[own] * within).tolist(), strict=True):
                names[lettered[i]], scores[lettered[i]] = duels.names[k], min(max(s, 0.0), 1.0)
        return names, scores


def train_language(exemplo: DataFrame, max_por_idioma: int = 600) -> LanguageModel:
    """Model from the rows of ``exemplo`` (``texto``, ``idioma``) with neither of them null.

    Only a sample of at most 1.5 times ``max_por_idioma`` rows of each language is
    fitted. Their vectors are made by Spark and come to the driver, where the machines
    are trained; this bound holds at any size of the input. Texts without a letter
    teach nothing. Without examples the model answers ``und``.
    """
    known = exemplo.where("texto is not null and idioma is not null").where(F.col("texto").rlike(r"\p{L}"))
    sample = bounded_sample(known.select("texto", "idioma"), "idioma", max_por_idioma)

    def vectors(rows):
        for batch in rows:
            texts, names = batch.column("texto").to_pylist(), batch.column("idioma").to_pylist()
            for i in range(0, len(texts), TEXTS):
                x = features(texts[i : i + TEXTS]).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[i : i + TEXTS]), pa.array([v.tobytes() for v in x], pa.binary())], names=["idioma", "v"]
                )

    rows = sorted((r["idioma"], bytes(r["v"])) for r in sample.mapInArrow(vectors, "idioma string, v binary").collect())
    if not rows:
        return LanguageModel(None, {})
    labels = np.array([r[0] for r in rows], object)
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float16).reshape(len(rows), DIMENSION).astype(np.float32)
    of = {language: family for family, members in FAMILIES.items() for language in members}
    family = np.array([of.get(name, name) for name in labels], object)
    inside = {f: Duels.fit(x[family == f], labels[family == f]) for f in sorted(set(family.tolist()))}
    return LanguageModel(Duels.fit(x, family), inside)


def identify_language(documento: DataFrame, modelo: LanguageModel) -> DataFrame:
    """``idioma`` and ``certeza`` (0 to 1) of every ``documento`` row, from its whole ``texto`` alone.

    Returns the input columns without ``texto``; columns named like a result are
    replaced. A text that is null or has no letter is ``und`` with certainty 0. Rows are
    independent, so repeated rows repeat their result; an empty table gives no rows.
    The model that is sent to the tasks has one weight vector per pair of languages.
    """
    names = ["idioma", "certeza"]
    columns = [c for c in documento.columns if c.lower() not in (*names, "texto")]
    shared = documento.sparkSession.sparkContext.broadcast(modelo)

    def predict(rows):
        for batch in rows:
            texts = ["" if t is None else t for t in batch.column("texto").to_pylist()]
            found, sure = [], []
            begin, size = 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or i - begin == TEXTS or size > B.SLICE_BYTES:
                    a, b = shared.value.predict(texts[begin:i])
                    found += a
                    sure += b
                    begin, size = i, 0
                size += len(texts[i]) if i < len(texts) else 0
            out = [batch.column(c) for c in columns] + [pa.array(found, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=columns + names)

    schema = documento.select(*columns).withColumns({"idioma": F.lit(""), "certeza": F.lit(0.0)}).schema
    return documento.select(*columns, "texto").mapInArrow(predict, schema)
