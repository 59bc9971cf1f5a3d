"""Quality of documents by hierarchical empirical Bayes.

A document's own evidence comes from a logistic model on text statistics. Hosts and
paths have a posterior share of good documents, a path shrunk toward its host, a
host toward the whole, the more the fewer documents it has. Both are combined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotproof.llm import batches as B
from plotproof.llm.samples import labelled_texts
from plotproof.session import materialise

_KINDS = {
    "maiusculas": range(65, 91),
    "digitos": range(48, 58),
    "simbolos": b"#*$%&|<>",
    "barras": b"|",
    "exclamacoes": b"!",
    "pontos": b".",
    "outros": b"()[]{}=+_\\/@~^\"'`;:-",
    "alem_ascii": range(128, 256),
}
N_FEATURES = len(_KINDS) + 7


def statistics(text: bytes) -> list[float]:
    """Shares and averages that describe a text; all finite, also for an empty one."""
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, w, k = max(len(data), 1), max(len(words), 1), max(len(lines), 1)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        *(counts[list(v)].sum() / n for v in _KINDS.values()),
        np.log1p(len(words)),
        len(data) / w / 10,
        distinct / w,
        pairs / w,
        1 - len(set(lines)) / k,
        np.log1p(len(words) / k),
        float(len(words) < 10),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by damped Newton steps on standardised columns; returned for raw columns, then the intercept."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(ridge)
        change = np.linalg.solve(curve, slope)
        w -= np.clip(change, -1, 1)
        if np.abs(change).max() < 1e-6:
            break
    return np.concatenate([mean, scale, w])


def log_odds(x: np.ndarray, model: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    z = np.clip((x - model[:k]) / model[k : 2 * k], -8, 8)
    return np.clip(z @ model[2 * k : 3 * k] + model[-1], -12, 12)


def train_quality(documento: DataFrame, rotulo: DataFrame, max_por_classe: int = 5_000) -> np.ndarray:
    """Document model from ``documento`` (``id``, ``texto``) and ``rotulo`` (``id``, ``qualidade``: 1 good, 0 poor).

    A sample of at most 1.5 times ``max_por_classe`` ids of each class is fitted;
    the statistics of their texts, not these, come to the driver. Null labels are ignored and
    null texts are empty. With fewer than two classes the model knows only their share.
    """
    known = rotulo.where("qualidade in (0, 1)")
    sizes = {r["qualidade"]: r["count"] for r in known.groupBy("qualidade").count().collect()}
    sample = labelled_texts(documento, known, "qualidade", max_por_classe)

    def describe(rows):
        for batch in rows:
            x = np.array([statistics(t) for t in B.utf8(batch.column("texto"))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("qualidade"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["qualidade", "x"]
            )

    kind = known.schema["qualidade"].dataType.simpleString()
    rows = sample.mapInArrow(describe, f"qualidade {kind}, x array<double>").collect()
    rows = sorted((int(r["qualidade"]), list(r["x"])) for r in rows)
    x = np.array([r[1] for r in rows]).reshape(-1, N_FEATURES)
    y = np.array([r[0] for r in rows], float)
    good, poor = sizes.get(1, 0), sizes.get(0, 0)
    if not len(y) or y.min() == y.max():
        flat = np.concatenate([np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1)])
        flat[-1] = np.log((good + 1) / (poor + 1))
        return flat
    model = fit_logistic(x, y)
    # The classes are sampled at different rates; give the intercept the share they have among all labels.
    model[-1] += np.log(good / poor) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def _strength(groups: DataFrame, total: str) -> DataFrame:
    """One row: mean share ``m`` and prior strength ``forca`` of groups (``s`` good of ``n``), by moments."""
    whole = groups.agg(
        (F.sum("s") / F.sum("n")).alias("m"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("_q"),
        F.sum("n").alias("_n"),
        F.count("*").alias("_g"),
    )
    m = F.col("m")
    between = F.col("_q") / F.col("_n") - m * m - m * (1 - m) * F.col("_g") / F.col("_n")
    prior = m * (1 - m) / F.greatest(between, m * (1 - m) * 1e-4) - 1
    return whole.select(
        F.coalesce(m, F.lit(0.5)).alias(f"m_{total}"),
        F.coalesce(F.least(F.greatest(prior, F.lit(1.0)), F.lit(10_000.0)), F.lit(1.0)).alias(f"forca_{total}"),
    )


def classify_quality(documento: DataFrame, modelo: np.ndarray, corte: float = 0.5) -> DataFrame:
    """Probability that each ``documento`` row (``id``, ``texto``, ``arquivo_origem``) is good.

    The host of ``arquivo_origem`` is its first path segment, the path its folder; null
    counts as one host of its own. Returns ``id``, ``evidencia`` (probability by the text
    alone), ``hospedeiro`` and ``pasta`` (posterior share of good documents of the host and
    of the folder, the document itself left out), ``nota`` (combined) and ``mantido``
    (``nota`` at least ``corte``). Further input columns are ignored.

    Null and empty texts are judged by the statistics of an empty text. Rows of a
    repeated id are judged each for itself and count each in their folder. An empty
    table gives no rows.

    Texts are read once. Only log odds are grouped, with partial sums before the
    shuffle, so a host with a large part of all rows is no single task's work; folder
    posteriors are joined back by key, and what is broadcast is one row.
    """
    kind = documento.schema["id"].dataType.simpleString()
    source = F.coalesce(F.col("arquivo_origem"), F.lit(""))
    rows = documento.select(
        "id",
        F.substring_index(source, "/", 1).alias("h"),
        F.regexp_replace(source, "/[^/]*$", "").alias("c"),
        "texto",
    )
    shared = documento.sparkSession.sparkContext.broadcast(modelo)

    def judge(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in B.utf8(batch.column("texto"))]).reshape(-1, N_FEATURES)
            odds = log_odds(x, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(odds)], names=["id", "h", "c", "l"])

    judged = materialise(rows.mapInArrow(judge, f"id {kind}, h string, c string, l double"), "evidencias")
    judged = judged.withColumn("p", 1 / (1 + F.exp(-F.col("l"))))
    folders = judged.groupBy("h", "c").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    hosts = folders.groupBy("h").agg(F.sum("s").alias("sh"), F.sum("n").alias("nh"))
    of_hosts = _strength(hosts.select(F.col("sh").alias("s"), F.col("nh").alias("n")), "h")
    of_folders = _strength(folders, "c")
    sites = folders.join(hosts, "h").join(F.broadcast(of_hosts)).join(F.broadcast(of_folders))
    joined = judged.join(sites, ["h", "c"])

    p = F.col("p")
    host = (F.col("sh") - p + F.col("forca_h") * F.col("m_h")) / (F.col("nh") - 1 + F.col("forca_h"))
    folder = (F.col("s") - p + F.col("forca_c") * F.col("_host")) / (F.col("n") - 1 + F.col("forca_c"))
    odds = F.col("l") + _logit(F.col("_folder")) - _logit(F.col("m_h"))
    scored = joined.withColumn("_host", host).withColumn("_folder", folder).withColumn("nota", 1 / (1 + F.exp(-odds)))
    return scored.select(
        "id",
        p.alias("evidencia"),
        F.col("_host").alias("hospedeiro"),
        F.col("_folder").alias("pasta"),
        "nota",
        (F.col("nota") >= corte).alias("mantido"),
    )
