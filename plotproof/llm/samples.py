"""Bounded samples of labelled rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, label: str, per_label: int, key: str = "texto") -> DataFrame:
    """About ``per_label`` rows of every value of ``label``, 1.5 times that at most, chosen by a hash of ``key``.

    Every row of a label with no more than ``per_label`` rows is taken. Equal rows are
    taken once, so copies do not crowd out others.
    """
    position = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    sizes = rows.groupBy(label).agg(F.count_distinct(F.xxhash64(key)).alias("_n")).collect()  # one row per label
    share = {r[label]: per_label / max(r["_n"], 1) for r in sizes}
    most = int(1.5 * per_label * max(len(share), 1))
    wanted = F.lit(False)
    for value, part in share.items():
        wanted = wanted | ((F.col(label) == F.lit(value)) & (position < F.lit(min(1.0, part))))
    return rows.where(wanted).dropDuplicates([label, key]).limit(most)


def labelled_texts(documento: DataFrame, rotulo: DataFrame, label: str, per_label: int) -> DataFrame:
    """Rows (``texto``, ``label``) of a bounded sample of labelled ids; as bounded itself.

    The sample is drawn from the labels and sent to the texts, so no text is shuffled
    but those of the sample. Repeated rows of an id count once.
    """
    sample = bounded_sample(rotulo.where("id is not null").select("id", label), label, per_label, "id")
    size = sample.count()
    found = documento.select("id", "texto").join(F.broadcast(sample), "id")
    return found.dropDuplicates(["id", "texto", label]).select("texto", label).limit(2 * size)
