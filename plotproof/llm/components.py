"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotproof.session import materialise


def components(links: DataFrame) -> DataFrame:
    """Rows (``no``, ``raiz``): every end of a link (``a``, ``b``) and the smallest node it reaches.

    Each round a node takes the smallest label around it, then the label of that
    label, so long chains close in few rounds. Rounds are written to the shared folder,
    which cuts the lineage and survives lost executors; only a count of changes reaches
    the driver. A hub's links are reduced before the shuffle by partial minima.
    """
    both = links.where("a <> b").select("a", "b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.distinct(), "ligacoes")
    state = materialise(
        both.groupBy(F.col("a").alias("no")).agg(F.min("b").alias("m")).select("no", F.least("no", "m").alias("raiz")),
        "raizes",
    )
    while True:
        around = (
            both.join(state.select(F.col("no").alias("b"), "raiz"), "b")
            .groupBy(F.col("a").alias("no"))
            .agg(F.min("raiz").alias("vizinha"))
        )
        near = state.join(around, "no").select("no", F.least("raiz", "vizinha").alias("raiz"), F.col("raiz").alias("_de"))
        jump = state.select(F.col("no").alias("raiz"), F.col("raiz").alias("_alem"))
        new = near.join(jump, "raiz", "left").select("no", F.least("raiz", "_alem").alias("raiz"), "_de")
        new = materialise(new, "raizes")
        changed = new.where("raiz <> _de").limit(1).count()
        state = new.select("no", "raiz")
        if not changed:
            return state
