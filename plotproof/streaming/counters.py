"""Live counters over the append-only audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotproof.schemas import TABLES


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TABLES["evento"]).parquet(path)


def action_counts(events: DataFrame) -> DataFrame:
    """Events per action; as a stream use output mode ``complete``."""
    return events.groupBy("acao").agg(F.count("*").alias("n"))
