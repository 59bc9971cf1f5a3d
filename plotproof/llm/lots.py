"""Texts in lots: groups of rows that one task reads together, each bounded in size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotproof.session import materialise

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
LAST = np.iinfo(np.int64).max


def characters(documento: DataFrame) -> int:
    """Characters of all texts, to size lots and buckets by."""
    return documento.agg(F.coalesce(F.sum(F.length("texto").cast("long")), F.lit(0))).first()[0]


def with_order(documento: DataFrame) -> DataFrame:
    """Column ``ordem``: a number that orders rows as ``id`` does, null ids last, equal ids alike.

    Whole-number ids are taken as they are; others are sorted once over all tasks,
    written, and numbered by their place.
    """
    if isinstance(documento.schema["id"].dataType, _INTEGERS):
        return documento.withColumn("ordem", F.coalesce(F.col("id").cast("long"), F.lit(int(LAST))))
    ids = documento.select("id").where("id is not null").distinct().sort("id")
    places = materialise(ids.withColumn("ordem", F.monotonically_increasing_id()), "ordem-dos-ids")
    return documento.join(places, "id", "left").withColumn("ordem", F.coalesce("ordem", F.lit(int(LAST))))


def in_lots(documento: DataFrame, lots: int) -> DataFrame:
    """Column ``lote``, by a hash of id and text: the same on every reading, equal in expected size."""
    return documento.withColumn("lote", F.pmod(F.xxhash64("id", "texto"), F.lit(lots)).cast("int"))


def planes(values: np.ndarray) -> bytes:
    """Bytes of numbers, most significant byte of all first: like bytes compress well together."""
    return values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    turned = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return np.ascontiguousarray(turned).view(f">{kind}").ravel().astype(kind)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)
