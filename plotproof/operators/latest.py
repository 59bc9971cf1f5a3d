"""Latest-row and first-row selections.

Where the order is a number or a time, optionally with a number after it, it is packed into one
fixed-width number whose maximum is taken by hash aggregation, and the rows that hold it
are joined back; nothing is sorted for the aggregate. Other orders use ``max_by`` on a struct. Both
combine on the map side, so a key that holds a third of the rows is reduced before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _packed(df: DataFrame, order: list[Column | str]) -> Column | None:
    """One number that orders rows as ``order`` does, if it can be: whole numbers, or a time and a whole number; null first."""
    if not all(isinstance(c, str) for c in order):
        return None
    kinds = [df.schema[c].dataType for c in order]
    least = F.lit(-(1 << 63)).cast("long")
    if len(order) == 1 and isinstance(kinds[0], _WHOLE):
        return F.coalesce(F.col(order[0]).cast("long"), least)
    if len(order) == 2 and isinstance(kinds[0], T.TimestampType) and isinstance(kinds[1], _WHOLE):
        # Microseconds take 18 digits, a number 19: together they fit the widest decimal.
        time = F.coalesce(F.unix_micros(order[0]), F.lit(-(10**18) + 1)).cast("decimal(18,0)")
        number = F.coalesce(F.col(order[1]).cast("long"), least).cast("decimal(19,0)")
        return (time * F.lit("1" + "0" * 19).cast("decimal(20,0)") + number).cast("decimal(38,0)")
    return None


def latest_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Row with the greatest ``order`` per key; ``order`` must be unique within a key."""
    packed = _packed(df, order)
    if packed is None:
        rest = [c for c in df.columns if c not in keys]
        best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
        return best.select(*keys, "row.*").select(*df.columns)
    best = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(packed).alias("_ordem"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(best, same & (packed == F.col("_ordem"))).select(*df.columns)


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*").select(*df.columns)


def latest_checks(checagem: DataFrame, by_time: bool = False) -> DataFrame:
    """Current check row per (parcel, code): by insertion order, or by time then order."""
    order = ["data_execucao", "seq"] if by_time else ["seq"]
    return latest_by(checagem, ["talhao_id", "codigo"], order)


def latest_aptitude(aptidao: DataFrame) -> DataFrame:
    return latest_by(aptidao, ["produtor_id", "camada"], ["avaliado_em", "id"])
