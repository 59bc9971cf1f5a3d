"""The findings behind a check, one row each: alerts, embargo terms, protected areas, listed links.

Checks keep counts and totals; these tables name what was counted. Rows, not
arrays, so a parcel with many findings is no wide row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotproof.functions.numbers import round_half_up
from plotproof.functions.text import digits
from plotproof.operators.spatial import distinct_geometries, geometry_key, spatial_pairs
from plotproof.plans.context import Context
from plotproof.plans.facts import area_severity, deny_list


def of_rows(pairs: DataFrame, parcels: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of geometries as pairs of the rows that hold them.

    Layer rows come first and parcels, the larger table, last: the pairs of rows are made by that
    join alone and shuffled no more.
    """
    return pairs.join(rows, "r_gkey").join(parcels, "l_gkey")


def _measured(ctx: Context, layer: DataFrame, radius: float) -> DataFrame:
    """Every (parcel, layer row) that meets or lies within the radius, with the layer's columns and the measures."""
    left = distinct_geometries(ctx.talhao, crs=ctx.crs)
    right = distinct_geometries(layer, crs=ctx.crs)
    pairs = spatial_pairs(left, right, radius).select("l_gkey", "r_gkey", "intersects", "area", "distance")
    parcels = ctx.talhao.select(
        F.col("id").alias("talhao_id"), F.col("area_ha").alias("_area_talhao"), geometry_key("geom_wkt").alias("l_gkey")
    )
    rows = layer.withColumn("r_gkey", geometry_key("geom_wkt")).drop("geom_wkt")
    return of_rows(pairs, parcels, rows).drop("l_gkey", "r_gkey")


def _hectares(places: int) -> Column:
    return round_half_up(F.col("area") / 10000.0, places)


def alert_findings(ctx: Context) -> DataFrame:
    """Alerts inside each parcel: id, day of detection, common area, and whether it lies after the cutoff."""
    found = _measured(ctx, ctx.alerta, 0.0).where("intersects")
    day = F.to_date("data_deteccao")
    return found.select(
        "talhao_id", "id_alerta", day.alias("data_deteccao"), _hectares(4).alias("area_ha"),
        F.coalesce(day > F.lit(ctx.params.cutoff).cast("date"), F.lit(False)).alias("depois_do_corte"),
    )


def embargo_findings(ctx: Context) -> DataFrame:
    """Embargo terms that meet a parcel or lie nearer than the limit, nearest first.

    Area and share of the parcel for those that meet it, the distance for all.
    """
    limit = ctx.params.embargo_near_m
    found = _measured(ctx, ctx.embargo, limit).where(F.col("intersects") | (F.col("distance") < limit))
    share = F.when(F.col("_area_talhao") > 0, F.col("area") / 10000.0 / F.col("_area_talhao") * 100.0).otherwise(0.0)
    rows = found.select(
        "talhao_id", F.coalesce("NUM_TAD", F.lit("sem numero")).alias("num_tad"), F.col("NOME_EMBARGADO").alias("embargado"),
        F.col("intersects").alias("intersecta"), _hectares(4).alias("area_ha"), round_half_up(share, 2).alias("pct"),
        round_half_up(F.col("distance"), 1).alias("distancia_m"), "origem_geometria",
    )
    # The terms around one parcel are few, whatever the size of the layer.
    nearest = Window.partitionBy("talhao_id").orderBy("distancia_m", "num_tad")
    return rows.withColumn("ordem", F.row_number().over(nearest))


def protected_area_findings(ctx: Context) -> DataFrame:
    """Protected areas that meet a parcel, with their common area and the severity of their category."""
    found = _measured(ctx, ctx.protegida, 0.0).where("intersects")
    category = F.lower(F.trim(F.coalesce("categoria_area", F.lit(""))))
    return found.select(
        "talhao_id", "id_area", "nome_area", "tipo_area",
        F.when(category == "", "nao_informada").otherwise(category).alias("categoria_area"), _hectares(4).alias("area_ha"),
        area_severity(F.col("tipo_area"), F.col("categoria_area")).alias("severidade"),
    )


def deny_list_links(ctx: Context) -> DataFrame:
    """Listed producers of each lot: (lote_id, produtor_id, cpf, numero_inscricao, ano_inclusao).

    One row per lot and producer; a parcel's links are those of its lots, joined by
    ``lote_talhao`` where they are wanted and never expanded here.
    """
    everyone = ctx.talhao if ctx.vinculos is None else ctx.vinculos
    owners = everyone.select(F.col("id").alias("talhao_id"), "produtor_id")
    listed = deny_list(ctx.lista_suja).select("cpf", "numero_inscricao", "ano_inclusao")
    people = ctx.produtor.select(F.col("id").alias("produtor_id"), digits(F.col("cpf")).alias("cpf")).join(listed, "cpf")
    links = ctx.lote_talhao.join(owners, "talhao_id").select("lote_id", "produtor_id").distinct()
    return links.join(people, "produtor_id").select("lote_id", "produtor_id", "cpf", "numero_inscricao", "ano_inclusao")
