"""Bulk embargo terms to a regional layer: filter, rings, geometry preference, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotproof.functions import geometry as G
from plotproof.functions.numbers import comma_decimal
from plotproof.functions.text import fold_upper

# The region of the cut, the default area and the frame of plausible coordinates.
REGION = ("ALTAMIRA", "BRASIL NOVO", "MEDICILANDIA", "URUARA")
DEFAULT_HA, MIN_RADIUS_M, METRES_PER_DEGREE = 50.0, 150.0, 111320.0
LON_RANGE, LAT_RANGE = (-75.0, -30.0), (-35.0, 6.0)


def regional_cut(terms: DataFrame, uf: str = "PA", towns: tuple[str, ...] = REGION) -> DataFrame:
    return terms.where((fold_upper(F.col("UF")) == uf) & fold_upper(F.col("MUNICIPIO")).isin(*towns))


def counts_by_town(cut: DataFrame) -> DataFrame:
    return cut.groupBy(fold_upper(F.col("MUNICIPIO")).alias("municipio")).agg(F.count("*").alias("n"))


def rings(vertices: DataFrame, order: str = "linha") -> DataFrame:
    """Closed ring per (SEQ_TAD, SEQ_POLIGONO) with at least three readable vertices, in file order."""
    v = vertices.withColumns({"x": comma_decimal(F.col("LONGITUDE")), "y": comma_decimal(F.col("LATITUDE"))})
    v = v.where("SEQ_TAD is not null and x is not null and y is not null")
    # One ring is one polygon's outline, so the list is as long as the polygon itself.
    grouped = v.groupBy("SEQ_TAD", "SEQ_POLIGONO").agg(F.sort_array(F.collect_list(F.struct(order, "x", "y"))).alias("v"))
    pts = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = F.when(F.get(pts, F.lit(0)) == F.element_at(pts, -1), pts).otherwise(F.concat(pts, F.slice(pts, 1, 1)))
    return grouped.where(F.size("v") >= 3).select("SEQ_TAD", "SEQ_POLIGONO", closed.alias("ring"))


def polygons(vertices: DataFrame) -> DataFrame:
    """All rings of a term as one multipolygon; overlapping rings count once when measured."""
    order = F.struct("SEQ_POLIGONO", "ring")
    return rings(vertices).groupBy("SEQ_TAD").agg(
        F.transform(F.sort_array(F.collect_list(order)), lambda r: F.array(r["ring"])).alias("montado")
    )


def declared_circle(lon: Column, lat: Column, hectares: Column) -> Column:
    """Circle of the declared area around the point of the term, in degrees."""
    ha = F.coalesce(F.when(hectares != 0, hectares), F.lit(DEFAULT_HA))
    radius = F.greatest(F.lit(MIN_RADIUS_M), F.sqrt(ha * 10000.0 / 3.14159)) / METRES_PER_DEGREE
    inside = (lon > LON_RANGE[0]) & (lon < LON_RANGE[1]) & (lat > LAT_RANGE[0]) & (lat < LAT_RANGE[1])
    return F.when(inside, G.circle(lon, lat, radius))


def with_geometry(cut: DataFrame, vertices: DataFrame) -> DataFrame:
    """Own WKT, else assembled vertices, else declared circle; rows without any are dropped."""
    joined = cut.join(polygons(vertices), "SEQ_TAD", "left")
    own = G.parse_wkt(F.col("GEOM_AREA_EMBARGADA"))
    circle = declared_circle(
        comma_decimal(F.col("NUM_LONGITUDE_TAD")), comma_decimal(F.col("NUM_LATITUDE_TAD")), comma_decimal(F.col("QTD_AREA_EMBARGADA"))
    )
    joined = joined.withColumns({"_own": own, "_circle": circle})
    label = (
        F.when(F.col("_own").isNotNull(), "GEOM_AREA_EMBARGADA").when(F.col("montado").isNotNull(), "coordenadas.csv")
        .when(F.col("_circle").isNotNull(), "ponto TAD bufferizado pela area declarada")
    )
    out = joined.withColumns({"geom": F.coalesce("_own", "montado", "_circle"), "origem_geometria": label})
    out = out.where("origem_geometria is not null").drop("_own", "_circle", "montado")
    return out.withColumn("geom_wkt", G.to_wkt(F.col("geom")))


def provenance(terms: DataFrame, cut: DataFrame, layer: DataFrame, updated: str) -> DataFrame:
    """One row about the source: base date and counts at every step."""
    one = lambda df: df.withColumn("_", F.lit(1))
    a = one(terms.agg(F.max(updated).alias("data_atualizacao_base"), F.count("*").alias("total_termos"),
                      F.count_if(fold_upper(F.col("UF")) == "PA").alias("termos_uf")))
    b = one(cut.agg(F.count("*").alias("termos_recorte")))
    c = one(layer.agg(F.count("*").alias("termos_com_geometria")))
    return a.join(b, "_").join(c, "_").drop("_")
