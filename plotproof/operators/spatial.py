"""Spatial join in two phases on an adaptive grid.

Both sides are reduced to distinct geometries first, so copies of one polygon
are measured once and fanned back out by key. The plane is cut into a quadtree whose
cells are split where many vertices lie, so no cell is hot, however
large a polygon over it. Candidates meet by an equi-join on cells with keys and
bounds alone. Pairs of boxes are measured there by built-in arithmetic; only for the
others are coordinates fetched, by key, cut to pieces along the cells, and measured cell by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotproof.functions import geometry as G
from plotproof.functions import predicates as P
from plotproof.session import materialise, spread

BOUNDS = ("xmin", "ymin", "xmax", "ymax")
#: Levels of the quadtree: cells of the coarsest are 2 to this power wider than those of the finest.
LEVELS = 11
#: Vertices of both sides from which a cell is split.
CROWDED = 4_096


def geometry_key(wkt: Column | str) -> Column:
    """128 bits that name a geometry text."""
    return F.substring(F.unhex(F.sha2(F.col(wkt) if isinstance(wkt, str) else wkt, 256)), 1, 16)


def distinct_geometries(df: DataFrame, wkt: str = "geom_wkt", crs: str = "utm22s", extra=()) -> DataFrame:
    """One prepared row per distinct geometry text, keyed ``gkey``; ``extra`` aggregates ride along."""
    keyed = df.where(F.col(wkt).isNotNull()).groupBy(geometry_key(wkt).alias("gkey"), F.col(wkt).alias("_wkt"))
    return prepared(keyed.agg(*extra) if extra else keyed.agg(F.count("*").alias("copies")), crs)


def prepared(unique: DataFrame, crs: str) -> DataFrame:
    """Parse and project each distinct geometry (text ``_wkt``) once and keep the result as a table:
    scans for the grid then read four bound columns and no text is parsed twice. Rows are dealt
    out before they are parsed: few short texts would else be the work of a few tasks. Unreadable ones go
    when the table is read: a filter before that would be carried down to the rows that share a text and parse each."""
    return materialise(G.prepare(spread(unique), "_wkt", crs).drop("_wkt"), "geometry").where(F.col("xmin").isNotNull())


def crowded_cells(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Cells (``level``, ``cx``, ``cy``) with so many vertices of both sides that they are split. All cells around one are in, too."""
    points = []
    for side in (left, right):
        middle = [((F.col(f"{a}min") + F.col(f"{a}max")) / 2).alias(a) for a in "xy"]
        # A box counts with its corners at its middle, so its coordinates are not read.
        points.append(side.where("is_box").select(*middle, F.lit(4).alias("n")))
        points.append(side.where("not is_box").select(F.explode(F.arrays_zip("xs", "ys")).alias("v")).select("v.xs", "v.ys", F.lit(1)))
    rows = points[0]
    for part in points[1:]:
        rows = rows.union(part)
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))))
    size = F.pow(F.lit(2.0), F.col("level")) * cell
    counted = rows.groupBy("level", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(F.sum("n").alias("n"))
    return materialise(counted.where(F.col("n") > CROWDED).select("level", "cx", "cy"), "celulas")


def in_cells(df: DataFrame, crowded: DataFrame, levels: list[int], cell: float) -> DataFrame:
    """One row per row of ``df`` and cell of the quadtree that its bounds touch."""
    top = cell * 2.0**LEVELS
    rows = df.withColumn("level", F.lit(LEVELS))
    for axis in "xy":
        span = F.sequence(F.floor(F.col(f"{axis}min") / top), F.floor(F.col(f"{axis}max") / top))
        rows = rows.withColumn(f"c{axis}", F.explode(span))
    for level in sorted(levels, reverse=True):
        size = cell * 2.0 ** (level - 1)
        half = F.struct(F.lit(level - 1).alias("level"), *[F.lit(0).cast("long").alias(f"c{a}") for a in "xy"])
        quarters = []
        for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
            x, y = F.col("cx") * 2 + dx, F.col("cy") * 2 + dy
            touched = (x >= F.floor(F.col("xmin") / size)) & (x <= F.floor(F.col("xmax") / size)) & (y >= F.floor(F.col("ymin") / size)) & (y <= F.floor(F.col("ymax") / size))
            quarters.append(F.when(touched, half.withField("cx", x).withField("cy", y)))
        split = crowded.where(F.col("level") == level).select("level", "cx", "cy", F.lit(True).alias("_split"))
        here = F.struct("level", "cx", "cy")
        rows = rows.join(split, ["level", "cx", "cy"], "left")
        parts = F.when(F.col("_split"), F.array_compact(F.array(*quarters))).otherwise(F.array(here))
        rows = rows.select(*df.columns, F.explode(parts).alias("_c")).select(*df.columns, "_c.level", "_c.cx", "_c.cy")
    return rows


def candidates(left: DataFrame, right: DataFrame, cell: float, among: DataFrame | None = None) -> DataFrame:
    """Pairs of rows that meet in a cell and whose bounds overlap, once per cell of theirs inside the common bounds.

    Columns ``l_*``, ``r_*``, the cell and ``primeira``: true in the one cell that holds the lower-left
    corner of the common bounds. ``right`` has ``reach`` added to its bounds already. No coordinates.
    ``among``: as for :func:`spatial_pairs`.
    """
    crowded = crowded_cells(left, right, cell)
    levels = [r[0] for r in crowded.select("level").distinct().collect()]  # at most one number per level
    sides = []
    for name, side in (("l", left), ("r", right)):
        narrow = side.select(*[c for c in side.columns if c not in ("xs", "ys", "sizes")])
        placed = in_cells(narrow, crowded, levels, cell)
        sides.append(placed.select("level", "cx", "cy", *[F.col(c).alias(f"{name}_{c}") for c in narrow.columns]))
    size = F.pow(F.lit(2.0), F.col("level")) * cell
    place = ["level", "cx", "cy"]
    met = sides[0].join(sides[1], place) if among is None else sides[0].join(among, "l_gkey").join(sides[1], [*place, "r_gkey"])
    inside, first = F.lit(True), F.lit(True)
    for axis in "xy":
        low, high = F.greatest(f"l_{axis}min", f"r_{axis}min"), F.least(f"l_{axis}max", f"r_{axis}max")
        at = F.floor(low / size)
        inside = inside & (low <= high) & (F.col(f"c{axis}") >= at) & (F.col(f"c{axis}") <= F.floor(high / size))
        first = first & (F.col(f"c{axis}") == at)
    return met.where(inside).withColumn("primeira", first)


def _cut(side: DataFrame, wanted: DataFrame, cell: float) -> DataFrame:
    """Pieces of the geometries in the cells they are wanted in."""
    asked = F.collect_set("asked") if "asked" in wanted.columns else F.lit(None).cast("array<binary>")
    per = wanted.groupBy("gkey").agg(F.collect_set(F.struct("level", "cx", "cy")).alias("cells"), asked.alias("asked"))
    shapes = side.groupBy("gkey").agg(F.max("reach").alias("reach")) if "reach" in side.columns else None
    coords = side.select("gkey", "is_box", "xs", "ys", "sizes")
    if shapes is not None:
        coords = coords.dropDuplicates(["gkey"]).join(shapes, "gkey")
    else:
        coords = coords.withColumn("reach", F.lit(0.0))
    rows = coords.join(per, "gkey").select("gkey", "is_box", "reach", "xs", "ys", "sizes", "cells", "asked")
    return spread(rows, "gkey").mapInArrow(P.cut_batches(cell), P.PIECE)


def measured_pieces(left: DataFrame, right: DataFrame, pairs: DataFrame, cell: float, box_shortcut: bool = True, named: bool = False) -> DataFrame:
    """Measures (``l_gkey``, ``r_gkey``, ``intersects``, ``area``, ``distance``) of the pairs that are no boxes.

    ``pairs``: keys and cells of such candidates. Each geometry is cut once; the pieces of a
    cell meet in one task, which holds the vertices of that cell alone. ``named``: only the pairs
    themselves are measured there, not all pairs of a cell; each left geometry carries its partners' keys.
    """
    partner = [F.col("r_gkey").alias("asked")] if named else []
    lefts = _cut(left, pairs.select(F.col("l_gkey").alias("gkey"), "level", "cx", "cy", *partner), cell)
    rights = _cut(right, pairs.select(F.col("r_gkey").alias("gkey"), "level", "cx", "cy"), cell)
    place = ["level", "cx", "cy"]
    found = lefts.groupBy(*place).cogroup(rights.groupBy(*place)).applyInArrow(P.measure_cell(cell, box_shortcut), P.MEASURED)
    return found.groupBy("l_gkey", "r_gkey").agg(F.max("intersects").alias("intersects"), F.sum("area").alias("area"), F.min("distance").alias("distance"))


def spatial_pairs(
    left: DataFrame, right: DataFrame, radius: float | Column = 0.0, cell: float = 250.0, box_shortcut: bool = True,
    among: DataFrame | None = None,
) -> DataFrame:
    """Pairs of prepared geometries that intersect or lie within ``radius`` (inclusive).

    ``cell``: side of the finest grid cell. Output: ``l_*`` and ``r_*`` columns of both sides
    (without geometry) plus ``intersects``, ``area`` (common area) and ``distance``. ``left`` has
    one row per ``gkey``; ``right`` may have several, of different other columns and radius. ``among``:
    distinct pairs of keys (``l_gkey``, ``r_gkey``), for a join with a further condition that few pairs of a place meet;
    others then meet in no cell.
    """
    reach = radius if isinstance(radius, Column) else F.lit(float(radius))
    reached = right.withColumn("reach", reach.cast("double"))
    grown = reached.withColumns({b: F.col(b) + F.col("reach") * (1 if b.endswith("max") else -1) for b in BOUNDS})
    met = candidates(left, grown, cell, among)
    # Candidates carry the grown bounds of the right side; shrink them again.
    for bound in BOUNDS:
        back = F.col("r_reach") * (-1 if bound.endswith("max") else 1)
        met = met.withColumn(f"r_{bound}", F.col(f"r_{bound}") + back)
    keep = [c for c in met.columns if c[:2] in ("l_", "r_") and c[2:] not in (*BOUNDS, "is_box")]
    simple = F.col("l_is_box") & F.col("r_is_box") if box_shortcut else F.lit(False)
    box = box_measures_of(met.where("primeira").where(simple), keep) if box_shortcut else None
    others = materialise(met.where(~simple).select(*keep, "level", "cx", "cy", "primeira"), "candidatos")
    shapes = measured_pieces(left, reached, others, cell, box_shortcut, among is not None)
    slow = others.where("primeira").select(*keep).join(shapes, ["l_gkey", "r_gkey"]).select(*keep, "intersects", "area", "distance")
    found = slow if box is None else box.unionByName(slow)
    return found.where(F.col("intersects") | (F.col("distance") <= F.col("r_reach"))).drop("r_reach")


def box_measures_of(met: DataFrame, keep: list[str]) -> DataFrame:
    return met.select(*keep, *[value.alias(name) for name, value in P.box_measures("l", "r").items()])
