"""Exact polygon measures on pieces: polygons cut along grid cells, measured cell by cell.

Spark finds the cells and deals pieces out by cell; this helper cuts one geometry and
measures the pieces of one cell with numpy. A piece holds the rings clipped to its cell, whose
winding numbers inside the cell are those of the whole polygon, and the polygon's own
edges near the cell, uncut. So a common area is a sum over cells, a distance a
minimum, and no step handles more than the vertices of one cell. Rings are oriented
(shells counter-clockwise, holes clockwise) and filled by the non-zero rule, so
overlapping members of a multipolygon count once, as in their union.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship this small helper with the job, so executors need no installed package for it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Elements of the largest table of edge pairs held at once.
BLOCK = 1 << 18
PIECE = (
    "level int, cx long, cy long, gkey binary, is_box boolean, reach double,"
    " rx array<double>, ry array<double>, rs array<int>, e array<double>, asked array<binary>"
)
MEASURED = "l_gkey binary, r_gkey binary, intersects boolean, area double, distance double"


@dataclass
class Piece:
    """Rings within one cell, closed; own edges (n, 4) of the geometry near it; the cell's bounds (x0, y0, x1, y1), if any."""

    rings: list
    own: np.ndarray
    cell: tuple | None = None
    cache: dict = field(default_factory=dict)

    @property
    def edges(self) -> np.ndarray:
        """Directed edges of the rings, (n, 4)."""
        if "edges" not in self.cache:
            solid = [np.column_stack([r[:-1], r[1:]]) for r in self.rings if len(r) > 1]
            self.cache["edges"] = np.concatenate(solid) if solid else np.zeros((0, 4))
        return self.cache["edges"]

    @property
    def knots(self) -> np.ndarray:
        """x of vertices and of the crossings of the rings with themselves: found once for all partners."""
        if "knots" not in self.cache:
            self.cache["knots"] = np.concatenate([self.edges[:, 0], _crossings(self.edges, self.edges)])
        return self.cache["knots"]

    @property
    def box(self) -> tuple | None:
        """Bounds of the rings if they are one rectangle along the axes."""
        if "box" not in self.cache:
            self.cache["box"] = _box_of(self.rings[0]) if len(self.rings) == 1 else None
        return self.cache["box"]

    @property
    def convex(self) -> bool:
        """Whether the rings are one convex ring."""
        if "convex" not in self.cache:
            self.cache["convex"] = len(self.rings) == 1 and _is_convex(self.rings[0])
        return self.cache["convex"]

    @property
    def inner(self) -> np.ndarray:
        """A point in the middle of what each own edge has inside the cell, (n, 2)."""
        if "inner" not in self.cache:
            self.cache["inner"] = _middles(self.own, self.cell)
        return self.cache["inner"]

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        if "bounds" not in self.cache:
            x = np.concatenate([self.edges[:, 0], self.own[:, 0], self.own[:, 2]])
            y = np.concatenate([self.edges[:, 1], self.own[:, 1], self.own[:, 3]])
            self.cache["bounds"] = (x.min(), y.min(), x.max(), y.max())
        return self.cache["bounds"]


def oriented_rings(xs, ys, sizes) -> list[np.ndarray]:
    """Closed rings (n, 2), shells counter-clockwise, holes (negative sizes) clockwise."""
    out, at = [], 0
    for size in sizes:
        n = abs(int(size))
        ring = np.column_stack([xs[at : at + n], ys[at : at + n]]).astype(float)
        at += n
        d = ring - ring[0]
        signed = np.sum(d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1])
        out.append(ring[::-1] if (signed < 0) == (size > 0) and n > 1 else ring)
    return out


def _own_edges(rings) -> np.ndarray:
    return np.concatenate([np.column_stack([r, r]) if len(r) == 1 else np.column_stack([r[:-1], r[1:]]) for r in rings])


def _inside(edges, px, py):
    """Non-zero winding test of points against directed edges."""
    out, step = np.zeros(len(px), bool), max(1, BLOCK // max(len(edges), 1))
    x1, y1, x2, y2 = (edges[:, k, None] for k in range(4))
    for i in range(0, len(px), step):
        x, y = px[i : i + step], py[i : i + step]
        cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        up = (y1 <= y) & (y2 > y) & (cross > 0)
        down = (y1 > y) & (y2 <= y) & (cross < 0)
        out[i : i + step] = (up.sum(0) - down.sum(0)) != 0
    return out


def _nearest(px, py, edges) -> float:
    """Least distance of points to segments."""
    best, step = np.inf, max(1, BLOCK // max(len(edges), 1))
    x1, y1, x2, y2 = edges.T
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    length = np.where(length == 0, 1.0, length)
    for i in range(0, len(px), step):
        x, y = px[i : i + step, None], py[i : i + step, None]
        t = np.clip(((x - x1) * dx + (y - y1) * dy) / length, 0.0, 1.0)
        best = min(best, float(np.hypot(x - (x1 + t * dx), y - (y1 + t * dy)).min()))
    return best


def _crossings(a, b) -> np.ndarray:
    """x of all points where an edge of ``a`` meets an edge of ``b`` that is not parallel."""
    found, step = [], max(1, BLOCK // max(len(b), 1))
    bx, by, bx2, by2 = b.T
    sx, sy = bx2 - bx, by2 - by
    for i in range(0, len(a), step):
        ax, ay, ax2, ay2 = (a[i : i + step, k, None] for k in range(4))
        rx, ry = ax2 - ax, ay2 - ay
        den = rx * sy - ry * sx
        safe = np.where(den == 0, 1.0, den)
        t = ((bx - ax) * sy - (by - ay) * sx) / safe
        u = ((bx - ax) * ry - (by - ay) * rx) / safe
        hit = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        found.append((ax + t * rx)[hit])
    return np.concatenate(found) if found else np.zeros(0)


def _middles(own, cell) -> np.ndarray:
    """Middle of the part of each edge that lies in the cell; edges that miss it have none."""
    if cell is None or not len(own):
        return (own[:, :2] + own[:, 2:]) / 2
    low, high = np.zeros(len(own)), np.ones(len(own))
    for axis in (0, 1):
        start, run = own[:, axis], own[:, axis + 2] - own[:, axis]
        still = run == 0
        safe = np.where(still, 1.0, run)
        a, b = (cell[axis] - start) / safe, (cell[axis + 2] - start) / safe
        low = np.where(still, low, np.maximum(low, np.minimum(a, b)))
        high = np.where(still, np.where((start >= cell[axis]) & (start <= cell[axis + 2]), high, -1.0), np.minimum(high, np.maximum(a, b)))
    t = ((low + high) / 2)[:, None]
    return (own[:, :2] + t * (own[:, 2:] - own[:, :2]))[low <= high]


def _covered(edges, x):
    """Intervals [lo, hi] where a vertical line is inside the shape."""
    x1, y1, x2, y2 = edges.T
    right, left = (x1 <= x) & (x2 > x), (x2 <= x) & (x1 > x)
    use = right | left
    if not use.any():
        return []
    y = y1[use] + (x - x1[use]) / (x2[use] - x1[use]) * (y2[use] - y1[use])
    step = np.where(right[use], 1, -1)
    order = np.argsort(y, kind="stable")
    y, depth = y[order], np.cumsum(step[order])
    return [(y[i], y[i + 1]) for i in range(len(y) - 1) if depth[i] != 0]


def _signed_area(ring: np.ndarray) -> float:
    d = ring - ring[0]
    return float(np.sum(d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1])) / 2


def _box_of(ring: np.ndarray) -> tuple | None:
    """Bounds of a closed ring that goes round a rectangle along the axes once."""
    if len(ring) < 5:
        return None
    low, high = ring.min(axis=0), ring.max(axis=0)
    if not (((ring == low) | (ring == high)).all()):
        return None
    size = float(np.prod(high - low))
    return (*low, *high) if size > 0 and abs(abs(_signed_area(ring)) - size) <= 1e-9 * size else None


def _is_convex(ring: np.ndarray) -> bool:
    """Whether a closed ring turns one way and goes round once; turns within rounding count as none."""
    d = np.diff(ring, axis=0)
    length = np.hypot(d[:, 0], d[:, 1])
    d = d[length > 0]
    if len(d) < 3:
        return False
    after = np.roll(d, -1, axis=0)
    cross, dot = d[:, 0] * after[:, 1] - d[:, 1] * after[:, 0], (d * after).sum(axis=1)
    turn = np.arctan2(cross, dot)
    return bool((turn >= -1e-9).all()) and abs(float(turn.sum()) - 2 * np.pi) < 1e-6


def _area_in_box(a: Piece, b: Piece) -> float | None:
    """Common area of a rectangle and a convex ring, cut to it side by side; none for other shapes."""
    for box, ring in ((b, a), (a, b)):
        if box.box is not None and ring.convex:
            part = clip_ring(ring.rings[0], box.box)
            return abs(_signed_area(part)) if len(part) > 2 else 0.0
    return None


def _common_area(a: Piece, b: Piece) -> float:
    """Exact area of the intersection by vertical slabs: edges do not cross
    inside a slab, so its area is width times the common length at its middle."""
    cut_area = _area_in_box(a, b)
    if cut_area is not None:
        return cut_area
    lo, hi = max(a.knots.min(), b.knots.min()), min(a.knots.max(), b.knots.max())
    touch = lambda e: e[(np.minimum(e[:, 0], e[:, 2]) <= hi) & (np.maximum(e[:, 0], e[:, 2]) >= lo)]
    first, second = touch(a.edges), touch(b.edges)
    xs = np.concatenate([a.knots, b.knots, _crossings(first, second), [lo, hi]])
    xs = np.unique(xs[(xs >= lo) & (xs <= hi)])
    total = 0.0
    for x1, x2 in zip(xs[:-1], xs[1:]):
        mid = (x1 + x2) / 2
        p, q = _covered(first, mid), _covered(second, mid)
        length = sum(max(0.0, min(s[1], t[1]) - max(s[0], t[0])) for s in p for t in q)
        total += length * (x2 - x1)
    return total


def measure_pieces(a: Piece, b: Piece) -> tuple[bool, float, float]:
    """(intersects, common area, distance) within one cell; the distance is infinite where one has no own edge near."""
    common = _area_in_box(a, b) if len(a.edges) and len(b.edges) else None
    if common:
        return True, common, 0.0
    near = len(a.own) and len(b.own)
    hit = bool(near) and len(_crossings(a.own, b.own)) > 0
    for one, other in ((a, b), (b, a)):
        if not hit and len(one.inner) and len(other.edges):
            hit = bool(_inside(other.edges, *one.inner.T).any())
    if not hit and a.cell is not None and len(a.edges) and len(b.edges):
        middle = np.array([(a.cell[0] + a.cell[2]) / 2]), np.array([(a.cell[1] + a.cell[3]) / 2])
        hit = bool(_inside(a.edges, *middle)[0] and _inside(b.edges, *middle)[0])
    if not hit:
        apart = np.inf
        if near:
            ends = [(np.concatenate([p.own[:, 0], p.own[:, 2]]), np.concatenate([p.own[:, 1], p.own[:, 3]])) for p in (a, b)]
            apart = min(_nearest(*ends[0], b.own), _nearest(*ends[1], a.own))
        if apart > 0:
            return False, 0.0, apart
    return True, _common_area(a, b) if len(a.edges) and len(b.edges) else 0.0, 0.0


def measure(ax, ay, ar, bx, by, br) -> tuple[bool, float, float]:
    """The same for two whole geometries, as flat coordinates and signed ring sizes."""
    x0, y0 = float(ax[0]), float(ay[0])
    pieces = []
    for x, y, sizes in ((ax, ay, ar), (bx, by, br)):
        rings = oriented_rings(np.asarray(x) - x0, np.asarray(y) - y0, sizes)
        pieces.append(Piece([r for r in rings if len(r) > 1], _own_edges(rings)))
    return measure_pieces(*pieces)


def clip_ring(ring: np.ndarray, box) -> np.ndarray:
    """Closed ring cut to a rectangle, side by side; inside it all winding numbers stay as they are."""
    for axis, sign, value in ((0, 1, box[0]), (1, 1, box[1]), (0, -1, box[2]), (1, -1, box[3])):
        if len(ring) < 2:
            return ring[:0]
        depth = sign * (ring[:, axis] - value)
        kept = depth >= 0
        if kept.all():
            continue
        p, q, dp, dq = ring[:-1], ring[1:], depth[:-1], depth[1:]
        cross = kept[:-1] != kept[1:]
        t = dp / np.where(cross, dp - dq, 1.0)
        met = p + t[:, None] * (q - p)
        met[:, axis] = value
        both = np.stack([p, met], axis=1).reshape(-1, 2)
        ring = both[np.stack([kept[:-1], cross], axis=1).ravel()]
        if len(ring):
            ring = np.concatenate([ring, ring[:1]])
    return ring


def cut(rings, own, cells, reach: float):
    """(place in ``cells``, rings, own edges) of every cell, rows (x0, y0, x1, y1), that the geometry comes near.

    Halves of the cells are cut out together, so the cost grows with the vertices times
    the logarithm of the cells.
    """
    todo = [(np.arange(len(cells)), rings, own)]
    while todo:
        which, rings, own = todo.pop()
        part = cells[which]
        box = (*part[:, :2].min(axis=0), *part[:, 2:].max(axis=0))
        rings = [c for r in rings if len(c := clip_ring(r, box)) > 1]
        x, y = own[:, [0, 2]], own[:, [1, 3]]
        near = (x.min(axis=1) <= box[2] + reach) & (x.max(axis=1) >= box[0] - reach)
        own = own[near & (y.min(axis=1) <= box[3] + reach) & (y.max(axis=1) >= box[1] - reach)]
        if not rings and not len(own):
            continue
        if len(which) == 1:
            yield int(which[0]), rings, own
            continue
        axis = int(box[3] - box[1] > box[2] - box[0])
        order = which[np.argsort(part[:, axis], kind="stable")]
        todo += [(order[: len(order) // 2], rings, own), (order[len(order) // 2 :], rings, own)]


def cut_batches(size: float):
    """Arrow function: rows (gkey, is_box, reach, xs, ys, sizes, cells, asked) to one row per piece; ``size``: the finest cell's side."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(11)]
            for row in batch.to_pylist():
                rings = oriented_rings(np.array(row["xs"]), np.array(row["ys"]), row["sizes"])
                own, solid = _own_edges(rings), [r for r in rings if len(r) > 1]
                named = np.array([[c["level"], c["cx"], c["cy"]] for c in row["cells"]], np.int64)
                side = size * 2.0 ** named[:, 0]
                low = named[:, 1:] * side[:, None]
                cells = np.concatenate([low, low + side[:, None]], axis=1)
                for i, part, edges in cut(solid, own, cells, row["reach"]):
                    flat = np.concatenate(part) if part else np.zeros((0, 2))
                    values = (*named[i].tolist(), row["gkey"], row["is_box"], row["reach"], flat[:, 0], flat[:, 1], [len(r) for r in part], edges.ravel(), row["asked"])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield _piece_batch(out)

    return run


def _piece_batch(columns) -> pa.RecordBatch:
    lists = pa.list_(pa.float64())
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.float64(), lists, lists, pa.list_(pa.int32()), lists, pa.list_(pa.binary())]
    names = ["level", "cx", "cy", "gkey", "is_box", "reach", "rx", "ry", "rs", "e", "asked"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _pieces(table: pa.Table, size: float) -> tuple[list, list[Piece], list[bool], float]:
    rows, out = table.to_pylist(), []
    for r in rows:
        side = size * 2.0 ** r["level"]
        x0, y0 = r["cx"] * side, r["cy"] * side
        # Near the cell's corner coordinates are small, which keeps their differences exact.
        ring = np.column_stack([np.array(r["rx"]) - x0, np.array(r["ry"]) - y0])
        own = np.array(r["e"]).reshape(-1, 4) - [x0, y0, x0, y0]
        stops = np.cumsum(r["rs"])[:-1] if r["rs"] else []
        out.append(Piece(np.split(ring, stops) if len(ring) else [], own, (0.0, 0.0, side, side)))
    return [r["gkey"] for r in rows], out, [r["is_box"] for r in rows], max((r["reach"] for r in rows), default=0.0)


def measure_cell(size: float, box_shortcut: bool):
    """Arrow function of one cell's pieces of both sides: measures of all pairs that come within the reach."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lkeys, lefts, lbox, _ = _pieces(left, size)
        rkeys, rights, rbox, reach = _pieces(right, size)
        rows = []

        def add(i: int, key: bytes, b: Piece) -> None:
            hit, area, apart = measure_pieces(lefts[i], b)
            if apart <= reach:
                rows.append((lkeys[i], key, hit, area, apart))

        if lefts and rights:
            at = np.array([p.bounds for p in lefts])
            flat = np.array(lbox)
            asked = left["asked"].to_pylist()
            place = {key: j for j, key in enumerate(rkeys)}
            # Lists of partners go with all pieces of a job or with none.
            wanted = [[] for _ in rkeys] if asked[0] is not None else None
            for i, keys in enumerate(asked if wanted is not None else ()):
                for key in keys:
                    if key in place:
                        wanted[place[key]].append(i)
            for j, (key, b, is_box) in enumerate(zip(rkeys, rights, rbox, strict=True)):
                own = slice(None) if wanted is None else np.array(wanted[j], int)
                x0, y0, x1, y1 = b.bounds
                near = (at[own, 0] <= x1 + reach) & (at[own, 2] >= x0 - reach) & (at[own, 1] <= y1 + reach) & (at[own, 3] >= y0 - reach)
                if box_shortcut and is_box:
                    near &= ~flat[own]
                for i in (np.flatnonzero(near) if wanted is None else own[near]).tolist():
                    add(i, key, b)
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.float64(), pa.float64())
        names = ["l_gkey", "r_gkey", "intersects", "area", "distance"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def box_measures(a: str, b: str) -> dict[str, Column]:
    """The same measures for axis-aligned boxes and points, by built-in arithmetic."""

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}")

    gap_x = F.greatest(c(a, "xmin") - c(b, "xmax"), c(b, "xmin") - c(a, "xmax"), F.lit(0.0))
    gap_y = F.greatest(c(a, "ymin") - c(b, "ymax"), c(b, "ymin") - c(a, "ymax"), F.lit(0.0))
    over_x = F.greatest(F.least(c(a, "xmax"), c(b, "xmax")) - F.greatest(c(a, "xmin"), c(b, "xmin")), F.lit(0.0))
    over_y = F.greatest(F.least(c(a, "ymax"), c(b, "ymax")) - F.greatest(c(a, "ymin"), c(b, "ymin")), F.lit(0.0))
    return {
        "intersects": (gap_x == 0) & (gap_y == 0),
        "area": over_x * over_y,
        "distance": F.sqrt(gap_x * gap_x + gap_y * gap_y),
    }
