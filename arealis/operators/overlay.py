"""Areas laid over each other: shared surface and weights, union of a tiling, validity, and points surely inside.

Outlines are edges with the inside at their left, whatever the sense of the rings in the text. Pairs of areas are
found on a grid of cells; a pair, an area or a dissolved outline is the most that one task holds at a time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ..sources.sinks import written as table
from .spatial import _inside, _upon

_RING = re.compile(r"(\(\s*)?\(([^()]+)\)")


def rings(text: str | None) -> list[tuple[bool, np.ndarray]]:
    """(whether it bounds from outside, its corners as they stand) of each ring of POLYGON or MULTIPOLYGON text."""
    out = []
    for m in _RING.finditer(text or ""):
        xy = np.array([[float(v) for v in p.split()[:2]] for p in m[2].split(",")])
        out.append((bool(m[1]), xy))
    return out


def _doubled(xy: np.ndarray) -> float:
    """Twice the surface, positive for corners that run with the inside at their left; taken from the first corner for precision."""
    d = xy - xy[0]
    return float((d[:, 0] * np.roll(d[:, 1], -1) - np.roll(d[:, 0], -1) * d[:, 1]).sum())


def oriented(text: str | None) -> np.ndarray:
    """Edges (x, y, x2, y2) with the inside at their left, without edges of no length."""
    edges = []
    for outer, xy in rings(text):
        if (_doubled(xy) > 0) != outer:
            xy = xy[::-1]
        e = np.hstack([xy, np.roll(xy, -1, axis=0)])
        edges.append(e[(e[:, :2] != e[:, 2:]).any(1)])
    return np.concatenate(edges) if edges else np.zeros((0, 4))


def surface(edges: np.ndarray) -> float:
    if not len(edges):
        return 0.0
    e = edges - np.tile(edges[0, :2], 2)
    return float((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]).sum()) / 2


def shared_surface(a: np.ndarray, b: np.ndarray) -> float:
    """Surface of the intersection of two areas given by oriented edges, holes and concave parts included.

    An area is the sum over its edges of what lies below each, counted plus under edges that run left and minus under
    those that run right. The product of two such sums is one over pairs of edges: the integral of the lower of the two
    lines over the stretch that both span, above a common base.
    """
    if not len(a) or not len(b):
        return 0.0
    base = np.minimum(a.reshape(-1, 2).min(0), b.reshape(-1, 2).min(0))
    a, b = a - np.tile(base, 2), b - np.tile(base, 2)
    lo = max(a[:, ::2].min(), b[:, ::2].min())
    hi = min(a[:, ::2].max(), b[:, ::2].max())
    a, b = (e[(e[:, ::2].max(1) > lo) & (e[:, ::2].min(1) < hi) & (e[:, 0] != e[:, 2])] for e in (a, b))
    if not len(a) or not len(b):
        return 0.0
    slope = lambda e: (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    sign_b, slope_b, total = np.sign(b[:, 0] - b[:, 2]), slope(b), 0.0
    step = max(1, (1 << 19) // len(b))
    for k in range(0, len(a), step):
        e = a[k : k + step]
        left = np.maximum(e[:, ::2].min(1)[:, None], b[:, ::2].min(1))
        width = np.maximum(np.minimum(e[:, ::2].max(1)[:, None], b[:, ::2].max(1)) - left, 0.0)
        at = lambda lines, m, x: lines[:, 1] + m * (x - lines[:, 0])
        ya, yb = e[:, 1:2] + slope(e)[:, None] * (left - e[:, :1]), at(b, slope_b, left)
        d0 = ya - yb
        d1 = d0 + (slope(e)[:, None] - slope_b) * width
        low0, low1 = np.minimum(d0, 0.0), np.minimum(d1, 0.0)
        # where the lines cross, only the part before or behind the crossing counts
        across = (d0 < 0) != (d1 < 0)
        part = np.where(across, (low0 * low0 + low1 * low1) / np.where(across, np.abs(d0 - d1), 1.0) / -2, (low0 + low1) / 2)
        total += float((np.sign(e[:, 0] - e[:, 2])[:, None] * sign_b * width * (yb + slope_b * width / 2 + part)).sum())
    return total


@F.pandas_udf(ArrayType(DoubleType()))
def _edges(texts: pd.Series) -> pd.Series:
    return pd.Series([oriented(t).ravel() for t in texts], dtype=object)


@F.pandas_udf(DoubleType())
def _surface(edges: pd.Series) -> pd.Series:
    return pd.Series([surface(np.asarray(e, float).reshape(-1, 4)) for e in edges], dtype=float)


@F.pandas_udf(DoubleType())
def _shared(one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([shared_surface(np.asarray(e, float).reshape(-1, 4), np.asarray(f, float).reshape(-1, 4)) for e, f in zip(one, other)], dtype=float)


BOUNDS = ("_x0", "_x1", "_y0", "_y1")


def oriented_edges(areas: DataFrame, keys: Sequence[str], wkt: str) -> DataFrame:
    """(*keys, _e): oriented edges of each area that has any."""
    return areas.select(*keys, _edges(wkt).alias("_e")).where(F.size("_e") > 0)


def outlines(areas: DataFrame, key: str, wkt: str) -> DataFrame:
    """(key, _e, _s, _x0, _x1, _y0, _y1): oriented edges, surface and bounds of each area that has any."""
    rows = oriented_edges(areas, [key], wkt)
    axis = lambda k: F.filter("_e", lambda _, i: i % 2 == k)
    return rows.select(key, "_e", _surface("_e").alias("_s"), F.array_min(axis(0)).alias("_x0"), F.array_max(axis(0)).alias("_x1"), F.array_min(axis(1)).alias("_y0"), F.array_max(axis(1)).alias("_y1"))


def _tiles(bounds: DataFrame, size: DataFrame) -> DataFrame:
    """A row for each cell of the grid that bounds reach; size has one row, _w and _h."""
    cells = lambda lo, hi, s: F.explode(F.sequence(F.floor(F.col(lo) / F.col(s)), F.floor(F.col(hi) / F.col(s))))
    return bounds.join(F.broadcast(size)).withColumn("_cx", cells("_x0", "_x1", "_w")).withColumn("_cy", cells("_y0", "_y1", "_h")).drop("_w", "_h")


def intersections(units: DataFrame, unit: str, areas: DataFrame, area: str, wkt: str, tolerance: float = 1e-9) -> DataFrame:
    """(unit, area, unit_area, intersection_area) of all pairs that share a surface.

    A share of at most tolerance of the smaller of both is rounding at a common boundary. The grid's cells are as large as
    a mean unit; only pairs whose bounds meet in a cell are compared, and pairs go to tasks by their own hash.
    """
    one, other = outlines(units, unit, wkt), outlines(areas, area, wkt)
    size = one.agg(F.coalesce(F.nullif(F.avg(F.col("_x1") - F.col("_x0")), F.lit(0.0)), F.lit(1.0)).alias("_w"), F.coalesce(F.nullif(F.avg(F.col("_y1") - F.col("_y0")), F.lit(0.0)), F.lit(1.0)).alias("_h"))
    here = _tiles(one.select(unit, *BOUNDS), size)
    there = _tiles(other.select(area, *BOUNDS), size).withColumnsRenamed({c: f"{c}t" for c in BOUNDS})
    near = here.join(there, ["_cx", "_cy"]).where("_x0 < _x1t AND _x0t < _x1 AND _y0 < _y1t AND _y0t < _y1").select(unit, area).distinct()
    pairs = near.join(one.select(unit, "_e", F.col("_s").alias("unit_area")), unit).join(other.select(area, F.col("_e").alias("_f"), "_s"), area)
    found = pairs.select(unit, area, "unit_area", "_s", _shared("_e", "_f").alias("intersection_area"))
    return found.where(F.col("intersection_area") > tolerance * F.least("unit_area", "_s")).drop("_s")


def overlay(units: DataFrame, unit: str, areas: DataFrame, area: str, wkt: str, sliver: float = 0.01) -> DataFrame:
    """(unit, area, intersection_area, weight, covered_fraction, is_crossing, is_sliver).

    weight is a pair's share of all that the unit shares with areas, so a covered unit's weights add up to 1;
    covered_fraction is that sum's share of the unit. A unit with several areas crosses; a part below the given
    weight is a sliver. Units without an area have no rows.
    """
    found = intersections(units, unit, areas, area, wkt)
    sums = found.groupBy(unit).agg(F.sum("intersection_area").alias("_all"), F.count("*").alias("_n"))
    rows = found.join(sums, unit).withColumn("weight", F.col("intersection_area") / F.col("_all"))
    return rows.select(unit, area, "intersection_area", "weight", (F.col("_all") / F.col("unit_area")).alias("covered_fraction"), (F.col("_n") > 1).alias("is_crossing"), (F.col("weight") < sliver).alias("is_sliver"))


# ---- union of a tiling ----


def boundary(areas: DataFrame, wkt: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, x, y, x2, y2): what is left of the areas' edges when those shared within a group cancel each other.

    Edges are cut where corners of other areas of the group lie within them, found on a grid; then each piece that runs
    both ways is none. An outer piece that comes twice means that areas overlap, which is an error. Edges are a table, and
    joins of them are sorted: their size is guessed too small for Spark to keep them from the driver.
    """
    e = oriented_edges(areas, by, wkt).select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.size("_e") - 4, F.lit(4)), lambda i: F.slice("_e", i + 1, 4))).alias("_e"))
    e = table(e.select(*by, *[F.col("_e")[k].alias(c) for k, c in enumerate(("x", "y", "x2", "y2"))]), "edges")
    size = e.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x")), F.abs(F.col("y2") - F.col("y")))).alias("_w")).withColumn("_h", F.col("_w"))
    spans = e.withColumns({"_x0": F.least("x", "x2"), "_x1": F.greatest("x", "x2"), "_y0": F.least("y", "y2"), "_y1": F.greatest("y", "y2")})
    tiles = _tiles(spans, size)
    corners = _tiles(e.select(*by, F.col("x").alias("_x0"), F.col("y").alias("_y0")).distinct().withColumns({"_x1": F.col("_x0"), "_y1": F.col("_y0")}), size).select(*by, "_cx", "_cy", F.col("_x0").alias("_px"), F.col("_y0").alias("_py"))
    dx, dy, px, py = (F.col(p) - F.col(q) for p, q in (("x2", "x"), ("y2", "y"), ("_px", "x"), ("_py", "y")))
    long2 = dx * dx + dy * dy
    along = (px * dx + py * dy) / long2
    scale = F.greatest(*[F.abs(F.col(c)) for c in ("x", "y", "x2", "y2")]) * 1e-12
    on = (F.abs(px * dy - py * dx) <= scale * F.sqrt(long2)) & (along > 0) & (along < 1) & ~((F.col("_px") == F.col("x")) & (F.col("_py") == F.col("y"))) & ~((F.col("_px") == F.col("x2")) & (F.col("_py") == F.col("y2")))
    edge = [*by, "x", "y", "x2", "y2"]
    cuts = tiles.join(corners.hint("merge"), [*by, "_cx", "_cy"]).where(on).groupBy(*edge).agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), F.col("_px").alias("x"), F.col("_py").alias("y")))).alias("_cuts"))
    counted = e.groupBy(*edge).agg(F.count("*").alias("_n"))
    cut = counted.join(cuts.hint("merge"), edge, "left")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    inner = F.transform(F.coalesce("_cuts", F.expr("array()").cast("array<struct<t:double,x:double,y:double>>")), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    stops = F.concat(F.array(point("x", "y")), inner, F.array(point("x2", "y2")))
    legs = cut.select(*by, "_n", stops.alias("_s")).select(*by, "_n", F.explode(F.arrays_zip(F.slice("_s", F.lit(1), F.size("_s") - 1).alias("p"), F.slice("_s", F.lit(2), F.size("_s") - 1).alias("q"))).alias("_l"))
    ahead = F.struct(F.col("_l.p.x"), F.col("_l.p.y")) < F.struct(F.col("_l.q.x"), F.col("_l.q.y"))
    legs = legs.select(*by, F.least("_l.p", "_l.q").alias("_p"), F.greatest("_l.p", "_l.q").alias("_q"), F.when(ahead, F.col("_n")).otherwise(-F.col("_n")).alias("_n"))
    net = legs.groupBy(*by, "_p", "_q").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    net = net.withColumn("_n", F.when(F.abs("_n") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("areas of a group overlap"))))
    start, end = F.when(F.col("_n") > 0, F.col("_p")).otherwise(F.col("_q")), F.when(F.col("_n") > 0, F.col("_q")).otherwise(F.col("_p"))
    return net.select(*by, start["x"].alias("x"), start["y"].alias("y"), end["x"].alias("x2"), end["y"].alias("y2"))


def chained(edges: np.ndarray) -> list[np.ndarray]:
    """Simple rings of oriented edges: at a corner with several ways on the leftmost is taken, and a path that meets itself is cut there."""
    ways: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for x, y, x2, y2 in edges.tolist():
        ways.setdefault((x, y), []).append((x2, y2))
    out = []
    while ways:
        at = next(iter(ways))
        path, place = [at], {at: 0}
        while True:
            here = path[-1]
            if here not in ways:
                raise ValueError("a boundary does not close")
            options = ways[here]
            if len(options) > 1 and len(path) > 1:
                back = np.arctan2(path[-2][1] - here[1], path[-2][0] - here[0])
                turn = [(back - np.arctan2(q[1] - here[1], q[0] - here[0])) % (2 * np.pi) for q in options]
                following = options.pop(int(np.argmin(turn)))
            else:
                following = options.pop()
            if not options:
                del ways[here]
            if following in place:  # a loop is complete
                first = place[following]
                out.append(np.array(path[first:]))
                for p in path[first + 1 :]:
                    del place[p]
                path = path[: first + 1]
                if first == 0:
                    break
            else:
                place[following] = len(path)
                path.append(following)
        if at in ways and not ways[at]:
            del ways[at]
    return out


def straight(loops: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Loops without corners that lie on the line between their neighbours; all at once, as there may be very many."""
    xy, first, n = _flat(loops)
    before, after = xy - xy[_beside(first, n, -1)], xy[_beside(first, n, 1)] - xy
    bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 1e-12 * np.hypot(*before.T) * np.hypot(*after.T)
    return np.split(xy[bend], np.add.reduceat(bend, first).cumsum()[:-1])


def _flat(loops: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All points of loops one after the other, where each loop begins, and how many it has."""
    n = np.array([len(r) for r in loops])
    return np.concatenate(loops), n.cumsum() - n, n


def _beside(first: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """The place of each point's neighbour, before it or after it in its loop."""
    at = np.arange(n.sum()) - np.repeat(first, n)
    return np.repeat(first, n) + (at + step) % np.repeat(n, n)


def nested(loops: Sequence[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons: an outer ring and its holes each, a hole with the smallest ring around it."""
    xy, first, n = _flat(loops)
    d = xy - np.repeat(xy[first], n, axis=0)
    turn = d[_beside(first, n, 1)]
    doubled = np.add.reduceat(d[:, 0] * turn[:, 1] - turn[:, 0] * d[:, 1], first)
    outer = np.flatnonzero(doubled > 0)
    outer = outer[np.argsort(doubled[outer], kind="stable")]
    out = [[loops[k]] for k in outer]
    low, high = np.minimum.reduceat(xy, first)[outer], np.maximum.reduceat(xy, first)[outer]
    for hole in (loops[k] for k in np.flatnonzero(doubled < 0)):
        point = np.array([inner_point(np.hstack([hole[::-1], np.roll(hole[::-1], -1, axis=0)]))])
        near = np.flatnonzero(((low <= point) & (point <= high)).all(1))
        home = next((k for k in near if _inside(point, np.hstack([out[k][0], np.roll(out[k][0], -1, axis=0)]))[0]), None)
        if home is None:
            raise ValueError("a hole lies in no ring")
        out[home].append(hole)
    return out


def written(polygons: Sequence[Sequence[np.ndarray]]) -> str:
    ring = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in np.vstack([r, r[:1]]).tolist()) + ")"
    parts = ["(" + ", ".join(map(ring, p)) + ")" for p in polygons]
    return f"POLYGON {parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(parts)})"


def dissolved(areas: DataFrame, key: str, wkt: str, by: str) -> DataFrame:
    """(by, wkt, parts, holes, surface, perimeter) of the union of each group of areas that do not overlap.

    Edges cancel in Spark's joins and sums; a task only chains the outline that a group keeps, which is its row's text.
    """
    kept = boundary(areas, wkt, [by])
    kind = dict(areas.dtypes)[by]

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        e = group[["x", "y", "x2", "y2"]].to_numpy()
        polygons = nested(straight(chained(e)))
        polygons.sort(key=lambda p: p[0].min(0).tolist())
        return pd.DataFrame([(group[by].iloc[0], written(polygons), len(polygons), sum(len(p) - 1 for p in polygons), surface(e), float(np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]).sum()))], columns=[by, "wkt", "parts", "holes", "surface", "perimeter"])

    # a number of parts that is given is not made smaller for few bytes: groups are few, and their work is in Python
    dealt = kept.repartition(3 * areas.sparkSession.sparkContext.defaultParallelism, by)
    return dealt.groupBy(by).applyInPandas(chain, f"{by} {kind}, wkt string, parts int, holes int, surface double, perimeter double")


# ---- validity and points inside ----


def inner_point(edges: np.ndarray) -> tuple[float, float]:
    """The middle of the longest stretch inside, on a level line between the corners next to the middle of the bounds."""
    levels = np.unique(edges[:, 1])
    if len(levels) < 2:
        return float("nan"), float("nan")
    k = min(max(int(np.searchsorted(levels, (levels[0] + levels[-1]) / 2)), 1), len(levels) - 1)
    y = (levels[k - 1] + levels[k]) / 2
    e = edges[(edges[:, 1] > y) != (edges[:, 3] > y)]
    x = np.sort(e[:, 0] + (y - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0]))
    wide = x[1::2] - x[::2]
    best = int(np.argmax(wide))
    return float(x[2 * best] + wide[best] / 2), float(y)


def representative_points(areas: DataFrame, key: str, wkt: str) -> DataFrame:
    """(key, x, y): a point surely inside each area, whatever its shape; areas without a surface have none."""

    @F.pandas_udf("array<double>")
    def point(edges: pd.Series) -> pd.Series:
        return pd.Series([[*inner_point(np.asarray(e, float).reshape(-1, 4))] for e in edges], dtype=object)

    rows = outlines(areas, key, wkt).where("_s > 0").select(key, point("_e").alias("_p"))
    return rows.select(key, F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))


def _pairs_in_sweep(e: np.ndarray):
    """Numbers of edges whose bounds meet, a bounded many at a time, found from left to right or upwards, whichever meets fewer."""
    ways = []
    for axis in (0, 1):
        lo, hi = e[:, axis::2].min(1), e[:, axis::2].max(1)
        order = np.argsort(lo, kind="stable")
        ways.append((order, np.searchsorted(lo[order], hi[order], side="right") - np.arange(len(e)) - 1))
    order, n = min(ways, key=lambda w: w[1].sum())
    ends = n.cumsum()
    at = 0
    while at < len(e):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
        i = np.repeat(np.arange(at, last), n[at:last])
        j = i + 1 + np.arange(len(i)) - np.repeat((n[at:last].cumsum() - n[at:last]), n[at:last])
        i, j, at = order[i], order[j], last
        meet = (e[i, 1::2].min(1) <= e[j, 1::2].max(1)) & (e[j, 1::2].min(1) <= e[i, 1::2].max(1))
        yield i[meet], j[meet]


def fault_of(text: str | None) -> str | None:
    """The first thing wrong with a polygon's text, or None."""
    found = rings(text)
    if not found:
        return "no ring"
    xy, first, size = _flat([xy for _, xy in found])
    last = first + size - 1
    off = xy - np.repeat(xy[first], size, axis=0)
    far = np.abs(off).sum(1)
    apart = np.where(far == np.repeat(np.maximum.reduceat(far, first), size), np.arange(len(xy)), len(xy))
    far = np.repeat(off[np.minimum(np.minimum.reduceat(apart, first), last)], size, axis=0)
    faults = {
        "a coordinate that is no number": ~np.logical_and.reduceat(np.isfinite(xy).all(1), first),
        "a ring that does not close": (xy[first] != xy[last]).any(1),
        "a ring without a surface": ~np.logical_or.reduceat(off[:, 0] * far[:, 1] != off[:, 1] * far[:, 0], first),
    }
    bad = np.flatnonzero(np.logical_or.reduce(list(faults.values())))
    if len(bad):
        return next(name for name, rings_ in faults.items() if rings_[bad[0]])
    start = np.ones(len(xy), bool)
    start[last] = False
    start = np.flatnonzero(start)
    start = start[(xy[start] != xy[start + 1]).any(1)]
    e, ring = np.hstack([xy[start], xy[start + 1]]), np.repeat(np.arange(len(size)), size)[start]
    upto = np.searchsorted(ring, np.arange(len(size) + 1))
    place, many = np.arange(len(e)) - upto[ring], np.diff(upto)[ring]
    cross = lambda o, p, q: (p[:, 0] - o[:, 0]) * (q[:, 1] - o[:, 1]) - (p[:, 1] - o[:, 1]) * (q[:, 0] - o[:, 0])
    for i, j in _pairs_in_sweep(e):
        a, b, c, d = e[i, :2], e[i, 2:], e[j, :2], e[j, 2:]
        s = [np.sign(x) for x in (cross(a, b, c), cross(a, b, d), cross(c, d, a), cross(c, d, b))]
        proper = (s[0] * s[1] < 0) & (s[2] * s[3] < 0)
        between = lambda p, q, r: ((np.minimum(p, q) <= r) & (r <= np.maximum(p, q))).all(1)
        touch = ((s[0] == 0) & between(a, b, c)) | ((s[1] == 0) & between(a, b, d)) | ((s[2] == 0) & between(c, d, a)) | ((s[3] == 0) & between(c, d, b))
        line = (s[0] == 0) & (s[1] == 0)
        along = np.argmax(np.abs(b - a), axis=1)
        pick = lambda p: np.take_along_axis(p, along[:, None], 1)[:, 0]
        overlap = line & (np.minimum(np.maximum(pick(a), pick(b)), np.maximum(pick(c), pick(d))) > np.maximum(np.minimum(pick(a), pick(b)), np.minimum(pick(c), pick(d))))
        same = ring[i] == ring[j]
        gap = np.abs(place[i] - place[j])
        beside = same & ((gap == 1) | (gap == many[i] - 1))
        if (proper | overlap | (same & ~beside & touch)).any():
            return "a boundary that meets itself"
    outer = None
    for k, (bounds, xy) in enumerate(found):
        if bounds:
            outer = e[upto[k] : upto[k + 1]]
        elif outer is None or not _within(xy[:-1], outer):
            return "a hole outside its ring"
    return None


def _within(corners: np.ndarray, outer: np.ndarray) -> bool:
    on = np.zeros(len(corners), bool)
    on[_upon(corners, outer, 1e-12 * max(np.abs(outer).max(), 1e-300))[0]] = True
    return bool((on | _inside(corners, outer)).all())


@F.pandas_udf(StringType())
def _fault(texts: pd.Series) -> pd.Series:
    return pd.Series([fault_of(t) for t in texts], dtype=object)


def geometry_fault(wkt: str | Column) -> Column:
    """The first fault of a polygon's text: no ring, a ring that does not close, has no surface or meets itself, a hole outside; null if none."""
    return _fault(wkt)


# ---- estimates and their margins ----

#: Codes that the American Community Survey publishes in place of a number, and what they say.
SENTINEL_STATES = {
    -999999999: "unavailable",
    -888888888: "not_applicable",
    -666666666: "unavailable",
    -555555555: "controlled",
    -333333333: "open_ended_median",
    -222222222: "unavailable",
}


def sentinel_state(value: Column) -> Column:
    """published, or what a code or a null stands for."""
    number = value.cast("double")
    state = F.when(number.isNull(), "missing")
    for code, name in SENTINEL_STATES.items():
        state = state.when(number == code, name)
    return state.otherwise("published")


def unpivoted_pairs(df: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(*keys, variable_id, estimate, estimate_state, margin_of_error, margin_of_error_state): a row for each variable.

    pairs names each variable's columns of estimate and margin. A code in place of a number becomes a state and a null.
    """
    rows = F.array(*[F.struct(F.lit(v).alias("variable_id"), F.col(e).cast("double").alias("estimate"), F.col(m).cast("double").alias("margin_of_error")) for v, (e, m) in pairs.items()])
    long = df.select(*keys, F.inline(rows)).withColumns({f"{c}_state": sentinel_state(F.col(c)) for c in ("estimate", "margin_of_error")})
    value = lambda c: F.when(F.col(f"{c}_state") == "published", F.col(c)).alias(c)
    return long.select(*keys, "variable_id", value("estimate"), "estimate_state", value("margin_of_error"), "margin_of_error_state")
