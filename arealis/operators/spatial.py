"""Neighbourhood graphs as edge tables and statistics over them.

Polygons are simple rings (well-known text); contiguity deals their bounds to grid cells, so only polygons whose
bounds meet are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written
from .resample import permuted


def vertices(areas: DataFrame, key: str, wkt: str) -> DataFrame:
    """(key, ring, at, x, y) of the corners of POLYGON and MULTIPOLYGON text, without each ring's closing repeat."""
    rings = F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))
    rows = areas.select(key, F.posexplode(rings).alias("ring", "_r")).select(key, "ring", F.posexplode(F.split(F.trim("_r"), r"\s*,\s*")).alias("at", "_p"))
    xy = F.split(F.trim("_p"), r"\s+")
    rows = rows.select(key, "ring", "at", xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))
    last = F.max("at").over(Window.partitionBy(key, "ring"))
    return rows.withColumn("_last", last).where("at < _last").drop("_last")


def _inside(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which points lie inside, by the even-odd rule."""
    out = np.zeros(len(points), bool)
    x1, y1, x2, y2 = edges.T
    flat = np.where(y2 == y1, 1.0, y2 - y1)
    step = max(1, (1 << 20) // len(edges))
    for k in range(0, len(points), step):
        px, py = points[k : k + step, :1], points[k : k + step, 1:]
        out[k : k + step] = (((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / flat + x1)).sum(1) % 2 == 1
    return out


def _upon(points: np.ndarray, edges: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, edge, place along it from 0 to 1) of points on edges."""
    d = edges[:, 2:] - edges[:, :2]
    long2 = np.maximum((d * d).sum(1), 1e-300)
    found, step = [], max(1, (1 << 20) // max(len(edges), 1))
    for k in range(0, len(points), step):
        off = points[k : k + step, None] - edges[None, :, :2]
        t = np.clip((off * d).sum(2) / long2, 0, 1)
        i, j = np.nonzero(np.hypot(off[..., 0] - t * d[:, 0], off[..., 1] - t * d[:, 1]) <= eps)
        found.append((i + k, j, t[i, j]))
    return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _crossing(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether an edge of a and one of b cross, each inside the other."""

    def sides(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        d = edges[:, 2:] - edges[:, :2]
        far = (d[:, 0] * (points[:, None, 1] - edges[:, 1]) - d[:, 1] * (points[:, None, 0] - edges[:, 0])) / np.maximum(np.hypot(*d.T), 1e-300)
        return np.where(np.abs(far) <= eps, 0, np.sign(far))

    step = max(1, (1 << 20) // len(b))
    for k in range(0, len(a), step):
        c = a[k : k + step]
        if ((sides(c[:, :2], b) * sides(c[:, 2:], b) < 0) & ((sides(b[:, :2], c) * sides(b[:, 2:], c)).T < 0)).any():
            return True
    return False


def relation(a: np.ndarray, b: np.ndarray) -> tuple[bool, bool, bool]:
    """(interiors intersect, boundaries meet, they share a length) of two areas' edges (x, y, x2, y2).

    Points within 1e-12 of the coordinates' size from an edge lie on it.
    """
    eps = 1e-12 * max(np.abs(a).max(), np.abs(b).max(), 1e-300)
    meet = shared = False
    overlap = _crossing(a, b, eps)
    for one, other in ((a, b), (b, a)):
        corners = np.unique(other[:, :2], axis=0)
        _, edge, t = _upon(corners, one, eps)
        meet |= len(edge) > 0
        # pieces of one's edges between the corners of the other: each inside it, outside or on its boundary
        edge, t = np.concatenate([edge, np.repeat(np.arange(len(one)), 2)]), np.concatenate([t, np.tile([0.0, 1.0], len(one))])
        order = np.lexsort((t, edge))
        edge, t = edge[order], t[order]
        d = one[edge[:-1], 2:] - one[edge[:-1], :2]
        piece = (edge[1:] == edge[:-1]) & ((t[1:] - t[:-1]) * np.hypot(*d.T) > 2 * eps)
        middle = (one[edge[:-1], :2] + d * ((t[1:] + t[:-1]) / 2)[:, None])[piece]
        across = (d * (t[1:] - t[:-1])[:, None])[piece][:, ::-1] * [1e-4, -1e-4]
        on = np.zeros(len(middle), bool)
        on[_upon(middle, other, eps)[0]] = True
        shared |= bool(on.any())
        overlap |= bool(_inside(middle[~on], other).any())
        for beside in (middle[on] + across[on], middle[on] - across[on]):  # a shared boundary has one of them on each side
            overlap |= bool((_inside(beside, one) & _inside(beside, other)).any())
    return overlap, meet, shared


def relations(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """relation() of many pairs at once: a and b are (pairs, edges, 4), each with as many edges in all pairs."""
    eps = 1e-12 * np.maximum(np.maximum(np.abs(a).max((1, 2)), np.abs(b).max((1, 2))), 1e-300)
    way = lambda e: e[..., 2:] - e[..., :2]

    def sides(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        d = way(edges)
        off = points[:, :, None] - edges[:, None, :, :2]
        far = (d[:, None, :, 0] * off[..., 1] - d[:, None, :, 1] * off[..., 0]) / np.maximum(np.hypot(d[..., 0], d[..., 1]), 1e-300)[:, None]
        return np.where(np.abs(far) <= eps[:, None, None], 0, np.sign(far))

    def upon(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, points, edges): whether a point lies on an edge, and its place along it."""
        d = way(edges)[:, None]
        off = points[:, :, None] - edges[:, None, :, :2]
        t = np.clip((off * d).sum(3) / np.maximum((d * d).sum(3), 1e-300), 0, 1)
        return np.hypot(off[..., 0] - t * d[..., 0], off[..., 1] - t * d[..., 1]) <= eps[:, None, None], t

    def inside(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        x1, y1, x2, y2 = (edges[:, None, :, k] for k in range(4))
        px, py = points[:, :, None, 0], points[:, :, None, 1]
        return (((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / np.where(y2 == y1, 1.0, y2 - y1) + x1)).sum(2) % 2 == 1

    overlap = ((sides(a[..., :2], b) * sides(a[..., 2:], b) < 0) & (sides(b[..., :2], a) * sides(b[..., 2:], a) < 0).transpose(0, 2, 1)).any((1, 2))
    meet, shared = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for one, other in ((a, b), (b, a)):
        on, t = upon(other[..., :2], one)
        meet |= on.any((1, 2))
        # corners that lie elsewhere cut a piece of no length, which does not count
        stops = np.where(on, t, 0.0).transpose(0, 2, 1)
        stops = np.sort(np.concatenate([stops, np.zeros((*stops.shape[:2], 1)), np.ones((*stops.shape[:2], 1))], 2), 2)
        d, step = way(one)[:, :, None], (stops[..., 1:] - stops[..., :-1])[..., None]
        piece = (step[..., 0] * np.hypot(d[..., 0], d[..., 1]) > 2 * eps[:, None, None]).reshape(len(a), -1)
        middle = (one[:, :, None, :2] + d * ((stops[..., 1:] + stops[..., :-1]) / 2)[..., None]).reshape(len(a), -1, 2)
        across = ((d * step)[..., ::-1] * [1e-4, -1e-4]).reshape(len(a), -1, 2)
        on = piece & upon(middle, other)[0].any(2)
        shared |= on.any(1)
        overlap |= (piece & ~on & inside(middle, other)).any(1)
        for beside in (middle + across, middle - across):
            overlap |= (on & inside(beside, one) & inside(beside, other)).any(1)
    return overlap, meet, shared


def _related(one: Sequence[np.ndarray], other: Sequence[np.ndarray], bound: int = 1 << 18) -> np.ndarray:
    """(pairs, 3) of relation(): pairs of small areas with as many edges are taken together, a bounded many at a time; large ones go singly."""
    out = np.zeros((len(one), 3), bool)
    sizes = np.array([(len(e) // 4, len(f) // 4) for e, f in zip(one, other)], dtype=int).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0):
        at = np.nonzero((sizes == (m, n)).all(1))[0]
        step = bound // (m * n * (max(m, n) + 1))
        for k in range(0, len(at), max(step, 1)):
            some = at[k : k + max(step, 1)]
            if step > 1:
                out[some] = np.stack(relations(*(np.stack([x[i] for i in some]).astype(float).reshape(len(some), -1, 4) for x in (one, other))), 1)
            else:
                out[some[0]] = relation(np.asarray(one[some[0]], float).reshape(-1, 4), np.asarray(other[some[0]], float).reshape(-1, 4))
    return out


def contiguity(areas: DataFrame, key: str, wkt: str, rule: str = "queen") -> DataFrame:
    """(src, dst) both ways: areas whose boundaries meet in a point at least (queen) or share a length (rook).

    Corners of one may lie within edges of the other. Areas whose interiors intersect are an error. Bounds are dealt to
    grid cells of their mean size, and areas compared whose bounds meet.
    """
    ring = Window.partitionBy(key, "ring").orderBy("at")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    sides = vertices(areas, key, wkt).select(key, "x", "y", after("x").alias("x2"), after("y").alias("y2"))
    shapes = sides.groupBy(key).agg(F.flatten(F.collect_list(F.array("x", "y", "x2", "y2"))).alias("e"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    shapes = written(shapes, "shapes")  # read five times; joins with it are sorted, as its size is guessed too small to keep it from the driver
    pad = F.greatest(*[F.abs(c) for c in "abcd"]) * 1e-11
    bounds = shapes.select(key, (F.col("a") - pad).alias("a"), (F.col("b") + pad).alias("b"), (F.col("c") - pad).alias("c"), (F.col("d") + pad).alias("d"))
    mean = bounds.agg(F.avg(F.col("b") - F.col("a")).alias("_w"), F.avg(F.col("d") - F.col("c")).alias("_h"))
    cells = lambda lo, hi, size: F.explode(F.sequence(F.floor(F.col(lo) / F.col(size)), F.floor(F.col(hi) / F.col(size))))
    tiles = bounds.crossJoin(F.broadcast(mean)).withColumn("_cx", cells("a", "b", "_w")).withColumn("_cy", cells("c", "d", "_h")).drop("_w", "_h")
    here, there = tiles.withColumnRenamed(key, "src"), tiles.withColumnsRenamed({key: "dst", "a": "a2", "b": "b2", "c": "c2", "d": "d2"})
    pairs = here.join(there.hint("merge"), ["_cx", "_cy"]).where("src < dst AND a <= b2 AND a2 <= b AND c <= d2 AND c2 <= d").select("src", "dst").distinct()
    of = lambda c, e: shapes.select(F.col(key).alias(c), F.col("e").alias(e)).hint("merge")
    pairs = pairs.join(of("src", "_e"), "src").join(of("dst", "_f"), "dst")

    @F.pandas_udf("boolean")
    def linked(src: pd.Series, dst: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
        found = _related(e.to_list(), f.to_list())
        for k in np.nonzero(found[:, 0])[0][:1]:
            raise ValueError(f"interiors of areas {src.iloc[k]} and {dst.iloc[k]} intersect")
        return pd.Series(found[:, 2 if rule == "rook" else 1], dtype=bool)

    found = pairs.where(linked("src", "dst", "_e", "_f")).select("src", "dst")
    return found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def covering_areas(points: DataFrame, key: str, x: str, y: str, areas: DataFrame, area: str, wkt: str, cell: float = 1.0) -> DataFrame:
    """(key, area) of points inside areas, by the even-odd rule over all rings; a boundary's points may fall to either side.

    Areas are dealt to the grid cells that their bounds cover, so a point meets only areas near it.
    """
    v = vertices(areas, area, wkt)
    ring = Window.partitionBy(area, "ring").orderBy("at")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = v.select(area, "x", "y", F.coalesce(F.lead("x").over(ring), F.first("x").over(whole)).alias("x2"), F.coalesce(F.lead("y").over(ring), F.first("y").over(whole)).alias("y2"))
    at = lambda c: F.floor(c / cell)
    bounds = v.groupBy(area).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    tiles = bounds.withColumn("_cx", F.explode(F.sequence(at(F.col("a")), at(F.col("b"))))).withColumn("_cy", F.explode(F.sequence(at(F.col("c")), at(F.col("d")))))
    p = points.select(key, F.col(x).alias("_px"), F.col(y).alias("_py")).withColumns({"_cx": at(F.col("_px")), "_cy": at(F.col("_py"))})
    near = p.join(tiles, ["_cx", "_cy"]).where("_px BETWEEN a AND b AND _py BETWEEN c AND d").select(key, area, "_px", "_py")
    crosses = ((F.col("y") > F.col("_py")) != (F.col("y2") > F.col("_py"))) & (F.col("_px") < F.try_divide((F.col("x2") - F.col("x")) * (F.col("_py") - F.col("y")), F.col("y2") - F.col("y")) + F.col("x"))
    hits = near.join(sides, area).groupBy(key, area).agg(F.count_if(F.coalesce(crosses, F.lit(False))).alias("n"))
    return hits.where("n % 2 = 1").select(key, area)


def distance_band(points: DataFrame, key: str, x: str, y: str, threshold: float) -> DataFrame:
    """(src, dst, distance) both ways of points up to threshold apart, by a grid of cells of that size and their eight neighbours."""
    cell = lambda c: F.floor(F.col(c) / threshold)
    p = points.select(F.col(key).alias("src"), F.col(x).alias("x"), F.col(y).alias("y"), cell(x).alias("cx"), cell(y).alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = points.select(F.col(key).alias("dst"), F.col(x).alias("x2"), F.col(y).alias("y2"), cell(x).alias("cx2"), cell(y).alias("cy2")).withColumn("s", F.explode(steps))
    near = near.select("dst", "x2", "y2", (F.col("cx2") + F.col("s.i")).alias("cx"), (F.col("cy2") + F.col("s.j")).alias("cy"))
    d = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))
    return p.join(near, ["cx", "cy"]).where("src <> dst").withColumn("distance", d).where(F.col("distance") <= threshold).select("src", "dst", "distance")


def smallest_connected_band(xy: np.ndarray) -> float:
    """The least threshold at which all points hang together: the longest edge of a least spanning tree. For some thousand points."""
    n = len(xy)
    reached, best, out = np.zeros(n, bool), np.full(n, np.inf), 0.0
    at = 0
    for _ in range(n - 1):
        reached[at] = True
        best = np.minimum(best, np.hypot(*(xy - xy[at]).T))
        best[reached] = np.inf
        at = int(best.argmin())
        out = max(out, float(best[at]))
    return out


def row_standardised(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", (F.lit(1.0) / F.count("*").over(Window.partitionBy("src"))).alias("w"))


def topology(edges: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """One row: areas, undirected edges, islands, least, mean and largest number of neighbours."""
    degree = areas.select(F.col(key).alias("src")).join(edges.groupBy("src").agg(F.count("*").alias("d")), "src", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return degree.agg(F.count("*").alias("areas"), F.expr("sum(d) div 2").alias("edges"), F.count_if(F.col("d") == 0).alias("islands"), F.min("d").alias("least"), F.avg("d").alias("mean"), F.max("d").alias("most"))


def z_scores(df: DataFrame, value: str, *by: str) -> Column:
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return (F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w)


def moran(values: DataFrame, key: str, value: str, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moran's I of each group of by (replicates, say): edges joined with centred values."""
    centred = values.withColumn("_z", F.col(value) - F.avg(value).over(Window.partitionBy(*by))).select(*by, F.col(key).alias("_k"), "_z")
    total = centred.groupBy(*by).agg(F.sum(F.col("_z") * F.col("_z")).alias("_zz"), F.count("*").alias("n"))
    here, there = centred.withColumnsRenamed({"_k": "src", "_z": "_a"}), centred.withColumnsRenamed({"_k": "dst", "_z": "_b"})
    pairs = here.join(weights, "src").join(there, [*by, "dst"])
    sums = pairs.groupBy(*by).agg(F.sum(F.col("w") * F.col("_a") * F.col("_b")).alias("_ab"), F.sum("w").alias("_w"))
    both = sums.join(total, list(by)) if by else sums.crossJoin(F.broadcast(total))
    return both.select(*by, "n", F.try_divide(F.col("n") * F.col("_ab"), F.col("_w") * F.col("_zz")).alias("moran"))


def permutation_moran(values: DataFrame, key: str, value: str, weights: DataFrame, permutations: int, seed: int) -> DataFrame:
    """One row: n, moran, expected, extreme, p = (extreme + 1) / (permutations + 1), by distance from the expectation."""
    seen = moran(values, key, value, weights).withColumn("expected", F.lit(-1.0) / (F.col("n") - 1))
    drawn = moran(permuted(values, key, value, permutations, seed), key, value, weights, ["replicate"]).select(F.col("moran").alias("drawn"))
    both = seen.crossJoin(drawn)
    far = F.abs(F.col("drawn") - F.col("expected")) >= F.abs(F.col("moran") - F.col("expected")) - 1e-12
    return both.groupBy("n", "moran", "expected").agg(F.count_if(far).alias("extreme")).withColumn("p", (F.col("extreme") + 1) / F.lit(float(permutations + 1)))


def local_statistics(values: DataFrame, key: str, value: str, weights: DataFrame, other: str | None = None) -> DataFrame:
    """z, lag, local Moran, bivariate (z with the lag of other's z), Gi* (the area and its neighbours alike) and a label."""
    rows = values.select(F.col(key).alias("src"), z_scores(values, value).alias("z"), (z_scores(values, other) if other else F.lit(None).cast("double")).alias("o"))
    lags = weights.join(rows.select(F.col("src").alias("dst"), F.col("z").alias("_z"), F.col("o").alias("_o")), "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("_z")).alias("lag"), F.sum(F.col("w") * F.col("_o")).alias("other_lag"), F.sum("_z").alias("_sum"), F.count("*").alias("_d"))
    out = rows.join(lags, "src")
    n = F.count("*").over(Window.partitionBy(F.lit(0))).cast("double")
    m = (F.col("_d") + 1).cast("double")
    gi = (F.col("_sum") + F.col("z")) / F.sqrt(m * (n - m) / (n - 1.0))
    label = F.when((F.col("z") >= 0) & (F.col("lag") >= 0), "high_high").when((F.col("z") < 0) & (F.col("lag") < 0), "low_low").when(F.col("z") >= 0, "high_low").otherwise("low_high")
    return out.select(F.col("src").alias(key), "z", "lag", (F.col("z") * F.col("lag")).alias("local_moran"), (F.col("z") * F.col("other_lag")).alias("bivariate"), gi.alias("gi_star"), label.alias("label"))


def conditional_p(values: DataFrame, key: str, value: str, weights: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(key, p) of local Moran: the area stays, its neighbours' values are drawn from all others without replacement.

    Each area draws, per replicate, as many other areas as it has neighbours: those whose hashes come first.
    """
    rows = values.select(F.col(key).alias("src"), z_scores(values, value).alias("z"))
    local = weights.join(rows.select(F.col("src").alias("dst"), F.col("z").alias("_z")), "dst").groupBy("src").agg(F.avg("_z").alias("lag"), F.count("*").alias("_d")).join(rows, "src")

    schema = f"{key} {dict(values.dtypes)[key]}, p double"
    table = [(r[0], r[1]) for r in rows.collect()]  # one number per area: bounded by the map, as edges are
    ids, z = [t[0] for t in table], np.array([t[1] for t in table])
    place = {k: i for i, k in enumerate(ids)}

    def test(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for src, lag, d, own in batch[["src", "lag", "_d", "z"]].itertuples(index=False):
                i = place[src]
                others = np.delete(z, i)
                rng = np.random.Generator(np.random.Philox(key=[seed, i]))
                d = int(d)
                picked = others[rng.random((permutations, len(others))).argpartition(min(d, len(others) - 1), 1)[:, :d]].mean(1)
                out.append((src, (1 + int((np.abs(own * picked) >= abs(own * lag) - 1e-12).sum())) / (permutations + 1)))
            yield pd.DataFrame(out, columns=[key, "p"])

    return local.mapInPandas(test, schema)


def spatial_error(y: np.ndarray, x: np.ndarray, w: np.ndarray, bound: float = 0.98) -> dict:
    """Maximum likelihood of y = x b + u, u = l W u + e, for a map of some hundred areas (arrays of that size only).

    The log determinant comes from the eigenvalues of W, once; l by golden-section search within +-bound.
    """
    n, values = len(y), np.linalg.eigvals(w)

    def solve(l: float):
        a = np.eye(n) - l * w
        ay, ax = a @ y, a @ x
        b = np.linalg.lstsq(ax, ay, rcond=None)[0]
        e = ay - ax @ b
        s2 = float(e @ e) / n
        return b, ax, s2, float(np.log(np.abs(1 - l * values)).sum()) - n / 2 * np.log(s2)

    lo, hi, g = -bound, bound, (np.sqrt(5) - 1) / 2
    for _ in range(90):
        p, q = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, q) if solve(p)[3] > solve(q)[3] else (p, hi)
    best = (lo + hi) / 2
    b, ax, s2, like = solve(best)
    return {"lambda": best, "beta": b, "se": np.sqrt(np.diag(s2 * np.linalg.inv(ax.T @ ax))), "log_likelihood": like - n / 2 * (np.log(2 * np.pi) + 1)}


def stability(ols: float, spatial: float, limit: float = 0.2) -> str:
    if ols * spatial < 0:
        return "sign_change"
    return "changed" if ols and abs(spatial - ols) / abs(ols) > limit else "stable"


def needs_escalation(moran_i: float, p: float) -> bool:
    return abs(moran_i) >= 0.10 and p < 0.05


def shapes(areas: DataFrame, key: str, wkt: str) -> DataFrame:
    """(key, rings, corners, surface, x, y): surface and centroid of polygons by sums over their edges.

    Outer rings and holes run in opposite senses, as valid text has them. Areas without a corner or surface give a null centroid;
    texts without numbers have no rows.
    """
    at = Window.partitionBy(key, "ring").orderBy("at")
    ring = Window.partitionBy(key, "ring")
    rows = vertices(areas, key, wkt)
    after = lambda c: F.coalesce(F.lead(c).over(at), F.first(c).over(at))
    rows = rows.withColumns({"_x": after("x"), "_y": after("y"), "_n": F.count("*").over(ring)})
    cross = F.col("x") * F.col("_y") - F.col("_x") * F.col("y")
    sums = rows.groupBy(key).agg(F.count_distinct("ring").alias("rings"), F.count("*").alias("corners"), F.min("_n").alias("_least"), F.sum(cross).alias("_s"), F.sum((F.col("x") + F.col("_x")) * cross).alias("_cx"), F.sum((F.col("y") + F.col("_y")) * cross).alias("_cy"))
    return sums.select(key, "rings", "corners", (F.abs("_s") / 2).alias("surface"), F.try_divide("_cx", F.col("_s") * 3).alias("x"), F.try_divide("_cy", F.col("_s") * 3).alias("y"))


def weight_faults(weights: DataFrame, areas: DataFrame, key: str, tolerance: float = 1e-12) -> DataFrame:
    """(fault, n) of what weights (src, dst, w) must not have, zeros included; connectedness is not looked at."""
    w = F.col("w")
    pairs = weights.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    rows = pairs.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("src") == F.col("dst")).alias("to_itself"), F.count_if(F.coalesce((w < 0) | F.isnan(w) | (F.abs(w) == float("inf")), F.lit(True))).alias("not_a_weight"))
    one_way = pairs.select("src", "dst").join(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").agg(F.count("*").alias("one_way"))
    sums = weights.groupBy("src").agg(F.sum("w").alias("_w"))
    uneven = sums.agg(F.count_if(F.abs(F.col("_w") - 1) > tolerance).alias("not_standardised"))
    islands = areas.select(F.col(key).alias("src")).join(sums, "src", "left_anti").agg(F.count("*").alias("islands"))
    strangers = sums.join(areas.select(F.col(key).alias("src")), "src", "left_anti").agg(F.count("*").alias("strangers"))
    out = None
    for frame in (rows, one_way, uneven, islands, strangers):  # of one row each
        long = frame.select(F.inline(F.array(*[F.struct(F.lit(c).alias("fault"), F.col(c).alias("n")) for c in frame.columns])))
        out = long if out is None else out.unionByName(long)
    return out
