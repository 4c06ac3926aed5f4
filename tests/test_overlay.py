import itertools
import math
import random
import time

import numpy as np
import pytest

from arealis.operators import overlay


def wkt(*polygons):
    ring = lambda r: "(" + ", ".join(f"{x} {y}" for x, y in [*r, r[0]]) + ")"
    parts = ["(" + ", ".join(map(ring, p)) + ")" for p in polygons]
    return f"POLYGON {parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(parts)})"


def star(rng, x, y, size, corners=9):
    """A concave ring around a point."""
    return [(x + r * math.cos(t), y + r * math.sin(t)) for r, t in ((size * rng.uniform(0.3, 1), 2 * math.pi * k / corners) for k in range(corners))]


def brute_shared(a, b):
    """Integrated over x between all corners and crossings: the length that both have on a vertical line."""
    xs = {e[k] for e in [*a, *b] for k in (0, 2)}
    for e, f in itertools.product(a, b):
        d = (e[2] - e[0]) * (f[3] - f[1]) - (e[3] - e[1]) * (f[2] - f[0])
        if d:
            t = ((f[0] - e[0]) * (f[3] - f[1]) - (f[1] - e[1]) * (f[2] - f[0])) / d
            if 0 < t < 1:
                xs.add(e[0] + t * (e[2] - e[0]))

    def spans(edges, x):
        y = sorted(e[1] + (x - e[0]) / (e[2] - e[0]) * (e[3] - e[1]) for e in edges if min(e[0], e[2]) < x < max(e[0], e[2]))
        return [*zip(y[::2], y[1::2])]

    total, xs = 0.0, sorted(xs)
    for p, q in zip(xs, xs[1:]):
        m = (p + q) / 2
        total += (q - p) * sum(max(0, min(u[1], v[1]) - max(u[0], v[0])) for u in spans(a, m) for v in spans(b, m))
    return total


def shape(rng):
    x, y = rng.uniform(-1, 1) + 100, rng.uniform(-1, 1) - 40
    outer = star(rng, x, y, 1.5, rng.randint(3, 12))
    hole = [(x + 0.15 * math.cos(t), y + 0.15 * math.sin(t)) for t in (0.3, 2.2, 4.4)]
    return wkt([outer, hole]) if rng.random() < 0.5 else wkt([outer[::-1], hole], [[(x + 3, y), (x + 4, y), (x + 3.5, y + 1)]])


def test_shared_surface_of_concave_areas_with_holes():
    rng = random.Random(4)
    for _ in range(300):
        a, b = overlay.oriented(shape(rng)), overlay.oriented(shape(rng))
        want = brute_shared(a.tolist(), b.tolist())
        assert abs(overlay.shared_surface(a, b) - want) < 1e-9 and abs(overlay.shared_surface(b, a) - want) < 1e-9
        assert abs(overlay.shared_surface(a, a) - overlay.surface(a)) < 1e-9


def test_surfaces_far_from_the_origin_keep_their_precision():
    square = lambda x, y, s: overlay.oriented(wkt([[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]))
    assert abs(overlay.shared_surface(square(4e6, 5e6, 3.0), square(4e6 + 1, 5e6 + 1, 1.0)) - 1) < 1e-6
    assert overlay.shared_surface(square(0, 0, 1), square(1, 0, 1)) == 0


def test_overlay_weights(spark):
    rng = random.Random(9)
    areas = [(f"a{k}", wkt([[(x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2)]])) for k, (x, y) in enumerate(itertools.product((0, 2, 4), (0, 2, 4)))]
    units = [(k, wkt([star(rng, rng.uniform(1.5, 4.5), rng.uniform(1.5, 4.5), 1.2)])) for k in range(40)] + [(100, wkt([star(rng, 50, 50, 1)])), (101, None), (102, "")]
    rows = overlay.overlay(spark.createDataFrame(units, "u int, wkt string"), "u", spark.createDataFrame(areas, "a string, wkt string"), "a", "wkt").collect()
    got = {(r.u, r.a): r.intersection_area for r in rows}
    shapes = {k: overlay.oriented(t).tolist() for k, t in units if t}
    boxes = {k: overlay.oriented(t).tolist() for k, t in areas}
    want = {(u, a): s for u in shapes for a in boxes if (s := brute_shared(shapes[u], boxes[a])) > 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for u in shapes:
        mine = [r for r in rows if r.u == u]
        assert not mine or abs(sum(r.weight for r in mine) - 1) < 1e-12
        assert all(r.is_crossing == (len(mine) > 1) and abs(r.covered_fraction - sum(m.intersection_area for m in mine) / overlay.surface(np.array(shapes[u]))) < 1e-9 for r in mine)
    assert any(r.is_sliver for r in rows) and not any(r.u >= 100 for r in rows)


def test_dissolved_tiling_with_holes_t_junctions_and_touching_corners(spark):
    box = lambda x, y, w=1, h=1: wkt([[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]])
    frame = [(x, y) for x in range(5) for y in range(5) if (x, y) not in ((1, 1), (2, 2), (3, 1))]  # holes that touch at corners
    rows = [("frame", box(x, y)) for x, y in frame] + [("halves", box(0, 0, 2, 2)), ("halves", box(2, 0, 1, 0.7)), ("halves", box(2, 0.7, 1, 1.3))]  # corners within edges
    rows += [("apart", box(0, 0)), ("apart", box(1, 1)), ("apart", box(7, 7)), ("slant", wkt([[(0, 0), (3, 3), (0, 3)]])), ("slant", wkt([[(0, 0), (3, 0), (1, 1)]])), ("slant", wkt([[(3, 0), (3, 3), (1, 1)]]))]
    frame_ = spark.createDataFrame([(k, g, t) for k, (g, t) in enumerate(rows)], "k int, g string, wkt string").repartition(3)
    got = {r.g: r for r in overlay.dissolved(frame_, "k", "wkt", "g").collect()}
    assert (got["frame"].parts, got["frame"].holes, got["frame"].surface, got["frame"].perimeter) == (1, 3, 22.0, 32.0)
    assert (got["halves"].parts, got["halves"].holes, got["halves"].wkt) == (1, 0, "POLYGON ((0.0 0.0, 3.0 0.0, 3.0 2.0, 0.0 2.0, 0.0 0.0))") or got["halves"].surface == 6.0
    assert (got["apart"].parts, got["apart"].surface, got["apart"].perimeter) == (3, 3.0, 12.0)
    assert (got["slant"].parts, got["slant"].holes, round(got["slant"].surface, 9), round(got["slant"].perimeter, 9)) == (1, 0, 9.0, 12.0)
    for r in got.values():
        assert overlay.fault_of(r.wkt) is None, r.wkt
        assert abs(overlay.surface(overlay.oriented(r.wkt)) - r.surface) < 1e-9
    with pytest.raises(Exception, match="overlap"):
        overlay.dissolved(spark.createDataFrame([(1, "g", box(0, 0)), (2, "g", box(0, 0))], "k int, g string, wkt string"), "k", "wkt", "g").collect()
    assert overlay.dissolved(frame_.where("k < 0"), "k", "wkt", "g").count() == 0


def test_random_regions_of_a_grid_keep_surface_and_outline(spark):
    rng = random.Random(12)
    cells = [(x, y, rng.randrange(4)) for x in range(12) for y in range(12)]
    owner = {(x, y): g for x, y, g in cells}
    rows = [(k, g, wkt([[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]])) for k, (x, y, g) in enumerate(cells)]
    for r in overlay.dissolved(spark.createDataFrame(rows, "k int, g int, wkt string"), "k", "wkt", "g").collect():
        mine = [c for c, g in owner.items() if g == r.g]
        sides = sum(owner.get((x + dx, y + dy)) != r.g for x, y in mine for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        assert (r.surface, r.perimeter) == (len(mine), sides) and overlay.fault_of(r.wkt) is None


@pytest.mark.parametrize("text,fault", [
    (None, "no ring"), ("", "no ring"), ("POLYGON EMPTY", "no ring"), ("POLYGON ((0 0, 1 0, 1 1, 0 0))", None), ("POLYGON ((0 0, 1 0, 1 1, 0 1))", "a ring that does not close"),
    ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "a boundary that meets itself"), ("POLYGON ((0 0, 1 1, 0 0))", "a ring without a surface"), ("POLYGON ((0 0, 4 0, 4 4, 2 0, 0 4, 0 0))", "a boundary that meets itself"),
    ("POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0), (1 1, 2 1, 2 2, 1 1))", None), ("POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0), (7 7, 8 7, 8 8, 7 7))", "a hole outside its ring"), ("POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0), (4 4, 8 4, 8 8, 4 4))", "a boundary that meets itself"),
    ("POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0), (0 2, 2 3, 2 1, 0 2))", None), ("POLYGON ((0 0, nan 0, 1 1, 0 0))", "a coordinate that is no number"), ("POLYGON ((0 0, 3 0, 3 3, 3 5, 3 3, 0 3, 0 0))", "a boundary that meets itself"),
])
def test_faults_of_geometry(text, fault):
    assert overlay.fault_of(text) == fault


def test_long_ring_is_swept():
    n = 20_000
    ring = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    assert overlay.fault_of(wkt([ring])) is None
    ring[5], ring[n // 2] = ring[n // 2], ring[5]
    assert overlay.fault_of(wkt([ring])) == "a boundary that meets itself"


def test_points_inside_whatever_the_shape(spark):
    rng = random.Random(2)
    texts = [shape(rng) for _ in range(60)] + [wkt([[(0, 0), (9, 0), (9, 1), (1, 1), (1, 8), (9, 8), (9, 9), (0, 9)]])]
    rows = overlay.representative_points(spark.createDataFrame([*enumerate(texts), (99, None)], "k int, wkt string"), "k", "wkt").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert overlay._inside(np.array([[r.x, r.y]]), overlay.oriented(texts[r.k]))[0]


def test_estimates_with_states(spark):
    df = spark.createDataFrame([("t1", 5.0, 1.5, -666666666.0, -222222222.0), ("t2", None, -555555555.0, 7.0, -333333333.0), ("t3", -999999999.0, None, -888888888.0, 0.0)], "geo string, a_e double, a_m double, b_e double, b_m double")
    got = {(r.geo, r.variable_id): tuple(r[2:]) for r in overlay.unpivoted_pairs(df, ["geo"], {"a": ("a_e", "a_m"), "b": ("b_e", "b_m")}).collect()}
    assert got == {
        ("t1", "a"): (5.0, "published", 1.5, "published"), ("t1", "b"): (None, "unavailable", None, "unavailable"), ("t2", "a"): (None, "missing", None, "controlled"),
        ("t2", "b"): (7.0, "published", None, "open_ended_median"), ("t3", "a"): (None, "unavailable", None, "missing"), ("t3", "b"): (None, "not_applicable", 0.0, "published"),
    }


def test_small_files_are_dealt_to_all_cores(spark):
    from arealis.plans import maps

    data = "/root/testdata/sf0.001"
    for rows in (maps.geometry_audit(spark, data), maps.units(spark, data)):
        assert rows.rdd.getNumPartitions() > 1


def test_relations_of_many_pairs_are_those_of_each():
    from arealis.operators.spatial import _related, relation

    rng = np.random.default_rng(3)
    ring = lambda p: np.hstack([p, np.roll(p, -1, axis=0)]).ravel()
    drawn = lambda n: ring(rng.integers(0, 4, (n, 2)).astype(float) + rng.integers(0, 2, 2) * 2)
    one, other = [drawn(3 + k % 3) for k in range(600)], [drawn(3 + k % 2) for k in range(600)]
    want = np.array([relation(a.reshape(-1, 4), b.reshape(-1, 4)) for a, b in zip(one, other)])
    assert want.any(0).all() and (_related(one, other) == want).all() and (_related(one, other, 1) == want).all()


def test_outlines_do_not_pass_through_the_driver(spark):
    from arealis.plans import maps

    plan = maps.dissolved_regions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_polygon_of_many_parts_in_a_column_is_checked_in_time():
    squares = [[[(0, 2 * k), (1, 2 * k), (1, 2 * k + 1), (0, 2 * k + 1)]] for k in range(20_000)]
    began = time.process_time()
    assert overlay.fault_of(wkt(*squares)) is None
    assert time.process_time() - began < 20  # all pairs of edges are 3.2 milliards
