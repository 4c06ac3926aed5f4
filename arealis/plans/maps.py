"""Queries over maps derived from the driver's tables: overlay, dissolve, validity, neighbourhood tests, spatial models.

Customers are unit squares in rows of forty. Suppliers are larger rectangles, 5 by 2.5, shifted against them, so that both
maps grow with the tables and most units lie in several areas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import local, models, networks, overlay, spatial, spatial_error
from ..sources.sinks import written
from .catalogue import _DRAW, query, r6
from .facts import dealt, read

WIDE = 40

_UNITS = f"u AS (SELECT c_custkey AS unit, c_nationkey AS grp, (c_custkey % {WIDE})::DOUBLE AS x, (c_custkey // {WIDE})::DOUBLE AS y FROM customer)"
_AREAS = "a AS (SELECT s_suppkey AS area, (s_suppkey % 8) * 5.0::DOUBLE + 0.3::DOUBLE AS x, (s_suppkey // 8) * 2.5::DOUBLE + 0.45::DOUBLE AS y FROM supplier)"
_OVER = f"""{_UNITS}, {_AREAS}, o AS (SELECT unit, area, (least(u.x + 1, a.x + 5) - greatest(u.x, a.x)) * (least(u.y + 1, a.y + 2.5) - greatest(u.y, a.y)) AS s FROM u, a WHERE u.x < a.x + 5 AND a.x < u.x + 1 AND u.y < a.y + 2.5 AND a.y < u.y + 1),
           t AS (SELECT *, sum(s) OVER (PARTITION BY unit) AS t, count(*) OVER (PARTITION BY unit) AS n FROM o)"""


def box(x: Column, y: Column, w: float, h: float) -> Column:
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in corners]), F.lit("))"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k % WIDE).cast("double"), F.floor(k / WIDE).cast("double")
    return dealt(spark, read(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("grp"), x.alias("x"), y.alias("y"), box(x, y, 1.0, 1.0).alias("wkt"), "c_acctbal")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return dealt(spark, read(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("area"), box((k % 8) * 5.0 + 0.3, F.floor(k / 8) * 2.5 + 0.45, 5.0, 2.5).alias("wkt"))


@query(f"WITH {_OVER} SELECT unit, area, round(s, 6) AS intersection_area, round(s / t, 6) AS weight, round(t, 6) AS covered_fraction, n > 1 AS is_crossing, s / t < 0.15 AS is_sliver FROM t")
def area_overlay(spark, sf_dir):
    out = overlay.overlay(units(spark, sf_dir), "unit", areas(spark, sf_dir), "area", "wkt", sliver=0.15)
    return out.select("unit", "area", *[r6(c) for c in ("intersection_area", "weight", "covered_fraction")], "is_crossing", "is_sliver")


@query(f"""WITH {_OVER}, w AS (SELECT area, s / t AS w, c_acctbal AS v FROM t JOIN customer ON c_custkey = unit)
           SELECT area, count(*) AS units, round(sum(w), 4) AS weight, round(sum(w * v), 3) AS allocated FROM w GROUP BY area""")
def allocation_by_overlay(spark, sf_dir):
    """Values of units dealt to areas by shared surface."""
    rows = units(spark, sf_dir)
    out = overlay.overlay(rows, "unit", areas(spark, sf_dir), "area", "wkt").join(rows.select("unit", "c_acctbal"), "unit")
    return out.groupBy("area").agg(F.count("*").alias("units"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.sum(F.col("weight") * F.col("c_acctbal")), 3).alias("allocated"))


@query(f"""WITH {_UNITS}, s AS (SELECT u.grp, count(*) AS n, count(r.unit) + count(t.unit) AS inner_sides FROM u LEFT JOIN u r ON r.grp = u.grp AND r.x = u.x + 1 AND r.y = u.y LEFT JOIN u t ON t.grp = u.grp AND t.y = u.y + 1 AND t.x = u.x GROUP BY u.grp)
           SELECT grp, n::DOUBLE AS surface, (4 * n - 2 * inner_sides)::DOUBLE AS perimeter, NULL::VARCHAR AS fault FROM s""")
def dissolved_regions(spark, sf_dir):
    """Outlines of each nation's squares: inner borders cancel, the rest is chained into rings and checked."""
    out = overlay.dissolved(units(spark, sf_dir), "unit", "wkt", "grp")
    return out.select("grp", F.round("surface", 6).alias("surface"), F.round("perimeter", 6).alias("perimeter"), overlay.geometry_fault("wkt").alias("fault"))


@query(f"""WITH {_UNITS}, {_AREAS}, p AS (SELECT unit, x + 0.5 AS px, y + 0.5 AS py FROM u)
           SELECT unit, px AS x, py AS y, EXISTS (SELECT 1 FROM a WHERE px >= a.x AND px <= a.x + 5 AND py >= a.y AND py <= a.y + 2.5) AS in_region FROM p""")
def region_membership(spark, sf_dir):
    """Units whose point surely inside is covered by the union of the areas."""
    points = overlay.representative_points(units(spark, sf_dir), "unit", "wkt")
    inside = spatial.covering_areas(points, "unit", "x", "y", areas(spark, sf_dir), "area", "wkt", cell=5.0).select("unit").distinct().withColumn("_in", F.lit(True))
    return points.join(inside, "unit", "left").select("unit", "x", "y", F.coalesce("_in", F.lit(False)).alias("in_region"))


#: A bow-tie, an open ring, a hole outside and a good triangle, by turns.
_TEXTS = ["POLYGON (({0} 0, {1} 2, {1} 0, {0} 2, {0} 0))", "POLYGON (({0} 0, {1} 0, {1} 1))", "POLYGON (({0} 0, {1} 0, {1} 1, {0} 0), (-9 -9, -8 -9, -8 -8, -9 -9))", "POLYGON (({0} 0, {1} 0, {1} 1, {0} 0))"]


@query("""SELECT c_custkey AS unit, CASE c_custkey % 4 WHEN 0 THEN 'a boundary that meets itself' WHEN 1 THEN 'a ring that does not close' WHEN 2 THEN 'a hole outside its ring' END AS fault FROM customer""")
def geometry_audit(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (k % 4 + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{0}"), k.cast("string")), F.lit("{1}"), (k + 2).cast("string"))
    return dealt(spark, read(spark, sf_dir, "customer"), "c_custkey").select(k.alias("unit"), overlay.geometry_fault(text).alias("fault"))


@query("""WITH w AS (SELECT c_custkey AS unit, CASE WHEN c_custkey % 7 = 0 THEN -666666666.0 ELSE c_acctbal END AS a_e, CASE c_custkey % 5 WHEN 0 THEN -222222222.0 WHEN 1 THEN -555555555.0 ELSE 1.5 END AS a_m, c_nationkey::DOUBLE AS b_e, CASE WHEN c_custkey % 3 = 0 THEN -333333333.0 END AS b_m FROM customer),
          l AS (SELECT unit, 'a' AS variable_id, a_e::DOUBLE AS e, a_m::DOUBLE AS m FROM w UNION ALL SELECT unit, 'b', b_e, b_m FROM w),
          c AS (FROM (VALUES (-666666666.0, 'unavailable'), (-222222222.0, 'unavailable'), (-555555555.0, 'controlled'), (-333333333.0, 'open_ended_median')) t(code, state))
          SELECT unit, variable_id, CASE WHEN x.state IS NULL THEN e END AS estimate, coalesce(x.state, CASE WHEN e IS NULL THEN 'missing' ELSE 'published' END) AS estimate_state, CASE WHEN y.state IS NULL THEN m END AS margin_of_error,
                 coalesce(y.state, CASE WHEN m IS NULL THEN 'missing' ELSE 'published' END) AS margin_of_error_state FROM l LEFT JOIN c x ON x.code = e LEFT JOIN c y ON y.code = m""")
def estimates_with_states(spark, sf_dir):
    k = F.col("c_custkey")
    wide = read(spark, sf_dir, "customer").select(k.alias("unit"), F.when(k % 7 == 0, -666666666.0).otherwise(F.col("c_acctbal")).alias("a_e"), F.when(k % 5 == 0, -222222222.0).when(k % 5 == 1, -555555555.0).otherwise(1.5).alias("a_m"), F.col("c_nationkey").alias("b_e"), F.when(k % 3 == 0, -333333333.0).alias("b_m"))
    return overlay.unpivoted_pairs(wide, ["unit"], {"a": ("a_e", "a_m"), "b": ("b_e", "b_m")})


# ---- neighbourhoods of the units ----

_NEAR = f"{_UNITS}, e AS (SELECT a.unit AS src, b.unit AS dst, a.grp AS g, b.grp AS h FROM u a JOIN u b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND a.unit <> b.unit)"


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst) of squares that touch, both ways, as a table: the graph is built once."""
    return written(spatial.contiguity(units(spark, sf_dir), "unit", "wkt"), "neighbours")


@query(f"""WITH RECURSIVE {_NEAR}, r AS (SELECT unit AS a, unit AS b FROM u UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src AND g = h), c AS (SELECT a, min(b) AS component FROM r GROUP BY a), s AS (SELECT component, count(*) AS n FROM c GROUP BY component)
           SELECT sum(n)::BIGINT AS nodes, count(*) AS components, max(n) AS largest, count(*) FILTER (n = 1) AS islands, count(*) = 1 AS connected FROM s""")
def region_connectivity(spark, sf_dir):
    """Connected parts of the squares when only neighbours of one nation hang together."""
    rows = units(spark, sf_dir)
    of = lambda c: rows.select(F.col("unit").alias(c), F.col("grp").alias(f"g_{c}")).hint("merge")  # noqa: E731  # by shuffles, as in the rounds
    same = neighbours(spark, sf_dir).join(of("src"), "src").join(of("dst"), "dst").where("g_src = g_dst").select("src", "dst")
    return networks.connectivity(rows, "unit", same)


@query(f"""WITH {_NEAR}, w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e) SELECT count(*) AS edges, sum({_DRAW.format("'0|' || src || '|' || dst || '|' || printf('%.12f', w)")})::BIGINT AS checksum FROM w""")
def neighbour_checksum(spark, sf_dir):
    return networks.weights_checksum(spatial.row_standardised(neighbours(spark, sf_dir)))


@query()
def connecting_band_of_units(spark, sf_dir):
    """The least distance at which points within the squares hang together; tested against whole matrices, as SQL can't express it."""
    k = F.col("unit")
    rows = units(spark, sf_dir).select("unit", (F.col("x") + (k * 37 % 101) / 101.0).alias("px"), (F.col("y") + (k * 59 % 103) / 103.0).alias("py"))
    return networks.connecting_band(rows, "unit", "px", "py").select(r6("threshold"), "edges", "points")


_REPLICATES = 99
_PICK = _DRAW.format("'41|' || unit || '|' || replicate || '|' || s[1]")


@query(f"""WITH {_NEAR}, v AS (SELECT c_custkey AS unit, c_acctbal AS v, (c_custkey * 7919 % 1009)::DOUBLE AS o FROM customer),
           z AS (SELECT unit, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z, (o - avg(o) OVER ()) / stddev_pop(o) OVER () AS o, count(*) OVER () AS n, row_number() OVER (ORDER BY substr(md5(unit::VARCHAR), 1, 3), unit) - 1 AS place FROM v),
           l AS (SELECT src AS unit, count(*) AS d, avg(z) AS lag, sum(z) AS s, avg(o) AS olag FROM e JOIN z ON unit = dst GROUP BY src), f AS (SELECT * FROM z JOIN l USING (unit)),
           t AS (SELECT unit, replicate, place, unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(range(1, d + 1), lambda i: [i])), lambda a, s: list_append(a, CASE WHEN list_contains(a, {_PICK} % (n - 1 - d + s[1])) THEN n - 1 - d + s[1] - 1 ELSE {_PICK} % (n - 1 - d + s[1]) END))) AS t FROM f, range({_REPLICATES}) r(replicate)),
           p AS (SELECT t.unit, replicate, avg(z.z) AS lag, sum(z.z) AS s, avg(z.o) AS olag FROM t JOIN z ON z.place = t + (t >= t.place)::INT GROUP BY ALL),
           g AS (SELECT f.unit, replicate, f.z * f.lag AS a1, f.z * p.lag AS b1, (f.z + f.s) / sqrt((n * (d + 1.0::DOUBLE) - (d + 1) ** 2) / (n - 1)) AS a2, (f.z + p.s) / sqrt((n * (d + 1.0::DOUBLE) - (d + 1) ** 2) / (n - 1)) AS b2, f.z * f.olag AS a3, f.z * p.olag AS b3 FROM f JOIN p ON p.unit = f.unit),
           m AS (SELECT unit, family, a, b, avg(b) OVER (PARTITION BY unit, family) AS c FROM (SELECT unit, 'local_moran' AS family, a1 AS a, b1 AS b FROM g UNION ALL SELECT unit, 'getis_ord_gi_star', a2, b2 FROM g UNION ALL SELECT unit, 'bivariate_lisa', a3, b3 FROM g)),
           q AS (SELECT unit, family, any_value(a) AS statistic, (count(*) FILTER (abs(b - c) >= abs(a - c) - 1e-12) + 1) / {_REPLICATES + 1}.0::DOUBLE AS p_raw FROM m GROUP BY ALL),
           k AS (SELECT *, p_raw * count(*) OVER (PARTITION BY family) / (rank() OVER (PARTITION BY family ORDER BY p_raw) + count(*) OVER (PARTITION BY family, p_raw) - 1) AS k FROM q)
           SELECT unit, family, round(statistic, 6) AS statistic, round(p_raw, 6) AS p_raw, round(least(1, min(k) OVER (PARTITION BY family ORDER BY p_raw DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM k""")
def conditional_local_tests(spark, sf_dir):
    """Local Moran, Gi* and bivariate LISA of the squares with conditional permutations and adjusted p-values."""
    values = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") * 7919 % 1009).cast("double").alias("o"))
    out = local.conditional_diagnostics(values, "unit", "v", neighbours(spark, sf_dir), _REPLICATES, 41, "o")
    return out.select("unit", "family", *[r6(c) for c in ("statistic", "p_raw", "p_adjusted")])


@query()
def spatial_error_sensitivity(spark, sf_dir):
    """Coefficients and contrasts of a model with correlated errors beside its ordinary fit; tested against whole matrices, as SQL can't express it."""
    edges = neighbours(spark, sf_dir)
    k = F.col("unit")
    rows = units(spark, sf_dir).select("unit", (k * 7919 % 1009 / 100.0).alias("h"), (k * 104729 % 1013 / 100.0).alias("d"), "x", "y", "c_acctbal")
    # the outcome rises along the map, which leaves errors of neighbours alike
    rows = written(rows.select("unit", "h", "d", (0.7 * F.col("h") - 0.2 * F.col("d") + F.col("c_acctbal") / 2000.0 + 3.0 * F.sin(F.col("x") / 5.0)).alias("v")), "model")
    found = spatial_error.fit(rows, "unit", "v", ["h", "d"], edges)
    return spatial_error.sensitivity_table(spark, {"C1": found, "C2": None}, {"C1": {"C1": {"h": 1.0, "d": 1.0}, "C1-H": {"h": 1.0}, "C1-D": {"d": 1.0}}})


# ---- models of customers by region ----

_FRAME = """f AS (SELECT c_custkey AS k, n_regionkey AS region, c_nationkey AS nation, c_acctbal / 100 AS y, coalesce(p, 0) / 1000 AS x1, coalesce(m, 0)::DOUBLE AS x2, coalesce(m, 0) + 1.0::DOUBLE AS w FROM customer JOIN nation ON n_nationkey = c_nationkey
          LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS p, count(*) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
_SOLVE = """ (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2"""
_MOMENTS = "count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) * var_pop(x1) AS s11, count(*) * var_pop(x2) AS s22, count(*) * covar_pop(x1, x2) AS s12, count(*) * covar_pop(x1, y) AS s1y, count(*) * covar_pop(x2, y) AS s2y"


def customer_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("p"), F.count("*").alias("m"))
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") / 100).alias("y")).join(nations, "nation").join(orders, "k", "left")
    m = F.coalesce("m", F.lit(0)).cast("double")
    return rows.select("k", "region", "nation", "y", (F.coalesce("p", F.lit(0.0)) / 1000).alias("x1"), m.alias("x2"), (m + 1).alias("w"))


@query(f"""WITH {_FRAME}, s AS (SELECT region, {_MOMENTS} FROM f GROUP BY region), b AS (SELECT *, {_SOLVE}, s22 / (s11 * s22 - s12 * s12) AS i11, s11 / (s11 * s22 - s12 * s12) AS i22, -s12 / (s11 * s22 - s12 * s12) AS i12 FROM s),
           e AS (SELECT region, n, b1, b2, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e, 1.0::DOUBLE / n + i11 * (x1 - m1) ** 2 + 2 * i12 * (x1 - m1) * (x2 - m2) + i22 * (x2 - m2) ** 2 AS h, i11 * (x1 - m1) + i12 * (x2 - m2) AS g1, i12 * (x1 - m1) + i22 * (x2 - m2) AS g2 FROM f JOIN b USING (region)),
           v AS (SELECT region, any_value(n) AS n, any_value(b1) AS b1, any_value(b2) AS b2, sqrt(sum((g1 * e / (1 - h)) ** 2)) AS v1, sqrt(sum((g2 * e / (1 - h)) ** 2)) AS v2, sqrt(sum(((g1 + g2) * e / (1 - h)) ** 2)) AS v3 FROM e GROUP BY region),
           l AS (SELECT region, 'first' AS contrast, n, b1 AS estimate, v1 AS se FROM v UNION ALL SELECT region, 'second', n, b2, v2 FROM v UNION ALL SELECT region, 'both', n, b1 + b2, v3 FROM v)
           SELECT region, contrast, n, round(estimate, 5) AS estimate, round(se, 5) AS se, round(estimate - 2.241402727604947 * se, 5) AS lo, round(estimate + 2.241402727604947 * se, 5) AS hi FROM l""")
def regional_models(spark, sf_dir):
    """Two predictors by region in one job: HC3 errors and contrasts at the 0.975 level."""
    fitted = models.robust_fits(customer_frame(spark, sf_dir), ["region"], "y", ["x1", "x2"])
    out = models.contrasts(fitted, ["region"], ["x1", "x2"], {"first": {"x1": 1.0}, "second": {"x2": 1.0}, "both": {"x1": 1.0, "x2": 1.0}}, level=0.975)
    return out.select("region", "contrast", "n", *[F.round(c, 5).alias(c) for c in ("estimate", "se", "lo", "hi")])


@query(f"""WITH {_FRAME}, s AS (SELECT p.region, p.nation, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) * var_pop(x1) AS s11, count(*) * var_pop(x2) AS s22, count(*) * covar_pop(x1, x2) AS s12, count(*) * covar_pop(x1, y) AS s1y, count(*) * covar_pop(x2, y) AS s2y
             FROM (SELECT DISTINCT region, nation FROM f) p JOIN f ON f.region = p.region AND f.nation <> p.nation GROUP BY p.region, p.nation)
           SELECT region, nation, n, round(b1, 5) AS b1, round(b2, 5) AS b2 FROM (SELECT *, {_SOLVE} FROM s)""")
def models_without_nations(spark, sf_dir):
    """Each region's model without each of its nations, from moments."""
    out = models.without_parts(customer_frame(spark, sf_dir), ["region"], "nation", "y", ["x1", "x2"])
    return out.select("region", "nation", "n", F.round(F.col("beta")[1], 5).alias("b1"), F.round(F.col("beta")[2], 5).alias("b2"))


_WEIGHED = "count(*) AS n, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, sum(w * y) / sum(w) AS my"


@query(f"""WITH {_FRAME}, v AS (SELECT 'all' AS variant, * FROM f UNION ALL SELECT 'with_orders', * FROM f WHERE x2 > 0 UNION ALL SELECT 'positive', * FROM f WHERE y > 0), m AS (SELECT variant, {_WEIGHED} FROM v GROUP BY variant),
           s AS (SELECT variant, any_value(n) AS n, sum(w * (x1 - m1) ** 2) AS s11, sum(w * (x2 - m2) ** 2) AS s22, sum(w * (x1 - m1) * (x2 - m2)) AS s12, sum(w * (x1 - m1) * (y - my)) AS s1y, sum(w * (x2 - m2) * (y - my)) AS s2y FROM v JOIN m USING (variant) GROUP BY variant)
           SELECT variant, n, round(b1, 5) AS b1, round(b2, 5) AS b2 FROM (SELECT *, {_SOLVE} FROM s)""")
def weighted_variants(spark, sf_dir):
    """Weighted fits of three variants of the rows in one job."""
    rows = models.with_variants(customer_frame(spark, sf_dir), {"all": None, "with_orders": F.col("x2") > 0, "positive": F.col("y") > 0})
    out = models.fits(rows, ["variant"], "y", ["x1", "x2"], "w")
    return out.select("variant", "n", F.round(F.col("beta")[1], 5).alias("b1"), F.round(F.col("beta")[2], 5).alias("b2"))
