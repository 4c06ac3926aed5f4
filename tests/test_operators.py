"""Operators that the catalogue doesn't show in full, on small frames with values worked out by hand or plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.functions import columns as C
from arealis.functions import text as T
from arealis.operators import agreement, cohort, joins, linear, quality, ranking, resample, spatial


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


# ---- known answers ----


def test_average_tie_ranks_and_quartiles(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 40.0), (5, None)], "k int, v double")
    assert column(df.withColumn("r", ranking.percentile_rank("v")).orderBy("k"), "r") == [0.25, 0.625, 0.625, 1.0, None]
    edges = spark.createDataFrame([(0.25,), (0.5,), (0.75,), (0.75001,), (None,)], "r double")
    assert column(edges, C.rank_quartile("r")) == [1, 2, 3, 4, None]


def test_bins_and_rank_quartiles_treat_bounds_differently(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    cuts = [F.lit(x) for x in (1.0, 2.0, 3.0)]
    assert column(df, C.cut_bin("v", *cuts)) == [1, 3, 4, 4]
    assert column(df, C.frozen_quartile("v", [1.0, 2.0, 3.0])) == [1, 2, 3, 4]


SQUARES = [(n, f"POLYGON (({x} {y}, {x + 1} {y}, {x + 1} {y + 1}, {x} {y + 1}, {x} {y}))", v) for n, x, y, v in [("d", 1, 1, 8.0), ("a", 0, 0, 1.0), ("c", 0, 1, 4.0), ("b", 1, 0, 2.0)]]


def test_moran_of_four_squares(spark):
    areas = spark.createDataFrame(SQUARES, "id string, wkt string, v double")
    queen, rook = (spatial.contiguity(areas, "id", "wkt", r) for r in ("queen", "rook"))
    assert queen.count() == 12 and rook.count() == 8
    weights = spatial.row_standardised(queen)
    assert abs(spatial.moran(areas, "id", "v", weights).first()["moran"] + 1 / 3) < 1e-12  # all are neighbours
    # rook: neighbours of a are b and c, of d too
    z = np.array([1, 2, 4, 8]) - 3.75
    w = np.array([[0, 0.5, 0.5, 0], [0.5, 0, 0, 0.5], [0.5, 0, 0, 0.5], [0, 0.5, 0.5, 0]])
    got = spatial.moran(areas, "id", "v", spatial.row_standardised(rook)).first()["moran"]
    assert abs(got - z @ w @ z / (z @ z)) < 1e-12
    top = spatial.topology(queen, areas, "id").first()
    assert (top["areas"], top["edges"], top["islands"], top["mean"]) == (4, 6, 0, 3.0)


def test_perfect_agreement(spark):
    df = spark.createDataFrame([(i % 4 + 1, i % 4 + 1) for i in range(20)], "a int, b int")
    t = agreement.crosstab(df, [], "a", "b")
    row = t.select(agreement.gwet_ac1(t).alias("ac1"), agreement.weighted_kappa(t).alias("kappa")).first()
    assert row["ac1"] == 1.0 and row["kappa"] == 1.0
    same = agreement.crosstab(spark.createDataFrame([(2, 2)] * 3, "a int, b int"), [], "a", "b")
    assert same.select(agreement.weighted_kappa(same)).first()[0] is None


def test_escalation_and_stability():
    assert spatial.needs_escalation(-0.10, 0.0499) and not spatial.needs_escalation(0.0999, 0.01) and not spatial.needs_escalation(0.2, 0.05)
    assert [spatial.stability(*x) for x in ((1, -1), (1, 1.2), (1, 1.21), (2, 1.5))] == ["sign_change", "stable", "changed", "changed"]


# ---- inference ----


def test_t_distribution():
    for t, df, p in [(0.0, 5, 1.0), (2.571, 5, 0.05), (1.96, 1e6, 0.05), (12.706, 1, 0.05), (3.169, 10, 0.01)]:
        assert abs(agreement.t_two_sided(t, df) - p) < 2e-4


def test_correlation_p(spark):
    df = agreement.with_correlation_p(spark.createDataFrame([(0.5, 20), (1.0, 9), (None, 3), (0.2, 2)], "r double, n int"), "r", "n")
    p = column(df, "p")
    assert abs(p[0] - 0.0248) < 1e-3 and p[1:] == [0.0, None, None]


def test_false_discovery_skips_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, 0.5)], "k int, p double")
    got = column(agreement.adjusted(df, "p", []).orderBy("k"), "p_adjusted")
    assert [None if x is None else round(x, 6) for x in got] == [0.04, 0.053333, 0.053333, None, 0.5]


def test_least_squares_hc3_and_influence(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=40) * (1 + abs(x[:, 0]))
    w = rng.uniform(0.5, 2, 40)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i]), float(w[i])) for i in range(40)] + [(99, None, 1.0, 1.0, 1.0)], "k int, y double, a double, b double, w double")
    for weight in (None, "w"):
        v = w if weight else np.ones(40)
        design = np.column_stack([np.ones(40), x])
        bread = np.linalg.inv(design.T @ (design * v[:, None]))
        beta = bread @ design.T @ (v * y)
        h = v * np.einsum("ij,jk,ik->i", design, bread, design)
        u = v * (y - design @ beta) / (1 - h)
        fit = linear.least_squares(df, "y", ["a", "b"], weight)
        assert fit.n == 40 and np.allclose(fit.beta, beta) and np.allclose(fit.covariance, bread @ design.T @ (design * (u * u)[:, None]) @ bread)
    row = linear.influence(df, "k", "y", ["a", "b"]).where("k = 7").first()
    left = np.delete(np.arange(40), 7)
    design = np.column_stack([np.ones(40), x])
    b = np.linalg.lstsq(design[left], y[left], rcond=None)[0]
    s = np.sqrt(((y[left] - design[left] @ b) ** 2).sum() / 36)
    h = design[7] @ np.linalg.inv(design.T @ design) @ design[7]
    full = np.linalg.lstsq(design, y, rcond=None)[0]
    assert abs(row["studentised"] - (y[7] - design[7] @ full) / (s * math.sqrt(1 - h))) < 1e-9
    with pytest.raises(ValueError):
        linear.least_squares(df.withColumn("c", F.col("a") * 2), "y", ["a", "c"])
    rows = linear.gates(df.withColumn("c", F.col("a") + F.col("b") * 0.01), "y", ["a", "c"], least_n=10)
    assert not any(r["passes"] for r in rows) and rows[0]["largest_r"] > 0.8


def test_spatial_error_recovers_its_parameter():
    rng = np.random.default_rng(0)
    n = 144
    w = np.zeros((n, n))
    for i in range(n):
        for j in (i - 1 if i % 12 else -1, i + 1 if i % 12 < 11 else -1, i - 12, i + 12):
            if 0 <= j < n:
                w[i, j] = 1
    w /= w.sum(1, keepdims=True)
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    y = x @ [1.0, 2.0] + np.linalg.solve(np.eye(n) - 0.6 * w, rng.normal(size=n) * 0.5)
    fit = spatial.spatial_error(y, x, w)
    assert abs(fit["lambda"] - 0.6) < 0.2 and abs(fit["beta"][1] - 2) < 0.15 and (fit["se"] > 0).all()


def test_smallest_band_connects(spark):
    xy = np.array([[0, 0], [1, 0], [1, 2], [5, 2]], float)
    assert spatial.smallest_connected_band(xy) == 4.0
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "id int, x double, y double")
    got = {(r.src, r.dst) for r in spatial.distance_band(points, "id", "x", "y", 2.0).collect()}
    assert got == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_conditional_permutations(spark):
    areas = spark.createDataFrame([(i, f"POLYGON (({i % 6} {i // 6}, {i % 6 + 1} {i // 6}, {i % 6 + 1} {i // 6 + 1}, {i % 6} {i // 6 + 1}, {i % 6} {i // 6}))", float(i % 6 > 2) * 5 + i * 0.01) for i in range(36)], "id int, wkt string, v double")
    w = spatial.row_standardised(spatial.contiguity(areas, "id", "wkt"))
    p = {r.id: r.p for r in spatial.conditional_p(areas, "id", "v", w, 199, 7).collect()}
    assert len(p) == 36 and p[0] < 0.2 and all(0 < x <= 1 for x in p.values())


def test_draws_are_normal_and_repeatable(spark):
    df = spark.createDataFrame([(1, 50.0, 5.0), (2, 1.0, 10.0)], "k int, m double, s double")
    a = resample.normal_draws(df, ["k"], "m", "s", 2000, 3)
    row = a.where("k = 1").agg(F.avg("drawn"), F.stddev("drawn")).first()
    assert abs(row[0] - 50) < 0.5 and abs(row[1] - 5) < 0.3 and a.agg(F.min("drawn")).first()[0] == 0.0
    assert a.exceptAll(resample.normal_draws(df, ["k"], "m", "s", 2000, 3)).isEmpty()
    assert sorted(column(resample.permuted(df, "k", "m", 5, 1).where("replicate = 3"), "m")) == [1.0, 50.0]


# ---- rules, joins, cohorts ----


def test_cleansing(spark):
    df = spark.createDataFrame([("1,234.5",), (" N/A",), ("<10",), ("x",), ("-7.9",), ("inf",), (None,)], "t string")
    assert column(df, C.number("t")) == [1234.5, None, None, None, -7.9, None, None]
    assert column(df, C.integer("t")) == [1234, None, None, None, -7, None, None]
    ids = spark.createDataFrame([("1714000-7",), ("1714000-35",), ("12.0",), ("loop",), ("17031",)], "t string")
    assert column(ids, C.area_id("t", "1714000-")) == ["07", "35", "12", "loop", "17031"]
    assert column(ids, C.flag(F.lit("Yes"))) == [True] * 5 and column(ids.limit(1), C.flag(F.lit(None))) == [False]
    ci = spark.createDataFrame([("(1.5, 20)",), ("1 2 3",), ("(5, 4)",), ("(-1, 4)",), (None,)], "t string")
    assert [tuple(x) if x else None for x in column(ci, C.interval("t"))] == [(1.5, 20.0), None, None, None, None]
    assert column(df.limit(1), C.percent_change(F.lit(3.0), F.lit(0.0))) == [None]


def test_suppression_order(spark):
    df = spark.createDataFrame([(None, 1.0, 50), (0, 1.0, 50), (9, 1.0, 50), (10, None, 50), (10, 1.0, 29), (10, 1.0, 30)], "n int, m double, d int")
    reason = C.suppression_reason("n", "m")
    assert column(df, reason) == ["unavailable", "unresolved_zero", "below_threshold", "unavailable", None, None]
    assert column(df, C.exclusion_reason(reason, "m", "d")) == ["unavailable", "unresolved_zero", "below_threshold", "unavailable", "small_denominator", "eligible"]


def test_checked_joins(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (3, "z")], "k int, v string")
    assert joins.checked_join(a, b, ["k"], "left", "m:1").count() == 3
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(a, b, ["k"], "left", "1:1")
    got = {r.k: r.side for r in joins.reconciled(a, b, ["k"]).collect()}
    assert got == {1: "both", 2: "left_only", 3: "right_only"} and joins.same_sets(a, a.distinct()) and not joins.same_sets(a, b.select("k"))


def test_exact_members_need_all_conditions(spark):
    rows = [(1, "a", 5, True), (1, "b", 5, True), (2, "a", 5, True), (3, "a", 5, True), (3, "b", 6, True), (4, "a", 5, True), (4, "b", 5, None), (5, "a", 5, True), (5, "b", 5, True), (5, "b", 5, True)]
    df = spark.createDataFrame(rows, "g int, m string, d int, ok boolean")
    assert column(cohort.with_exact_members(df, ["g"], "m", ["a", "b"], "d", F.col("ok")), "g") == [1]


def test_jaccard_of_nothing_is_one(spark):
    df = spark.createDataFrame([(1, False, False), (2, True, None), (2, True, True)], "g int, a boolean, b boolean")
    got = {r.g: r.j for r in df.groupBy("g").agg(cohort.flag_jaccard(F.col("a"), F.col("b")).alias("j")).collect()}
    assert got == {1: 1.0, 2: 0.5}


def test_quality_and_lineage(spark):
    df = spark.createDataFrame([(1, 5, 4, 1.25), (2, 1, 4, 0.25), (3, None, 4, None)], "k int, n int, d int, r double")
    rules = [("n_above_d", quality.more_than("n", "d")), ("ratio", quality.ratio_differs("n", "d", "r"))]
    assert [tuple(r) for r in quality.findings(df, "k", rules).collect()] == [("n_above_d", "1")]
    assert {r.rule: r.findings for r in quality.finding_counts(df, rules).collect()} == {"n_above_d": 1, "ratio": 0}
    with pytest.raises(ValueError):
        quality.require_unique(df, ["d"])
    with pytest.raises(ValueError):
        quality.require_columns(df, ["zz"])
    m = spark.createDataFrame([("t", '{"x": "s1:a|s2:b", "y": "s1:c"}')], "target string, map string")
    assert sorted(tuple(r)[1:] for r in quality.field_lineage(m, "target", "map").collect()) == [("x", "s1", "a"), ("x", "s2", "b"), ("y", "s1", "c")]


def test_text_metrics(spark):
    df = spark.createDataFrame([("The government may act. It is a nice implementation, of 3 parts! No.\n\n\n\nPage 7\nMore text here now.",)], "t string")
    t = F.col("t")
    row = df.select(T.sentences(t).alias("s"), T.cleaned(t, r"^Page \d+$").alias("c"), *[c.alias(n) for n, c in T.section_metrics(t).items()]).first()
    assert len(row["s"]) == 3 and "Page" not in row["c"] and row["n_words"] == 17
    assert row["nominal_share"] == pytest.approx(2 / 17) and row["hedge_share"] == pytest.approx(1 / 17)
    assert column(spark.createDataFrame([("cake",), ("table",), ("a",), ("rhythm",), ("reading",)], "w string"), T.syllables(F.col("w"))) == [1, 2, 1, 1, 2]
    assert column(df, T.term_hits(t, ["NICE", "govern"])) == [["NICE"]]


def test_normal_quantiles_and_scores(spark):
    from statistics import NormalDist

    ps = [1e-9, 0.001, 0.02425, 0.2, 0.5, 0.9, 0.99, 0.999999]
    got = column(spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double"), C.normal_quantile("p"))
    assert all(abs(a - NormalDist().inv_cdf(p)) < 1e-7 for a, p in zip(got, ps)) and got[len(ps) :] == [None, None]
    df = spark.createDataFrame([(3.0,), (1.0,), (2.0,), (None,)], "v double")
    scores = {r.v: r.s for r in df.withColumn("s", ranking.normal_scores("v")).collect()}
    assert abs(scores[2.0]) < 1e-12 and abs(scores[1.0] + scores[3.0]) < 1e-12 and scores[None] is None


def test_points_in_a_ring_with_a_hole(spark):
    areas = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"), (2, "POLYGON ((1 1, 3 1, 2 3, 1 1))")], "area int, wkt string")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 1.5), (3, 1.05, 2.9), (4, 9.0, 9.0)], "p int, x double, y double")
    got = {(r.p, r.area) for r in spatial.covering_areas(points, "p", "x", "y", areas, "area", "wkt").collect()}
    assert got == {(1, 1), (2, 2)}


def test_prediction_curve_passes_through_the_line(spark):
    df = spark.createDataFrame([(float(i), float(i * 2 + 1 + (i % 3 - 1) * 0.1)) for i in range(20)], "x double, y double")
    rows = linear.prediction_curve(df, linear.least_squares(df, "y", ["x"]), "x", 5).collect()
    assert [r.value for r in rows] == [0.0, 4.75, 9.5, 14.25, 19.0] and all(abs(r.predicted - (2 * r.value + 1)) < 0.2 and r.lo < r.predicted < r.hi for r in rows)


def test_contiguity_of_areas_that_meet_within_edges(spark):
    box = lambda a, b, c, d: f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))"
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id string, wkt string")
    areas = {
        "base": box(0, 0, 4, 2),
        "left": box(0, 2, 1, 3),  # T-junction at (1, 2), within base's edge
        "right": "POLYGON ((1 2, 2 2, 3 2, 4 2, 4 3, 1 3, 1 2))",  # base's edge subdivided
        "tip": "POLYGON ((1 0, 2 -1, 0 -1, 1 0))",  # a corner within an edge
        "far": box(5, 5, 6, 6),
        "frame": "POLYGON ((8 0, 12 0, 12 4, 8 4, 8 0), (9 1, 11 1, 11 3, 9 3, 9 1))",
        "plug": box(9, 1, 11, 3),  # fills the hole
    }
    got = [{(r.src, r.dst) for r in spatial.contiguity(frame(areas), "id", "wkt", rule).collect()} for rule in ("queen", "rook")]
    rook = {("base", "left"), ("base", "right"), ("left", "right"), ("frame", "plug")}
    both_ways = lambda e: e | {(b, a) for a, b in e}
    assert got == [both_ways(rook | {("base", "tip")}), both_ways(rook)]
    for other in (box(1, 1, 3, 5), box(1, 0, 5, 2), box(0, 0, 4, 2), box(1, 0.5, 2, 1), "POLYGON ((2 0, 4 1, 2 2, 0 1, 2 0))"):
        with pytest.raises(Exception, match="intersect"):
            spatial.contiguity(frame({"base": areas["base"], "other": other}), "id", "wkt").collect()


def test_null_rules_and_text_ids(spark):
    from arealis.functions import columns as C
    from arealis.operators import agreement, cohort, resample

    rows = spark.createDataFrame([("a", 1, 0.01), ("b", 1, 0.02), ("c", 1, float("nan")), ("d", 1, float("nan")), ("e", 1, None)], "k string, f int, p double")
    got = {r.k: r.p_adjusted for r in agreement.adjusted(rows, "p", ["f"]).collect()}
    assert got["a"] == got["b"] == 0.02 and got["c"] is got["d"] is got["e"] is None
    assert spark.range(1).select(C.clamped_interval(F.lit(None).cast("double"), F.lit(1.0))).first()[0] is None
    many = resample.normal_draws(spark.createDataFrame([(1, None, 1.0), (2, 5.0, 1.0)], "k int, m double, s double"), ["k"], "m", "s", 3, 1)
    assert {(r.k, r.drawn is None) for r in many.collect()} == {(1, True), (2, False)}
    links = spark.createDataFrame([("u", "x", 0.5), ("u", "w", 0.5), ("v", "z", 1.0)], "u string, a string, w double")
    assert {r.u: r.dominant for r in cohort.dominant_link(links, "u", "a", "w").collect()} == {"u": "w", "v": "z"}
    states = spark.createDataFrame([("u", "hi"), ("u", "lo"), ("u", "hi"), ("v", "lo"), ("v", "hi")], "u string, s string")
    assert {r.u: r.persistence for r in cohort.persistent_state(states, ["u"], "s").collect()} == {"u": "hi", "v": "unstable"}
    one = agreement.variance_partition(spark.createDataFrame([(1, 2.0, "a"), (1, 3.0, "a")], "g int, v double, a string"), ["g"], "v", "a").first()
    assert one.between is None and one.vpc is None and one.within == 0.5


def test_p_of_correlations_and_syllables(spark):
    from arealis.functions import text as T
    from arealis.operators import agreement

    rows = spark.createDataFrame([(0.5, 27), (None, 9), (1.0, 9), (0.2, 2)], "r double, n int")
    p = [r.p for r in agreement.with_correlation_p(rows, "r", "n").collect()]
    assert abs(p[0] - 0.00791) < 1e-4 and p[1] is None and p[2] == 0.0 and p[3] is None
    texts = spark.createDataFrame([("gate the apple employee rhythm don't Queue-like a e",), ("",), ("...",)], "t string")
    got = texts.select(T.syllable_count(F.array_join(T.words(F.col("t")), " ")).alias("a"), T.total(T.words(F.col("t")), T.syllables).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


# ---- reports ----


def test_allocation_keeps_totals_and_replicates(spark):
    weights = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 1.0), ("b", 2, 5.0), ("c", 3, 0.0), (None, 3, 1.0)], "u string, area int, w double")
    counts = spark.createDataFrame([("a", 8.0, [4.0, 12.0]), ("b", 2.0, [2.0, 2.0]), ("c", 9.0, [9.0, 9.0]), ("d", 7.0, [7.0, 7.0])], "u string, n double, r array<double>")
    got = cohort.allocated(counts, weights, "u", "area", "w", ["n"], ["r"]).orderBy("area").collect()
    assert [(r.area, r.n, r.r) for r in got] == [(1, 6.0, [3.0, 9.0]), (2, 4.0, [3.0, 5.0])]
    df = spark.createDataFrame([(6.0, [3.0, 9.0]), (1.0, []), (None, [1.0])], "n double, r array<double>")
    assert column(df, cohort.replicate_error(F.col("n"), F.col("r"))) == [6.0, None, None]


def test_claims_records_and_sentences(spark):
    claims = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.0)], "k string, claimed double")
    evidence = spark.createDataFrame([("a", 1.05), ("b", 1.0), ("c", None)], "k string, value double")
    assert {r.k: r.status for r in quality.claim_audit(claims, evidence, ["k"], 0.1).collect()} == {"a": "supported", "b": "contradicted", "c": "no_evidence"}
    rows = spark.createDataFrame([("A1", "one", 1, 1.0, False), ("A1", None, -1, float("nan"), True), ("X", "one", None, None, None)], "id string, name string, d int, e double, ok boolean")
    found = {tuple(r) for r in quality.findings(rows.withColumn("k", F.concat_ws("/", "id", "name")), "k", quality.result_rules({"A1": "one"}, "id", "name", "d", ["e"], "ok")).collect()}
    assert found == {("other_name", "A1"), ("denominator", "A1"), ("authorised", "A1"), ("e_not_finite", "A1"), ("unknown_id", "X/one"), ("denominator", "X/one"), ("authorised", "X/one")}
    text = lambda subject: spark.range(1).select(C.association_sentence(F.lit(subject), F.lit(70), F.lit(1.0), F.lit(0.5), F.lit(1.5), F.lit("unit"), ["Caused by"])).first()[0]
    assert text("Rates").startswith("Rates: 70 areas, a difference of 1.00 per unit (0.50 to 1.50).")
    with pytest.raises(Exception, match="forbidden term"):
        text("rates caused BY age")


def test_recomputed_figures_and_residuals(spark):
    a = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, None)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, 5.0), (2, 2.0, 6.0)], "k int, x double, y double")
    assert {r.measure: (r.rows, r.unmatched, r.agrees) for r in quality.recomputed(a, b, ["k"], {"x": 1e-8, "y": 1e-8}).collect()} == {"x": (2, 0, True), "y": (2, 1, False)}
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 3.0), ("g", 3.0, 2.0), ("g", None, 1.0), ("h", 1.0, 1.0)], "g string, x double, y double")
    got = {(r.g, r.x): r.residual for r in linear.residuals(df, ["g"], "y", "x").collect()}
    assert got[("g", None)] is None and got[("h", 1.0)] is None and [round(got[("g", x)], 9) for x in (1.0, 2.0, 3.0)] == [-0.5, 1.0, -0.5]
    assert {r.g: r.role for r in linear.selected(df, ["g"], "y", "x", 3).collect()} == {"g": "primary", "h": "audit_only"}


def test_shapes_with_holes_and_weight_faults(spark):
    square = "(0 0, 4 0, 4 4, 0 4, 0 0)"
    areas = spark.createDataFrame([("s", f"POLYGON ({square})"), ("h", f"POLYGON ({square}, (0 0, 0 2, 2 2, 2 0, 0 0))"), ("m", f"MULTIPOLYGON (({square}), ((8 0, 12 0, 12 4, 8 4, 8 0)))"), ("e", "POLYGON EMPTY")], "k string, wkt string")
    got = {r.k: (r.rings, r.surface, round(r.x, 6), round(r.y, 6)) for r in spatial.shapes(areas, "k", "wkt").collect()}
    assert got == {"s": (1, 16.0, 2.0, 2.0), "h": (2, 12.0, round(28 / 12, 6), round(28 / 12, 6)), "m": (2, 32.0, 6.0, 2.0)}
    w = spark.createDataFrame([("a", "b", 0.5), ("a", "a", 0.5), ("b", "a", 1.0), ("b", "c", -1.0), ("x", "a", 1.0), ("x", "a", 0.0)], "src string, dst string, w double")
    found = {r.fault: r.n for r in spatial.weight_faults(w, spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k").collect()}
    assert found == {"repeated": 1, "to_itself": 1, "not_a_weight": 1, "one_way": 2, "not_standardised": 1, "islands": 1, "strangers": 1}


def test_sentences_are_cut_once_for_all_their_figures(spark):
    from arealis.plans import reports

    plan = reports.writing_style(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1
