import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.scipy_free import benjamini_hochberg, dense_spatial_error, grid_edges, least_spanning_tree

from arealis.operators import agreement, local, networks, spatial, spatial_error
from arealis.plans import maps


def test_spanning_forest_and_components(spark):
    rng = random.Random(3)
    nodes = [*range(60)]
    edges = [(a, b, rng.randint(1, 9) / 2) for a, b in ((rng.randrange(55), rng.randrange(55)) for _ in range(90))] + [(3, 3, 0.1), (7, 99, 0.1)]
    tree, labels = networks.spanning_forest(spark.createDataFrame([(n,) for n in nodes], "k long"), "k", spark.createDataFrame(edges, "src long, dst long, w double"))
    want, component = least_spanning_tree(nodes, [e for e in edges if e[1] != 99])
    rows = tree.collect()
    assert abs(sum(r.w for r in rows) - sum(want)) < 1e-9 and sorted(r.w for r in rows) == sorted(want)
    assert {r.k: r.component for r in labels.collect()} == component
    one = networks.connectivity(spark.createDataFrame([(n,) for n in nodes], "k long"), "k", spark.createDataFrame(edges, "src long, dst long, w double")).first()
    sizes = Counter(component.values())
    assert (one.nodes, one.components, one.largest, one.islands, one.connected) == (60, len(sizes), max(sizes.values()), sum(n == 1 for n in sizes.values()), False)


def test_long_path_settles_in_few_rounds(spark):
    edges = [(i, i + 1, float(i % 7)) for i in range(300)]
    tree, labels = networks.spanning_forest(spark.range(301).toDF("k"), "k", spark.createDataFrame(edges, "src long, dst long, w double"), most_rounds=10)
    assert tree.count() == 300 and {r.component for r in labels.collect()} == {0}


@pytest.mark.parametrize("seed,spread", [(1, "even"), (2, "clusters")])
def test_connecting_band_is_that_of_the_whole_matrix(spark, seed, spread):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 10, (2000, 2)) if spread == "even" else np.concatenate([rng.normal(c, 0.05, (150, 2)) for c in ((0, 0), (9, 1), (3, 7))] + [[[40.0, 40.0]], [[0.0, 0.0]]])
    got = networks.connecting_band(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "k long, x double, y double"), "k", "x", "y").first()
    assert abs(got.threshold - spatial.smallest_connected_band(xy)) < 1e-12 and got.edges == len(xy) - 1


def test_points_in_one_place_never_connect(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, x double, y double")
    assert tuple(networks.connecting_band(make([(1, 1.0, 1.0), (2, 1.0, 1.0)]), "k", "x", "y").first()) == (None, 0, 2)
    # a third point joins both
    assert tuple(networks.connecting_band(make([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 1.0)]), "k", "x", "y").first()) == (1.0, 2, 3)
    assert networks.connecting_band(make([(1, 0.0, 0.0)]), "k", "x", "y").first().threshold is None


def test_no_round_sends_a_table_through_the_driver(spark, monkeypatch):
    plans, real = [], networks.written
    monkeypatch.setattr(networks, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or real(df, name))
    xy = np.random.default_rng(4).uniform(0, 10, (300, 2))
    got = networks.connecting_band(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "k long, x double, y double"), "k", "x", "y").first()
    assert got.edges == 299 and sum("SortMergeJoin" in p for p in plans) > 5
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_regions_are_joined_to_their_neighbours_by_shuffles(spark, monkeypatch):
    plans, real = [], networks.written
    monkeypatch.setattr(networks, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or real(df, name))
    assert maps.region_connectivity(spark, "/root/testdata/sf0.001").first().nodes > 0
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_checksum_hangs_on_weights_and_not_on_order(spark):
    rows = [(1, 2, 0.5), (2, 1, 1.0), (1, 3, 0.5)]
    make = lambda r: networks.weights_checksum(spark.createDataFrame(r, "src long, dst long, w double")).first()
    assert make(rows) == make(rows[::-1]) != make([(1, 2, 0.6), *rows[1:]])


def test_picks_are_different_places_each_as_likely(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(local.picks(5, F.lit("a"), F.col("id"), F.lit(6).cast("long"), F.lit(3).cast("long")).alias("p")).collect()
    assert all(len(set(r.p)) == 3 and set(r.p) <= set(range(6)) for r in rows)
    every = Counter(tuple(sorted(r.p)) for r in rows)
    assert len(every) == 20 and all(90 < n < 220 for n in every.values())


def test_conditional_diagnostics_match_arrays(spark):
    rng = np.random.default_rng(7)
    side, permutations = 6, 99
    n = side * side
    v, u = rng.normal(size=n), rng.normal(size=n)
    v[:9] += 3
    edges = grid_edges(side, side)
    values = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, u))], "k long, v double, u double")
    weights = spark.createDataFrame(edges, "src long, dst long")
    rows = local.conditional_diagnostics(values, "k", "v", weights, permutations, 11, "u").collect()
    assert len(rows) == 3 * n
    z, o = ((x - x.mean()) / x.std() for x in (v, u))
    near = {i: [b for a, b in edges if a == i] for i in range(n)}
    seen = {(i, f): s for i in range(n) for f, s in (("local_moran", z[i] * z[near[i]].mean()), ("bivariate_lisa", z[i] * o[near[i]].mean()), ("getis_ord_gi_star", (z[i] + z[near[i]].sum()) / np.sqrt((n * (len(near[i]) + 1) - (len(near[i]) + 1) ** 2) / (n - 1))))}
    for r in rows:
        assert abs(r.statistic - seen[r.k, r.family]) < 1e-9 and 1 / (permutations + 1) <= r.p_raw <= 1
    # areas far from chance are found, others mostly not
    draws = np.random.default_rng(1)
    for r in rows:
        if r.family == "local_moran" and r.k in (0, 7, 20, 33):
            d = len(near[r.k])
            many = np.array([z[r.k] * draws.choice(np.delete(z, r.k), d, replace=False).mean() for _ in range(4000)])
            p = (np.abs(many - many.mean()) >= abs(r.statistic - many.mean())).mean()
            assert abs(p - r.p_raw) < 4 * np.sqrt(max(p * (1 - p), 0.01) / permutations) + 0.02
    for f in local.FAMILIES:
        mine = [r for r in rows if r.family == f]
        assert np.allclose([r.p_adjusted for r in mine], benjamini_hochberg([r.p_raw for r in mine]))
    assert {r.family: (r.tests, r.raw) for r in local.surviving(local.conditional_diagnostics(values, "k", "v", weights, permutations, 11)).collect()}.keys() == {"local_moran", "getis_ord_gi_star"}


def test_conditional_draws_stay_in_their_tasks(spark):
    """Whole p-values by a plain loop over the same draws, with unknown values and long keys, and few rows moved: draws are 79 for each edge."""
    md5 = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    side, permutations, seed = 16, 79, 5
    names = [f"a{i}" + "x" * (60 * (i % 50 == 3)) for i in range(side * side)]
    v = {k: None if i % 7 == 2 else float(i * 37 % 101) for i, k in enumerate(names)}
    edges = [(names[a], names[b]) for a, b in grid_edges(side, side)]
    values, weights = spark.createDataFrame([*v.items()], "k string, v double"), spark.createDataFrame(edges, "src string, dst string")

    def moved():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = moved()
    rows = local.conditional_diagnostics(values, "k", "v", weights, permutations, seed).collect()
    assert moved() - before < 20 * len(edges)
    known = np.array([x for x in v.values() if x is not None])
    z = {k: None if x is None else (x - known.mean()) / known.std() for k, x in v.items()}
    order = sorted(names, key=lambda k: (md5(k)[:3], k))
    near = {k: [b for a, b in edges if a == k] for k in names}
    want, n = {}, len(names)
    for k in names:
        d, place, lags, sums = len(near[k]), order.index(k), [], []
        for r in range(permutations):
            chosen = []
            for slot in range(1, d + 1):
                t = int(md5(seed, k, r, slot)[:8], 16) % (n - 1 - d + slot)
                chosen.append(n - 1 - d + slot - 1 if t in chosen else t)
            got = [x for x in (z[order[t + (t >= place)]] for t in chosen) if x is not None]
            if got:
                lags.append(np.mean(got))
                sums.append(sum(got))
        seen = [z[b] for b in near[k] if z[b] is not None]
        scale = np.sqrt((n * (d + 1) - (d + 1) ** 2) / (n - 1))
        for f, one, many in (("local_moran", lambda x: z[k] * x, lags), ("getis_ord_gi_star", lambda x: (z[k] + x) / scale, sums)):
            if z[k] is None or not seen:
                want[k, f] = None
                continue
            a, b = one(np.mean(seen) if f == "local_moran" else sum(seen)), np.array([one(x) for x in many])
            c = b.sum() / permutations
            want[k, f] = (1 + int((np.abs(b - c) >= abs(a - c) - 1e-12).sum())) / (permutations + 1)
    assert {(r.k, r.family): r.p_raw for r in rows} == want and None in want.values()


def test_neighbourhood_of_all_has_no_gi_star(spark):
    values = spark.createDataFrame([(i, float(i * i)) for i in range(4)], "k long, v double")
    edges = spark.createDataFrame([(a, b) for a in range(4) for b in range(4) if a != b], "src long, dst long")
    rows = local.conditional_diagnostics(values, "k", "v", edges, 19, 1).collect()
    assert all((r.statistic is None and r.p_raw is None and r.label == "not_estimable") == (r.family == "getis_ord_gi_star") for r in rows)


def test_adjusted_by_ranges_is_adjusted(spark):
    rng = random.Random(1)
    rows = [(f"f{i % 3}", rng.choice([None, float("nan"), rng.random() ** 3, 0.04, 0.5])) for i in range(900)] + [("lone", None), ("one", 0.2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, p double")
    a = {r.i: r.q for r in agreement.adjusted(df, "p", ["f"], "q").collect()}
    b = {r.i: r.q for r in agreement.adjusted_by_ranges(df, "p", ["f"], "q", ranges=8).collect()}
    assert a.keys() == b.keys() and all((a[i] is None) == (b[i] is None) and (a[i] is None or abs(a[i] - b[i]) < 1e-12) for i in a)


def test_spatial_error_of_300_areas_against_whole_matrices(spark):
    rng = np.random.default_rng(4)
    n, edges = 300, grid_edges(20, 15)
    w = np.zeros((n, n))
    for a, b in edges:
        w[a, b] = 1
    w /= w.sum(1, keepdims=True)
    x = rng.normal(50, 3, (n, 2))
    y = 7 + x @ [0.8, -0.4] + np.linalg.solve(np.eye(n) - 0.6 * w, rng.normal(0, 1, n))
    df = spark.createDataFrame([(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "k long, y double, a double, b double")
    got = spatial_error.fit(df, "k", "y", ["a", "b"], spark.createDataFrame(edges, "src long, dst long"))
    want = dense_spatial_error(y, np.column_stack([np.ones(n), x]), w)
    assert abs(got.value - want["lambda"]) < 0.02 and got.converged
    assert np.allclose(got.beta[1:], want["beta"][1:], atol=0.01) and np.allclose(np.sqrt(np.diag(got.covariance)), want["se"], rtol=0.03)
    assert abs(got.log_likelihood - want["log_likelihood"]) < 2
    rows = {(r.model_id, r.term): r for r in spatial_error.sensitivity_table(spark, {"C1": got, "C2": None}, {"C1": {"C1": {"a": 1.0, "b": 1.0}, "C1-H": {"a": 1.0}}}).collect()}
    assert rows["C2", "not_applicable"].status == "not_run_no_escalation" and len(rows) == 6
    assert abs(rows["C1", "C1"].estimate - (got.beta[1] + got.beta[2])) < 1e-12 and rows["C1", "C1-H"].sensitivity in ("model-sensitive", "not_model_sensitive")


def test_log_determinant_from_exact_traces():
    edges = grid_edges(7, 6)
    n = 42
    b = np.zeros((n, n))
    for i, j in edges:
        b[i, j] = 1
    w = b / b.sum(1, keepdims=True)
    t, mu = np.linalg.eigvals(w).real, []
    for k in range(120):
        mu.append(np.cos(k * np.arccos(np.clip(t, -1, 1))).sum())
    for l in (-0.9, -0.3, 0.0, 0.5, 0.95):
        assert abs(spatial_error.log_determinant(np.array(mu), l) - np.linalg.slogdet(np.eye(n) - l * w)[1]) < 1e-8


@pytest.mark.parametrize("ols,spatial_,label", [(1.0, 1.2, "not_model_sensitive"), (1.0, 1.21, "model-sensitive"), (1.0, -1.0, "model-sensitive"), (0.0, 0.0, "not_model_sensitive"), (0.0, 0.1, "model-sensitive"), (-2.0, -1.7, "not_model_sensitive")])
def test_sensitivity_labels(ols, spatial_, label):
    assert spatial_error.sensitivity(ols, spatial_) == label


def test_replicates_are_drawn_once_for_all_ranks(spark, monkeypatch):
    from arealis.operators import local

    seen = []
    monkeypatch.setattr(local, "adjusted_by_ranges", lambda df, p, family: seen.append(df) or df.withColumn("p_adjusted", df[p]))
    values = spark.range(30).selectExpr("id", "cast(id * 7 % 11 AS double) AS v")
    ring = spark.range(30).selectExpr("id AS src", "(id + 1) % 30 AS dst")
    assert local.conditional_diagnostics(values, "id", "v", ring, 5, 3).count() == 60
    assert seen[0].inputFiles()  # a table, so that what reads it several times draws once
    assert "Generate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_traces_by_blocks_are_those_by_joins(spark):
    edges = spark.createDataFrame(grid_edges(5, 60), "src long, dst long")
    nodes = edges.select(F.col("src").alias("k")).distinct()
    by_joins = spatial_error.chebyshev_traces(nodes, "k", edges, 8, 5, copies=-1.0)
    by_blocks = spatial_error.chebyshev_traces(nodes, "k", edges, 8, 5, block=60)
    assert len(by_joins) == 11 and abs(by_joins - by_blocks).max() < 1e-9
    assert spatial_error._surrounded(nodes.select(F.col("k").alias("node"), F.col("k").alias("block")), edges, 5, 300.0) is None
