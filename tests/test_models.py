import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.operators import linear, models


def plain(y, x, w=None):
    """(coefficients, HC3 covariance) by whole matrices."""
    x = np.column_stack([np.ones(len(y)), x])
    w = np.ones(len(y)) if w is None else w
    bread = np.linalg.inv(x.T @ (x * w[:, None]))
    beta = bread @ x.T @ (w * y)
    h = w * np.einsum("ij,jk,ik->i", x, bread, x)
    u = w * (y - x @ beta) / (1 - h)
    return beta, bread @ (x.T @ (x * (u * u)[:, None])) @ bread


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(4):
        n = 60 + 10 * g
        x = rng.normal([10**g, -5, 0.01], [1, 3, 0.002], (n, 3))
        y = x @ [0.5, -1.0, 90.0] + g + rng.normal(0, 1 + np.abs(x[:, 1]), n)
        rows += [(f"g{g}", i % 5, float(y[i]), *map(float, x[i]), float(rng.integers(1, 6))) for i in range(n)]
    rows += [("g0", 0, float("nan"), 1.0, 1.0, 1.0, 1.0), ("g1", 1, None, 1.0, 1.0, 1.0, 1.0), ("g1", 1, 5.0, float("inf"), 1.0, 1.0, 1.0), ("few", 0, 1.0, 2.0, 3.0, 4.0, 1.0)]
    rows += [("twin", i % 2, float(i), float(i % 7), 2.0 * (i % 7), 1.0 * i, 1.0) for i in range(30)]
    return spark.createDataFrame(rows, "g string, part int, y double, a double, b double, c double, w double"), rows


def good(rows, g):
    r = np.array([r[2:] for r in rows if r[0] == g and None not in r and np.isfinite(r[2:]).all()], float)
    return r[:, 0], r[:, 1:4], r[:, 4]


@pytest.mark.parametrize("weight", [None, "w"])
def test_grouped_robust_fits_match_whole_matrices(frame, weight):
    df, rows = frame
    got = {r.g: r for r in models.robust_fits(df, ["g"], "y", ["a", "b", "c"], weight).collect()}
    assert not got["few"].rank_ok and not got["twin"].rank_ok and got["twin"].beta is None and got["twin"].covariance is None
    for g in ("g0", "g1", "g2", "g3"):
        y, x, w = good(rows, g)
        beta, covariance = plain(y, x, w if weight else None)
        assert got[g].n == len(y) and np.allclose(got[g].beta, beta, rtol=1e-6) and np.allclose(got[g].covariance, covariance.ravel(), rtol=1e-5, atol=1e-9)


def test_contrasts_at_two_levels(frame):
    df, rows = frame
    fitted = models.robust_fits(df.where("g = 'g1'"), ["g"], "y", ["a", "b", "c"])
    beta, covariance = plain(*good(rows, "g1")[:2])
    c = np.array([0, 1, 1, 0])
    for level, z in ((0.95, 1.959963984540054), (0.975, 2.241402727604947)):
        r = models.contrasts(fitted, ["g"], ["a", "b", "c"], {"sum": {"a": 1.0, "b": 1.0}}, level).first()
        assert abs(r.estimate - c @ beta) < 1e-8 and abs(r.se - np.sqrt(c @ covariance @ c)) < 1e-8 and abs(r.hi - (r.estimate + z * r.se)) < 1e-9


def test_fits_without_parts(frame):
    df, rows = frame
    got = {(r.g, r.part): r for r in models.without_parts(df, ["g"], "part", "y", ["a", "b", "c"]).collect()}
    for g in ("g0", "g2", "g3"):
        for part in range(5):
            y, x, _ = good([r for r in rows if r[1] != part], g)
            assert got[g, part].n == len(y) and np.allclose(got[g, part].beta, plain(y, x)[0], rtol=1e-6)
    assert not got["few", 0].rank_ok and got["few", 0].n == 0


def test_variants_in_one_job(frame):
    df, rows = frame
    many = models.with_variants(df.where("g = 'g3'"), {"all": None, "without_last": F.col("part") < 4, "heavy": F.col("w") > 2})
    got = {r.variant: r for r in models.fits(many, ["variant"], "y", ["a", "b", "c"]).collect()}
    for name, keep in (("all", lambda r: True), ("without_last", lambda r: r[1] < 4), ("heavy", lambda r: r[6] > 2)):
        y, x, _ = good([r for r in rows if keep(r)], "g3")
        assert got[name].n == len(y) and np.allclose(got[name].beta, plain(y, x)[0], rtol=1e-6)


def test_far_from_zero_slopes_keep_their_digits(spark):
    rng = np.random.default_rng(1)
    x = 1e8 + rng.normal(0, 1, 1000)
    y = 3 * (x - 1e8) + rng.normal(0, 0.01, 1000)
    df = spark.createDataFrame([("g", i % 4, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, part int, x double, y double")
    want = np.polyfit(x - 1e8, y, 1)[0]
    assert abs(linear.slopes(df, ["g"], "y", "x").first().slope - want) < 1e-6
    assert abs(models.fits(df, ["g"], "y", ["x"]).first().beta[1] - want) < 1e-6
    for r in linear.leave_one_out_slopes(df, ["g"], "part", "y", "x").collect():
        keep = np.arange(1000) % 4 != r.part
        assert r.n == 750 and abs(r.slope - np.polyfit(x[keep] - 1e8, y[keep], 1)[0]) < 1e-6
    assert abs(linear.least_squares(df, "y", ["x"]).beta[1] - want) < 1e-6
    e = linear.residuals(df, ["g"], "y", "x").agg(F.max(F.abs("residual"))).first()[0]
    assert e < 0.1


def test_ranks_within_replicates_match_the_window(spark):
    from arealis.operators import resample

    rng = np.random.default_rng(2)
    rows = [(int(r), f"g{g}", float(rng.integers(0, 40)) / 7, int(rng.integers(1, 4))) for r in range(6) for g in range(2) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, replicate int, g string, v double, times long")
    got = {r.i: r.x for r in resample.replicated_ranks(df, "v", "times", ["g"], "x", ranges=8).collect()}
    want = {r.i: r.x for r in df.withColumn("x", resample.weighted_percentile_rank("v", "times", "replicate", "g")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_gaps_of_ranks_in_draws_need_no_row_for_a_draw(spark):
    from arealis.operators import resample

    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([1, 2, 3, 5, 8, None]), rng.choice([None, float(rng.randrange(20)), float(rng.randrange(400))]), float(rng.randrange(30))) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, area int, v double, w double").localCheckpoint()
    key = ("replicate", "g")
    every = resample.bootstrap_rows(df, "area", 30, 5)
    gap = F.abs(resample.weighted_percentile_rank("v", "times", *key) - resample.weighted_percentile_rank("w", "times", *key))
    want = {(r.g, r.replicate): r.gap for r in every.withColumn("gap", gap).groupBy(*key).agg((F.sum(F.col("gap") * F.col("times")) / F.sum("times")).alias("gap")).collect()}
    got = {(r.g, r.replicate): r.gap for r in resample.rank_gap_draws(df, ["g"], "area", "v", "w", 30, 5, ranges=7).collect()}
    assert len(got) == 60 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_scales_in_draws_need_no_row_for_a_draw(spark):
    from arealis.operators import resample

    rng = random.Random(9)
    rows = [(g, area, float(rng.randrange(60)), float(area % 4 + (g == "b"))) for g in "ab" for area in range(7) for _ in range(rng.randrange(1, 90))]
    df = spark.createDataFrame(rows, "g string, area int, v double, wide double").localCheckpoint()
    draws = resample.cluster_draws(df, "area", 25, 3)
    fine = resample.replicated_ranks(df.join(draws, "area"), "v", "times", ["g"], "_fine")
    coarse = resample.replicated_ranks(df.select("g", "area", "wide").distinct().join(draws, "area"), "wide", "times", ["g"], "_coarse").select("replicate", "g", "area", "_coarse")
    found = resample.scale_metrics(fine.join(coarse, ["replicate", "g", "area"]), ["replicate", "g"], "_fine", "_coarse", F.col("times"))
    long = found.select("g", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in resample.SCALE_METRICS])))
    want = {(r.g, r.metric): r for r in resample.percentile_interval(long, ["g", "metric"], "v").collect()}
    got = {(r.g, r.metric): r for r in resample.cross_scale_bootstrap(df, ["g"], "area", "v", "wide", 25, 3, ranges=5).collect()}
    assert len(got) == 8 and got.keys() == want.keys()
    assert all(got[k].estimable == want[k].estimable and abs(got[k].lo - want[k].lo) < 1e-9 and abs(got[k].hi - want[k].hi) < 1e-9 for k in want)
