"""Agreement of two ratings, correlation with p-values, multiplicity, variance partition and separation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from .ranking import leave_one_out_mean, ranks_by_ranges


def crosstab(df: DataFrame, by: Sequence[str], a: str, b: str, levels: int = 4) -> DataFrame:
    """One row per group with a matrix of counts by level; all later measures need only this small aggregate."""
    cells = [F.count_if((F.col(a) == i) & (F.col(b) == j)) for i in range(1, levels + 1) for j in range(1, levels + 1)]
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.array(*cells).alias("cells"), F.count("*").alias("n"))


def _margin(levels: int, axis: int, k: int) -> Column:
    return sum((F.col("cells")[k * levels + m if axis == 0 else m * levels + k] for m in range(levels)), F.lit(0)).cast("double")


def weighted_kappa(table: DataFrame, levels: int = 4) -> Column:
    """With squared distances as weights; null if no disagreement is expected."""
    seen = sum((F.col("cells")[i * levels + j] * float((i - j) ** 2) for i in range(levels) for j in range(levels)), F.lit(0.0))
    expected = sum((_margin(levels, 0, i) * _margin(levels, 1, j) * float((i - j) ** 2) for i in range(levels) for j in range(levels)), F.lit(0.0))
    return F.lit(1.0) - F.try_divide(seen * F.col("n").cast("double"), expected)


def gwet_ac1(table: DataFrame, levels: int = 4) -> Column:
    n = F.col("n").cast("double")
    agree = sum((F.col("cells")[i * levels + i] for i in range(levels)), F.lit(0)).cast("double") / n
    share = [(_margin(levels, 0, i) + _margin(levels, 1, i)) / (2.0 * n) for i in range(levels)]
    chance = sum((p * (1.0 - p) for p in share), F.lit(0.0)) / float(levels - 1)
    return F.try_divide(agree - chance, 1.0 - chance)


def correlation(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """n, Pearson's r and Spearman's rho (Pearson's of average ranks) of rows that have both values."""
    rows = ranks_by_ranges(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y), {x: "_rx", y: "_ry"}, by)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t: the regularised incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _beta_fraction(1 - x, b, a) / b
    return front * _beta_fraction(x, a, b) / a


def _beta_fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def with_correlation_p(df: DataFrame, r: str, n: str, name: str = "p") -> DataFrame:
    """Adds p of a correlation r of n pairs to summary rows, one for each group."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        known = r.notna() & (n >= 3)
        return pd.Series([(0.0 if abs(a) >= 1 else t_two_sided(a * math.sqrt((b - 2) / (1 - a * a)), b - 2)) if k else None for a, b, k in zip(r, n, known)], dtype="float64")

    return df.withColumn(name, p(r, n))


def benjamini_hochberg(p: str, *family: str) -> Column:
    """Adjusted p-values within each family; nulls are left out and stay null."""
    known = Window.partitionBy(*family, F.col(p).isNull())
    last = F.rank().over(known.orderBy(p)) + F.count("*").over(Window.partitionBy(*family, p)) - 1
    return F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.count(p).over(known) / last))


def adjusted(df: DataFrame, p: str, family: Sequence[str], name: str = "p_adjusted") -> DataFrame:
    """df with Benjamini-Hochberg p-values: of each the least of n * p / rank among it and larger ones.

    What is null, NaN or infinite is no test: it isn't counted in its family and gets null.
    """
    out = df.withColumn("_p", finite(p))
    out = out.withColumn("_q", benjamini_hochberg("_p", *family))
    down = Window.partitionBy(*family, F.col("_p").isNull()).orderBy(F.desc("_p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn(name, F.when(F.col("_p").isNotNull(), F.min("_q").over(down))).drop("_q", "_p")


def adjusted_by_ranges(df: DataFrame, p: str, family: Sequence[str], name: str = "p_adjusted", ranges: int = 64) -> DataFrame:
    """What adjusted() gives, for families too large for one task.

    p-values are counted by family and value first, and families cut into ranges by quantile sketches that merge. A value's rank is
    a sum within its range and over the ranges before it; the least n * p / rank of larger values one within its range and over those behind it.
    df is read more than once, so it should be a table.
    """
    known = df.withColumn("_p", finite(p)).where(F.col("_p").isNotNull())
    counts = known.groupBy(*family, "_p").agg(F.count("*").alias("_n"))
    cuts = known.groupBy(*family).agg(F.percentile_approx("_p", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    counts = counts.join(cuts, list(family)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_p")))).drop("_cuts")
    group, part = Window.partitionBy(*family), Window.partitionBy(*family, "_range")
    totals = counts.groupBy(*family, "_range").agg(F.sum("_n").alias("_t"))
    before = F.coalesce(F.sum("_t").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*family, "_range", before.alias("_before"), F.sum("_t").over(group).alias("_all"))
    rank = F.sum("_n").over(part.orderBy("_p")) + F.col("_before")
    ranked = counts.join(totals, [*family, "_range"]).withColumn("_q", F.least(F.lit(1.0), F.col("_p") * F.col("_all") / rank))
    lowest = ranked.groupBy(*family, "_range").agg(F.min("_q").alias("_low"))
    behind = F.min("_low").over(group.orderBy("_range").rowsBetween(1, Window.unboundedFollowing))
    lowest = lowest.select(*family, "_range", behind.alias("_behind"))
    here = F.min("_q").over(part.orderBy(F.desc("_p")))
    done = ranked.join(lowest, [*family, "_range"]).select(*family, "_p", F.least(here, F.col("_behind")).alias(name))
    return df.withColumn("_p", finite(p)).join(done, [*family, "_p"], "left").drop("_p")


def variance_partition(df: DataFrame, by: Sequence[str], value: str, area: str) -> DataFrame:
    """One-way moments of unbalanced groups: n, areas, n_bar, between and within variance, the share of between.

    What isn't defined (one area, or no area with several units) is null.
    """
    groups = df.where(F.col(value).isNotNull() & F.col(area).isNotNull()).groupBy(*by, area).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), (F.var_pop(value) * F.count("*")).alias("_s"))
    every = Window.partitionBy(*by)  # of a row for each area
    groups = groups.withColumn("_d", F.col("_m") - F.sum(F.col("_n") * F.col("_m")).over(every) / F.sum("_n").over(every))
    sums = groups.groupBy(*by).agg(F.sum("_n").alias("n"), F.count("*").alias("areas"), F.sum("_s").alias("ssw"), F.sum(F.col("_n") * F.col("_d") * F.col("_d")).alias("ssb"), F.sum(F.col("_n") * F.col("_n")).alias("_nn"))
    n, k = F.col("n").cast("double"), F.col("areas").cast("double")
    n_bar = F.try_divide(n - F.col("_nn") / n, k - 1)
    within = F.try_divide(F.col("ssw"), n - k)
    raw = F.try_divide(F.try_divide(F.col("ssb"), k - 1) - within, n_bar)
    between = F.when(raw.isNotNull(), F.greatest(F.lit(0.0), raw))  # greatest() skips nulls
    return sums.select(*by, "n", "areas", n_bar.alias("n_bar"), within.alias("within"), between.alias("between"), F.try_divide(between, between + within).alias("vpc"))


def label_separation(df: DataFrame, by: Sequence[str], value: str, area: str, threshold: float = 0.75) -> DataFrame:
    """How well an area's mean, without the unit itself, tells units at or above the quantile from others (AUC).

    Areas of one unit are left out. By Mann-Whitney: ties count one half.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_loo", leave_one_out_mean(value, *by, area)).where("_loo IS NOT NULL")
    cut = rows.groupBy(*by).agg(F.percentile(value, F.lit(threshold)).alias("_cut"))
    rows = (rows.join(cut, list(by)) if by else rows.crossJoin(F.broadcast(cut))).withColumn("_high", F.col(value) >= F.col("_cut"))
    w, ties = Window.partitionBy(*by), Window.partitionBy(*by, "_loo")
    rows = rows.withColumn("_rank", F.rank().over(w.orderBy("_loo")) + (F.count("*").over(ties) - 1) / F.lit(2.0))
    out = rows.groupBy(*by).agg(F.count_if("_high").alias("high"), F.count_if(~F.col("_high")).alias("low"), F.sum(F.when(F.col("_high"), F.col("_rank"))).alias("_sum"))
    h = F.col("high").cast("double")
    return out.select(*by, "high", "low", F.try_divide(F.col("_sum") - h * (h + 1) / 2.0, h * F.col("low").cast("double")).alias("auc"))
