"""Ranks, cut points and window transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, normal_quantile


def percentile_rank(value: str, *by: str) -> Column:
    """Average rank of ties over the group's count, in (0, 1]. Nulls are neither ranked nor counted.

    percent_rank() and cume_dist() treat ties otherwise.
    """
    group = Window.partitionBy(*by, F.col(value).isNull())
    ties = Window.partitionBy(*by, value)
    rank = F.rank().over(group.orderBy(value)) + (F.count("*").over(ties) - 1) / F.lit(2.0)
    return F.when(F.col(value).isNotNull(), rank / F.count("*").over(group))


def cut_points(df: DataFrame, value: str, by: Sequence[str] = (), at: Sequence[float] = (0.25, 0.5, 0.75), name: str = "cuts") -> DataFrame:
    """Linear quantiles of each group as an array; groups with fewer than two different cuts get none."""
    cuts = F.percentile(value, F.array(*[F.lit(float(q)) for q in at]))
    return df.groupBy(*by).agg(cuts.alias(name)).where(F.size(F.array_distinct(name)) == len(at))


def differences(df: DataFrame, value: str, by: Sequence[str], order: str, name: str = "difference") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


def disruptions(df: DataFrame, value: str, by: Sequence[str], order: str, watched: Column, least: float, times: float = 2.0) -> DataFrame:
    """Adds difference, typical (median absolute difference of the group) and status.

    A watched row is a candidate if its absolute difference exceeds both least and times the typical one.
    """
    out = differences(df, value, by, order)
    out = out.withColumn("typical", F.median(F.abs("difference")).over(Window.partitionBy(*by)))
    size = F.abs("difference")
    status = F.when(F.col("difference").isNull(), "no_earlier").when(~watched, "not_watched").when((size > least) & (size > times * F.col("typical")), "candidate").otherwise("steady")
    return out.withColumn("status", status)


def leave_one_out_mean(value: str, *by: str) -> Column:
    """The mean of the group's other rows; null if there are none."""
    w = Window.partitionBy(*by)
    return F.try_divide(F.sum(value).over(w) - F.col(value), (F.count(value).over(w) - 1).cast("double"))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row of each key that comes first in this order (descending, nulls last)."""
    w = Window.partitionBy(*key).orderBy(*[col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_known(value: str, order: str) -> Column:
    """Aggregate: the first value that is not null, in this order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Numbers rows from 1 in order and deals them to batches of size.

    The order is global: rows are counted in each range of the leading key first, so no single task sorts all.
    """
    lead = order[0]
    counts = df.groupBy(lead).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy(lead).rowsBetween(Window.unboundedPreceding, -1)))
    rows = df.join(before.select(F.col(lead).alias("_lead"), F.coalesce("_before", F.lit(0)).alias("_before")), F.col(lead).eqNullSafe(F.col("_lead")))
    number = F.row_number().over(Window.partitionBy(lead).orderBy(*order[1:] or [F.lit(0)])) + F.col("_before")
    return rows.withColumn("row_number", number).withColumn("batch", F.ceil(F.col("row_number") / F.lit(float(size))).cast("long")).drop("_lead", "_before")


def normal_scores(value: str, *by: str) -> Column:
    """The normal quantile expected at each value's place in its group, (i - 0.5) / n."""
    w = Window.partitionBy(*by, F.col(value).isNull())
    place = (F.row_number().over(w.orderBy(value)) - 0.5) / F.count("*").over(w)
    return F.when(F.col(value).isNotNull(), normal_quantile(place))


def average_ranks(df: DataFrame, value: str, by: Sequence[str], name: str = "r", ranges: int = 64) -> DataFrame:
    """df with percentile_rank() of value, for groups too large for one task.

    Rows are counted by group and value first. Approximate quantiles, whose sketches merge, cut each group into ranges; ranks
    within a range follow from a sum over its values, and those before it from a sum over the group's ranges. Equal
    values fall into one range, so the cuts decide on balance only. Nulls get null.
    """
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count("*").alias("_n"))
    cuts = known.groupBy(*by).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    counts = counts.join(cuts, list(by)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_t"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_t").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*by, "_range", before.alias("_before"), F.sum("_t").over(group).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy(value)) + F.col("_before")
    ranks = counts.join(totals, [*by, "_range"]).select(*by, value, ((upto - (F.col("_n") - 1) / F.lit(2.0)) / F.col("_all")).alias(name))
    return df.join(ranks, [*by, value], "left")


def ranks_by_ranges(df: DataFrame, names: dict[str, str], by: Sequence[str], ranges: int = 64) -> DataFrame:
    """average_ranks() of several columns in one pass: names gives the name of each column's rank.

    df is read more than once, so it should be a table. Groups of any size: no task sorts more than a range of one.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in names])
    known = df.select(*by, F.inline(pairs)).where("_v IS NOT NULL")
    key = [*by, "_c"]
    counts = known.groupBy(*key, "_v").agg(F.count("*").alias("_n"))
    cuts = known.groupBy(*key).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    counts = counts.join(cuts, key).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    totals = counts.groupBy(*key, "_range").agg(F.sum("_n").alias("_t"))
    group = Window.partitionBy(*key)  # of a row for each range
    before = F.coalesce(F.sum("_t").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*key, "_range", before.alias("_before"), F.sum("_t").over(group).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(*key, "_range").orderBy("_v")) + F.col("_before")
    ranks = counts.join(totals, [*key, "_range"]).select(*key, "_v", ((upto - (F.col("_n") - 1) / F.lit(2.0)) / F.col("_all")).alias("_r"))
    out = df
    for c, name in names.items():
        mine = ranks.where(F.col("_c") == c).select(*[F.col(b).alias(f"_by_{b}") for b in by], "_v", F.col("_r").alias(name))
        same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by] + [F.col(c).cast("double") == F.col("_v")]
        out = out.join(mine, same, "left").drop("_v", *[f"_by_{b}" for b in by])
    return out


def by_mapped_rank(order: dict[str, int], c: str, last: int = 1_000_000) -> Column:
    """The place of a label in a stated order; unknown labels come last."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col(c)), F.lit(last))


def bin_indicators(value: str, cuts: Sequence[float], prefix: str = "bin") -> list[Column]:
    """0 or 1 for each bin above the first; a bound belongs to the bin below it, null gives null."""
    at = sum(((F.col(value) > c).cast("int") for c in cuts), F.lit(0))
    return [(at == k).cast("int").alias(f"{prefix}_{k}") for k in range(1, len(cuts) + 1)]
