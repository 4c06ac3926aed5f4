"""Cohorts and pooled measures of small areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, joined_sorted


def shape_summary(df: DataFrame, by: Sequence[str], unit: str, period: str, suppressed: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct(unit).alias("units"), F.countDistinct(period).alias("periods"), F.count_if(suppressed).alias("suppressed"))


def cascade(df: DataFrame, by: Sequence[str], unit: str, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows and distinct units that are left after each step; a null in a condition fails it. Long format, one scan."""
    held, aggs = F.lit(True), []
    for name, condition in steps:
        held = held & F.coalesce(condition, F.lit(False))
        aggs += [F.count_if(held).alias(f"{name}_rows"), F.countDistinct(F.when(held, F.col(unit))).alias(f"{name}_units")]
    wide = df.groupBy(*by).agg(*aggs)
    step = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("name"), F.col(f"{n}_rows").alias("rows"), F.col(f"{n}_units").alias("units")) for i, (n, _) in enumerate(steps)])
    return wide.select(*by, F.inline(step))


def ratio_of_sums(df: DataFrame, by: Sequence[str], numerator: str, denominator: str, period: str, periods: Sequence, least: int = 1, scale: float = 100.0, also: Sequence[Column] = ()) -> DataFrame:
    """scale * sum(numerator) / sum(denominator) over rows with a denominator of at least least, of groups that have every period; also: further aggregates of the same rows."""
    rows = df.where(F.col(period).isin(*periods) & F.col(numerator).isNotNull() & (F.col(denominator) >= least))
    out = rows.groupBy(*by).agg(F.countDistinct(period).alias("periods"), F.sum(numerator).alias("numerator"), F.sum(denominator).alias("denominator"), *also)
    return out.where(F.col("periods") == len(set(periods))).withColumn("pooled", F.try_divide(F.col("numerator") * scale, F.col("denominator").cast("double")))


def with_exact_members(df: DataFrame, by: Sequence[str], member: str, wanted: Sequence[str], same: str | None = None, flags: Column | None = None) -> DataFrame:
    """Groups whose members are exactly wanted, each once, with one value of same and all flags true; a null flag fails."""
    out = df.groupBy(*by).agg(F.array_sort(F.collect_set(member)).alias("_m"), F.count("*").alias("_n"), F.countDistinct(same).alias("_s") if same else F.lit(1).alias("_s"), F.bool_and(F.coalesce(flags, F.lit(False)) if flags is not None else F.lit(True)).alias("_f"))
    good = (F.col("_m") == F.array(*[F.lit(x) for x in sorted(wanted)])) & (F.col("_n") == len(wanted)) & (F.col("_s") == 1) & F.col("_f")
    return out.where(good).select(*by)


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate over rows that have both."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.try_divide(F.sum(F.when(both, F.col(value) * F.col(weight))), F.sum(F.when(both, F.col(weight))))


def quality_profile(df: DataFrame, by: Sequence[str], value: str, unit: str, suppressed: Column, missing: Column) -> DataFrame:
    """Median, quartiles, shares of missing and suppressed rows and the units concerned."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        quartiles.alias("_q"),
        (F.count_if(missing) * 100.0 / F.count("*")).alias("missing_pct"),
        (F.count_if(suppressed) * 100.0 / F.count("*")).alias("suppressed_pct"),
        joined_sorted(F.when(suppressed, F.col(unit))).alias("suppressed_units"),
    )
    return out.select(*by, "rows", F.col("_q")[1].alias("median"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), "missing_pct", "suppressed_pct", "suppressed_units")


def dominant_link(df: DataFrame, unit: str, area: str, weight: str) -> DataFrame:
    """Links of a unit to several areas as one row: the heaviest area (then the smallest), all areas in order, a map of weights."""
    pair = F.struct((-F.col(weight)).alias("w"), F.col(area).alias("a"))
    out = df.groupBy(unit).agg(F.min_by(area, pair).alias("dominant"), F.max(weight).alias("top_weight"), F.count("*").alias("areas"), F.array_sort(F.collect_list(F.struct(F.col(area).alias("area"), F.col(weight).alias("weight")))).alias("_l"))
    return out.select(unit, "dominant", "top_weight", "areas", (F.col("areas") > 1).alias("crossing"), F.array_join(F.transform("_l", lambda x: x["area"].cast("string")), ";").alias("area_list"), F.map_from_entries("_l").alias("weights"))


def single_valued(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups in which one of the columns has several values, with the count of each."""
    out = df.groupBy(*by).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])
    return out.where(" OR ".join(f"n_{c} > 1" for c in columns))


def transitions(df: DataFrame, by: Sequence[str], before: str, after: str, states: Sequence[int]) -> DataFrame:
    """Counts of every pair of states in each group, zeros included, and their percentage of the group."""
    key = F.struct(F.col(before).cast("int").alias("a"), F.col(after).cast("int").alias("b"))
    counts = df.groupBy(*by, key.alias("_k")).agg(F.count("*").alias("_n"))
    known = F.filter(F.collect_list(F.struct("_k", "_n")), lambda x: x["_k"]["a"].isNotNull() & x["_k"]["b"].isNotNull())
    groups = counts.groupBy(*by).agg(known.alias("_l"), F.sum("_n").alias("_total"))  # a list of states x states at most
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in states for b in states])
    rows = groups.select(*by, "_total", F.map_from_entries("_l").alias("_m"), F.explode(pairs).alias("_k")).withColumn("n", F.coalesce(F.col("_m")[F.col("_k")], F.lit(0)))
    return rows.select(*by, F.col("_k.a").alias(before), F.col("_k.b").alias(after), "n", (F.col("n") * 100.0 / F.col("_total")).alias("pct"))


def flag_jaccard(a: Column, b: Column) -> Column:
    """Aggregate: shared over united flags of a group; 1 if neither is ever set."""
    united = F.count_if(F.coalesce(a | b, F.lit(False)))
    return F.when(united == 0, F.lit(1.0)).otherwise(F.count_if(F.coalesce(a & b, F.lit(False))) / united.cast("double"))


def persistent_state(df: DataFrame, by: Sequence[str], state: str, least: int = 2, unstable: str = "unstable") -> DataFrame:
    """The state that a group shows least times or more (the most frequent, then the smallest), else unstable."""
    counts = df.groupBy(*by, state).agg(F.count("*").alias("_n"))
    top = counts.groupBy(*by).agg(F.max("_n").alias("times"), F.min_by(state, F.struct((-F.col("_n")).alias("n"), F.col(state).alias("s"))).alias("_s"))
    return top.select(*by, F.when(F.col("times") >= least, F.col("_s").cast("string")).otherwise(unstable).alias("persistence"), "times")


def condition_frame(df: DataFrame, condition: str, periods: Sequence[int], value: str, suppressed: Column, keep: Column) -> DataFrame:
    """Rows of one condition and these periods with a finite value, not suppressed (null counts as suppressed), that keep holds for."""
    known = finite(value).isNotNull()
    return df.where((F.col("condition") == condition) & F.col("period").isin(*periods) & known & ~F.coalesce(suppressed, F.lit(True)) & F.coalesce(keep, F.lit(False)))


def pooled_comparison(df: DataFrame, by: Sequence[str], value: str, other: str, period: str, periods: Sequence[int]) -> DataFrame:
    """Means of value and other over groups with every period and both values in each, their signed and absolute difference."""
    rows = df.where(F.col(period).isin(*periods) & F.col(value).isNotNull() & F.col(other).isNotNull())
    out = rows.groupBy(*by).agg(F.countDistinct(period).alias("_p"), F.avg(value).alias("value"), F.avg(other).alias("other"))
    return out.where(F.col("_p") == len(set(periods))).drop("_p").withColumns({"difference": F.col("value") - F.col("other"), "distance": F.abs(F.col("value") - F.col("other"))})


def availability(df: DataFrame, by: Sequence[str], period: str, available: Column, suppressed: Column, value: str) -> DataFrame:
    """Of each group's periods: how many, and over them mean and median of the shares of available and suppressed rows and of the annual means."""
    share = lambda c: F.count_if(F.coalesce(c, F.lit(False))) * 100.0 / F.count("*")
    years = df.groupBy(*by, period).agg(share(available).alias("_a"), share(suppressed).alias("_s"), F.avg(value).alias("_v"))
    return years.groupBy(*by).agg(F.count("*").alias("periods"), F.avg("_a").alias("available_mean"), F.median("_a").alias("available_median"), F.avg("_s").alias("suppressed_mean"), F.median("_s").alias("suppressed_median"), F.avg("_v").alias("value_mean"))


def collapsed(df: DataFrame, by: Sequence[str], first: Sequence[tuple[str, str]], any_of: Sequence[tuple[str, Column]], most: Sequence[str]) -> DataFrame:
    """One row a group: columns first by an order (column, order), whether any row matches, largest finite values."""
    aggs = [F.min_by(c, o).alias(c) for c, o in first] + [F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in any_of] + [F.max(finite(c)).alias(f"max_{c}") for c in most]
    return df.groupBy(*by).agg(*aggs)


def allocated(counts: DataFrame, weights: DataFrame, unit: str, area: str, weight: str, values: Sequence[str], replicates: Sequence[str] = ()) -> DataFrame:
    """Counts of units shared out to areas by weight: (area, values, replicates), sums of each value times the unit's share.

    weights has rows of (unit, area, weight), blocks say, any number for each; a unit's share in an area is its weight there over all its
    weight, the same for every value and replicate. replicates are arrays of one length. Ratios are to be taken of the sums. Units without
    weight are left out, null values count as nothing.
    """
    parts = weights.groupBy(unit, area).agg(F.sum(F.col(weight).cast("double")).alias("_w"))
    total = weights.groupBy(unit).agg(F.sum(F.col(weight).cast("double")).alias("_all"))
    rows = parts.join(total, unit).join(counts, unit).withColumn("_s", F.try_divide("_w", "_all")).where("_s IS NOT NULL")
    out = rows.groupBy(area).agg(*[F.sum(F.col(v) * F.col("_s")).alias(v) for v in values])
    for name in replicates:
        each = rows.select(area, F.posexplode(F.transform(name, lambda x: x * F.col("_s"))).alias("_k", "_x")).groupBy(area, "_k").agg(F.sum("_x").alias("_x"))
        each = each.groupBy(area).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_x"))), lambda r: r["_x"]).alias(name))
        out = out.join(each, area, "left")
    return out


def replicate_error(estimate: Column, replicates: Column, factor: float = 4.0) -> Column:
    """Standard error from replicates by successive differences: the root of factor times their mean squared distance."""
    squares = F.aggregate(replicates, F.lit(0.0), lambda s, x: s + (x - estimate) * (x - estimate))
    return F.sqrt(F.lit(factor) * F.try_divide(squares, F.size(replicates)))


def spread_or_null(df: DataFrame, by: Sequence[str], value: str, least: int = 70) -> DataFrame:
    """(by, n, iqr) of known values; the range is null in groups of fewer than least."""
    rows = df.where(finite(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_p"))
    return rows.select(*by, "n", F.when(F.col("n") >= least, F.col("_p")[1] - F.col("_p")[0]).alias("iqr"))


def evidence(frames: Sequence[DataFrame], key: str, metrics: Sequence[str]) -> DataFrame:
    """(key, metric, value) of several summaries that each have the key once; values that no summary has are left out."""
    long = lambda f: F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in f.columns if m in metrics]))
    out = None
    for f in frames:
        rows = f.select(key, long(f)).where("value IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def metadata_collapse(df: DataFrame, by: Sequence[str], same: Sequence[str], mean: str, least: str, flag: str) -> DataFrame:
    """One row for each group: columns of one value, a mean, the least weight, and whether any row's flag holds, where an unknown flag counts as holding.

    conflicts names those of the columns that have several values; they are null then.
    """
    one = lambda c: F.count_distinct(c) <= 1
    conflicts = F.array_compact(F.array(*[F.when(~one(c), F.lit(c)) for c in same]))
    return df.groupBy(*by).agg(*[F.when(one(c), F.max(c)).alias(c) for c in same], F.avg(mean).alias(mean), F.min(least).alias(least), F.bool_or(F.coalesce(F.col(flag), F.lit(True))).alias(flag), conflicts.alias("conflicts"))
