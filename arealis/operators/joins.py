"""Joins with stated cardinality, dense grids, semi and anti joins, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A join's keys are not as unique as its cardinality says."""


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", cardinality: str = "m:1") -> DataFrame:
    """A join whose cardinality is checked first by an aggregate over the keys of each side that must be unique.

    how is left, inner or full; cardinality 1:1, m:1, 1:m or m:m.
    """
    one_left, one_right = cardinality.split(":")
    for side, one, name in ((left, one_left, "left"), (right, one_right, "right")):
        if one == "1" and not repeated_keys(side, on).isEmpty():
            raise CardinalityError(f"the {name} side of a {cardinality} join repeats keys {list(on)}")
    return left.join(right, list(on), how)


def grid(*axes: DataFrame) -> DataFrame:
    """All combinations of small sets of key values (areas, periods, states)."""
    out = axes[0].distinct()
    for a in axes[1:]:
        out = out.crossJoin(F.broadcast(a.distinct()))
    return out


def densified(df: DataFrame, skeleton: DataFrame, key: Sequence[str], fill: dict[str, object] | None = None) -> DataFrame:
    """skeleton's rows with df's values; absent ones are filled as given, else null."""
    out = skeleton.join(df, list(key), "left")
    return out.fillna(fill) if fill else out


def reconciled(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """For each key of either side: both, left_only or right_only. Keys are compared null-safe and without repeats."""
    a = left.select(*key).distinct().withColumn("_l", F.lit(True))
    b = right.select(*[F.col(k).alias(f"_r_{k}") for k in key]).distinct().withColumn("_r", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key]
    both = a.join(b, on, "full")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return both.select(*[F.coalesce(k, f"_r_{k}").alias(k) for k in key], side.alias("side"))


def same_sets(left: DataFrame, right: DataFrame) -> bool:
    return left.distinct().exceptAll(right.distinct()).isEmpty() and right.distinct().exceptAll(left.distinct()).isEmpty()


def joined_outer(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """All rows of frames that each have the key once, side by side; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(key), "full")
    return out


def joined_by_other_name(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
    """A join on columns that are called otherwise on each side; both stay."""
    condition = None
    for a, b in on.items():
        term = left[a] == right[b]
        condition = term if condition is None else condition & term
    return left.join(right, condition, how)


def joined_with_suffixes(left: DataFrame, right: DataFrame, key: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """A left join, one row to one at most; columns that both sides have, but for the key, get a suffix."""
    shared = (set(left.columns) & set(right.columns)) - set(key)
    named = lambda df, s: df.select(*[F.col(c).alias(c + s if c in shared else c) for c in df.columns])
    return checked_join(named(left, suffixes[0]), named(right, suffixes[1]), list(key), "left", "1:1")
