"""Local statistics of a map with conditional permutations: local Moran, Gi* and bivariate LISA.

A permutation leaves an area's value in place and draws its neighbours from all others without replacement. Draws are hashes of
(area, replicate, slot) made into different places by Floyd's method, so each area draws as many as it has neighbours;
the values at those places are looked up in the task that draws. It holds two scores for each area of the map, and a lost one makes its own draws again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written
from .agreement import adjusted_by_ranges
from .resample import draw, draws


def numbered(df: DataFrame, key: str, name: str = "place") -> DataFrame:
    """df with a number from 0 for each row of a unique key, in order of the key's hash prefix, then the key.

    Rows are ordered within 4,096 parts; only the parts' sizes are summed up in one place.
    """
    part = F.substring(F.md5(F.col(key).cast("string")), 1, 3)
    rows = df.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return rows.withColumn("_at", within).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def standardised(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, *columns) as z-scores of the whole population, by one row of means and deviations; constant columns become null."""
    sums = df.agg(F.count("*").alias("_count"), *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) for c in columns]
    return df.join(F.broadcast(sums)).select(key, "_count", *z)


def picks(seed: int, area: Column, replicate: Column, others: Column, many: Column) -> Column:
    """many different places out of others (0 to others - 1), each set of them as likely as any other."""

    # each draw is made once; the slot's last place is what Floyd's method takes instead of one that is taken
    drawn = F.transform(F.sequence(F.lit(1).cast("long"), many), lambda slot: draw(seed, area, replicate, slot) % (others - many + slot))
    none = F.expr("CAST(array() AS array<bigint>)")
    return F.aggregate(drawn, none, lambda chosen, t: F.concat(chosen, F.array(F.when(F.array_contains(chosen, t), others - many + F.size(chosen)).otherwise(t))))


def picked(seed: int, areas: Sequence[str], replicates: range, others: int, many: int) -> np.ndarray:
    """picks() of all these areas and replicates: an array of areas by replicates by many."""
    chosen = draws(seed, areas, replicates, many) % np.arange(others - many + 1, others + 1)
    for k in range(1, many):  # the slot's last place is what Floyd's method takes instead of one that is taken
        taken = (chosen[..., :k] == chosen[..., k : k + 1]).any(-1)
        chosen[..., k][taken] = others - many + k
    return chosen


#: Places in a row of scores, and draws made at once, about.
PLACES, AT_ONCE = 1 << 13, 1 << 16


def _packed(rows: pa.Table) -> pa.Table:
    """One row of a block of places: values and whether they are known, of z and o by turns; a place without an area is not known."""
    block = rows["block"][0].as_py()
    at = rows["place"].to_numpy() - block * PLACES
    values, known = np.zeros((PLACES, 2)), np.zeros((PLACES, 2), bool)
    for k, c in enumerate(("z", "o")):
        values[at, k], known[at, k] = rows[c].fill_null(0.0).to_numpy(), rows[c].is_valid().to_numpy()
    return pa.table({"block": pa.array([block], pa.int64()), "values": pa.array([values.tobytes()], pa.binary()), "known": pa.array([known.tobytes()], pa.binary())})


def _extremes(rows: pa.Table, scores: pa.Table, seed: int, permutations: int) -> np.ndarray:
    """How many replicates are at least as far from their mean as the statistic is, by area and family; what is undefined is any number."""
    order = scores["block"].to_numpy().argsort()
    values, known = (np.concatenate([np.frombuffer(scores[c][i].as_buffer(), kind).reshape(-1, 2) for i in order.tolist()]) for c, kind in (("values", float), ("known", bool)))
    z, lag, s, olag, n, d, place = (rows[c].to_numpy() for c in ("z", "lag", "s", "olag", "n", "d", "place"))
    names, whole, out = rows["text"].to_pylist(), bool(known.all()), np.zeros((len(z), len(FAMILIES)), np.int64)
    if (d >= n).any():
        raise ValueError(f"area {names[int((d >= n).argmax())]} has more neighbours than there are other areas")
    for many in np.unique(d).tolist():
        same = np.flatnonzero(d == many)
        for f in range(0, len(same), step := max(1, AT_ONCE // (permutations * many))):
            i = same[f : f + step]
            sums, found = np.zeros((len(i), permutations, 2)), np.full((len(i), permutations, 2), many)
            for r in range(0, permutations, some := max(1, AT_ONCE // (len(i) * many))):
                at = picked(seed, [names[k] for k in i.tolist()], range(r, min(r + some, permutations)), int(n[i[0]]) - 1, many)
                at += at >= place[i, None, None]
                sums[:, r : r + some] = values[at].sum(2)
                if not whole:
                    found[:, r : r + some] = known[at].sum(2)
            mean, m = sums / found, many + 1.0
            scale = np.sqrt((n[i] * m - m * m) / (n[i] - 1))
            own = z[i, None]
            kinds = ((z[i] * lag[i], own * mean[..., 0], 0), ((z[i] + s[i]) / scale, (own + sums[..., 0]) / scale[:, None], 0), (z[i] * olag[i], own * mean[..., 1], 1))
            for k, (seen, drawn, c) in enumerate(kinds):
                counts = found[..., c] > 0  # a replicate of unknown values only has no statistic
                center = np.where(counts, drawn, 0.0).sum(1) / permutations
                far = np.abs(drawn - center[:, None])
                out[i, k] = (counts & ((far >= np.abs(seen - center)[:, None] - 1e-12) | np.isnan(far))).sum(1)
    return out


FAMILIES = ("local_moran", "getis_ord_gi_star", "bivariate_lisa")


def conditional_diagnostics(values: DataFrame, key: str, value: str, weights: DataFrame, permutations: int, seed: int, other: str | None = None) -> DataFrame:
    """(key, family, statistic, p_raw, p_adjusted, label) for each area with a neighbour, Benjamini-Hochberg within each family.

    weights (src, dst) are neighbours of equal weight. p_raw counts replicates at least as far from their own mean as
    the statistic is, plus one, over replicates plus one. Gi* takes the area and its neighbours alike; where these are all areas it
    has no value. Without other there is no bivariate family. A replicate's draws serve all families.
    """
    columns = [value, *([other] if other else [])]
    z = standardised(values.select(key, *columns), key, columns)
    z = z.select(F.col(key).alias("src"), F.col("_count").cast("long").alias("n"), F.col(value).alias("z"), (F.col(other) if other else F.lit(None).cast("double")).alias("o"))
    z = written(numbered(z, "src"), "scores")
    near = weights.select("src", "dst").join(z.select(F.col("src").alias("dst"), F.col("z").alias("_z"), F.col("o").alias("_o")), "dst")
    lags = near.groupBy("src").agg(F.count("*").alias("d"), F.avg("_z").alias("lag"), F.sum("_z").alias("s"), F.avg("_o").alias("olag"))
    # Draws outnumber areas by far and fall on any place, so they stay in the task that makes them, and the scores of all places are sent
    # there: 18 bytes for each area. Parts are as many as cores ask for, whatever the number of areas, so what is moved grows with it.
    parts = 3 * values.sparkSession.sparkContext.defaultParallelism
    focal = z.join(lags, "src").withColumns({"text": F.col("src").cast("string"), "part": F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int")})
    blocks = z.select(F.floor(F.col("place") / PLACES).alias("block"), "place", "z", "o").groupBy("block").applyInArrow(_packed, "block long, values binary, known binary")
    each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    plain = ["src", "n", "d", "z", "lag", "s", "olag"]

    def tested(rows: pa.Table, scores: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            found = _extremes(rows, scores, seed, permutations) if rows.num_rows else np.zeros((0, len(FAMILIES)), np.int64)
        out = rows.select(plain)
        for k, f in enumerate(FAMILIES):
            out = out.append_column(f, pa.array(found[:, k]))
        return out

    shape = ", ".join([*(f"{c} {dict(focal.dtypes)[c]}" for c in plain), *(f"{f} long" for f in FAMILIES)])
    focal = focal.repartition(parts, "part").groupBy("part").cogroup(each.repartition(parts, "part").groupBy("part")).applyInArrow(tested, shape)
    m = (F.col("d") + 1).cast("double")
    scale = F.sqrt((F.col("n") * m - m * m) / (F.col("n") - 1))
    gi = lambda s: F.try_divide(F.col("z") + s, F.when(scale > 0, scale))
    seen = {"local_moran": F.col("z") * F.col("lag"), "getis_ord_gi_star": gi(F.col("s")), "bivariate_lisa": F.col("z") * F.col("olag")}
    corner = lambda lag: F.when((F.col("z") > 0) & (lag > 0), "high-high").when((F.col("z") < 0) & (lag < 0), "low-low").when(F.col("z") > 0, "high-low").when(lag > 0, "low-high").otherwise("not_classified")
    label = {"local_moran": corner(F.col("lag")), "getis_ord_gi_star": F.when(F.coalesce(seen["getis_ord_gi_star"], F.lit(0.0)) > 0, "high").otherwise("low"), "bivariate_lisa": corner(F.col("olag"))}
    long = focal.select("src", F.inline(F.array(*[F.struct(F.lit(f).alias("family"), seen[f].alias("statistic"), F.col(f).alias("_extreme"), label[f].alias("label")) for f in FAMILIES if other or f != "bivariate_lisa"])))
    raw = long.select(F.col("src").alias(key), "family", "statistic", F.when(F.col("statistic").isNotNull(), (F.col("_extreme") + 1) / F.lit(float(permutations + 1))).alias("p_raw"), F.when(F.col("statistic").isNull(), "not_estimable").otherwise(F.col("label")).alias("label"))
    return adjusted_by_ranges(written(raw, "tests"), "p_raw", ["family"]).select(key, "family", "statistic", "p_raw", "p_adjusted", "label")


def surviving(diagnostics: DataFrame, level: float = 0.05) -> DataFrame:
    """(family, tests, raw, kept): tests with a p-value, and how many are below level before and after adjustment."""
    return diagnostics.groupBy("family").agg(F.count("p_raw").alias("tests"), F.count_if(F.col("p_raw") < level).alias("raw"), F.count_if(F.col("p_adjusted") < level).alias("kept"))
