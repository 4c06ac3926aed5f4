"""Reproducible draws from counters: bootstrap of clusters and permutations as joins.

A draw is a hash of (seed, replicate, slot), so that any engine with md5 gets the same ones and a lost task makes
its own again. Replicates are rows; nothing loops on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written


def draw(seed: int, *parts: Column) -> Column:
    """A whole number from 0 to 2**32 - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: MD5's turns, by step, and its sines.
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(np.sin(i + 1)) * 4294967296) for i in range(64)]


def _md5_heads(words: np.ndarray, size: int) -> np.ndarray:
    """The first 32 bits of the MD5 of texts of size bytes (55 at most): words holds a row for each little-endian word of theirs, with the bit behind."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x) for x in start)
    for i in range(64):
        f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
        g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        f += a
        f += np.uint32((_SINES[i] + 8 * size * (g == 14)) % 4294967296)
        if g < len(words):
            f += words[g]
        turn = np.uint32(_TURNS[i // 16][i % 4])
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
    return (a + start[0]).byteswap()


def draws(seed: int, areas: Sequence[str], replicates: range, slots: int) -> np.ndarray:
    """What draw() gives for (area, replicate, slot) with slots from 1, many at a time: an array of areas by replicates by slots."""
    out = np.empty((len(areas), len(replicates) * slots), np.uint32)
    heads, tails = [f"{seed}|{a}|".encode() for a in areas], [b"%d|%d" % (r, s) for r in replicates for s in range(1, slots + 1)]
    sizes = [np.array([len(x) for x in texts]) for texts in (heads, tails)]
    for m in np.unique(sizes[0]):
        for n in np.unique(sizes[1]):
            i, j = np.flatnonzero(sizes[0] == m), np.flatnonzero(sizes[1] == n)
            if m + n > 55:
                out[np.ix_(i, j)] = [[int.from_bytes(hashlib.md5(heads[x] + tails[y]).digest()[:4], "big") for y in j] for x in i]
                continue
            text = np.zeros((len(i), len(j), (m + n) // 4 * 4 + 4), np.uint8)
            text[..., :m] = np.frombuffer(b"".join(heads[x] for x in i), np.uint8).reshape(-1, 1, m)
            text[..., m : m + n] = np.frombuffer(b"".join(tails[y] for y in j), np.uint8).reshape(-1, n)
            text[..., m + n] = 128
            words = np.ascontiguousarray(text.reshape(len(i) * len(j), -1).view("<u4").T)
            found = np.concatenate([_md5_heads(words[:, k : k + 16384], int(m + n)) for k in range(0, words.shape[1], 16384)])
            out[np.ix_(i, j)] = found.reshape(len(i), len(j))
    return out.reshape(len(areas), len(replicates), slots)


def cluster_draws(clusters: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, cluster, times): as many draws with replacement as there are clusters, counted by cluster."""
    spark = clusters.sparkSession
    line = clusters.select(cluster).distinct()
    numbered = line.withColumn("_k", F.row_number().over(Window.orderBy(cluster)) - 1)  # one row per cluster, few
    n = numbered.agg(F.count("*").alias("_n"))
    slots = spark.range(replicates).select(F.col("id").cast("int").alias("replicate")).crossJoin(F.broadcast(n)).withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    drawn = slots.withColumn("_k", draw(seed, F.col("replicate"), F.col("slot")) % F.col("_n"))
    return drawn.groupBy("replicate", "_k").agg(F.count("*").alias("times")).join(F.broadcast(numbered), "_k").select("replicate", cluster, "times")


def bootstrap_rows(df: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """df's rows for every replicate, each with times, how often its cluster was drawn; others are absent."""
    return df.join(F.broadcast(cluster_draws(df, cluster, replicates, seed)), cluster)


def weighted_percentile_rank(value: str, weight: str, *by: str) -> Column:
    """percentile_rank() of rows that stand for weight copies each."""
    w = Window.partitionBy(*by)
    upto = F.sum(weight).over(w.orderBy(value))  # with ties
    ties = F.sum(weight).over(Window.partitionBy(*by, value))
    return (upto - (ties - 1) / F.lit(2.0)) / F.sum(weight).over(w)


def permuted(df: DataFrame, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, key, value): the values dealt to the keys in another order in each replicate, the same in number."""
    spark = df.sparkSession
    rows = df.select(key, value).withColumn("_i", F.row_number().over(Window.orderBy(key)))
    many = spark.range(replicates).select(F.col("id").cast("int").alias("replicate")).crossJoin(F.broadcast(rows))
    order = Window.partitionBy("replicate").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string"))), key)
    dealt = many.withColumn("_j", F.row_number().over(order))
    return dealt.select("replicate", key, F.col("_j").alias("_i")).join(F.broadcast(rows.select("_i", value)), "_i").select("replicate", key, value)


def percentile_interval(df: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    cut = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("estimable"), cut.alias("_c")).select(*by, "estimable", F.col("_c")[0].alias("lo"), F.col("_c")[1].alias("hi"))


def normal_draws(df: DataFrame, key: Sequence[str], mean: str, se: str, replicates: int, seed: int, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """df's rows for every replicate with drawn: a normal value from two hashed uniforms, clipped to low..high; null if mean or se is."""
    many = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = [(draw(seed + k, F.col("replicate"), *[F.col(c) for c in key]) + 0.5) / F.lit(4294967296.0) for k in (0, 1)]
    z = F.sqrt(F.log(u[0]) * -2.0) * F.cos(u[1] * 6.283185307179586)
    return many.withColumn("drawn", F.when(F.col(mean).isNotNull() & F.col(se).isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), F.col(mean) + F.col(se) * z))))


def replicated_ranks(df: DataFrame, value: str, weight: str, group: Sequence[str], name: str, replicate: str = "replicate", ranges: int = 64) -> DataFrame:
    """df with weighted_percentile_rank() of value in each replicate of a group, without a task that sorts a replicate.

    A group's values are cut into ranges once, for all its replicates; ranks are sums within a range and over those before it. df is read
    more than once, so it should be a table.
    """
    key = [replicate, *group]
    counts = df.groupBy(*key, value).agg(F.sum(weight).alias("_t"))
    cuts = df.groupBy(*group).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    counts = counts.join(cuts, list(group)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = counts.groupBy(*key, "_range").agg(F.sum("_t").alias("_s"))
    whole = Window.partitionBy(*key)  # of a row for each range
    before = F.coalesce(F.sum("_s").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*key, "_range", before.alias("_before"), F.sum("_s").over(whole).alias("_all"))
    upto = F.sum("_t").over(Window.partitionBy(*key, "_range").orderBy(value)) + F.col("_before")
    ranks = counts.join(totals, [*key, "_range"]).select(*key, value, ((upto - (F.col("_t") - 1) / F.lit(2.0)) / F.col("_all")).alias(name))
    return df.join(ranks, [*key, value])


SCALE_METRICS = ("median_gap", "mean_gap", "quartile_disagree", "top_movement")


def scale_metrics(df: DataFrame, by: Sequence[str], fine: str, coarse: str, times: Column) -> DataFrame:
    """(*by, median_gap, mean_gap, quartile_disagree, top_movement) between ranks at two scales, rows counted times each; shares in percent."""
    quartile = lambda c: F.when(F.col(c) <= 0.25, 1).when(F.col(c) <= 0.5, 2).when(F.col(c) <= 0.75, 3).otherwise(4)
    rows = df.select(*by, F.abs(F.col(fine) - F.col(coarse)).alias("_gap"), quartile(fine).alias("_q"), quartile(coarse).alias("_p"), times.cast("long").alias("_w"))
    share = lambda c: F.sum(c.cast("int") * F.col("_w")) * 100.0 / F.sum("_w")
    moved = (F.col("_q") == 4) != (F.col("_p") == 4)
    return rows.groupBy(*by).agg(F.percentile("_gap", 0.5, F.col("_w")).alias("median_gap"), (F.sum(F.col("_gap") * F.col("_w")) / F.sum("_w")).alias("mean_gap"), share(F.col("_q") != F.col("_p")).alias("quartile_disagree"), share(moved).alias("top_movement"))


# ---- ranks in draws of clusters, without a row for each draw ----
#
# A row's rank in a replicate is a sum over clusters: how often each was drawn, times how many of its rows lie below (ties count half). So a
# row needs one number for each cluster, and its ranks in all replicates are a product with the matrix of draws. Whole and half numbers: it is exact.


def _draw_matrix(df: DataFrame, cluster: str, replicates: int, seed: int) -> tuple[pd.Index, np.ndarray]:
    """Clusters that were drawn, and how often each was in each replicate; clusters are few."""
    drawn = cluster_draws(df, cluster, replicates, seed).where(F.col(cluster).isNotNull()).toPandas()
    names = pd.Index(sorted(drawn[cluster].unique()))
    times = np.zeros((len(names), replicates))
    times[names.get_indexer(drawn[cluster]), drawn["replicate"]] = drawn["times"]
    return names, times


def _ranged(df: DataFrame, group: Sequence[str], cluster: str, value: str, others: dict[str, Column], ranges: int) -> tuple[DataFrame, DataFrame]:
    """df with _range, its value's range in the group, and (_g..., _r, _k, _below, _all, others): each cluster's rows in lower ranges and in all.

    Nulls are the lowest value. df is read more than once, so it should be a table.
    """
    known = df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))))
    cuts = known.groupBy(*group).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    same = [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(group)]
    cuts = cuts.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(group)], "_cuts")
    rows = known.join(F.broadcast(cuts), same).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts", *[f"_c{i}" for i in range(len(group))])
    g = [f"_g{i}" for i in range(len(group))]
    totals = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(group, g)], F.col("_range").alias("_q"), F.col(cluster).alias("_k")).agg(F.count("*").alias("_n"), *[f.alias(n) for n, f in others.items()])
    lists = totals.groupBy(*g).agg(F.collect_set("_q").alias("_ranges"), F.collect_list(F.struct("_q", "_k", "_n", *others)).alias("_t"))  # of one number for each range and cluster
    each = lists.select(*g, F.explode("_ranges").alias("_r"), "_t").select(*g, "_r", F.inline("_t"))
    return rows, each.groupBy(*g, "_r", "_k").agg(F.sum(F.when(F.col("_q") < F.col("_r"), F.col("_n")).otherwise(0)).alias("_below"), F.sum("_n").alias("_all"), *[F.max(n).alias(n) for n in others])


def _halves(rows: pd.DataFrame, totals: pd.DataFrame, names: pd.Index, cluster: str) -> np.ndarray:
    """(rows, clusters): how many of a cluster's rows lie below each row's value, ties by half."""
    v, k = rows["_v"].to_numpy(float), names.get_indexer(rows[cluster])
    out = np.zeros((len(rows), len(names)))
    at = names.get_indexer(totals["_k"])
    out[:, at[at >= 0]] = totals["_below"].to_numpy(float)[at >= 0]
    for c in np.unique(k[k >= 0]):
        mine = np.sort(v[k == c])
        out[:, c] += (np.searchsorted(mine, v, side="left") + np.searchsorted(mine, v, side="right")) / 2.0
    return out


def _by_range(rows: DataFrame, totals: DataFrame, group: Sequence[str], function, schema: str) -> DataFrame:
    parts = 3 * rows.sparkSession.sparkContext.defaultParallelism
    keys = [c for c in totals.columns if c.startswith("_g")]
    here, there = rows.repartition(parts, *group, "_range"), totals.repartition(parts, *keys, "_r")
    return here.groupBy(*group, "_range").cogroup(there.groupBy(*keys, "_r")).applyInPandas(function, schema)


_CHUNK = 1024


def rank_gap_draws(df: DataFrame, group: Sequence[str], cluster: str, one: str, other: str, replicates: int, seed: int, ranges: int = 64) -> DataFrame:
    """(*group, replicate, gap): the mean distance between the percentile ranks of two values in each draw of clusters, ranks taken anew in it.

    A cluster's rows count as often as it was drawn. df is read more than once, so it should be a table.
    """
    names, times = _draw_matrix(df, cluster, replicates, seed)
    kinds = dict(df.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in group)

    def first(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        return rows[[*group, cluster, "_w"]].assign(_h=list(_halves(rows, totals, names, cluster)))

    def second(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in [*group, "replicate", "far", "rows"]})
        apart = np.stack(rows["_h"].to_numpy()) - _halves(rows, totals, names, cluster)
        k = names.get_indexer(rows[cluster])
        far, n = np.zeros(replicates), np.zeros(replicates)
        for i in range(0, len(rows), _CHUNK):
            some = slice(i, i + _CHUNK)
            w = times[k[some]] * (k[some] >= 0)[:, None]
            far += (np.abs(apart[some] @ times) * w).sum(0)
            n += w.sum(0)
        return pd.DataFrame({**{c: rows[c].iloc[0] for c in group}, "replicate": np.arange(replicates), "far": far, "rows": n})

    rows, totals = _ranged(df.select(*group, cluster, F.col(one).alias("_a"), F.col(other).cast("double").alias("_w")), group, cluster, "_a", {}, ranges)
    ranked = written(_by_range(rows, totals, group, first, f"{head}, {cluster} {kinds[cluster]}, _w double, _h array<double>"), "halves")
    rows, totals = _ranged(ranked, group, cluster, "_w", {}, ranges)
    sums = _by_range(rows, totals, group, second, f"{head}, replicate int, far double, rows double").groupBy(*group, "replicate").agg(F.sum("far").alias("far"), F.sum("rows").alias("rows"))
    return sums.where("rows > 0").select(*group, "replicate", (F.col("far") / F.col("rows") / F.col("rows")).alias("gap"))


_BINS = 128


def cross_scale_bootstrap(df: DataFrame, group: Sequence[str], area: str, value: str, area_value: str, replicates: int, seed: int, level: float = 0.95, ranges: int = 64) -> DataFrame:
    """(*group, metric, lo, hi): percentile intervals of scale_metrics() over draws of areas, ranks at both scales taken anew in each.

    df has a row for each unit, with its area's value beside its own; it is read more than once. An area counts as often as it is
    drawn, with all its units. Medians are exact: a first pass counts gaps in bins, a second keeps those of the bins that the middle falls
    into. The driver sees the counts of a group's replicate and nothing of its rows.
    """
    names, times = _draw_matrix(df, area, replicates, seed)
    kinds = dict(df.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in group)

    def wide_ranks(totals: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(areas, replicates): the area's rank among the group's areas; and (replicates) how many units the group has."""
        at = names.get_indexer(totals["_k"])
        t = totals[at >= 0].assign(at=at[at >= 0]).drop_duplicates("at")
        w, n = t["_w"].to_numpy(float), np.zeros(len(names))
        n[t["at"]] = t["_all"]
        half = (w < w[:, None]) + (w == w[:, None]) / 2.0
        drawn, out = times[t["at"]], np.zeros(times.shape)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[t["at"]] = (half @ drawn + 0.5) / drawn.sum(0)
        return out, n @ times

    def chunks(rows: pd.DataFrame, totals: pd.DataFrame):
        """(gap, rank, wide rank, weight) of some rows in all replicates."""
        wide, n = wide_ranks(totals)
        k, half = names.get_indexer(rows[area]), _halves(rows, totals, names, area)
        for i in range(0, len(rows), _CHUNK):
            some = slice(i, i + _CHUNK)
            with np.errstate(invalid="ignore", divide="ignore"):
                fine = (half[some] @ times + 0.5) / n
            coarse = wide[k[some]]
            yield np.abs(fine - coarse), fine, coarse, times[k[some]] * (k[some] >= 0)[:, None]

    bin_of = lambda gap: np.minimum((np.where(np.isfinite(gap), gap, 0.0) * _BINS).astype(int), _BINS - 1)
    quartile = lambda r: (r > 0.25).astype(int) + (r > 0.5) + (r > 0.75)
    block = max(1, -(-replicates // 16))

    def counts(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        bins, sums = np.zeros((replicates, _BINS)), np.zeros((4, replicates))
        for gap, fine, coarse, w in chunks(rows, totals):
            bins += np.bincount((bin_of(gap) + np.arange(replicates) * _BINS).ravel(), w.ravel(), replicates * _BINS).reshape(bins.shape)
            p, q = quartile(fine), quartile(coarse)
            sums += [w.sum(0), (np.where(w > 0, gap, 0.0) * w).sum(0), (w * (p != q)).sum(0), (w * ((p == 3) != (q == 3))).sum(0)]
        first = np.arange(0, replicates, block) if len(rows) else np.zeros(0, int)
        return pd.DataFrame({**{c: [rows[c].iloc[0]] * len(first) for c in group}, "first": first, "bins": [bins[k : k + block].astype(np.int64).tobytes() for k in first], "sums": [sums[:, k : k + block].tobytes() for k in first]})

    def added(some: pd.DataFrame) -> pd.DataFrame:
        bins = sum(np.frombuffer(b, np.int64).reshape(-1, _BINS) for b in some["bins"])
        n, far, unlike, moved = sum(np.frombuffer(b).reshape(4, -1) for b in some["sums"])
        upto, at = bins.cumsum(1), np.flatnonzero(n > 0)
        low, high = np.floor((n - 1) / 2), np.ceil((n - 1) / 2)  # places of the middle, from 0
        lo, hi = (upto <= low[:, None]).sum(1), (upto <= high[:, None]).sum(1)
        below = np.where(lo > 0, np.take_along_axis(upto, np.maximum(lo - 1, 0)[:, None], 1)[:, 0], 0)
        out = {"replicate": at + int(some["first"].iloc[0]), "lo": lo[at], "hi": hi[at], "low": low[at] - below[at], "high": high[at] - below[at], "mean_gap": far[at] / n[at], "quartile_disagree": unlike[at] * 100.0 / n[at], "top_movement": moved[at] * 100.0 / n[at]}
        return pd.DataFrame({**{c: some[c].iloc[0] for c in group}, **out})

    rows, totals = _ranged(df.select(*group, area, F.col(value).alias("_u"), F.col(area_value).cast("double").alias("_w")), group, area, "_u", {"_w": F.max("_w")}, ranges)
    rows, totals = written(rows.select(*group, area, "_v", "_range"), "ranged"), written(totals, "totals")
    parts = 3 * df.sparkSession.sparkContext.defaultParallelism
    binned = _by_range(rows, totals, group, counts, f"{head}, first int, bins binary, sums binary").repartition(parts, *group, "first").groupBy(*group, "first")
    binned = written(binned.applyInPandas(added, f"{head}, replicate int, lo int, hi int, low double, high double, mean_gap double, quartile_disagree double, top_movement double"), "binned")
    wanted = binned.select(*group, "replicate", "lo", "hi").toPandas()  # two numbers for each replicate of a group
    wanted = {g if isinstance(g, tuple) else (g,): (p["replicate"].to_numpy(), p["lo"].to_numpy(), p["hi"].to_numpy()) for g, p in wanted.groupby(list(group), dropna=False)}

    def middle(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        lo, hi, found = np.full(replicates, -1), np.full(replicates, -1), []
        if len(rows):
            at, lo_, hi_ = wanted[tuple(rows[c].iloc[0] for c in group)]
            lo[at], hi[at] = lo_, hi_
            for gap, _, _, w in chunks(rows, totals):
                b = bin_of(gap)
                i, r = np.nonzero(((b == lo) | (b == hi)) & (w > 0))
                found.append(pd.DataFrame({"replicate": r, "gap": gap[i, r], "w": w[i, r]}))
        out = pd.concat(found) if found else pd.DataFrame({"replicate": [], "gap": [], "w": []})
        return out.assign(**{c: rows[c].iloc[0] if len(rows) else None for c in group})

    kept = _by_range(rows, totals, group, middle, f"{head}, replicate int, gap double, w double").groupBy(*group, "replicate", "gap").agg(F.sum("w").alias("w"))
    upto = F.sum("w").over(Window.partitionBy(*group, "replicate").orderBy("gap"))  # of what two bins hold
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in [*group, "replicate"]]
    named = binned.withColumnsRenamed({c: f"_b_{c}" for c in [*group, "replicate"]})
    kept = kept.withColumn("upto", upto).join(named.hint("merge"), same)
    at = lambda place: F.min(F.when(F.col("upto") > F.col(place), F.col("gap")))
    found = kept.groupBy(*group, "replicate").agg(((at("low") + at("high")) / 2.0).alias("median_gap"), *[F.max(m).alias(m) for m in SCALE_METRICS[1:]])
    long = found.select(*group, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in SCALE_METRICS])))
    return percentile_interval(long, [*group, "metric"], "v", level)


def propagated_ranks(df: DataFrame, key: Sequence[str], mean: str, se: str, group: Sequence[str], replicates: int, seed: int, level: float = 0.95, name: str = "draws") -> DataFrame:
    """(*key, estimable, rank_lo, rank_hi, q1 .. q4): how a row's rank in its group moves when all values are drawn anew from their intervals.

    Each replicate draws every row's value, normal about its mean and clipped to 0..100, and ranks it in its group. q1 to q4 are the shares of
    replicates in each quartile. key holds the group's columns, too; rows without a mean or se take no part.
    """
    drawn = normal_draws(df.select(*key, mean, se), key, mean, se, replicates, seed).where("drawn IS NOT NULL").withColumn("_one", F.lit(1))
    ranks = replicated_ranks(written(drawn.select("replicate", *key, "drawn", "_one"), name), "drawn", "_one", group, "_r")
    tail = (1 - level) / 2
    bounds = [(0.0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 2.0)]
    shares = [F.avg(((F.col("_r") > lo) & (F.col("_r") <= hi)).cast("int")).alias(f"q{k}") for k, (lo, hi) in enumerate(bounds, 1)]
    cut = F.percentile("_r", F.array(F.lit(tail), F.lit(1 - tail)))
    return ranks.groupBy(*key).agg(F.count("*").alias("estimable"), cut.alias("_c"), *shares).select(*key, "estimable", F.col("_c")[0].alias("rank_lo"), F.col("_c")[1].alias("rank_hi"), "q1", "q2", "q3", "q4")
