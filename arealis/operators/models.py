"""Linear models with several predictors for many groups at once: one aggregate of moments, solved in tasks.

A group's moments are its number of rows, its means and its centred cross products, which merge and can be taken away
from each other; rows never meet in one place. Robust covariance is a second aggregate, of rows beside their group's fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from .linear import complete


def with_variants(df: DataFrame, variants: dict[str, Column | None], name: str = "variant") -> DataFrame:
    """df's rows once for each variant whose condition they meet (None: all rows), so that all variants are fitted in one job."""
    held = F.array(*[F.when(F.lit(True) if c is None else F.coalesce(c, F.lit(False)), F.lit(v)) for v, c in variants.items()])
    return df.withColumn(name, F.explode(F.array_compact(held)))


def moments(df: DataFrame, by: Sequence[str], columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(*by, n, w, mean, cross): rows, their weight, and means and centred cross products of columns, as arrays.

    Without weights the aggregates are Spark's own merging covariances. With weights sums are taken about the means of all rows, then
    moved to the group's. Rows in which a column is missing or not finite, or a weight not positive, don't count.
    """
    rows = complete(df, columns[0], columns[1:], weight)
    for c in columns:
        rows = rows.where(finite(c).isNotNull())
    x = [F.col(c).cast("double") for c in columns]
    k = len(columns)
    if weight is None:
        n = F.count("*").cast("double")
        cross = [n * (F.var_pop(x[i]) if i == j else F.covar_pop(x[max(i, j)], x[min(i, j)])) for i in range(k) for j in range(k)]
        return rows.groupBy(*by).agg(F.count("*").alias("n"), n.alias("w"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*cross).alias("cross"))
    about = rows.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)])
    rows = rows.join(F.broadcast(about))
    w, d = F.col(weight).cast("double"), [c - F.col(f"_m{i}") for i, c in enumerate(x)]
    first = [F.sum(w * c).alias(f"_s{i}") for i, c in enumerate(d)]
    second = [F.sum(w * d[i] * d[j]).alias(f"_p{i}_{j}") for i in range(k) for j in range(i + 1)]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("w"), *first, *second, *[F.first(f"_m{i}").alias(f"_m{i}") for i in range(k)])
    product = lambda i, j: F.col(f"_p{max(i, j)}_{min(i, j)}") - F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("w")
    return sums.select(*by, "n", "w", F.array(*[F.col(f"_m{i}") + F.col(f"_s{i}") / F.col("w") for i in range(k)]).alias("mean"), F.array(*[product(i, j) for i in range(k) for j in range(k)]).alias("cross"))


def solution(n: float, w: float, mean: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(coefficients with the intercept first, inverse of X'WX, residual sum of squares); None if predictors depend on each other.

    The first column is the outcome. Predictors are scaled to unit variance before Cholesky, so that units don't decide on rank.
    """
    k = len(mean)
    cross = cross.reshape(k, k)
    scale = np.sqrt(np.diag(cross)[1:])
    if n <= k or not (scale > 1e-12 * np.maximum(np.abs(mean[1:]) * np.sqrt(w), 1e-300)).all():
        return None
    r = cross[1:, 1:] / np.outer(scale, scale)
    if np.linalg.eigvalsh(r)[0] < 1e-10:
        return None
    root = np.linalg.inv(np.linalg.cholesky(r)) / scale
    inverse = root.T @ root
    slopes = inverse @ cross[1:, 0]
    beta = np.concatenate([[mean[0] - mean[1:] @ slopes], slopes])
    bread = np.zeros((k, k))
    bread[1:, 1:] = inverse
    bread[0, 1:] = bread[1:, 0] = -inverse @ mean[1:]
    bread[0, 0] = 1 / w + mean[1:] @ inverse @ mean[1:]
    return beta, bread, float(cross[0, 0] - slopes @ cross[1:, 0])


def _schema(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def fits(df: DataFrame, by: Sequence[str], outcome: str, predictors: Sequence[str], weight: str | None = None) -> DataFrame:
    """(*by, n, rank_ok, beta, bread, rss, mean): each group's least squares, nulls where predictors depend on each other or rows are too few."""
    made = moments(df, by, [outcome, *predictors], weight)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [solution(n, w, np.array(m), np.array(c)) for n, w, m, c in zip(batch["n"], batch["w"], batch["mean"], batch["cross"])]
            out = batch[[*by, "n", "mean"]].copy()
            out["rank_ok"] = [f is not None for f in found]
            out["beta"] = [None if f is None else f[0] for f in found]
            out["bread"] = [None if f is None else f[1].ravel() for f in found]
            out["rss"] = [None if f is None else f[2] for f in found]
            yield out[[*by, "n", "rank_ok", "beta", "bread", "rss", "mean"]]

    return made.mapInPandas(solve, _schema(made, [*by, "n"]) + ", rank_ok boolean, beta array<double>, bread array<double>, rss double, mean array<double>")


def robust_fits(df: DataFrame, by: Sequence[str], outcome: str, predictors: Sequence[str], weight: str | None = None) -> DataFrame:
    """(*by, n, rank_ok, beta, covariance): fits() with HC3 covariance, squared residuals over (1 - leverage) squared.

    Cross products are taken about the group's means and moved to the intercept's form after they are summed up. A group in which a row has
    a leverage of one has no covariance.
    """
    found = fits(df, by, outcome, predictors, weight)
    rows = complete(df, outcome, predictors, weight)
    for c in (outcome, *predictors):
        rows = rows.where(finite(c).isNotNull())
    w, k = F.col(weight).cast("double") if weight else F.lit(1.0), len(predictors) + 1
    near = rows.join(found.where("rank_ok").select(*by, F.col("beta").alias("_b"), F.col("bread").alias("_i"), F.col("mean").alias("_m")), list(by))
    z = [F.lit(1.0), *[F.col(c).cast("double") - F.col("_m")[i + 1] for i, c in enumerate(predictors)]]
    fitted = sum((F.col("_b")[i + 1] * z[i + 1] for i in range(k - 1)), F.col("_m")[0])
    # about the means the intercept stands apart from the rest: its part of the leverage is one over the group's weight
    own = F.col("_i")[0] - sum((F.col("_i")[(i + 1) * k + j + 1] * F.col("_m")[i + 1] * F.col("_m")[j + 1] for i in range(k - 1) for j in range(k - 1)), F.lit(0.0))
    leverage = w * (own + sum((F.col("_i")[(i + 1) * k + j + 1] * z[i + 1] * z[j + 1] for i in range(k - 1) for j in range(k - 1)), F.lit(0.0)))
    u = w * (F.col(outcome).cast("double") - fitted) / (1.0 - leverage)
    near = near.withColumn("_u", F.when(leverage < 1.0 - 1e-12, u * u))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    meat = near.groupBy(*by).agg(F.count_if(F.col("_u").isNull()).alias("_full"), F.array(*[F.sum(F.col("_u") * z[i] * z[j]) for i, j in pairs]).alias("_meat"))
    both = found.join(meat, list(by), "left")

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ok, full, bread, mean, meat in zip(batch["rank_ok"], batch["_full"], batch["bread"], batch["mean"], batch["_meat"]):
                if not ok or full or meat is None:
                    out.append(None)
                    continue
                m = np.zeros((k, k))
                for (i, j), x in zip(pairs, meat):
                    m[i, j] = m[j, i] = x
                move = np.eye(k)  # of the intercept at the means to that at zero
                move[0, 1:] = -np.asarray(mean)[1:]
                apart = np.zeros((k, k))
                bread = np.asarray(bread).reshape(k, k)
                apart[1:, 1:] = bread[1:, 1:]
                apart[0, 0] = bread[0, 0] - np.asarray(mean)[1:] @ bread[1:, 1:] @ np.asarray(mean)[1:]
                a = move @ apart
                out.append((a @ m @ a.T).ravel())
            part = batch[[*by, "n", "rank_ok", "beta"]].copy()
            part["covariance"] = out
            yield part

    return both.mapInPandas(cover, _schema(found, [*by, "n", "rank_ok", "beta"]) + ", covariance array<double>")


def contrasts(fitted: DataFrame, by: Sequence[str], predictors: Sequence[str], wanted: dict[str, dict[str, float]], level: float = 0.95) -> DataFrame:
    """(*by, contrast, n, estimate, se, lo, hi): sums of coefficients by weights, with normal intervals at level."""
    names, z = ["intercept", *predictors], NormalDist().inv_cdf((1 + level) / 2)
    k, rows = len(names), []
    for name, weights in wanted.items():
        c = [float(weights.get(t, 0.0)) for t in names]
        estimate = sum((F.col("beta")[i] * x for i, x in enumerate(c) if x), F.lit(0.0))
        variance = sum((F.col("covariance")[i * k + j] * (x * y) for i, x in enumerate(c) for j, y in enumerate(c) if x and y), F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("contrast"), estimate.alias("estimate"), F.sqrt(variance).alias("se")))
    long = fitted.select(*by, "n", F.inline(F.array(*rows)))
    return long.select(*by, "contrast", "n", "estimate", "se", (F.col("estimate") - z * F.col("se")).alias("lo"), (F.col("estimate") + z * F.col("se")).alias("hi"))


def without_parts(df: DataFrame, by: Sequence[str], part: str, outcome: str, predictors: Sequence[str], weight: str | None = None) -> DataFrame:
    """(*by, part, n, rank_ok, beta): each group's fit without each of its parts (a period, an area), from moments of the parts.

    The group's cross products about its mean, less the part's, are moved to the mean of what remains. A task sees one row for each part of a group.
    """
    parts = moments(df, [*by, part], [outcome, *predictors], weight)

    def leave_out(group: pd.DataFrame) -> pd.DataFrame:
        w, k = group["w"].to_numpy(), len(predictors) + 1
        mean, cross = np.stack(group["mean"]), np.stack(group["cross"]).reshape(-1, k, k)
        centre = w @ mean / w.sum()
        off = mean - centre
        own = cross + w[:, None, None] * off[:, :, None] * off[:, None, :]
        total, rows = own.sum(0), []
        for i, row in enumerate(group.itertuples(index=False)):
            left = w.sum() - w[i]
            n = int(group["n"].sum() - group["n"].iloc[i])
            move = -w[i] * off[i] / left if left > 0 else off[i]
            f = solution(n, left, centre + move, (total - own[i] - left * np.outer(move, move)).ravel()) if n else None
            rows.append((*[getattr(row, c) for c in (*by, part)], n, f is not None, None if f is None else f[0]))
        return pd.DataFrame(rows, columns=[*by, part, "n", "rank_ok", "beta"])

    return parts.groupBy(*by).applyInPandas(leave_out, _schema(parts, [*by, part]) + ", n long, rank_ok boolean, beta array<double>")
