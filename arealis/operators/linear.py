"""Linear models: distributed cross products, a small solve on the driver, and robust covariance by a second pass.

Only p x p matrices (p predictors) pass through the driver; rows never do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaling(df: DataFrame, by_iqr: Sequence[str], by_sd: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Centre and unit of each predictor in one aggregate: the mean, and IQR or sample deviation."""
    aggs = []
    for c in by_iqr:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
        aggs += [F.avg(c).alias(f"m_{c}"), (q[1] - q[0]).alias(f"u_{c}")]
    for c in by_sd:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"u_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"u_{c}"]) for c in [*by_iqr, *by_sd]}


def scaled(df: DataFrame, units: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(u) for c, (m, u) in units.items()})


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    bread: np.ndarray  # inverse of X'WX
    covariance: np.ndarray
    n: int
    rank: int
    condition: float

    def contrast(self, weights: dict[str, float], z: float = 1.959963984540054) -> dict[str, float]:
        c = np.array([weights.get(n, 0.0) for n in self.names])
        e, se = float(c @ self.beta), float(np.sqrt(c @ self.covariance @ c))
        return {"estimate": e, "se": se, "lo": e - z * se, "hi": e + z * se}


def _terms(predictors: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") for c in predictors]]


def _products(df: DataFrame, terms: list[Column], other: Column | None, weight: Column) -> np.ndarray:
    """Sums of weight * terms x terms, or of weight * terms * other, in one aggregate."""
    p = len(terms)
    if other is not None:
        row = df.agg(*[F.sum(weight * t * other) for t in terms]).first()
        return np.array([float(x) for x in row])
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    row = df.agg(*[F.sum(weight * terms[i] * terms[j]) for i, j in pairs]).first()
    out = np.zeros((p, p))
    for (i, j), x in zip(pairs, row):
        out[i, j] = out[j, i] = float(x)
    return out


def complete(df: DataFrame, outcome: str, predictors: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows in which the model's columns are finite and a weight is positive."""
    cols = [outcome, *predictors, *([weight] if weight else [])]
    good = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols] + ([F.col(weight) > 0] if weight else [])
    out = df
    for g in good:
        out = out.where(g)
    return out


def least_squares(df: DataFrame, outcome: str, predictors: Sequence[str], weight: str | None = None) -> Fit:
    """OLS or WLS with HC3 covariance; rows that complete() leaves out don't count. Raises if the design is singular."""
    rows = complete(df, outcome, predictors, weight)
    w, y = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(outcome).cast("double")
    about = rows.agg(*[F.avg(F.col(c).cast("double")) for c in (outcome, *predictors)]).first()
    if about[0] is None:
        raise ValueError("the design has not full rank")
    centre = np.array([float(x) for x in about[1:]])
    near = [F.lit(1.0), *[F.col(c).cast("double") - float(m) for c, m in zip(predictors, centre)]]
    gram, terms = _products(rows, near, None, w), _terms(predictors)
    size = np.sqrt(np.diag(gram))
    rank = int(np.linalg.matrix_rank(gram / np.outer(size, size))) if (size > 0).all() else 0
    if rank < len(terms):
        raise ValueError("the design has not full rank")
    move = np.eye(len(terms))  # of coefficients about the means to those of the columns as they are
    move[0, 1:] = -centre
    inside = np.linalg.inv(gram)
    beta = move @ (inside @ _products(rows, near, y - float(about[0]), w))
    beta[0] += float(about[0])
    bread = move @ inside @ move.T
    residual, leverage = residual_columns(predictors, outcome, beta, bread, weight)
    # HC3: squared residuals over (1 - leverage), as weights of the cross products
    u = residual / (1.0 - leverage)
    meat = _products(rows, terms, None, w * w * u * u)
    n = rows.count()
    return Fit(["intercept", *predictors], beta, bread, bread @ meat @ bread, n, rank, float(np.linalg.cond(gram)))


def residual_columns(predictors: Sequence[str], outcome: str, beta: np.ndarray, bread: np.ndarray, weight: str | None = None) -> tuple[Column, Column]:
    """Residual and leverage as expressions of a row."""
    terms, w = _terms(predictors), F.col(weight).cast("double") if weight else F.lit(1.0)
    fitted = sum((t * float(b) for t, b in zip(terms, beta)), F.lit(0.0))
    leverage = sum((terms[i] * terms[j] * float(bread[i, j]) for i in range(len(terms)) for j in range(len(terms))), F.lit(0.0))
    return F.col(outcome).cast("double") - fitted, leverage * w


def influence(df: DataFrame, key: str, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Residual, leverage, Cook's distance and external studentised residual of each row, with flags at 4/n, 2p/n and 3.

    The refit without a row follows from the full fit (Sherman and Morrison), so there is no loop over rows.
    """
    rows = complete(df, outcome, predictors)
    fit = least_squares(rows, outcome, predictors)
    residual, leverage = residual_columns(predictors, outcome, fit.beta, fit.bread)
    out = rows.select(key, residual.alias("residual"), leverage.alias("leverage"))
    n, p = fit.n, len(fit.beta)
    sse = float(out.agg(F.sum(F.col("residual") * F.col("residual"))).first()[0])
    e, h, s2 = F.col("residual"), F.col("leverage"), sse / (n - p)
    cook = e * e * h / (p * s2 * (1.0 - h) * (1.0 - h))
    without = (F.lit(sse) - e * e / (1.0 - h)) / float(n - p - 1)
    out = out.withColumn("cook", cook).withColumn("studentised", e / F.sqrt(without * (1.0 - h)))
    return out.withColumns({"high_cook": F.col("cook") > 4.0 / n, "high_leverage": F.col("leverage") > 2.0 * p / n, "high_residual": F.abs("studentised") > 3.0})


def gates(df: DataFrame, outcome: str, predictors: Sequence[str], least_n: int = 70, least_distinct: int = 10, most_r: float = 0.8, most_vif: float = 5.0) -> list[dict]:
    """For each predictor: n, distinct values, IQR, largest |r| with another, VIF, and whether all gates hold (limits are strict)."""
    rows = complete(df, outcome, predictors)
    pairs = [(a, b) for i, a in enumerate(predictors) for b in predictors[:i]]
    q = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))) for c in predictors]
    row = rows.agg(F.count("*"), *[F.countDistinct(c) for c in predictors], *[x[1] - x[0] for x in q], *[F.corr(a, b) for a, b in pairs]).first()
    k = len(predictors)
    corr = np.eye(k)
    for (a, b), r in zip(pairs, row[1 + 2 * k :]):
        i, j = predictors.index(a), predictors.index(b)
        corr[i, j] = corr[j, i] = np.nan if r is None else r
    vif = np.diag(np.linalg.inv(corr)) if np.isfinite(corr).all() and np.linalg.matrix_rank(corr) == k else np.full(k, np.inf)
    out = []
    for i, c in enumerate(predictors):
        most = max([abs(corr[i, j]) for j in range(k) if j != i], default=0.0)
        good = row[0] >= least_n and row[1 + i] >= least_distinct and row[1 + k + i] > 0 and most <= most_r and vif[i] <= most_vif
        out.append({"predictor": c, "n": row[0], "distinct": row[1 + i], "iqr": row[1 + k + i], "largest_r": float(most), "vif": float(vif[i]), "passes": bool(good)})
    return out


def prediction_curve(df: DataFrame, fit: Fit, predictor: str, points: int = 50, z: float = 1.959963984540054) -> DataFrame:
    """(value, predicted, lo, hi) over the range of one predictor, with the others at their means, by the delta method."""
    row = df.agg(F.min(predictor), F.max(predictor), *[F.avg(c) for c in fit.names[1:]]).first()
    at = np.tile([1.0, *row[2:]], (points, 1))
    at[:, fit.names.index(predictor)] = np.linspace(row[0], row[1], points)
    mean, se = at @ fit.beta, np.sqrt(np.einsum("ij,jk,ik->i", at, fit.covariance, at))
    rows = [tuple(map(float, r)) for r in np.column_stack([at[:, fit.names.index(predictor)], mean, mean - z * se, mean + z * se])]
    return df.sparkSession.createDataFrame(rows, "value double, predicted double, lo double, hi double")


def _pairs(df: DataFrame, y: str, x: str) -> DataFrame:
    """df with _y and _x, both null unless both are numbers."""
    b, a = F.col(y).cast("double"), F.col(x).cast("double")
    good = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    return df.withColumns({"_x": F.when(good, a), "_y": F.when(good, b)})


def slopes(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """(by, n, slope) of the simple regression in each group, from one aggregate about its means; null where x doesn't vary."""
    return _pairs(df, y, x).where("_x IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("slope"))


def leave_one_out_slopes(df: DataFrame, by: Sequence[str], part: str, y: str, x: str) -> DataFrame:
    """(by, part, n, slope): the regression without each part (a period, say), from moments of the parts.

    The group's moments about its mean, less the part's, are moved to the mean of what remains.
    """
    n = F.count("*").cast("double")
    parts = _pairs(df, y, x).where("_x IS NOT NULL").groupBy(*by, part).agg(n.alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), (n * F.var_pop("_x")).alias("xx"), (n * F.covar_pop("_x", "_y")).alias("xy"))
    every = Window.partitionBy(*by)  # of a row for each part
    parts = parts.withColumns({"_n": F.sum("n").over(every), "dx": F.col("mx") - F.sum(F.col("n") * F.col("mx")).over(every) / F.sum("n").over(every), "dy": F.col("my") - F.sum(F.col("n") * F.col("my")).over(every) / F.sum("n").over(every)})
    parts = parts.withColumns({"xx": F.col("xx") + F.col("n") * F.col("dx") * F.col("dx"), "xy": F.col("xy") + F.col("n") * F.col("dx") * F.col("dy")})
    rest = F.col("_n") - F.col("n")
    move = lambda c: F.try_divide(F.col("n") * F.col(c), rest)  # noqa: E731  # of the mean, with its sign turned
    left = lambda c, d: F.sum(c).over(every) - F.col(c) - rest * move("dx") * move(d)
    parts = parts.withColumns({"_xx": left("xx", "dx"), "_xy": left("xy", "dy"), "_all": F.sum("xx").over(every)})
    varies = (rest > 1) & (F.col("_xx") > F.col("_all") * 1e-13)
    return parts.select(*by, part, rest.cast("long").alias("n"), F.when(varies, F.try_divide("_xy", "_xx")).alias("slope"))


def residuals(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """df with fitted and residual of each group's simple regression; both null where y, x or the slope is."""
    sums = _pairs(df, y, x).groupBy(*by).agg(F.regr_slope("_y", "_x").alias("_b"), F.avg(F.when(F.col("_x").isNotNull(), F.col("_x"))).alias("_mx"), F.avg("_y").alias("_my"))
    out = df.join(sums, list(by), "left").withColumn("fitted", F.when(F.col(y).isNotNull(), F.col("_my") + F.col("_b") * (F.col(x) - F.col("_mx"))))
    return out.withColumn("residual", F.col(y) - F.col("fitted")).drop("_b", "_mx", "_my")


def selected(df: DataFrame, by: Sequence[str], y: str, x: str, least: int = 70) -> DataFrame:
    """(by, n, slope, role): primary with at least least complete rows and an x that varies, audit_only otherwise."""
    rows = slopes(df, by, y, x)
    return rows.withColumn("role", F.when((F.col("n") >= least) & F.col("slope").isNotNull(), "primary").otherwise("audit_only"))
