"""Scalar column functions: cleansing, identifiers, suppression, intervals, quartiles and discordance.

All are expressions of built-in functions, so they stay within generated code and can be pushed to scans.
Null rules: text that is no number becomes null, non-finite numbers become null, and a predicate on a null is
false where the docstring says "strict".
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities as null."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def steady_mean(c: str | Column) -> Column:
    """Aggregate: the mean from a decimal sum, the same to the last bit in whatever order rows come, so that groups of equal values tie.

    Sums count to 18 decimals. Groups with values that this doesn't hold (none finite, above 1e19, or all under 1e-6) get the plain mean.
    """
    x = col(c).cast("double")
    exact = x.try_cast("decimal(38,18)")
    held = (F.count(exact) == F.count(x)) & ((F.max(F.abs(x)) >= 1e-6) | (F.max(F.abs(x)) == 0))
    return F.coalesce(F.when(held, F.try_sum(exact).cast("double") / F.count(x)), F.avg(x))


def number(text: str | Column, missing: Sequence[str] = ("", "N/A", "NA", "<10")) -> Column:
    """A number from text: thousands separators go, the tokens of missing and what is no number are null."""
    t = F.trim(col(text))
    return finite(F.when(t.isin(*missing), None).otherwise(F.regexp_replace(t, ",", "")).try_cast("double"))


def integer(text: str | Column, missing: Sequence[str] = ("", "N/A", "NA", "<10")) -> Column:
    """number() cut towards zero."""
    x = number(text, missing)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def slug(label: str | Column) -> Column:
    return F.replace(F.lower(F.trim(col(label))), F.lit(" "), F.lit("_"))


def by_prefix(c: str | Column, families: Mapping[str, str], default: str | None = None) -> Column:
    """The value of the first prefix that c starts with."""
    out = None
    for prefix, value in families.items():
        out = F.when(col(c).startswith(prefix), value) if out is None else out.when(col(c).startswith(prefix), value)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def mapped(c: str | Column, values: Mapping[str, str]) -> Column:
    """A lookup in a small fixed table; what it doesn't hold is null."""
    out = F.lit(None).cast("string")
    for k, v in reversed(list(values.items())):
        out = F.when(col(c) == k, v).otherwise(out)
    return out


def padded(c: str | Column, width: int) -> Column:
    """Digits filled up with zeros to width; longer ones and other text stay as they are (lpad would cut them)."""
    x = col(c)
    return F.when(x.rlike("^[0-9]+$") & (F.length(x) < width), F.lpad(x, width, "0")).otherwise(x)


def area_id(c: str | Column, prefix: str, width: int = 2) -> Column:
    """The last dash-separated part without prefix, as a whole number padded to width; other text stays."""
    t = F.trim(col(c).cast("string"))
    t = F.when(t.startswith(prefix), F.substring(t, F.lit(len(prefix) + 1), F.length(t))).otherwise(t)
    last = F.element_at(F.split(t, "-"), -1)
    n = last.try_cast("double")
    return F.when(n.isNotNull(), padded(n.cast("long").cast("string"), width)).otherwise(last)


def flag(c: str | Column) -> Column:
    """Whether text means yes; strict."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


def suppression_reason(numerator: str | Column, measure: str | Column, below: int = 10) -> Column:
    n = col(numerator)
    return (
        F.when(n.isNull() | col(measure).isNull(), "unavailable")
        .when(n == 0, "unresolved_zero")
        .when((n > 0) & (n < below), "below_threshold")
    )


def eligible(level: Column, included: Column, suppressed: Column, numerator: str | Column, denominator: str | Column, least: int = 30) -> Column:
    """Strict conjunction: a null anywhere makes it false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(level) & yes(included) & ~F.coalesce(suppressed, F.lit(True)) & col(numerator).isNotNull() & yes(col(denominator) >= least)


def exclusion_reason(reason: str | Column, measure: str | Column, denominator: str | Column, least: int = 30) -> Column:
    """Later rules win: eligible, then small denominator, then missing measure, then the suppression reason."""
    return (
        F.when(col(reason).isNotNull(), col(reason))
        .when(col(measure).isNull(), "missing_measure")
        .when(F.coalesce(col(denominator) < least, F.lit(True)), "small_denominator")
        .otherwise("eligible")
    )


def interval(text: str | Column) -> Column:
    """struct(lo, hi) of a text with exactly two numbers, 0 <= lo < hi <= 100; else null."""
    numbers = F.regexp_extract_all(col(text), F.lit(r"([+-]?\d+(?:\.\d+)?)"), F.lit(1))
    lo, hi = (F.try_element_at(numbers, F.lit(k)).try_cast("double") for k in (1, 2))
    good = (F.size(numbers) == 2) & (lo >= 0) & (lo < hi) & (hi <= 100)
    return F.when(good, F.struct(lo.alias("lo"), hi.alias("hi")))


def clamped_interval(estimate: str | Column, se: str | Column, z: float = 1.96) -> Column:
    """struct(lo, hi) within 0 and 100; null if either is."""
    e, s = col(estimate), col(se)
    return F.when(e.isNotNull() & s.isNotNull(), F.struct(F.greatest(F.lit(0.0), e - z * s).alias("lo"), F.least(F.lit(100.0), e + z * s).alias("hi")))


def rank_quartile(rank: str | Column) -> Column:
    """1 to 4 of a rank in (0, 1]; bounds belong to the lower quartile."""
    r = col(rank)
    return F.when(r <= 0.25, 1).when(r <= 0.5, 2).when(r <= 0.75, 3).when(r.isNotNull(), 4)


def cut_bin(value: str | Column, low: Column, mid: Column, high: Column) -> Column:
    """1 to 4 of a value between cut points: up to low, below mid, below high, above."""
    v = col(value)
    return F.when(v <= low, 1).when(v < mid, 2).when(v < high, 3).when(v.isNotNull(), 4)


def frozen_quartile(value: str | Column, cuts: Sequence[float]) -> Column:
    """1 to 4 with cut points that were fixed before; each bound belongs to the lower quartile."""
    v = col(value)
    return F.when(v <= cuts[0], 1).when(v <= cuts[1], 2).when(v <= cuts[2], 3).when(v.isNotNull(), 4)


def discordance(first: str | Column, second: str | Column, high: float = 0.75, low: float = 0.25, mid: float = 0.5) -> Column:
    """Of two ranks: both high, one high and the other below the middle, both low, or neither."""
    a, b = col(first), col(second)
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when((a > high) & (b > high), "both_high")
        .when((a > high) & (b < mid), "first_high")
        .when((b > high) & (a < mid), "second_high")
        .when((a <= low) & (b <= low), "both_low")
        .otherwise("other")
    )


def same_direction(a: str | Column, b: str | Column) -> Column:
    return F.signum(col(a)) == F.signum(col(b))


def percent_change(new: str | Column, old: str | Column) -> Column:
    """Absolute change in percent; null if old is zero."""
    return F.abs(F.try_divide((col(new) - col(old)) * 100.0, col(old)))


def overlap(a: Column, b: Column) -> Column:
    """Whether two closed intervals, struct(lo, hi), meet."""
    return (a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])


def joined_sorted(c: str | Column, sep: str = "|") -> Column:
    """Aggregate: distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(col(c).cast("string"))), sep)


def share_present(*cols: str) -> Column:
    """How many of these columns are not null, as a share."""
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) / F.lit(float(len(cols)))


#: Coefficients of a rational approximation of the normal quantile (P. J. Acklam), relative error below 1.2e-9.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: str | Column) -> Column:
    """The z below which a share p of the normal distribution lies; null outside (0, 1)."""
    x = col(p)
    tail = F.sqrt(F.log(F.least(x, 1.0 - x)) * -2.0)
    outer = _polynomial(_C, tail) / (_polynomial(_D, tail) * tail + 1.0)
    q = x - 0.5
    inner = _polynomial(_A, q * q) * q / (_polynomial(_B, q * q) * q * q + 1.0)
    return F.when((x <= 0) | (x >= 1), None).when(x < 0.02425, outer).when(x > 1 - 0.02425, -outer).otherwise(inner)


# ---- texts for tables and provenance ----


def first_label(*cols: str) -> Column:
    """The first of these that holds more than white space."""
    return F.coalesce(*[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in cols])


def to_percent(value: str | Column, unit: str | Column) -> Column:
    """Percentages as they are, proportions times 100; another unit is an error, a null one null."""
    v, u = col(value), F.lower(F.trim(col(unit)))
    bad = F.raise_error(F.concat(F.lit("unknown unit: "), u)).cast("double")
    return F.when(u.isNull(), None).when(u.isin("percent", "%"), v).when(u == "proportion", v * 100.0).otherwise(bad)


def fixed(x: str | Column, digits: int) -> Column:
    """A number with so many decimals, rounded half up, without thousands separators."""
    return F.round(col(x), digits).cast(f"decimal(28,{digits})").cast("string")


def count_text(n: str | Column, total: str | Column) -> Column:
    """n (p%) with one decimal."""
    return F.concat(col(n).cast("string"), F.lit(" ("), fixed(F.try_divide(col(n) * 100.0, col(total).cast("double")), 1), F.lit("%)"))


def spread_text(median: Column, low: Column, high: Column, digits: int = 1) -> Column:
    """median (low, high)."""
    return F.concat(fixed(median, digits), F.lit(" ("), fixed(low, digits), F.lit(", "), fixed(high, digits), F.lit(")"))


def p_text(p: str | Column) -> Column:
    """Three decimals, and <0.001 below that."""
    x = finite(p)
    return F.when(x < 0.001, "<0.001").otherwise(fixed(x, 3))


def provenance(*cols: str, sep: str = "; ") -> Column:
    """name=value of each column that is known, in this order."""
    return F.concat_ws(sep, *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in cols])


def json_of(entries: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def sentinel(value: str | Column, *codes: float) -> Column:
    """Codes that stand for a missing value as null."""
    return F.when(col(value).isin(*codes), None).otherwise(col(value))


def formula_like(text: str | Column) -> Column:
    """Whether a spreadsheet could take a text for a formula."""
    return F.coalesce(F.ltrim(col(text)).rlike(r"^[=+\-@\t\r]"), F.lit(False))


def plain_scalar(df_type: str, c: str | Column) -> Column:
    """A column of this type as one cell of a report: containers as JSON (maps with keys in order), scalars as they are."""
    if df_type.startswith("map<"):
        return json_of(col(c))
    return F.to_json(col(c)) if df_type.startswith(("array<", "struct<")) else col(c)


def period_role(period: str | Column, baseline: Sequence, disrupted: Sequence) -> Column:
    """baseline, disruption or primary_annual; null stays null."""
    p = col(period)
    return F.when(p.isNull(), None).when(p.isin(*baseline), "baseline").when(p.isin(*disrupted), "disruption").otherwise("primary_annual")


def association_sentence(subject: Column, n: Column, estimate: Column, low: Column, high: Column, scale: Column, forbidden: Sequence[str]) -> Column:
    """A sentence on an estimate and its interval; an error where subject or scale holds a forbidden term, in whatever case."""
    text = F.format_string("%s: %d areas, a difference of %.2f per %s (%.2f to %.2f). An association of areas, not of persons.", subject, n, estimate, scale, low, high)
    said = F.lower(F.concat_ws(" ", subject, scale))
    bad = F.lit(False)
    for term in forbidden:
        bad |= said.contains(term.lower())
    return F.when(bad, F.raise_error(F.concat(F.lit("forbidden term in: "), said))).otherwise(text)
