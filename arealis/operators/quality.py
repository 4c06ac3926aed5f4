"""Quality rules, each as a table of findings, column profiles and lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def findings(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(rule, key) of every broken rule, in one scan; a condition that is null is no finding."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def finding_counts(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(rule, findings) of all rules, zeros included."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, (_, c) in enumerate(rules)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("findings")) for i, (n, _) in enumerate(rules)])))


def more_than(a: str, b: str) -> Column:
    return F.col(a) > F.col(b)


def ratio_differs(numerator: str, denominator: str, ratio: str, tolerance: float = 1e-10) -> Column:
    n, d, r = F.col(numerator).cast("double"), F.col(denominator).cast("double"), F.col(ratio)
    return F.when(r.isNotNull() & n.isNotNull() & d.isNotNull(), (d == 0) | (F.abs(r - F.try_divide(n, d)) > tolerance))


def outside(c: str, allowed: Sequence) -> Column:
    return ~F.col(c).isin(*allowed)


def suppressed_as_zero(value: str, suppressed: Column) -> Column:
    """A value that is zero where it should be withheld: suppression shows as null, never as a count."""
    return F.coalesce(suppressed & (F.col(value) == 0), F.lit(False))


def varying(df: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """Groups with several values of c."""
    return df.groupBy(*by).agg(F.countDistinct(c).alias("values"), F.count("*").alias("rows")).where("values > 1")


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, rows, missing, distinct_values) of each column, from one aggregate."""
    cols = list(columns or df.columns)
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"c_{c}") for c in cols], *[F.countDistinct(c).alias(f"d_{c}") for c in cols])
    each = [F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("rows"), (F.col("_n") - F.col(f"c_{c}")).alias("missing"), F.col(f"d_{c}").alias("distinct_values")) for c in cols]
    return row.select(F.inline(F.array(*each)))


def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")


def require_unique(df: DataFrame, key: Sequence[str]) -> None:
    if not df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"rows repeat the key {list(key)}")


def field_lineage(mapping: DataFrame, target: str, sources: str) -> DataFrame:
    """(target, source, field) from a JSON map of target fields to 'source:field|source:field' lists."""
    rows = mapping.select(target, F.explode(F.from_json(sources, "map<string,string>")).alias("output_field", "_l"))
    rows = rows.select(target, "output_field", F.explode(F.split("_l", r"\|")).alias("_p"))
    part = F.split(F.trim("_p"), ":")
    return rows.select(target, "output_field", part[0].alias("source"), F.try_element_at(part, F.lit(2)).alias("field"))


def all_or_none(df: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """Groups in which c is null in some rows but not in all, or has several values: (by, rows, missing, values)."""
    out = df.groupBy(*by).agg(F.count("*").alias("rows"), (F.count("*") - F.count(c)).alias("missing"), F.countDistinct(c).alias("values"))
    return out.where("(missing > 0 AND missing < rows) OR values > 1")


def gate_report(counts: DataFrame, blocking: Sequence[str]) -> DataFrame:
    """finding_counts() with the severity of each rule and one state for all: blocked if a blocking rule has findings, review if another has, else passed."""
    rows = counts.withColumn("severity", F.when(F.col("rule").isin(*blocking), "blocking").otherwise("warning"))
    every = Window.partitionBy(F.lit(0))  # one row for each rule
    hard, any_ = (F.bool_or((F.col("findings") > 0) & c).over(every) for c in (F.col("severity") == "blocking", F.lit(True)))
    return rows.withColumn("state", F.when(hard, "blocked").when(any_, "review").otherwise("passed"))


def stale_flags(df: DataFrame, recorded: str, recalculated: Column) -> DataFrame:
    """Rows whose recorded flag isn't what the rule gives now, nulls told from values."""
    return df.withColumn("recalculated", recalculated).where(~F.col(recorded).eqNullSafe(F.col("recalculated")))


def lineage_gaps(columns: DataFrame, lineage: DataFrame, key: str) -> DataFrame:
    """Columns without lineage and lineage without a column: (key, problem)."""
    a, b = columns.select(key).distinct().withColumn("_a", F.lit(True)), lineage.select(key).distinct().withColumn("_b", F.lit(True))
    problem = F.when(F.col("_b").isNull(), "no_lineage").when(F.col("_a").isNull(), "no_column")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def recomputed(df: DataFrame, other: DataFrame, key: Sequence[str], tolerances: dict[str, float]) -> DataFrame:
    """(measure, rows, unmatched, largest, agrees) of figures worked out twice; a figure that only one side has is unmatched."""
    both = df.select(*key, *[F.col(c).cast("double").alias(f"a_{c}") for c in tolerances]).join(other.select(*key, *[F.col(c).cast("double").alias(f"b_{c}") for c in tolerances]), list(key), "full")
    rows = both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b"), F.lit(t).alias("most")) for c, t in tolerances.items()])))
    out = rows.groupBy("measure").agg(F.count("*").alias("rows"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("unmatched"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest"), F.max("most").alias("most"))
    return out.select("measure", "rows", "unmatched", "largest", ((F.col("unmatched") == 0) & (F.coalesce("largest", F.lit(0.0)) < F.col("most"))).alias("agrees"))


def claim_audit(claims: DataFrame, evidence: DataFrame, key: Sequence[str], tolerance: float) -> DataFrame:
    """claims (key, claimed) with the evidence's value and a status: supported, contradicted, or no_evidence."""
    rows = claims.join(evidence.select(*key, "value"), list(key), "left")
    status = F.when(F.col("value").isNull(), "no_evidence").when(F.abs(F.col("value") - F.col("claimed")) <= tolerance, "supported").otherwise("contradicted")
    return rows.withColumn("status", status)


def result_rules(names: dict[str, str], identity: str, name: str, denominator: str, figures: Sequence[str], authorised: str) -> list[tuple[str, Column]]:
    """Rules for result rows: known id, the id's own name, nonnegative denominator, finite figures where given, not authorised."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    bad = lambda c: F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return [
        ("unknown_id", F.coalesce(~F.col(identity).isin(*names), F.lit(True))),
        ("other_name", F.try_element_at(known, F.col(identity)) != F.coalesce(F.col(name), F.lit(""))),
        ("denominator", F.coalesce(F.col(denominator) < 0, F.lit(True))),
        ("authorised", F.coalesce(F.col(authorised), F.lit(True))),
        *[(f"{c}_not_finite", bad(c)) for c in figures],
    ]


def column_classes(names: DataFrame, c: str, rules: Sequence[tuple[str, str]], default: str) -> DataFrame:
    """names with a class: that of the first pattern (class, pattern) that the column's name matches."""
    out = F.lit(default)
    for kind, pattern in reversed(rules):
        out = F.when(F.col(c).rlike(pattern), kind).otherwise(out)
    return names.withColumn("class", out)


def not_run(expected: DataFrame, results: DataFrame, key: Sequence[str], reason: Column) -> DataFrame:
    """One row per expected key: status ran, or not_run with a reason and no figures."""
    rows = expected.join(results.withColumn("_ran", F.lit(True)), list(key), "left")
    ran = F.col("_ran").isNotNull()
    return rows.withColumns({"status": F.when(ran, "ran").otherwise("not_run"), "reason": F.when(~ran, reason)}).drop("_ran")
