"""Queries of the small-area operators over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as T
from ..operators import agreement, cohort, joins, linear, quality, ranking, resample, spatial
from ..sources.sinks import written
from .facts import FACTS, LEAST, PERIODS, SUPPRESSED_BELOW, facts, in_file_order, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, condition, pooled percentage of the contemporary periods, mean comparator and area."""
    also = [C.steady_mean("comparator").alias("comparator"), F.max("area").alias("area")]
    return cohort.ratio_of_sums(facts(spark, sf_dir), ["unit", "condition"], "numerator", "denominator", "period", PERIODS, LEAST, also=also)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.ranks_by_ranges(written(pooled(spark, sf_dir), "pooled"), {"pooled": "r", "comparator": "s"}, ["condition"])
    return rows.withColumns({"q": C.rank_quartile("r"), "p": C.rank_quartile("s")})


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# ---- cohorts ----


@query(f"WITH {FACTS} SELECT unit, condition, numerator, denominator, round(pooled, 6) AS pooled FROM pooled")
def ratio_of_sums(spark, sf_dir):
    return cohort.ratio_of_sums(facts(spark, sf_dir), ["unit", "condition"], "numerator", "denominator", "period", PERIODS, LEAST).select("unit", "condition", "numerator", "denominator", r6("pooled"))


@query(f"WITH {FACTS} SELECT condition, count(*) AS rows, count(DISTINCT unit) AS units, count(DISTINCT period) AS periods, count(*) FILTER (numerator < {SUPPRESSED_BELOW}) AS suppressed FROM facts GROUP BY ALL")
def shape_summary(spark, sf_dir):
    return cohort.shape_summary(facts(spark, sf_dir), ["condition"], "unit", "period", F.col("numerator") < SUPPRESSED_BELOW)


_STEPS = [("boundary", "TRUE"), ("contemporary", f"period IN {PERIODS}"), ("denominator", f"denominator >= {LEAST}"), ("observable", f"numerator >= {SUPPRESSED_BELOW}")]


@query("WITH " + FACTS + " UNION ALL ".join(f"SELECT condition, {i + 1}::INT AS step, '{n}' AS name, count(*) FILTER ({w}) AS rows, count(DISTINCT unit) FILTER ({w}) AS units FROM facts GROUP BY condition" for i, n, w in ((i, n, " AND ".join(c for _, c in _STEPS[: i + 1])) for i, (n, _) in enumerate(_STEPS))))
def cohort_cascade(spark, sf_dir):
    return cohort.cascade(facts(spark, sf_dir), ["condition"], "unit", [(n, F.expr(c)) for n, c in _STEPS])


@query("""SELECT l_partkey AS unit, year(l_shipdate) AS period FROM lineitem GROUP BY ALL
          HAVING list_sort(list(DISTINCT l_linestatus)) = ['F', 'O'] AND count(*) = 2 AND count(DISTINCT l_returnflag) = 1""")
def exact_component_pairs(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("unit"), F.year("l_shipdate").alias("period"), "l_linestatus", "l_returnflag")
    return cohort.with_exact_members(lines, ["unit", "period"], "l_linestatus", ["F", "O"], same="l_returnflag")


@query("""WITH areas AS (SELECT DISTINCT s_nationkey AS area FROM supplier), periods AS (SELECT DISTINCT l_shipdate::DATE::VARCHAR AS period FROM lineitem),
          n AS (SELECT s_nationkey AS area, l_shipdate::DATE::VARCHAR AS period, l_linestatus AS component, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
          SELECT area, period, sum(n)::BIGINT AS merged, coalesce(sum(n), 0)::BIGINT AS merged_or_zero, count(component) AS components
          FROM areas CROSS JOIN periods LEFT JOIN n USING (area, period) GROUP BY ALL""")
def merged_components(spark, sf_dir):
    """Sums of components on a full grid: null where nothing is known, and zero where the zero rule holds."""
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("period"), "l_linestatus")
    n = lines.join(suppliers, "l_suppkey").groupBy("area", "period").agg(F.count("*").alias("merged"), F.countDistinct("l_linestatus").alias("components"))
    skeleton = joins.grid(suppliers.select("area"), lines.select("period"))
    return joins.densified(n, skeleton, ["area", "period"]).select("area", "period", "merged", F.coalesce("merged", F.lit(0)).alias("merged_or_zero"), F.coalesce("components", F.lit(0)).alias("components"))


@query(f"WITH {FACTS} SELECT area, count(DISTINCT unit) AS units, round(avg(comparator), 6) AS outcome, round(sum(capture * weight) / sum(weight), 6) AS capture, round(sum(weight), 6) AS weight FROM facts WHERE period IN {PERIODS} GROUP BY area")
def area_frame(spark, sf_dir):
    rows = facts(spark, sf_dir).where(F.col("period").isin(*PERIODS))
    return rows.groupBy("area").agg(F.countDistinct("unit").alias("units"), F.round(F.avg("comparator"), 6).alias("outcome"), F.round(cohort.weighted_mean("capture", "weight"), 6).alias("capture"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"""WITH {FACTS} SELECT condition, period, count(*) AS rows, round(median(proportion), 6) AS median, round(quantile_cont(proportion, 0.75) - quantile_cont(proportion, 0.25), 6) AS iqr,
           round(count(*) FILTER (comparator IS NULL) * 100.0 / count(*), 6) AS missing_pct, round(count(*) FILTER (numerator < {SUPPRESSED_BELOW}) * 100.0 / count(*), 6) AS suppressed_pct,
           coalesce(array_to_string(list_sort(list(DISTINCT unit::VARCHAR) FILTER (numerator < {SUPPRESSED_BELOW})), '|'), '') AS suppressed_units FROM facts GROUP BY ALL""")
def quality_profile(spark, sf_dir):
    out = cohort.quality_profile(facts(spark, sf_dir), ["condition", "period"], "proportion", "unit", F.col("numerator") < SUPPRESSED_BELOW, F.col("comparator").isNull())
    return out.select("condition", "period", "rows", r6("median"), r6("iqr"), r6("missing_pct"), r6("suppressed_pct"), "suppressed_units")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
          SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM k) AS keys, (SELECT count(*) FROM k WHERE n > 1) AS repeated_keys, (SELECT max(n) FROM k) AS most_rows,
                 (SELECT count(*) FROM lineitem WHERE l_quantity <= 0 OR l_quantity IS NULL) AS bad_quantity, (SELECT count(*) FROM lineitem WHERE abs(l_discount) > 0.1) AS bad_discount,
                 (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) < 3)) AS units_without_all_conditions""")
def fact_audit(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    keys = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.max("n").alias("most_rows"))
    bad = lines.agg(F.count_if(F.coalesce(F.col("l_quantity") <= 0, F.lit(True))).alias("bad_quantity"), F.count_if(F.coalesce(F.abs("l_discount") > 0.1, F.lit(False))).alias("bad_discount"))
    short = lines.groupBy("l_suppkey").agg(F.countDistinct("l_returnflag").alias("c")).agg(F.count_if(F.col("c") < 3).alias("units_without_all_conditions"))
    return keys.crossJoin(bad).crossJoin(short)


@query(f"""WITH {FACTS}, up AS (SELECT area, condition, sum(numerator)::BIGINT AS rolled FROM facts GROUP BY ALL),
           published AS (SELECT s_nationkey AS area, l_returnflag AS condition, count(*) AS published FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
           SELECT area, condition, rolled, published, rolled = published AS matches FROM up FULL JOIN published USING (area, condition)""")
def rollup_reconciliation(spark, sf_dir):
    up = facts(spark, sf_dir).groupBy("area", "condition").agg(F.sum("numerator").alias("rolled"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    published = read(spark, sf_dir, "lineitem").join(suppliers, "l_suppkey").groupBy("area", F.col("l_returnflag").alias("condition")).agg(F.count("*").alias("published"))
    return up.join(published, ["area", "condition"], "full").withColumn("matches", F.col("rolled") == F.col("published"))


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS customers, count(*) FILTER (c_custkey IS NULL) AS unknown, count(*) FILTER (coalesce(n_regionkey, -1) NOT IN (0, 1)) AS out_of_scope FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def scope_audit(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("c_custkey").isNull()).alias("unknown"), F.count_if(~F.coalesce("n_regionkey", F.lit(-1)).isin(0, 1)).alias("out_of_scope"))


@query("""WITH w AS (SELECT l_partkey AS unit, s_nationkey AS area, sum(l_quantity) AS weight FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
          SELECT unit, arg_max(area, weight * 1000 - area) AS dominant, max(weight) AS top_weight, count(*) AS areas, count(*) > 1 AS crossing, array_to_string(list_sort(list(area)), ';') AS area_list,
                 round(max(weight) / sum(weight), 6) AS top_share FROM w GROUP BY unit""")
def dominant_area(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    w = read(spark, sf_dir, "lineitem").join(suppliers, "l_suppkey").groupBy(F.col("l_partkey").alias("unit"), "area").agg(F.sum("l_quantity").alias("weight"))
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x)
    return cohort.dominant_link(w, "unit", "area", "weight").select("unit", "dominant", "top_weight", "areas", "crossing", "area_list", F.round(F.col("top_weight") / total, 6).alias("top_share"))


@query("SELECT o_custkey AS customer, count(DISTINCT o_orderstatus) AS n_o_orderstatus, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1")
def metadata_conflicts(spark, sf_dir):
    return cohort.single_valued(read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer"), ["customer"], ["o_orderstatus", "o_orderpriority"])


# ---- ranks ----


@query(f"WITH {FACTS} SELECT unit, condition, round(r, 9) AS r, round(s, 9) AS s, q, p FROM quartiles")
def percentile_ranks(spark, sf_dir):
    return ranked(spark, sf_dir).select("unit", "condition", F.round("r", 9).alias("r"), F.round("s", 9).alias("s"), "q", "p")


@query(f"""WITH {FACTS}, cuts AS (SELECT condition, quantile_cont(pooled, 0.25) AS a, quantile_cont(pooled, 0.5) AS b, quantile_cont(pooled, 0.75) AS c FROM pooled GROUP BY condition)
           SELECT unit, condition, CASE WHEN pooled <= a THEN 1 WHEN pooled < b THEN 2 WHEN pooled < c THEN 3 ELSE 4 END AS bin FROM pooled JOIN cuts USING (condition) WHERE a < b AND b < c""")
def cut_point_bins(spark, sf_dir):
    rows = pooled(spark, sf_dir)
    cuts = ranking.cut_points(rows, "pooled", ["condition"])
    return rows.join(F.broadcast(cuts), "condition").select("unit", "condition", C.cut_bin("pooled", F.col("cuts")[0], F.col("cuts")[1], F.col("cuts")[2]).alias("bin"))


@query(f"""WITH {FACTS}, cuts AS (SELECT quantile_cont(proportion, 0.25) AS a, quantile_cont(proportion, 0.5) AS b, quantile_cont(proportion, 0.75) AS c FROM facts WHERE period = 1996)
           SELECT unit, condition, period, CASE WHEN proportion <= a THEN 1 WHEN proportion <= b THEN 2 WHEN proportion <= c THEN 3 ELSE 4 END AS quartile FROM facts, cuts WHERE period = 1997""")
def frozen_quartiles(spark, sf_dir):
    rows = facts(spark, sf_dir)
    cuts = ranking.cut_points(rows.where("period = 1996"), "proportion").first()
    quartile = C.frozen_quartile("proportion", cuts["cuts"]) if cuts else F.lit(None).cast("int")  # without three different cuts there are no quartiles
    return rows.where("period = 1997").select("unit", "condition", "period", quartile.alias("quartile"))


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
          x AS (SELECT *, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS difference FROM d), y AS (SELECT *, median(abs(difference)) OVER (PARTITION BY event_type) AS typical FROM x)
          SELECT event_type, day::VARCHAR AS day, n, difference, typical, CASE WHEN difference IS NULL THEN 'no_earlier' WHEN NOT day BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' THEN 'not_watched'
                 WHEN abs(difference) > 10 AND abs(difference) > 2 * typical THEN 'candidate' ELSE 'steady' END AS status FROM y""")
def disruption_flags(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    out = ranking.disruptions(days, "n", ["event_type"], "day", F.col("day").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date")), 10)
    return out.select("event_type", F.col("day").cast("string").alias("day"), "n", "difference", "typical", "status")


@query(f"WITH {FACTS} SELECT unit, condition, round((sum(pooled) OVER w - pooled) / nullif(count(*) OVER w - 1, 0), 6) AS others_mean, count(*) OVER w AS area_units FROM pooled WINDOW w AS (PARTITION BY condition, area)")
def leave_one_out(spark, sf_dir):
    return pooled(spark, sf_dir).select("unit", "condition", F.round(ranking.leave_one_out_mean("pooled", "condition", "area"), 6).alias("others_mean"), F.count("*").over(Window.partitionBy("condition", "area")).alias("area_units"))


@query("SELECT o_custkey AS customer, o_orderkey AS latest_order, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return ranking.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("latest_order"), F.col("o_totalprice").alias("price"))


@query("SELECT o_custkey AS customer, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderpriority <> '5-LOW') AS first_priority FROM orders GROUP BY 1")
def first_known_value(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return rows.groupBy(F.col("o_custkey").alias("customer")).agg(ranking.first_known("p", "o_orderkey").alias("first_priority"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS n FROM customer)
          SELECT ceil(n / 100.0)::BIGINT AS batch, count(*) AS rows, min(n) AS first_row, max(n) AS last_row, sum(c_custkey)::BIGINT AS keys FROM r GROUP BY 1""")
def numbered_batches(spark, sf_dir):
    rows = ranking.batches(read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], 100)
    return rows.groupBy("batch").agg(F.count("*").alias("rows"), F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"), F.sum("c_custkey").alias("keys"))


# ---- agreement ----

_DISCORD = "CASE WHEN r > 0.75 AND s > 0.75 THEN 'both_high' WHEN r > 0.75 AND s < 0.5 THEN 'first_high' WHEN s > 0.75 AND r < 0.5 THEN 'second_high' WHEN r <= 0.25 AND s <= 0.25 THEN 'both_low' ELSE 'other' END"


@query(f"WITH {FACTS}, d AS (SELECT condition, {_DISCORD} AS category FROM ranked), c AS (SELECT condition, category, count(*) AS n FROM d GROUP BY ALL) SELECT condition, category, n, round(n * 100.0 / sum(n) OVER (PARTITION BY condition), 6) AS share FROM c")
def discordance_by_rank(spark, sf_dir):
    counts = ranked(spark, sf_dir).groupBy("condition", C.discordance("r", "s").alias("category")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("condition")), 6))


@query(f"""WITH {FACTS}, cuts AS (SELECT condition, quantile_cont(pooled, [1/3.0, 1/2.0, 2/3.0]) AS a, quantile_cont(comparator, [1/3.0, 1/2.0, 2/3.0]) AS b FROM pooled GROUP BY condition),
           d AS (SELECT unit, condition, pooled >= a[3] AS ah, pooled <= a[1] AS al, pooled < a[2] AS am, comparator >= b[3] AS bh, comparator <= b[1] AS bl, comparator < b[2] AS bm FROM pooled JOIN cuts USING (condition))
           SELECT unit, condition, CASE WHEN ah AND bh THEN 'both_high' WHEN ah AND bm THEN 'first_high' WHEN bh AND am THEN 'second_high' WHEN al AND bl THEN 'both_low' ELSE 'other' END AS category FROM d""")
def discordance_by_cuts(spark, sf_dir):
    rows = pooled(spark, sf_dir)
    a, b = (ranking.cut_points(rows, c, ["condition"], (1 / 3, 1 / 2, 2 / 3), n) for c, n in (("pooled", "a"), ("comparator", "b")))
    d = rows.join(F.broadcast(a), "condition").join(F.broadcast(b), "condition")
    level = lambda c, k: (F.col(c) >= F.col(k)[2], F.col(c) <= F.col(k)[0], F.col(c) < F.col(k)[1])
    (ah, al, am), (bh, bl, bm) = level("pooled", "a"), level("comparator", "b")
    return d.select("unit", "condition", F.when(ah & bh, "both_high").when(ah & bm, "first_high").when(bh & am, "second_high").when(al & bl, "both_low").otherwise("other").alias("category"))


@query(f"WITH {FACTS} SELECT condition, count(*) AS n, round(corr(pooled, comparator), 6) AS pearson, round(corr(r, s), 6) AS spearman FROM ranked GROUP BY condition")
def correlations(spark, sf_dir):
    return agreement.correlation(written(pooled(spark, sf_dir), "pooled"), ["condition"], "pooled", "comparator").select("condition", "n", r6("pearson"), r6("spearman"))


@query(f"""WITH {FACTS}, c AS (SELECT condition, q, p, count(*) AS n FROM quartiles GROUP BY ALL), t AS (SELECT condition, sum(n) AS n FROM c GROUP BY 1),
           a AS (SELECT condition, q AS k, sum(n) AS m FROM c GROUP BY ALL), b AS (SELECT condition, p AS k, sum(n) AS m FROM c GROUP BY ALL),
           o AS (SELECT condition, sum(n * (q - p) ** 2)::DOUBLE AS seen, sum(n) FILTER (q = p)::DOUBLE AS agree FROM c GROUP BY 1),
           e AS (SELECT condition, sum(a.m * b.m * (a.k - b.k) ** 2)::DOUBLE AS expected FROM a JOIN b USING (condition) GROUP BY 1),
           l AS (SELECT unnest([1, 2, 3, 4]) AS k), g AS (SELECT t.condition, (coalesce(a.m, 0) + coalesce(b.m, 0)) / (2.0 * t.n)::DOUBLE AS pi FROM t CROSS JOIN l LEFT JOIN a ON a.condition = t.condition AND a.k = l.k LEFT JOIN b ON b.condition = t.condition AND b.k = l.k),
           h AS (SELECT condition, sum(pi * (1 - pi)) / 3 AS chance FROM g GROUP BY 1)
           SELECT condition, t.n::BIGINT AS n, round(1 - seen * t.n / expected, 6) AS kappa, round((coalesce(agree, 0) / t.n - chance) / (1 - chance), 6) AS ac1, round(coalesce(agree, 0) * 100 / t.n, 6) AS agreement
           FROM t JOIN o USING (condition) JOIN e USING (condition) JOIN h USING (condition)""")
def kappa_and_ac1(spark, sf_dir):
    t = agreement.crosstab(ranked(spark, sf_dir), ["condition"], "q", "p")
    same = sum((F.col("cells")[5 * i] for i in range(4)), F.lit(0))
    return t.select("condition", "n", F.round(agreement.weighted_kappa(t), 6).alias("kappa"), F.round(agreement.gwet_ac1(t), 6).alias("ac1"), F.round(same * 100.0 / F.col("n"), 6).alias("agreement"))


@query(f"""WITH {FACTS}, x AS (SELECT condition, area % 3 AS stratum, r, s FROM ranked)
           SELECT condition, coalesce(stratum::VARCHAR, 'overall') AS stratum, count(*) AS n, round(median(abs(r - s)), 6) AS median_gap, round(max(abs(r - s)), 6) AS largest_gap FROM x GROUP BY GROUPING SETS ((condition), (condition, stratum))""")
def agreement_strata(spark, sf_dir):
    rows = ranked(spark, sf_dir).withColumn("gap", F.abs(F.col("r") - F.col("s")))
    both = rows.withColumn("stratum", F.explode(F.array(F.lit("overall"), (F.col("area") % 3).cast("string"))))
    return both.groupBy("condition", "stratum").agg(F.count("*").alias("n"), F.round(F.median("gap"), 6).alias("median_gap"), F.round(F.max("gap"), 6).alias("largest_gap"))


@query(f"""WITH {FACTS}, x AS (SELECT unit, condition, exp(-abs(pooled - comparator * 600)) AS pv FROM pooled),
           y AS (SELECT *, pv * count(*) OVER (PARTITION BY condition) / (rank() OVER (PARTITION BY condition ORDER BY pv) + count(*) OVER (PARTITION BY condition, pv) - 1) AS raw FROM x)
           SELECT unit, condition, round(pv, 9) AS pv, round(least(1, min(raw) OVER (PARTITION BY condition ORDER BY pv DESC)), 9) AS p_adjusted FROM y""")
def false_discovery(spark, sf_dir):
    rows = written(pooled(spark, sf_dir).withColumn("pv", F.exp(-F.abs(F.col("pooled") - F.col("comparator") * 600))), "tests")
    return agreement.adjusted_by_ranges(rows, "pv", ["condition"]).select("unit", "condition", F.round("pv", 9).alias("pv"), F.round("p_adjusted", 9).alias("p_adjusted"))


@query(f"""WITH {FACTS}, g AS (SELECT condition, area, count(*) AS n, avg(pooled) AS m, var_pop(pooled) * count(*) AS s FROM pooled GROUP BY ALL),
           t AS (SELECT condition, sum(n)::DOUBLE AS n, count(*) AS k, sum(s) AS ssw, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum(n * n)::DOUBLE AS nn FROM g GROUP BY 1),
           v AS (SELECT condition, n, k, (n - nn / n) / nullif(k - 1, 0) AS n_bar, ssw / nullif(n - k, 0) AS within, ssb / nullif(k - 1, 0) AS msb FROM t),
           w AS (SELECT *, CASE WHEN isfinite((msb - within) / n_bar) THEN greatest(0, (msb - within) / n_bar) END AS between FROM v)
           SELECT condition, n::BIGINT AS n, k AS areas, round(n_bar, 6) AS n_bar, round(within, 6) AS within, round(between, 6) AS between, round(between / nullif(between + within, 0), 6) AS vpc FROM w""".replace("AS between", 'AS "between"').replace("round(between,", 'round("between",').replace("round(between /", 'round("between" /').replace("(between +", '("between" +'))
def variance_partition(spark, sf_dir):
    out = agreement.variance_partition(pooled(spark, sf_dir), ["condition"], "pooled", "area")
    return out.select("condition", "n", "areas", r6("n_bar"), r6("within"), r6("between"), r6("vpc"))


@query(f"""WITH {FACTS}, l AS (SELECT condition, pooled, (sum(pooled) OVER w - pooled) / nullif(count(*) OVER w - 1, 0) AS loo FROM pooled WINDOW w AS (PARTITION BY condition, area)),
           m AS (SELECT *, pooled >= quantile_cont(pooled, 0.75) OVER (PARTITION BY condition) AS high FROM l WHERE loo IS NOT NULL),
           k AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY loo) + (count(*) OVER (PARTITION BY condition, loo) - 1) / 2.0::DOUBLE AS rk FROM m)
           SELECT condition, count(*) FILTER (high) AS high, count(*) FILTER (NOT high) AS low,
                  round((sum(rk) FILTER (high) - count(*) FILTER (high) * (count(*) FILTER (high) + 1) / 2.0::DOUBLE) / (count(*) FILTER (high) * count(*) FILTER (NOT high))::DOUBLE, 6) AS auc FROM k GROUP BY condition""")
def label_separation(spark, sf_dir):
    return agreement.label_separation(pooled(spark, sf_dir), ["condition"], "pooled", "area").select("condition", "high", "low", r6("auc"))


# ---- across scales ----

_COARSE = f"""WITH {FACTS}, coarse AS (SELECT area, condition, sum(numerator) * 100.0::DOUBLE / sum(denominator)::DOUBLE AS pooled FROM facts WHERE period IN {PERIODS} AND denominator >= {LEAST} GROUP BY ALL),
    cr AS (SELECT *, (rank() OVER (PARTITION BY condition ORDER BY pooled) + (count(*) OVER (PARTITION BY condition, pooled) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY condition) AS cr FROM coarse),
    scales AS (SELECT quartiles.unit, quartiles.area, condition, r, q, cr, CASE WHEN cr <= 0.25 THEN 1 WHEN cr <= 0.5 THEN 2 WHEN cr <= 0.75 THEN 3 ELSE 4 END AS cq FROM quartiles JOIN cr USING (area, condition))"""


def both_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with their rank r and quartile q, and those of their area, cr and cq."""
    coarse = facts(spark, sf_dir).where(F.col("period").isin(*PERIODS) & (F.col("denominator") >= LEAST)).groupBy("area", "condition").agg((F.sum("numerator") * 100.0 / F.sum("denominator").cast("double")).alias("pooled_area"))
    coarse = ranking.ranks_by_ranges(written(coarse, "coarse"), {"pooled_area": "cr"}, ["condition"]).withColumn("cq", C.rank_quartile("cr"))
    return ranked(spark, sf_dir).join(coarse, ["area", "condition"])


@query(f"""{_COARSE}, l AS (SELECT unnest([1, 2, 3, 4]) AS k), s AS (SELECT condition, a.k AS cq, b.k AS q FROM (SELECT DISTINCT condition FROM scales) CROSS JOIN l a CROSS JOIN l b), n AS (SELECT condition, cq, q, count(*) AS n FROM scales GROUP BY ALL)
           SELECT condition, cq, q, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / sum(n) OVER (PARTITION BY condition), 6) AS pct FROM s LEFT JOIN n USING (condition, cq, q)""")
def resolution_matrix(spark, sf_dir):
    return cohort.transitions(both_scales(spark, sf_dir), ["condition"], "cq", "q", [1, 2, 3, 4]).select("condition", "cq", "q", "n", r6("pct"))


@query(_COARSE + " SELECT condition, cq, count(*) FILTER (q = 1) AS q1, count(*) FILTER (q = 2) AS q2, count(*) FILTER (q = 3) AS q3, count(*) FILTER (q = 4) AS q4 FROM scales GROUP BY ALL")
def resolution_heatmap(spark, sf_dir):
    out = both_scales(spark, sf_dir).groupBy("condition", "cq").pivot("q", [1, 2, 3, 4]).count()
    return out.select("condition", "cq", *[F.coalesce(str(k), F.lit(0)).alias(f"q{k}") for k in (1, 2, 3, 4)])


@query(_COARSE + " SELECT area, condition, count(*) AS units, count(DISTINCT q) AS quartiles FROM scales GROUP BY ALL HAVING bool_or(q = 1) AND bool_or(q = 4)")
def mixed_extremes(spark, sf_dir):
    out = both_scales(spark, sf_dir).groupBy("area", "condition").agg(F.count("*").alias("units"), F.countDistinct("q").alias("quartiles"), (F.bool_or(F.col("q") == 1) & F.bool_or(F.col("q") == 4)).alias("mixed"))
    return out.where("mixed").drop("mixed")


@query(_COARSE + " SELECT condition, count(*) AS units, count(*) FILTER (q <> cq) AS movers, round(count(*) FILTER (q <> cq) * 100.0 / count(*), 6) AS moved_pct, count(*) FILTER (q = 4 AND cq <> 4) AS hidden_high, round(median(abs(r - cr)), 6) AS median_shift FROM scales GROUP BY condition")
def aggregation_loss(spark, sf_dir):
    b = both_scales(spark, sf_dir)
    moved = F.count_if(F.col("q") != F.col("cq"))
    return b.groupBy("condition").agg(F.count("*").alias("units"), moved.alias("movers"), F.round(moved * 100.0 / F.count("*"), 6).alias("moved_pct"), F.count_if((F.col("q") == 4) & (F.col("cq") != 4)).alias("hidden_high"), F.round(F.median(F.abs(F.col("r") - F.col("cr"))), 6).alias("median_shift"))


_ANNUAL = f"""WITH {FACTS}, y AS (SELECT unit, condition, period, (rank() OVER (PARTITION BY condition, period ORDER BY proportion) + (count(*) OVER (PARTITION BY condition, period, proportion) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY condition, period) AS r FROM facts WHERE period IN {PERIODS}),
    yq AS (SELECT *, CASE WHEN r <= 0.25 THEN 1 WHEN r <= 0.5 THEN 2 WHEN r <= 0.75 THEN 3 ELSE 4 END AS q FROM y)"""


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(facts(spark, sf_dir).where(F.col("period").isin(*PERIODS)).select("unit", "condition", "period", "proportion"), "annual")
    rows = ranking.ranks_by_ranges(rows, {"proportion": "r"}, ["condition", "period"])
    return rows.select("unit", "condition", "period", C.rank_quartile("r").alias("q"))


@query(_ANNUAL + """ SELECT condition, round(CASE WHEN count(*) FILTER (a OR b) = 0 THEN 1 ELSE count(*) FILTER (a AND b) / count(*) FILTER (a OR b)::DOUBLE END, 6) AS jaccard FROM
    (SELECT unit, condition, coalesce(bool_or(q = 4) FILTER (period = 1996), false) AS a, coalesce(bool_or(q = 4) FILTER (period = 1997), false) AS b FROM yq GROUP BY ALL) GROUP BY condition""")
def annual_overlap(spark, sf_dir):
    high = lambda year: F.coalesce(F.bool_or(F.when(F.col("period") == year, F.col("q") == 4)), F.lit(False))
    flags = annual(spark, sf_dir).groupBy("unit", "condition").agg(high(1996).alias("a"), high(1997).alias("b"))
    return flags.groupBy("condition").agg(F.round(cohort.flag_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(_ANNUAL + """, c AS (SELECT unit, condition, q, count(*) AS n FROM yq GROUP BY ALL)
    SELECT unit, condition, CASE WHEN max(n) >= 2 THEN arg_max(q, n * 10 - q)::VARCHAR ELSE 'unstable' END AS persistence, max(n) AS times FROM c GROUP BY ALL""")
def persistence(spark, sf_dir):
    return cohort.persistent_state(annual(spark, sf_dir), ["unit", "condition"], "q")


@query(f"WITH {FACTS} SELECT area, condition, count(*) AS units, round(median(pooled), 6) AS median, round(quantile_cont(pooled, 0.75) - quantile_cont(pooled, 0.25), 6) AS iqr, round(max(pooled) - min(pooled), 6) AS spread, round(avg((q = 4)::INT), 6) AS top_share, bool_or(q = 1) AND bool_or(q = 4) AS coexist FROM quartiles GROUP BY ALL")
def within_area_spread(spark, sf_dir):
    q = F.percentile("pooled", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = ranked(spark, sf_dir).groupBy("area", "condition").agg(F.count("*").alias("units"), q.alias("c"), (F.max("pooled") - F.min("pooled")).alias("spread"), F.avg((F.col("q") == 4).cast("int")).alias("top_share"), (F.bool_or(F.col("q") == 1) & F.bool_or(F.col("q") == 4)).alias("coexist"))
    return out.select("area", "condition", "units", F.round(F.col("c")[1], 6).alias("median"), F.round(F.col("c")[2] - F.col("c")[0], 6).alias("iqr"), r6("spread"), r6("top_share"), "coexist")


# ---- resampling: with few draws, and as *_whole with as many as the reference ----

REPLICATES, PERMUTATIONS = 1000, 9999

_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_BOOT = f"""WITH {FACTS}, k AS (SELECT area, row_number() OVER (ORDER BY area) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT area FROM pooled)),
    slots AS (SELECT r.range::INT AS replicate, s.range AS slot, n FROM range(40) r, range(10000) s, (SELECT max(n) AS n FROM k) WHERE s.range < n),
    draws AS (SELECT replicate, {_DRAW.format("'17|' || replicate || '|' || slot")} % n AS i FROM slots), times AS (SELECT replicate, area, count(*) AS times FROM draws JOIN k USING (i) GROUP BY ALL)"""


@query(_BOOT + " SELECT replicate, condition, sum(times)::BIGINT AS units, round(sum(pooled * times) / sum(times), 6) AS mean FROM pooled JOIN times USING (area) GROUP BY ALL")
def cluster_bootstrap(spark, sf_dir, replicates=40):
    rows = resample.bootstrap_rows(pooled(spark, sf_dir), "area", replicates, 17)
    return rows.groupBy("replicate", "condition").agg(F.sum("times").alias("units"), F.round(F.sum(F.col("pooled") * F.col("times")) / F.sum("times"), 6).alias("mean"))


@query(_BOOT + """, b AS (SELECT replicate, condition, pooled, comparator, times FROM pooled JOIN times USING (area)),
    e AS (SELECT * FROM b, range(100) c WHERE c.range < times),
    g AS (SELECT replicate, condition, abs((rank() OVER (PARTITION BY replicate, condition ORDER BY pooled) + (count(*) OVER (PARTITION BY replicate, condition, pooled) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY replicate, condition)
          - (rank() OVER (PARTITION BY replicate, condition ORDER BY comparator) + (count(*) OVER (PARTITION BY replicate, condition, comparator) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY replicate, condition)) AS gap FROM e),
    m AS (SELECT replicate, condition, avg(gap) AS gap FROM g GROUP BY ALL)
    SELECT condition, count(*) AS estimable, round(quantile_cont(gap, 0.025), 6) AS lo, round(quantile_cont(gap, 0.975), 6) AS hi FROM m GROUP BY condition""")
def bootstrap_rank_gap(spark, sf_dir, replicates=40):
    """Ranks are taken anew in each replicate, with drawn clusters counted as often as they were drawn."""
    rows = written(pooled(spark, sf_dir).select("area", "condition", "pooled", "comparator"), "pooled")
    means = resample.rank_gap_draws(rows, ["condition"], "area", "pooled", "comparator", replicates, 17)
    return resample.percentile_interval(means, ["condition"], "gap").select("condition", "estimable", r6("lo"), r6("hi"))


@query(SQL["cluster_bootstrap"].replace("range(40)", f"range({REPLICATES})"))
def cluster_bootstrap_whole(spark, sf_dir):
    return cluster_bootstrap(spark, sf_dir, REPLICATES)


@query(SQL["bootstrap_rank_gap"].replace("range(40)", f"range({REPLICATES})"))
def bootstrap_rank_gap_whole(spark, sf_dir):
    return bootstrap_rank_gap(spark, sf_dir, REPLICATES)


_QUARTILE = "CASE WHEN {0} <= 0.25 THEN 1 WHEN {0} <= 0.5 THEN 2 WHEN {0} <= 0.75 THEN 3 ELSE 4 END"
_RANKED = "(rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {0})"
_SCALE_METRICS = f"median(abs(a - b)) AS median_gap, avg(abs(a - b)) AS mean_gap, 100.0::DOUBLE * avg(({_QUARTILE.format('a')} <> {_QUARTILE.format('b')})::INT) AS quartile_disagree, 100.0::DOUBLE * avg((({_QUARTILE.format('a')} = 4) <> ({_QUARTILE.format('b')} = 4))::INT) AS top_movement"


@query(_BOOT.replace("range(40)", f"range({REPLICATES})") + f""", coarse AS (SELECT area, condition, sum(numerator) * 100.0::DOUBLE / sum(denominator)::DOUBLE AS wide FROM facts WHERE period IN {PERIODS} AND denominator >= {LEAST} GROUP BY ALL),
    scaled AS (SELECT unit, pooled.area, condition, pooled, wide FROM pooled JOIN coarse USING (area, condition)), f AS (SELECT unit, area, condition, {_RANKED.format("condition", "pooled")} AS a FROM scaled),
    g AS (SELECT area, condition, {_RANKED.format("condition", "wide")} AS b FROM coarse), point AS (SELECT condition, {_SCALE_METRICS} FROM f JOIN g USING (area, condition) GROUP BY condition),
    fr AS (SELECT replicate, condition, area, {_RANKED.format("replicate, condition", "pooled")} AS a FROM scaled JOIN times USING (area), range(100) c WHERE c.range < times),
    gr AS (SELECT DISTINCT replicate, condition, area, b FROM (SELECT replicate, condition, area, {_RANKED.format("replicate, condition", "wide")} AS b FROM (SELECT DISTINCT area, condition, wide FROM scaled) JOIN times USING (area), range(100) c WHERE c.range < times)),
    m AS (SELECT replicate, condition, {_SCALE_METRICS} FROM fr JOIN gr USING (replicate, condition, area) GROUP BY ALL), l AS (UNPIVOT m ON median_gap, mean_gap, quartile_disagree, top_movement INTO NAME metric VALUE v), p AS (UNPIVOT point ON median_gap, mean_gap, quartile_disagree, top_movement INTO NAME metric VALUE v)
    SELECT condition, metric, round(any_value(p.v), 6) AS estimate, count(*) AS estimable, round(quantile_cont(l.v, 0.025), 6) AS lo, round(quantile_cont(l.v, 0.975), 6) AS hi FROM l JOIN p USING (condition, metric) GROUP BY condition, metric""")
def cross_scale_bootstrap(spark, sf_dir):
    """Ranks of units against those of their areas, with intervals over a thousand draws of areas."""
    rows = written(both_scales(spark, sf_dir), "scales")
    point = resample.scale_metrics(rows, ["condition"], "r", "cr", F.lit(1)).select("condition", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate")) for m in resample.SCALE_METRICS])))
    spans = resample.cross_scale_bootstrap(rows, ["condition"], "area", "pooled", "pooled_area", REPLICATES, 17)
    return point.join(spans, ["condition", "metric"]).select("condition", "metric", r6("estimate"), "estimable", r6("lo"), r6("hi"))


# ---- neighbourhoods: nations as unit cells of a grid of five ----

_CELLS = "cells AS (SELECT n_nationkey AS area, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation)"
_QUEEN = _CELLS + ", e AS (SELECT a.area AS src, b.area AS dst FROM cells a, cells b WHERE a.area <> b.area AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    corners = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
    ring = F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in corners])
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), x.alias("x"), y.alias("y"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"))


def area_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.avg("c_acctbal").alias("v"), F.count("*").cast("double").alias("u"))


_VALUES = "v AS (SELECT c_nationkey AS area, avg(c_acctbal) AS v, count(*)::DOUBLE AS u FROM customer GROUP BY 1), z AS (SELECT area, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z, (u - avg(u) OVER ()) / stddev_pop(u) OVER () AS o FROM v), w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e)"


@query(f"WITH {_QUEEN} SELECT * FROM e")
def queen_neighbours(spark, sf_dir):
    return spatial.contiguity(cells(spark, sf_dir), "area", "wkt")


@query(f"WITH {_CELLS} SELECT a.area AS src, b.area AS dst FROM cells a, cells b WHERE abs(a.x - b.x) + abs(a.y - b.y) = 1")
def rook_neighbours(spark, sf_dir):
    return spatial.contiguity(cells(spark, sf_dir), "area", "wkt", "rook")


@query(f"WITH {_CELLS} SELECT a.area AS src, b.area AS dst, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM cells a, cells b WHERE a.area <> b.area AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2.1")
def distance_band(spark, sf_dir):
    return spatial.distance_band(cells(spark, sf_dir), "area", "x", "y", 2.1).select("src", "dst", r6("distance"))


@query(f"WITH {_QUEEN}, d AS (SELECT area, count(src) AS d FROM cells LEFT JOIN e ON src = area GROUP BY 1) SELECT count(*) AS areas, (sum(d) // 2)::BIGINT AS edges, count(*) FILTER (d = 0) AS islands, min(d) AS least, avg(d) AS mean, max(d) AS most FROM d")
def graph_topology(spark, sf_dir):
    areas = cells(spark, sf_dir)
    return spatial.topology(spatial.contiguity(areas, "area", "wkt"), areas, "area")


@query(f"""WITH {_QUEEN}, {_VALUES}, i AS (SELECT area, row_number() OVER (ORDER BY area) AS i FROM z), n AS (SELECT count(*) AS n FROM z), obs AS (SELECT n * sum(w * a.z * b.z) / (sum(w) * n) AS moran FROM w JOIN z a ON a.area = src JOIN z b ON b.area = dst, n GROUP BY n),
           perm AS (SELECT r.range AS replicate, area, row_number() OVER (PARTITION BY r.range ORDER BY md5('29|' || r.range || '|' || area), area) AS i FROM z, range(99) r), dealt AS (SELECT replicate, perm.area, z.z FROM perm JOIN i USING (i) JOIN z ON z.area = i.area),
           drawn AS (SELECT a.replicate, sum(w * a.z * b.z) / sum(w) AS m FROM w JOIN dealt a ON a.area = src JOIN dealt b ON b.area = dst AND b.replicate = a.replicate GROUP BY 1)
           SELECT n, round(moran, 6) AS moran, round(-1.0 / (n - 1), 6) AS expected, count(*) FILTER (abs(m + 1.0 / (n - 1)) >= abs(moran + 1.0 / (n - 1)) - 1e-12) AS extreme,
                  round((count(*) FILTER (abs(m + 1.0 / (n - 1)) >= abs(moran + 1.0 / (n - 1)) - 1e-12) + 1) / 100.0, 6) AS p FROM obs, n, drawn GROUP BY n, moran""")
def moran_permutation(spark, sf_dir, permutations=99):
    w = written(spatial.row_standardised(spatial.contiguity(cells(spark, sf_dir), "area", "wkt")), "weights")  # the graph is built once
    return spatial.permutation_moran(area_values(spark, sf_dir), "area", "v", w, permutations, 29).select("n", r6("moran"), r6("expected"), "extreme", r6("p"))


@query(SQL["moran_permutation"].replace("range(99)", f"range({PERMUTATIONS})").replace("/ 100.0", f"/ {PERMUTATIONS + 1}.0"))
def moran_permutation_whole(spark, sf_dir):
    return moran_permutation(spark, sf_dir, PERMUTATIONS)


@query(f"""WITH {_QUEEN}, {_VALUES}, l AS (SELECT src AS area, sum(w * z.z) AS lag, sum(w * z.o) AS ol, sum(z.z) AS s, count(*) AS d FROM w JOIN z ON z.area = dst GROUP BY 1)
           SELECT area, round(z, 6) AS z, round(lag, 6) AS lag, round(z * lag, 6) AS local_moran, round(z * ol, 6) AS bivariate, round((s + z) / sqrt((d + 1) * (count(*) OVER () - (d + 1)) / (count(*) OVER () - 1.0::DOUBLE)), 6) AS gi_star,
                  CASE WHEN z >= 0 AND lag >= 0 THEN 'high_high' WHEN z < 0 AND lag < 0 THEN 'low_low' WHEN z >= 0 THEN 'high_low' ELSE 'low_high' END AS label FROM z JOIN l USING (area)""")
def local_indicators(spark, sf_dir):
    w = written(spatial.row_standardised(spatial.contiguity(cells(spark, sf_dir), "area", "wkt")), "weights")  # the graph is built once
    out = spatial.local_statistics(area_values(spark, sf_dir), "area", "v", w, "u")
    return out.select("area", *[r6(c) for c in ("z", "lag", "local_moran", "bivariate", "gi_star")], "label")


# ---- models ----


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("unit")).agg((F.avg("l_extendedprice") / 1000).alias("y"), (F.avg((F.col("l_returnflag") == "R").cast("int")) * 100).alias("x1"), (F.avg("l_discount") * 100).alias("x2"), F.avg("l_quantity").alias("x3"))


_MODEL = "m AS (SELECT l_suppkey AS unit, avg(l_extendedprice) / 1000 AS y, avg((l_returnflag = 'R')::INT) * 100 AS x1, avg(l_discount) * 100 AS x2, avg(l_quantity) AS x3 FROM lineitem GROUP BY 1)"


@query(f"""WITH {_MODEL}, s AS (SELECT count(*) AS n, avg(x1) AS mx, avg(y) AS my, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_sxx(y, x1) AS sxx FROM m),
           r AS (SELECT m.*, y - a - b * x1 AS e, 1.0::DOUBLE / n + (x1 - mx) ** 2 / sxx AS h, n, a, b, mx, sxx FROM m, s)
           SELECT any_value(n) AS n, round(any_value(a), 6) AS intercept, round(any_value(b), 6) AS slope, round(sqrt(sum((x1 - mx) ** 2 * e ** 2 / (1 - h) ** 2)) / any_value(sxx), 6) AS slope_se FROM r""")
def simple_regression_hc3(spark, sf_dir):
    fit = linear.least_squares(model_frame(spark, sf_dir), "y", ["x1"])
    return spark.createDataFrame([(fit.n, float(fit.beta[0]), float(fit.beta[1]), fit.contrast({"x1": 1.0})["se"])], "n long, intercept double, slope double, slope_se double").select("n", r6("intercept"), r6("slope"), r6("slope_se"))


@query(f"""WITH {_MODEL}, s AS (SELECT count(*) AS n, avg(x1) AS mx, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_sxx(y, x1) AS sxx FROM m),
           r AS (SELECT unit, y - a - b * x1 AS e, 1.0::DOUBLE / n + (x1 - mx) ** 2 / sxx AS h, n FROM m, s), t AS (SELECT *, sum(e * e) OVER () AS sse FROM r)
           SELECT unit, round(e, 6) AS residual, round(h, 6) AS leverage, round(e * e * h / (2 * sse / (n - 2) * (1 - h) ** 2), 6) AS cook, round(e / sqrt((sse - e * e / (1 - h)) / (n - 3) * (1 - h)), 6) AS studentised,
                  e * e * h / (2 * sse / (n - 2) * (1 - h) ** 2) > 4.0 / n AS high_cook FROM t""")
def influence_measures(spark, sf_dir):
    out = linear.influence(model_frame(spark, sf_dir), "unit", "y", ["x1"])
    return out.select("unit", *[r6(c) for c in ("residual", "leverage", "cook", "studentised")], "high_cook")


@query(f"""WITH {_MODEL} SELECT unit, round((x1 - avg(x1) OVER ()) / (quantile_cont(x1, 0.75) OVER () - quantile_cont(x1, 0.25) OVER ()), 6) AS x1, round((x3 - avg(x3) OVER ()) / stddev_samp(x3) OVER (), 6) AS x3 FROM m""")
def scaled_predictors(spark, sf_dir):
    rows = model_frame(spark, sf_dir)
    return linear.scaled(rows, linear.scaling(rows, ["x1"], ["x3"])).select("unit", r6("x1"), r6("x3"))


@query(f"""WITH {_MODEL}, c AS (SELECT count(*) AS n, count(DISTINCT x1) AS d1, count(DISTINCT x2) AS d2, quantile_cont(x1, 0.75) - quantile_cont(x1, 0.25) AS i1, quantile_cont(x2, 0.75) - quantile_cont(x2, 0.25) AS i2, corr(x1, x2) AS r FROM m)
           SELECT 'x1' AS predictor, n, d1 AS "distinct", round(i1, 6) AS iqr, round(abs(r), 6) AS largest_r, round(1 / (1 - r * r), 6) AS vif, n >= 70 AND d1 >= 10 AND i1 > 0 AND abs(r) <= 0.8 AND 1 / (1 - r * r) <= 5 AS passes FROM c
           UNION ALL SELECT 'x2', n, d2, round(i2, 6), round(abs(r), 6), round(1 / (1 - r * r), 6), n >= 70 AND d2 >= 10 AND i2 > 0 AND abs(r) <= 0.8 AND 1 / (1 - r * r) <= 5 FROM c""")
def collinearity_gates(spark, sf_dir):
    """Gates of two predictors. Doubles' averages hang on the order of their sums, and x2's are counted, so its sums follow the files' rows.

    So does the SQL on one thread; on more, its count of x2 differs from run to run.
    """
    lines = in_file_order(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("_unit"), "l_discount"))
    upto = Window.partitionBy("_unit").orderBy("_file", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = lines.withColumn("_sum", F.sum("l_discount").over(upto)).groupBy("_unit").agg((F.max_by("_sum", F.struct("_file", "_row")) / F.count("l_discount") * 100).alias("x2"))
    frame = model_frame(spark, sf_dir).drop("x2").join(sums, F.col("unit").eqNullSafe(F.col("_unit"))).select("unit", "y", "x1", "x2")
    rows = linear.gates(frame, "y", ["x1", "x2"])
    out = spark.createDataFrame([(r["predictor"], r["n"], r["distinct"], r["iqr"], r["largest_r"], r["vif"], r["passes"]) for r in rows], "predictor string, n long, distinct long, iqr double, largest_r double, vif double, passes boolean")
    return out.select("predictor", "n", "distinct", r6("iqr"), r6("largest_r"), r6("vif"), "passes")


# ---- scalar functions ----


@query("""SELECT o_orderkey AS k, lower(replace(trim(o_orderpriority), ' ', '_')) AS slug, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'urgent' ELSE 'other' END AS family,
          CASE WHEN o_custkey < 10 THEN NULL ELSE o_custkey::DOUBLE END AS number, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS mapped,
          CASE WHEN length(o_custkey::VARCHAR) < 5 THEN lpad(o_custkey::VARCHAR, 5, '0') ELSE o_custkey::VARCHAR END AS padded,
          CASE WHEN o_custkey % 100 < 10 THEN lpad((o_custkey % 100)::VARCHAR, 2, '0') ELSE (o_custkey % 100)::VARCHAR END AS area FROM orders""")
def identifier_cleansing(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    raw = F.when(F.col("o_custkey") < 10, "<10").otherwise(F.format_number("o_custkey", 0))
    return o.select(F.col("o_orderkey").alias("k"), C.slug("o_orderpriority").alias("slug"), C.by_prefix("o_orderpriority", {"1": "urgent", "2": "urgent"}, "other").alias("family"), C.number(raw).alias("number"), C.mapped("o_orderstatus", {"F": "final", "O": "open"}).alias("mapped"), C.padded(F.col("o_custkey").cast("string"), 5).alias("padded"), C.area_id(F.concat(F.lit("1714000-"), (F.col("o_custkey") % 100).cast("string")), "1714000-").alias("area"))


@query(f"""WITH {FACTS}, x AS (SELECT unit, condition, period, denominator, CASE WHEN numerator % 7 = 0 THEN NULL ELSE greatest(numerator - 12, 0) END AS n, proportion FROM facts),
           y AS (SELECT *, CASE WHEN n IS NULL THEN 'unavailable' WHEN n = 0 THEN 'unresolved_zero' WHEN n < 10 THEN 'below_threshold' END AS reason FROM x)
           SELECT unit, condition, period, reason, coalesce(reason, CASE WHEN denominator < {LEAST} THEN 'small_denominator' ELSE 'eligible' END) AS exclusion, reason IS NULL AND n IS NOT NULL AND denominator >= {LEAST} AS eligible FROM y""")
def suppression_rules(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("n", F.when(F.col("numerator") % 7 == 0, None).otherwise(F.greatest(F.col("numerator") - 12, F.lit(0)))).withColumn("reason", C.suppression_reason("n", "proportion"))
    return rows.select("unit", "condition", "period", "reason", C.exclusion_reason("reason", "proportion", "denominator", LEAST).alias("exclusion"), C.eligible(F.lit(True), F.lit(True), F.col("reason").isNotNull(), "n", "denominator", LEAST).alias("eligible"))


@query("""WITH i AS (SELECT p_partkey AS k, '(' || p_size || '.5, ' || (p_size + 10) || ')' AS t, p_size + 0.5 AS lo, p_size + 10.0 AS hi, p_retailprice / 100 AS e FROM part)
          SELECT k, round(lo, 6)::DOUBLE AS lo, round(hi, 6)::DOUBLE AS hi, e BETWEEN lo AND hi AS inside, round(greatest(0, e - 1.96 * 3), 6) AS clamped_lo, round(least(100, e + 1.96 * 3), 6) AS clamped_hi, round(abs((hi - lo) * 100 / lo), 6)::DOUBLE AS change FROM i""")
def interval_parsing(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), C.interval(F.format_string("(%d.5, %d)", "p_size", F.col("p_size") + 10)).alias("i"), (F.col("p_retailprice") / 100).alias("e"))
    c = C.clamped_interval("e", F.lit(3.0))
    return p.select("k", "i.lo", "i.hi", C.overlap(F.col("i"), F.struct(F.col("e").alias("lo"), F.col("e").alias("hi"))).alias("inside"), F.round(c["lo"], 6).alias("clamped_lo"), F.round(c["hi"], 6).alias("clamped_hi"), F.round(C.percent_change("i.hi", "i.lo"), 6).alias("change"))


# ---- text ----

_WORDS = "regexp_extract_all({}, '[A-Za-z][A-Za-z''-]*')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w, len(regexp_extract_all(text, '\\d+')) AS numbers FROM documents)
           SELECT doc_id, len(w) AS n_words, numbers AS n_numbers, len(list_filter(w, lambda x: regexp_matches(lower(x), '(tion|ment|ness|ity)$'))) AS n_nominal,
                  coalesce(list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')) - (CASE WHEN regexp_matches(lower(x), 'e$') AND NOT regexp_matches(lower(x), 'le$') AND len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END), 1))), 0)::BIGINT AS n_syllables FROM w""")
def text_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.array_join(T.words(F.col("text")), " ").alias("w"))
    return d.select("doc_id", T.word_count("w").cast("long").alias("n_words"), F.regexp_count("text", F.lit(r"\d+")).cast("long").alias("n_numbers"), T.nominal_count("w").cast("long").alias("n_nominal"), T.syllable_count("w").cast("long").alias("n_syllables"))


@query(f"""WITH s AS (SELECT doc_id, {_WORDS.format('text')} AS w, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len({_WORDS.format('x')}) >= 4) AS s,
                  list_filter(regexp_split_to_array(text, '\\n[ \\t\\n\\x0B\\f\\r]*\\n'), lambda x: len({_WORDS.format('x')}) >= 8) AS p FROM documents)
           SELECT doc_id, len(s) AS n_sentences, len(p) AS n_paragraphs, round(len(w) / nullif(len(s), 0)::DOUBLE, 6) AS words_per_sentence FROM s""")
def text_structure(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.size(T.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"), F.round(F.try_divide(F.size(T.words(F.col("text"))).cast("double"), F.size(s).cast("double")), 6).alias("words_per_sentence"))


_TERMS = ["the", "from", "token", "with"]


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{t}\\b') THEN '{t}' END" for t in _TERMS) + "], lambda x: x IS NOT NULL), '|') AS terms FROM documents")
def term_scan(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.term_hits(F.col("text"), _TERMS), "|").alias("terms"))


# ---- joins, sets, quality ----


@query("SELECT coalesce(c.c_custkey, o.o_custkey) AS k, CASE WHEN c.c_custkey IS NULL THEN 'right_only' WHEN o.o_custkey IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c.c_custkey = o.o_custkey")
def key_reconciliation(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return joins.reconciled(a, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""SELECT d.source, count(*) AS documents, count(quality) AS labelled, count(*) FILTER (toxic = 1) AS toxic, (SELECT count(*) FROM documents x ANTI JOIN labels USING (doc_id) WHERE x.source = d.source) AS unlabelled
          FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.source""")
def label_coverage(spark, sf_dir):
    d, labels = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels")
    rows = joins.checked_join(d, labels, ["doc_id"], "left", "1:1").groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    left = d.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("unlabelled"))
    return rows.join(left, "source", "left").fillna({"unlabelled": 0})


@query("""SELECT 'customer' AS kind, c_custkey AS k, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_by_name(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"))
    return c.unionByName(s, allowMissingColumns=True)


@query(SQL["union_by_name"])
def union_by_name_whole(spark, sf_dir):
    return union_by_name(spark, sf_dir)


@query("""SELECT s_nationkey AS area, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS conditions, array_to_string(list_sort(list(DISTINCT year(l_shipdate)::VARCHAR)), '|') AS periods FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def sorted_value_lists(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    return read(spark, sf_dir, "lineitem").join(s, "l_suppkey").groupBy("area").agg(C.joined_sorted("l_returnflag").alias("conditions"), C.joined_sorted(F.year("l_shipdate")).alias("periods"))


@query("SELECT event_type, count(*) AS events, sum((props->>'k')::BIGINT)::BIGINT AS k_sum, count(*) FILTER ((props->>'k')::INT >= 50) AS high FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return read(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("k_sum"), F.count_if(F.col("k") >= 50).alias("high"))


_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values FROM orders" for c in _PROFILED))
def column_profile(spark, sf_dir):
    return quality.profile(read(spark, sf_dir, "orders"), _PROFILED)


@query("""SELECT 'price_over_limit' AS rule, count(*) FILTER (l_extendedprice > 90000) AS findings FROM lineitem UNION ALL SELECT 'unknown_flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
          UNION ALL SELECT 'tax_above_discount', count(*) FILTER (l_tax > l_discount) FROM lineitem UNION ALL SELECT 'ratio_differs', count(*) FILTER (abs(l_discount - l_tax / l_quantity) > 0.05) FROM lineitem""")
def quality_findings(spark, sf_dir):
    rules = [("price_over_limit", F.col("l_extendedprice") > 90000), ("unknown_flag", quality.outside("l_returnflag", ["A", "N"])), ("tax_above_discount", quality.more_than("l_tax", "l_discount")), ("ratio_differs", quality.ratio_differs("l_tax", "l_quantity", "l_discount", 0.05))]
    return quality.finding_counts(read(spark, sf_dir, "lineitem"), rules)


@query("SELECT l_orderkey AS k, count(DISTINCT l_linestatus) AS values, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def varying_values(spark, sf_dir):
    return quality.varying(read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k"), ["k"], "l_linestatus")


@query("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS events, count(*) FILTER (value >= 10) AS eligible FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf_dir):
    from ..streaming.cohorts import windowed_counts

    out = windowed_counts(read(spark, sf_dir, "events"), "event_type", "value", 10)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events", "eligible")


@query("SELECT c_custkey AS customer, (floor((c_custkey * 37 % 499 + 0.5) / 100) + 5 * floor((c_custkey * 91 % 499 + 0.5) / 100))::INT AS area FROM customer")
def points_in_areas(spark, sf_dir):
    at = lambda k: (F.col("c_custkey") * k % 499 + 0.5) / 100.0
    points = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), at(37).alias("px"), at(91).alias("py"))
    return spatial.covering_areas(points, "customer", "px", "py", cells(spark, sf_dir), "area", "wkt")


@query("""WITH s AS (SELECT c_nationkey AS candidate, c_mktsegment AS domain, count(*) FILTER (c_custkey % 2 = 0) AS a, count(*) FILTER (c_custkey % 2 = 1) AS b FROM customer GROUP BY ALL)
          SELECT candidate, count(*) AS domains, sum(a)::BIGINT AS first_total, sum(b)::BIGINT AS second_total, (sum(a) + sum(b)) / 2.0::DOUBLE AS mean_total, count(*) FILTER (a = b) AS agreed FROM s GROUP BY candidate""")
def two_rater_totals(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("candidate"), F.col("c_mktsegment").alias("domain"), "c_custkey")
    rated = [c.where(F.col("c_custkey") % 2 == k).groupBy("candidate", "domain").agg(F.count("*").alias(n)) for k, n in ((0, "a"), (1, "b"))]
    both = joins.checked_join(*rated, ["candidate", "domain"], "full", "1:1").fillna(0)
    return both.groupBy("candidate").agg(F.count("*").alias("domains"), F.sum("a").alias("first_total"), F.sum("b").alias("second_total"), ((F.sum("a") + F.sum("b")) / 2.0).alias("mean_total"), F.count_if(F.col("a") == F.col("b")).alias("agreed"))
