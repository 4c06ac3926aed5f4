"""More queries and their SQL: files written and read back, texts of tables, joins with context, audits, screening, refits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as T
from ..operators import agreement, cohort, joins, linear, quality, ranking
from ..sources import pipe, sinks
from .catalogue import model_frame, pooled, query, r6
from .facts import FACTS, LEAST, PERIODS, SUPPRESSED_BELOW, facts, read

# ---- files, written to a scratch folder and read back ----


#: Rows of a file.
FILE_ROWS = 1000


def _lines(rows: DataFrame, name: str, key: str | None = None, head: str | None = None) -> str:
    """rows' column value as lines of text files; with key, files of a thousand numbers each, in order, a head before each."""
    path = sinks.scratch_path(rows.sparkSession, name)
    if key is None:
        rows.select("value").write.text(path)
        return path
    rows = rows.select(F.floor(F.col(key) / FILE_ROWS).alias("part"), F.col(key).cast("long").alias("_k"), "value")
    if head is not None:
        rows = rows.unionByName(rows.select("part").distinct().select("part", F.lit(-1).cast("long").alias("_k"), F.lit(head).alias("value")))
    rows.repartition("part").sortWithinPartitions("part", "_k").drop("_k").write.partitionBy("part").text(path)
    return path


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def pipe_lenient_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    lines = n.select(F.explode(F.array(F.concat_ws("|", "n_nationkey", F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")), "n_regionkey"), F.lit("   "))).alias("value"))
    return pipe.read_lenient(spark, _lines(lines, "pipe"), ["k", "name", "region"])


@query("""SELECT c_custkey AS k, nullif(c_acctbal, 0) AS balance, c_nationkey % 2 = 0 AS even, TIMESTAMP '2024-01-02 03:04:05' AS at,
          row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) AS source_row FROM customer""")
def pipe_strict_rows(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    balance = F.when(F.col("c_acctbal") == 0, F.lit(pipe.NULL)).otherwise(F.col("c_acctbal").cast("string"))
    lines = c.select("c_custkey", F.concat_ws("|", "c_custkey", balance, F.when(F.col("c_nationkey") % 2 == 0, "t").otherwise("f"), F.lit("2024-01-02T03:04:05Z")).alias("value"))
    fields = [pipe.Field("k", "long", False), pipe.Field("balance", "double"), pipe.Field("even", "boolean"), pipe.Field("at", "timestamp")]
    return pipe.read_strict(spark, _lines(lines, "strict", "c_custkey"), fields, ["k"]).select("k", "balance", "even", F.col("at").cast("timestamp_ntz").alias("at"), F.col("source_row").cast("long").alias("source_row"))


@query("SELECT k, count(*) AS rows, min(n) AS first_row, max(n) AS last_row FROM (SELECT s_nationkey AS k, row_number() OVER (PARTITION BY s_suppkey // 1000 ORDER BY s_suppkey) AS n FROM supplier) GROUP BY k HAVING count(*) > 1")
def repeated_source_keys(spark, sf_dir):
    lines = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("value"))
    rows = pipe.read_strict(spark, _lines(lines, "keys", "s_suppkey"), [pipe.Field("k", "long", False)])
    return pipe.repeated_rows(rows, ["k"]).select(F.col("k").cast("int").alias("k"), "rows", F.col("first_row").cast("long").alias("first_row"), F.col("last_row").cast("long").alias("last_row"))


@query("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS rows, '2,3' AS widths")
def pipe_widths(spark, sf_dir):
    three = read(spark, sf_dir, "nation").select(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    two = read(spark, sf_dir, "region").select(F.concat_ws("|", "r_regionkey", "r_name").alias("value"))
    return pipe.widths(spark, _lines(three.union(two), "widths")).select("rows", F.array_join("widths", ",").alias("widths"))


@query("SELECT p_partkey::VARCHAR AS part_id, p_name || ', \"' || p_brand || '\"' AS label FROM part")
def header_csv_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""'), F.col("p_brand"), F.lit('"""')).alias("q"))
    lines = rows.select("k", F.concat_ws(",", "k", "q").alias("value"))
    return pipe.read_header_csv(spark, _lines(lines, "csv", "k", "\ufeffpart_id,label"), ["part_id", "label"]).select("part_id", "label")


@query("SELECT 'present' AS which, count(*) AS rows FROM region UNION ALL SELECT 'absent', 0")
def optional_table_rows(spark, sf_dir):
    schema = "r_regionkey int, r_name string"
    tables = (("present", f"{sf_dir}/region.parquet"), ("absent", f"{sf_dir}/no_such_table.parquet"))
    out = [pipe.optional_parquet(spark, path, schema).agg(F.lit(name).alias("which"), F.count("*").alias("rows")) for name, path in tables]
    return out[0].unionByName(out[1])


@query("SELECT n_regionkey::VARCHAR || lpad(n_nationkey::VARCHAR, 3, '0') AS record_id, n_name AS name FROM nation")
def json_matrix_rows(spark, sf_dir):
    row = F.array(F.col("n_name"), F.col("n_regionkey").cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    pages = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(row).alias("rows"))
    pages = pages.select(F.to_json(F.concat(F.array(F.array(F.lit("NAME"), F.lit("state"), F.lit("tract"))), "rows")).alias("page"))
    return pipe.json_matrix(pages, "page", ["state", "tract"]).select("record_id", F.col("values")["NAME"].alias("name"))


@query("SELECT n_name AS name, n_nationkey::VARCHAR AS number, 'Polygon' AS geometry_type, '[[[' || n_nationkey || ',0],[1,1],[0,1]]]' AS coordinates FROM nation")
def geojson_polygons(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    feature = F.concat(F.lit('{"properties":{"name":"'), "n_name", F.lit('","number":"'), "n_nationkey", F.lit('"},"geometry":{"type":"Polygon","coordinates":[[['), "n_nationkey", F.lit(",0],[1,1],[0,1]]]}}"))
    pages = n.groupBy("n_regionkey").agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("page"))
    return pipe.geojson_features(pages, "page", "name string, number string")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def published_rows(spark, sf_dir):
    path = sinks.scratch_path(spark, "published")
    sinks.publish(read(spark, sf_dir, "supplier"), path, ["s_suppkey"], ["s_suppkey", "s_name", "s_acctbal"])
    return spark.read.parquet(path)


@query("SELECT o_orderkey AS k, round(o_totalprice / 3, 6) AS third FROM orders")
def twelve_digit_csv(spark, sf_dir):
    path = sinks.scratch_path(spark, "digits")
    sinks.write_csv(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 3).alias("third")), path, ["k"])
    rows = spark.read.option("header", True).schema("k long, third double").csv(path)
    return rows.select("k", r6("third"))


# ---- texts and flags ----


@query("""SELECT n_nationkey AS k, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_nationkey % 3 = 1 THEN r_name END, n_nationkey::VARCHAR) AS label,
          n_nationkey % 3 = 0 AS has_name, n_nationkey % 3 = 1 AS has_region FROM nation JOIN region ON r_regionkey = n_regionkey""")
def label_fallbacks(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("n_nationkey").alias("k"), F.when(F.col("k") % 3 == 0, F.col("n_name")).alias("a"), F.when(F.col("k") % 3 == 1, F.col("r_name")).otherwise("  ").alias("b"))
    return rows.select("k", C.first_label("a", "b", "k").alias("label"), F.col("a").isNotNull().alias("has_name"), (F.trim("b") != "").alias("has_region"))


@query("SELECT o_orderkey AS k, o_orderkey % 5 IN (0, 1, 2) AS yes FROM orders")
def boolean_texts(spark, sf_dir):
    texts = F.array(F.lit(" TRUE"), F.lit("1"), F.lit("Yes "), F.lit("no"), F.lit(None).cast("string"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), C.flag(texts[(F.col("o_orderkey") % 5).cast("int")]).alias("yes"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN round(p_size, 6)::DOUBLE ELSE round(p_size * (CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 100 END), 6)::DOUBLE END AS percent FROM part")
def units_to_percent(spark, sf_dir):
    units = F.array(F.lit("percent"), F.lit("Proportion "), F.lit("%"), F.lit(None).cast("string"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(C.to_percent(F.col("p_size").cast("double"), units[(F.col("p_partkey") % 4).cast("int")]), 6).alias("percent"))


@query("""WITH s AS (SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS n, count(*) AS total, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1)
          SELECT priority, n || ' (' || round(n * 100.0 / total, 1)::DECIMAL(28, 1) || '%)' AS final, round(m, 1)::DECIMAL(28, 1) || ' (' || round(a, 1)::DECIMAL(28, 1) || ', ' || round(b, 1)::DECIMAL(28, 1) || ')' AS price,
                 CASE WHEN n / total::DOUBLE / 1000 < 0.001 THEN '<0.001' END AS p_small, (round(n / total::DOUBLE, 3)::DECIMAL(28, 3))::VARCHAR AS p FROM s""")
def display_texts(spark, sf_dir):
    q = F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count("*").alias("total"), q.alias("q"))
    share = F.col("n") / F.col("total").cast("double")
    return s.select("priority", C.count_text("n", "total").alias("final"), C.spread_text(F.col("q")[1], F.col("q")[0], F.col("q")[2]).alias("price"), C.p_text(share / 1000).alias("p_small"), C.p_text(share).alias("p"))


@query("""SELECT c_custkey AS k, concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN 'segment=' || c_mktsegment END, 'nation=' || c_nationkey) AS source,
          '{"nation":"' || c_nationkey || '","segment":"' || c_mktsegment || '"}' AS fields FROM customer""")
def provenance_texts(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"), "c_mktsegment")
    fields = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("nation").cast("string"))
    return c.select("k", C.provenance("segment", "nation").alias("source"), C.json_of(fields).alias("fields"))


@query("""WITH x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN -999.0::DOUBLE ELSE p_size / 50.0::DOUBLE END AS rank, CASE WHEN p_partkey % 7 = 0 THEN '=1+' || p_name ELSE p_name END AS name FROM part)
          SELECT k, nullif(rank, -999) AS rank, coalesce(nullif(rank, -999) NOT BETWEEN 0 AND 1, false) AS out_of_range, k % 7 = 0 AS formula FROM x""")
def official_value_checks(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 10 == 0, -999.0).otherwise(F.col("p_size") / 50.0).alias("v"), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("=1+"), "p_name")).otherwise(F.col("p_name")).alias("name"))
    rank = C.sentinel("v", -999.0)
    return p.select("k", rank.alias("rank"), F.coalesce(~rank.between(0, 1), F.lit(False)).alias("out_of_range"), C.formula_like("name").alias("formula"))


_W = "regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')"


@query(f"""WITH d AS (SELECT doc_id, {_W} AS w, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '[A-Za-z][A-Za-z''-]*')) >= 4)) AS s,
           len(regexp_extract_all(text, '(?i)\\b(?:is|are|was|were|be|been|being)[ \\t\\n\\x0B\\f\\r]+[a-z]+ed\\b')) AS passive, len(regexp_extract_all(text, '\\d+')) AS numbers FROM documents)
           SELECT doc_id, len(w)::INT AS n_words, s::INT AS n_sentences, round(passive / nullif(s, 0)::DOUBLE, 6) AS passive_share, round(numbers / nullif(len(w), 0)::DOUBLE, 6) AS numeric_share,
                  round(len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{h}'" for h in T.HEDGES)}))) / nullif(len(w), 0)::DOUBLE, 6) AS hedge_share FROM d""")
def section_metrics(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    m = T.section_metrics(F.col("text"))
    return d.select("doc_id", m["n_words"].alias("n_words"), m["n_sentences"].alias("n_sentences"), *[F.round(m[c], 6).alias(c) for c in ("passive_share", "numeric_share", "hedge_share")])


# ---- joins with context ----


@query("""SELECT s_suppkey AS unit, n_name AS area, r_name AS region, count(l_orderkey) AS lines, round(sum(l_quantity), 6) AS quantity FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
          LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""")
def checked_context(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("n_nationkey"))
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    totals = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    areas = joins.checked_join(joins.checked_join(s, n, ["n_nationkey"], "inner"), r, ["n_regionkey"], "inner")
    return joins.checked_join(areas, totals, ["unit"], "left", "1:1").select("unit", F.col("n_name").alias("area"), F.col("r_name").alias("region"), F.coalesce("lines", F.lit(0)).alias("lines"), r6("quantity"))


@query(f"""WITH {FACTS}, o AS (SELECT n_nationkey AS place, 1996 + n_regionkey % 3 AS outcome_period, n_nationkey * 1.5::DOUBLE AS outcome FROM nation)
           SELECT unit, condition, area, place, period, outcome_period, outcome FROM facts LEFT JOIN o ON place = area AND outcome_period = period""")
def outcome_by_period(spark, sf_dir):
    o = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), (F.lit(1996) + F.col("n_regionkey") % 3).alias("outcome_period"), (F.col("n_nationkey") * 1.5).alias("outcome"))
    return joins.joined_by_other_name(facts(spark, sf_dir), o, {"area": "place", "period": "outcome_period"}).select("unit", "condition", "area", "place", "period", "outcome_period", "outcome")


@query("""WITH y AS (SELECT s_nationkey AS area, year(l_shipdate)::VARCHAR AS period, avg(l_discount) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
          SELECT n_nationkey AS area, period AS latest_period, round(v, 6) AS latest_value FROM nation LEFT JOIN (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY area ORDER BY period DESC) = 1) l ON l.area = n_nationkey""")
def latest_outcome(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    y = read(spark, sf_dir, "lineitem").join(s, "l_suppkey").groupBy("area", F.year("l_shipdate").cast("string").alias("latest_period")).agg(F.round(F.avg("l_discount"), 6).alias("latest_value"))
    areas = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"))
    return joins.checked_join(areas, ranking.latest(y, ["area"], ["latest_period"]), ["area"])


_MEASURES = {"A": "RETURNED", "R": "REFUSED"}


@query(f"""WITH {FACTS}, m AS (SELECT area, CASE condition WHEN 'A' THEN 'RETURNED' WHEN 'R' THEN 'REFUSED' END AS measure, sum(numerator)::BIGINT AS public FROM facts GROUP BY ALL)
           SELECT unit, condition, period, measure, public FROM (SELECT *, CASE condition WHEN 'A' THEN 'RETURNED' WHEN 'R' THEN 'REFUSED' END AS measure FROM facts) LEFT JOIN (SELECT * FROM m WHERE measure IS NOT NULL) USING (area, measure)""")
def comparator_by_measure(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("measure", C.mapped("condition", _MEASURES))
    m = f.where("measure IS NOT NULL").groupBy("area", "measure").agg(F.sum("numerator").alias("public"))
    return joins.checked_join(f, m, ["area", "measure"]).select("unit", "condition", "period", "measure", "public")


@query("""SELECT n_nationkey AS area, suppliers, customers, round(balance, 6) AS balance, orders, lines FROM nation
          FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) a USING (n_nationkey) FULL JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer GROUP BY 1) b USING (n_nationkey)
          FULL JOIN (SELECT c_nationkey AS n_nationkey, avg(c_acctbal) AS balance FROM customer GROUP BY 1) c USING (n_nationkey) FULL JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) d USING (n_nationkey)
          FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) e USING (n_nationkey)""")
def five_aggregates(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "area")
    suppliers = read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "area")
    orders = read(spark, sf_dir, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), "area"), "o_custkey").groupBy("area").agg(F.count("*").alias("orders"))
    lines = read(spark, sf_dir, "lineitem").join(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "area"), "l_suppkey").groupBy("area").agg(F.count("*").alias("lines"))
    frames = [read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area")), suppliers.groupBy("area").agg(F.count("*").alias("suppliers")), customers.groupBy("area").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 6).alias("balance")), orders, lines]
    return joins.joined_outer(frames, ["area"])


@query(f"WITH {FACTS} SELECT unit, condition, period, numerator FROM facts SEMI JOIN pooled USING (unit, condition)")
def eligible_pairs(spark, sf_dir):
    return facts(spark, sf_dir).join(pooled(spark, sf_dir).select("unit", "condition").distinct(), ["unit", "condition"], "left_semi").select("unit", "condition", "period", "numerator")


# ---- frames and audits ----


@query(f"WITH {FACTS} SELECT unit, period, round(proportion, 6) AS proportion FROM facts WHERE condition = 'R' AND period IN {PERIODS} AND numerator >= {SUPPRESSED_BELOW} AND denominator >= {LEAST}")
def one_condition_frame(spark, sf_dir):
    rows = cohort.condition_frame(facts(spark, sf_dir), "R", PERIODS, "proportion", F.col("numerator") < SUPPRESSED_BELOW, F.col("denominator") >= LEAST)
    return rows.select("unit", "period", r6("proportion"))


@query(f"""WITH {FACTS}, m AS (SELECT unit, condition, avg(proportion) AS v, avg(comparator) AS o FROM facts WHERE period IN {PERIODS} GROUP BY ALL HAVING count(DISTINCT period) = 3)
           SELECT unit, condition, round(v, 6) AS value, round(o, 6) AS other, round(v - o, 6) AS difference, round(abs(v - o), 6) AS distance FROM m""")
def pooled_comparison(spark, sf_dir):
    out = cohort.pooled_comparison(facts(spark, sf_dir), ["unit", "condition"], "proportion", "comparator", "period", PERIODS)
    return out.select("unit", "condition", *[r6(c) for c in ("value", "other", "difference", "distance")])


@query(f"""WITH {FACTS}, y AS (SELECT condition, period, count(*) FILTER (denominator >= {LEAST}) * 100.0 / count(*) AS a, count(*) FILTER (numerator < {SUPPRESSED_BELOW}) * 100.0 / count(*) AS s, avg(proportion) AS v FROM facts GROUP BY ALL)
           SELECT condition, count(*) AS periods, round(avg(a), 6) AS available_mean, round(median(a), 6) AS available_median, round(avg(s), 6) AS suppressed_mean, round(median(s), 6) AS suppressed_median, round(avg(v), 6) AS value_mean FROM y GROUP BY condition""")
def annual_availability(spark, sf_dir):
    out = cohort.availability(facts(spark, sf_dir), ["condition"], "period", F.col("denominator") >= LEAST, F.col("numerator") < SUPPRESSED_BELOW, "proportion")
    return out.select("condition", "periods", *[r6(c) for c in ("available_mean", "available_median", "suppressed_mean", "suppressed_median", "value_mean")])


@query(f"""WITH {FACTS}, x AS (SELECT unit, condition, exp(-abs(pooled - comparator * 600)) AS pv FROM pooled), y AS (SELECT *, pv * count(*) OVER (PARTITION BY condition) / (rank() OVER (PARTITION BY condition ORDER BY pv) + count(*) OVER (PARTITION BY condition, pv) - 1) AS raw FROM x),
           z AS (SELECT unit, condition, pv, least(1, min(raw) OVER (PARTITION BY condition ORDER BY pv DESC)) AS q FROM y)
           SELECT condition, count(*) AS tests, count(*) FILTER (pv < 0.05) AS raw_hits, count(*) FILTER (q < 0.05) AS survivors, coalesce(array_to_string(list_sort(list(unit::VARCHAR) FILTER (q < 0.05)), '|'), '') AS units FROM z GROUP BY condition""")
def fdr_survivors(spark, sf_dir):
    tests = sinks.written(pooled(spark, sf_dir).withColumn("pv", F.exp(-F.abs(F.col("pooled") - F.col("comparator") * 600))), "tests")  # read again, the same to the last bit
    rows = agreement.adjusted_by_ranges(tests, "pv", ["condition"])
    hit = F.coalesce(F.col("p_adjusted") < 0.05, F.lit(False))
    return rows.groupBy("condition").agg(F.count("pv").alias("tests"), F.count_if(F.col("pv") < 0.05).alias("raw_hits"), F.count_if(hit).alias("survivors"), C.joined_sorted(F.when(hit, F.col("unit"))).alias("units"))


@query(f"""WITH {FACTS}, k AS (SELECT unit, condition, period, count(*) AS n FROM facts GROUP BY ALL), d AS (SELECT unit, period FROM facts GROUP BY ALL HAVING count(DISTINCT denominator) > 1)
           SELECT metric, value FROM (SELECT count(*) AS input_rows, count(*) FILTER (period IN {PERIODS}) AS selected_rows, count(*) FILTER (period NOT IN {PERIODS}) AS excluded_rows, count(DISTINCT unit) AS units, count(DISTINCT condition) AS conditions, count(DISTINCT period) AS periods,
           count(*) FILTER (numerator IS NULL) AS missing_numerator, count(*) FILTER (denominator IS NULL) AS missing_denominator, count(*) FILTER (comparator IS NULL) AS missing_comparator, count(*) FILTER (numerator < {SUPPRESSED_BELOW}) AS suppressed, count(*) FILTER (denominator < {LEAST}) AS small_denominator,
           count(*) FILTER (numerator > denominator) AS numerator_above, count(*) FILTER (abs(proportion - numerator / denominator::DOUBLE) > 1e-12) AS ratio_mismatch, (SELECT count(*) FROM k WHERE n > 1) AS repeated_keys, (SELECT count(*) FROM d) AS varying_denominators FROM facts)
           UNPIVOT (value FOR metric IN (input_rows, selected_rows, excluded_rows, units, conditions, periods, missing_numerator, missing_denominator, missing_comparator, suppressed, small_denominator, numerator_above, ratio_mismatch, repeated_keys, varying_denominators))""")
def fifteen_metric_audit(spark, sf_dir):
    f = facts(spark, sf_dir)
    chosen = F.col("period").isin(*PERIODS)
    row = f.agg(
        F.count("*").alias("input_rows"), F.count_if(chosen).alias("selected_rows"), F.count_if(~chosen).alias("excluded_rows"), F.countDistinct("unit").alias("units"), F.countDistinct("condition").alias("conditions"), F.countDistinct("period").alias("periods"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("numerator", "denominator", "comparator")],
        F.count_if(F.col("numerator") < SUPPRESSED_BELOW).alias("suppressed"), F.count_if(F.col("denominator") < LEAST).alias("small_denominator"), F.count_if(quality.more_than("numerator", "denominator")).alias("numerator_above"), F.count_if(quality.ratio_differs("numerator", "denominator", "proportion", 1e-12)).alias("ratio_mismatch"),
    )
    row = row.crossJoin(joins.repeated_keys(f, ["unit", "condition", "period"]).agg(F.count("*").alias("repeated_keys"))).crossJoin(quality.varying(f, ["unit", "period"], "denominator").agg(F.count("*").alias("varying_denominators")))
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns])))


@query("""WITH c AS (SELECT 'tax_above_discount' AS rule, count(*) FILTER (l_tax > l_discount) AS findings FROM lineitem UNION ALL SELECT 'unknown_flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem UNION ALL SELECT 'no_quantity', count(*) FILTER (l_quantity <= 0) FROM lineitem),
          s AS (SELECT *, CASE WHEN rule = 'tax_above_discount' THEN 'warning' ELSE 'blocking' END AS severity FROM c)
          SELECT rule, findings, severity, CASE WHEN bool_or(findings > 0 AND severity = 'blocking') OVER () THEN 'blocked' WHEN bool_or(findings > 0) OVER () THEN 'review' ELSE 'passed' END AS state FROM s""")
def gate_report(spark, sf_dir):
    rules = [("tax_above_discount", quality.more_than("l_tax", "l_discount")), ("unknown_flag", quality.outside("l_returnflag", ["A", "N", "R"])), ("no_quantity", F.col("l_quantity") <= 0)]
    return quality.gate_report(quality.finding_counts(read(spark, sf_dir, "lineitem"), rules), ["unknown_flag", "no_quantity"])


@query("""WITH x AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS v FROM orders)
          SELECT k, count(*) AS rows, count(*) - count(v) AS missing, count(DISTINCT v) AS values FROM x GROUP BY k HAVING (count(*) > count(v) AND count(v) > 0) OR count(DISTINCT v) > 1""")
def all_or_none_values(spark, sf_dir):
    return quality.all_or_none(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("v")), ["k"], "v")


@query(f"""WITH {FACTS}, x AS (SELECT unit, condition, period, CASE WHEN unit % 11 = 0 THEN NULL ELSE denominator >= {LEAST} AND unit % 5 <> 0 END AS recorded, numerator >= {SUPPRESSED_BELOW} AND denominator >= {LEAST} AS recalculated FROM facts)
           SELECT * FROM x WHERE recorded IS DISTINCT FROM recalculated""")
def stale_flags(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("recorded", F.when(F.col("unit") % 11 != 0, (F.col("denominator") >= LEAST) & (F.col("unit") % 5 != 0)))
    return quality.stale_flags(rows, "recorded", (F.col("numerator") >= SUPPRESSED_BELOW) & (F.col("denominator") >= LEAST)).select("unit", "condition", "period", "recorded", "recalculated")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'no_lineage' ELSE 'no_column' END AS problem FROM (SELECT DISTINCT user_id AS k FROM events) a
          FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def lineage_gaps(spark, sf_dir):
    return quality.lineage_gaps(read(spark, sf_dir, "events").select(F.col("user_id").alias("k")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""SELECT source, count(*) AS records, count(quality) AS screened, count(*) FILTER (quality = 1) AS included, count(*) FILTER (quality = 0 AND toxic = 1) AS excluded_with_reason, count(*) FILTER (quality = 0 AND toxic = 0) AS excluded_without,
          count(*) FILTER (quality = 1 AND toxic = 1) AS broken_rule FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def screening_counts(spark, sf_dir):
    d = joins.checked_join(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), ["doc_id"], "left", "1:1")
    n = lambda c: F.count_if(F.coalesce(F.expr(c), F.lit(False)))
    return d.groupBy("source").agg(F.count("*").alias("records"), F.count("quality").alias("screened"), n("quality = 1").alias("included"), n("quality = 0 AND toxic = 1").alias("excluded_with_reason"), n("quality = 0 AND toxic = 0").alias("excluded_without"), n("quality = 1 AND toxic = 1").alias("broken_rule"))


@query("""WITH declared AS (SELECT role AS query, count(*) AS declared FROM conversations GROUP BY 1), found AS (SELECT role AS query, count(DISTINCT conv_id) AS found FROM conversations GROUP BY 1)
          SELECT query, declared, found, declared = found AS matches, (SELECT count(DISTINCT conv_id) FROM conversations) AS union_ids FROM declared JOIN found USING (query)""")
def search_reconciliation(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    by_query = c.groupBy(F.col("role").alias("query")).agg(F.count("*").alias("declared"), F.countDistinct("conv_id").alias("found"))
    return by_query.crossJoin(c.agg(F.countDistinct("conv_id").alias("union_ids"))).withColumn("matches", F.col("declared") == F.col("found"))


# ---- ranks, bins and refits ----


@query(f"WITH {FACTS} SELECT unit, condition, round(r, 9) AS r FROM ranked")
def ranks_by_ranges(spark, sf_dir):
    """percentile_ranks() without a window over a whole condition."""
    return ranking.average_ranks(pooled(spark, sf_dir), "pooled", ["condition"]).select("unit", "condition", F.round("r", 9).alias("r"))


@query("SELECT p_partkey AS k, (p_size > 10 AND p_size <= 25)::INT AS bin_1, (p_size > 25 AND p_size <= 40)::INT AS bin_2, (p_size > 40)::INT AS bin_3 FROM part")
def bin_indicators(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *ranking.bin_indicators("p_size", [10, 25, 40]))


@query("""WITH m AS (SELECT s_suppkey AS k, s_acctbal AS v, (row_number() OVER (ORDER BY s_acctbal) - 0.5::DOUBLE) / count(*) OVER () AS p FROM supplier) SELECT k, v, round(p, 6) AS p FROM m""")
def normal_scores(spark, sf_dir):
    """The place that each value's normal score stands for; the score itself is turned back by a plain error function in tests."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    z = rows.withColumn("z", ranking.normal_scores("v"))

    @F.pandas_udf("double")
    def below(z):
        import math

        return z.map(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))

    return z.select("k", "v", F.round(below("z"), 6).alias("p"))


@query("SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 3 ELSE 1000000 END AS place FROM orders")
def mapped_order(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), ranking.by_mapped_rank({"1-URGENT": 1, "2-HIGH": 2, "5-LOW": 3}, "o_orderpriority").alias("place"))


@query(f"WITH {FACTS} SELECT condition, period, count(*) AS n, round(regr_slope(comparator, proportion), 6) AS slope FROM facts GROUP BY ALL HAVING count(*) > 5")
def annual_slopes(spark, sf_dir):
    return linear.slopes(facts(spark, sf_dir), ["condition", "period"], "comparator", "proportion").where("n > 5").select("condition", "period", "n", r6("slope"))


@query(f"""WITH {FACTS}, p AS (SELECT DISTINCT period AS part FROM facts) SELECT condition, part AS period, count(*) AS n, round(regr_slope(comparator, proportion), 6) AS slope FROM facts JOIN p ON part <> period
           SEMI JOIN (SELECT DISTINCT condition AS c, period AS d FROM facts) k ON k.c = condition AND k.d = part GROUP BY ALL""")
def leave_one_year_out(spark, sf_dir):
    return linear.leave_one_out_slopes(facts(spark, sf_dir), ["condition"], "period", "comparator", "proportion").select("condition", "period", "n", r6("slope"))


@query("""WITH m AS (SELECT l_suppkey AS unit, avg(l_extendedprice) / 1000 AS y, avg((l_returnflag = 'R')::INT) * 100 AS x1, avg(l_discount) * 100 AS x2, avg(l_quantity) AS x3 FROM lineitem GROUP BY 1)
          SELECT 'x1' AS predictor, count(*) AS n, round(regr_slope(y, x1), 6) AS slope FROM m UNION ALL SELECT 'x2', count(*), round(regr_slope(y, x2), 6) FROM m UNION ALL SELECT 'x3', count(*), round(regr_slope(y, x3), 6) FROM m""")
def unadjusted_slopes(spark, sf_dir):
    long = model_frame(spark, sf_dir).select("y", F.inline(F.array(*[F.struct(F.lit(c).alias("predictor"), F.col(c).alias("x")) for c in ("x1", "x2", "x3")])))
    return linear.slopes(long, ["predictor"], "y", "x").select("predictor", "n", r6("slope"))


# ---- projections and collapses ----


@query("SELECT DISTINCT c_nationkey::VARCHAR AS area_id, c_mktsegment AS period FROM customer")
def outcome_projection(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(C.area_id(F.concat(F.lit("1714000-"), "c_nationkey"), "1714000-", 1).alias("area_id"), F.col("c_mktsegment").alias("period"))
    return rows.dropDuplicates(["area_id", "period"])


@query("SELECT 'supplier' AS source, s_nationkey AS area, count(*) AS tests FROM supplier GROUP BY 2 UNION ALL SELECT 'customer', c_nationkey, count(*) FROM customer GROUP BY 2")
def metric_inventory(spark, sf_dir):
    of = lambda t, c: read(spark, sf_dir, t).groupBy(F.col(c).alias("area")).agg(F.count("*").alias("tests")).withColumn("source", F.lit(t))
    return of("supplier", "s_nationkey").unionByName(of("customer", "c_nationkey"))


@query("""SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, bool_or(o_orderstatus = 'P') AS any_partial, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1""")
def collapsed_models(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    return cohort.collapsed(rows, ["k"], [("o_orderpriority", "o_orderkey")], [("any_partial", F.col("o_orderstatus") == "P")], ["o_totalprice"])


@query("SELECT doc_id, round(((text IS NOT NULL)::INT + (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT) / 3.0::DOUBLE, 6) AS present FROM documents")
def presence_share(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(C.share_present("text", "lang", "source"), 6).alias("present"))
