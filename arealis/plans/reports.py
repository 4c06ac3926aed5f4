"""Queries on the way from summaries to reports: probes, checked files, allocation, evidence, claims, selection; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as T
from ..operators import agreement, cohort, joins, linear, quality, resample, spatial
from ..sources import pipe, sinks
from ..sources.sinks import written
from .catalogue import _DRAW, _QUEEN, area_values, cells, pooled, query, r6, ranked
from .facts import FACTS, LEAST, facts, read
from .records import _lines

# ---- files ----


@query("SELECT c_nationkey AS k, CASE WHEN c_nationkey % 5 < 3 THEN count(*) ELSE -1 END AS n FROM customer GROUP BY 1")
def probed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, form = F.col("n").cast("string"), F.col("k") % 5
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    page = F.when(form == 0, F.concat(F.lit('[{"count": "'), n, F.lit('"}]'))).when(form == 1, F.concat(F.lit("count\n"), n, F.lit("\n")))
    page = page.when(form == 2, F.concat(F.lit('{"type": "FeatureCollection", "features": [{"properties": {"count": '), n, F.lit("}}]}")))
    page = page.when(form == 3, F.concat(F.lit('[{"count": "0'), n, F.lit('"}]'))).otherwise(F.concat(F.lit('{"count": '), n, F.lit("}")))
    return rows.select("k", F.coalesce(pipe.probed_count(page), F.lit(-1)).alias("n"))  # -1: the page states none


_LINKS = ("zone", "tract", "land", "water")


@query("SELECT lpad(c_nationkey::VARCHAR, 5, '0') AS zone, lpad(c_custkey::VARCHAR, 11, '0') AS tract, c_custkey::VARCHAR AS land, '0' AS water FROM customer")
def relationship_rows(spark, sf_dir):
    line = F.concat_ws("|", F.lpad(F.col("c_nationkey").cast("string"), 5, "0"), F.lpad(F.col("c_custkey").cast("string"), 11, "0"), "c_custkey", F.lit("0")).alias("value")
    lines = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), line)
    return pipe.read_headed(spark, _lines(lines, "links", "k", "\ufeff" + "|".join(_LINKS)), _LINKS, {"zone": r"(\d{5})?", "tract": r"\d{11}", "land": r"\d+", "water": r"\d+"})


@query("SELECT p_partkey, p_name FROM part")
def verified_json_rows(spark, sf_dir):
    path = sinks.scratch_path(spark, "json")
    read(spark, sf_dir, "part").select("p_partkey", "p_name").write.json(path)
    ledger = written(pipe.checksums(spark, path + "/*.json").select("path", "sha256"), "ledger")  # taken once, when the files are published
    return pipe.read_verified_json(spark, path + "/*.json", "p_partkey long, p_name string", ledger)


# ---- cells of reports ----


@query("""SELECT r_regionkey AS k, '["' || r_name || '","' || r_regionkey || '"]' AS listed, '{"a":"' || r_name || '","b":"x"}' AS mapped, r_name AS plain FROM region""")
def plain_scalars(spark, sf_dir):
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.array("r_name", F.col("r_regionkey").cast("string")).alias("listed"), F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("r_name")).alias("mapped"), F.col("r_name").alias("plain"))
    return r.select("k", *[C.plain_scalar(t, c).alias(c) for c, t in r.dtypes if c != "k"])


@query("""SELECT n_nationkey AS k, 'Nation ' || n_name || ': ' || n || ' areas, a difference of ' || printf('%.2f', n / 4.0) || ' per unit (' || printf('%.2f', n / 8.0) || ' to ' || printf('%.2f', n / 2.0)
          || '). An association of areas, not of persons.' AS sentence FROM nation JOIN (SELECT c_nationkey, count(*) * 4 AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def association_sentences(spark, sf_dir):
    n = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.count("*") * 4).alias("n"))
    text = C.association_sentence(F.concat(F.lit("Nation "), "n_name"), F.col("n"), F.col("n") / 4, F.col("n") / 8, F.col("n") / 2, F.lit("unit"), ("caused by", "leads to"))
    return read(spark, sf_dir, "nation").join(n, "n_nationkey").select(F.col("n_nationkey").alias("k"), text.alias("sentence"))


@query("SELECT column_name AS name, CASE WHEN column_name LIKE '%key' THEN 'identifier' WHEN column_name LIKE '%date' THEN 'period' WHEN regexp_matches(column_name, '(price|discount|tax|quantity)$') THEN 'measure' ELSE 'attribute' END AS class FROM (DESCRIBE SELECT * FROM lineitem)")
def column_classes(spark, sf_dir):
    names = spark.createDataFrame([(c,) for c in read(spark, sf_dir, "lineitem").columns], "name string")
    return quality.column_classes(names, "name", [("identifier", "key$"), ("period", "date$"), ("measure", "(price|discount|tax|quantity)$")], "attribute")


@query(f"""WITH {FACTS} SELECT CASE WHEN period = 1996 THEN 'baseline' WHEN period IN (1994, 1995) THEN 'disruption' ELSE 'primary_annual' END AS role, count(*) AS rows,
           count(DISTINCT unit) FILTER (denominator < {LEAST}) AS small_units, min(unit || '|' || condition || '|' || period) AS first_candidate FROM facts GROUP BY 1""")
def period_roles(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("role", C.period_role("period", (1996,), (1994, 1995)))
    return rows.groupBy("role").agg(F.count("*").alias("rows"), F.count_distinct(F.when(F.col("denominator") < LEAST, F.col("unit"))).alias("small_units"), F.min(F.concat_ws("|", "unit", "condition", "period")).alias("first_candidate"))


# ---- allocation and ranges ----


@query("""WITH p AS (SELECT c_mktsegment AS unit, c_nationkey AS area, count(*) AS w FROM customer GROUP BY ALL), s AS (SELECT *, w / sum(w) OVER (PARTITION BY unit)::DOUBLE AS share FROM p),
          c AS (SELECT c_mktsegment AS unit, sum(c_custkey)::DOUBLE AS poor, sum(c_custkey + 1000)::DOUBLE AS people FROM customer GROUP BY ALL),
          a AS (SELECT area, sum(poor * share) AS poor, sum(people * share) AS people FROM s JOIN c USING (unit) GROUP BY ALL)
          SELECT area, round(poor, 4) AS poor, round(people, 4) AS people, round(100 * poor / people, 6) AS percent,
                 round(sqrt(4.0::DOUBLE * (SELECT avg(power(poor * (k - 40) / 1000.0::DOUBLE, 2)) FROM range(80) t(k))), 2) AS error FROM a""")
def areal_allocation(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("unit"), F.col("c_nationkey").alias("area"), F.lit(1).alias("w"), "c_custkey")
    counts = c.groupBy("unit").agg(F.sum("c_custkey").cast("double").alias("poor"), F.sum(F.col("c_custkey") + 1000).cast("double").alias("people"))
    counts = counts.withColumn("poor_replicates", F.transform(F.sequence(F.lit(0), F.lit(79)), lambda k: F.col("poor") * (1 + (k - 40) / 1000.0)))
    out = cohort.allocated(counts, c, "unit", "area", "w", ["poor", "people"], ["poor_replicates"])
    error = cohort.replicate_error(F.col("poor"), F.col("poor_replicates"))
    return out.select("area", F.round("poor", 4).alias("poor"), F.round("people", 4).alias("people"), F.round(100 * F.col("poor") / F.col("people"), 6).alias("percent"), F.round(error, 2).alias("error"))


@query(f"WITH {FACTS} SELECT condition, area, count(pooled) AS n, CASE WHEN count(pooled) >= 3 THEN round(quantile_cont(pooled, 0.75) - quantile_cont(pooled, 0.25), 6) END AS iqr FROM pooled GROUP BY ALL")
def ranges_of_enough(spark, sf_dir):
    return cohort.spread_or_null(pooled(spark, sf_dir), ["condition", "area"], "pooled", 3).select("condition", "area", "n", r6("iqr"))


# ---- summaries, evidence and claims ----

_SUMMARY = f"""WITH {FACTS}, e AS (SELECT condition, count(*) AS n, corr(r, s) AS spearman, median(abs(r - s)) AS median_gap, avg((q = p)::INT) AS same_quartile FROM quartiles GROUP BY 1)"""


@query(_SUMMARY + " SELECT condition, n, round(spearman, 6) AS spearman, round(median_gap, 6) AS median_gap, round(same_quartile, 6) AS same_quartile FROM e")
def rank_comparison(spark, sf_dir):
    rows = ranked(spark, sf_dir).groupBy("condition")
    return rows.agg(F.count("*").alias("n"), F.round(F.corr("r", "s"), 6).alias("spearman"), F.round(F.median(F.abs(F.col("r") - F.col("s"))), 6).alias("median_gap"), F.round(F.avg((F.col("q") == F.col("p")).cast("int")), 6).alias("same_quartile"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir)
    frames = [
        agreement.correlation(rows, ["condition"], "pooled", "comparator").select("condition", "spearman"),
        rows.groupBy("condition").agg(F.median(F.abs(F.col("r") - F.col("s"))).alias("median_gap")),
        rows.groupBy("condition").agg(F.avg((F.col("q") == F.col("p")).cast("int")).alias("same_quartile")),
        rows.groupBy("condition").agg(F.count("*").alias("n")),
    ]
    return cohort.evidence(frames, "condition", ("spearman", "median_gap", "same_quartile", "n"))


_EVIDENCE = _SUMMARY + ", v AS (SELECT condition, unnest(['spearman', 'median_gap', 'same_quartile', 'n']) AS metric, unnest([spearman, median_gap, same_quartile, n::DOUBLE]) AS value FROM e)"


@query(_EVIDENCE + " SELECT condition, metric, round(value, 6) AS value FROM v WHERE value IS NOT NULL")
def evidence_rows(spark, sf_dir):
    return _evidence(spark, sf_dir).select("condition", "metric", r6("value"))


@query(_EVIDENCE + """, c AS (SELECT DISTINCT l_returnflag AS condition, m AS metric, CASE m WHEN 'n' THEN -1.0 WHEN 'same_quartile' THEN 0.5 ELSE 0.0 END AS claimed FROM lineitem, (VALUES ('n'), ('same_quartile'), ('odds')) t(m))
       SELECT condition, metric, CASE WHEN value IS NULL THEN 'no_evidence' WHEN abs(value - claimed) <= 0.5 THEN 'supported' ELSE 'contradicted' END AS status FROM c LEFT JOIN v USING (condition, metric)""")
def claim_audit(spark, sf_dir):
    flags = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("condition")).distinct()
    claims = flags.select("condition", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(x).alias("claimed")) for m, x in (("n", -1.0), ("same_quartile", 0.5), ("odds", 0.0))])))
    return quality.claim_audit(claims, _evidence(spark, sf_dir), ["condition", "metric"], 0.5).select("condition", "metric", "status")


@query("SELECT 'share' AS measure, count(DISTINCT (l_suppkey, l_returnflag)) AS rows, 0 AS unmatched, true AS agrees FROM lineitem")
def recomputed_shares(spark, sf_dir):
    """Shares of flags among a supplier's lines, by a window over counts and again from sums of indicators."""
    f = facts(spark, sf_dir).groupBy("unit", "condition").agg(F.sum("numerator").alias("n"))
    total = f.groupBy("unit").agg(F.sum("n").alias("d"))
    once = f.join(total, "unit").select("unit", "condition", (F.col("n") / F.col("d")).alias("share"))
    lines = read(spark, sf_dir, "lineitem")
    flags = sorted(r[0] for r in lines.select("l_returnflag").distinct().collect())  # a few codes
    wide = lines.groupBy(F.col("l_suppkey").alias("unit")).agg(*[F.avg((F.col("l_returnflag") == c).cast("double")).alias(c) for c in flags])
    again = wide.select("unit", F.inline(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).alias("share")) for c in flags]))).where("share > 0")
    return quality.recomputed(once, again, ["unit", "condition"], {"share": 1e-8}).drop("largest")


@query("""SELECT rule, CASE rule WHEN 'unknown_id' THEN (SELECT count(*) FROM nation WHERE n_regionkey > 2) WHEN 'other_name' THEN (SELECT count(*) FROM nation WHERE n_regionkey = 1)
          WHEN 'denominator' THEN (SELECT count(*) FROM nation WHERE n_nationkey < 3) WHEN 'estimate_not_finite' THEN (SELECT count(*) FROM nation WHERE n_nationkey = 7) ELSE 0 END AS findings
          FROM (VALUES ('unknown_id'), ('other_name'), ('denominator'), ('authorised'), ('estimate_not_finite')) t(rule)""")
def result_record_checks(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = read(spark, sf_dir, "nation").select(k, F.concat(F.lit("A"), "n_regionkey").alias("id"), F.when(F.col("n_regionkey") == 1, "else").otherwise(F.concat(F.lit("name "), "n_regionkey")).alias("name"), (k - 3).alias("denominator"), F.when(k == 7, F.lit(float("inf"))).when(k != 8, 1.0).alias("estimate"), F.lit(False).alias("authorised"))
    return quality.finding_counts(rows, quality.result_rules({f"A{i}": f"name {i}" for i in range(3)}, "id", "name", "denominator", ["estimate"], "authorised"))


# ---- models and runs ----


@query(f"WITH {FACTS}, b AS (SELECT condition, regr_slope(pooled, comparator) AS b, regr_intercept(pooled, comparator) AS a FROM pooled GROUP BY 1) SELECT unit, area, condition, round(a + b * comparator, 5) AS fitted, round(pooled - a - b * comparator, 5) AS residual FROM pooled JOIN b USING (condition)")
def residual_export(spark, sf_dir):
    rows = linear.residuals(pooled(spark, sf_dir), ["condition"], "pooled", "comparator")
    return rows.select("unit", "area", "condition", F.round("fitted", 5).alias("fitted"), F.round("residual", 5).alias("residual"))


@query(f"WITH {FACTS}, m AS (SELECT area, count(*) AS n, regr_slope(pooled, comparator) AS slope FROM pooled GROUP BY 1) SELECT area, n, CASE WHEN n >= 9 AND slope IS NOT NULL THEN 'primary' ELSE 'audit_only' END AS role FROM m")
def model_selection(spark, sf_dir):
    return linear.selected(pooled(spark, sf_dir), ["area"], "pooled", "comparator", 9).select("area", "n", "role")


@query("SELECT n_nationkey AS area, CASE WHEN s.n IS NULL THEN 'not_run' ELSE 'ran' END AS status, CASE WHEN s.n IS NULL THEN 'no supplier in ' || n_name END AS reason, s.n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def not_run_records(spark, sf_dir):
    results = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.count("*").alias("n"))
    expected = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), "n_name")
    return quality.not_run(expected, results, ["area"], F.concat(F.lit("no supplier in "), "n_name")).select("area", "status", "reason", "n")


# ---- maps ----


@query("SELECT n_nationkey AS area, 1 AS rings, 4 AS corners, 1.0::DOUBLE AS surface, n_nationkey % 5 + 0.5::DOUBLE AS x, n_nationkey // 5 + 0.5::DOUBLE AS y FROM nation")
def polygon_shapes(spark, sf_dir):
    return spatial.shapes(cells(spark, sf_dir), "area", "wkt").select("area", "rings", "corners", "surface", r6("x"), r6("y"))


@query(f"WITH {_QUEEN} SELECT fault, CASE WHEN fault = 'islands' THEN (SELECT count(*) FROM cells WHERE area NOT IN (SELECT src FROM e)) ELSE 0 END AS n FROM (VALUES ('repeated'), ('to_itself'), ('not_a_weight'), ('one_way'), ('not_standardised'), ('islands'), ('strangers')) t(fault)")
def weight_faults(spark, sf_dir):
    areas = cells(spark, sf_dir)
    return spatial.weight_faults(spatial.row_standardised(spatial.contiguity(areas, "area", "wkt")), areas, "area")


@query(f"WITH {_QUEEN} SELECT area, (SELECT count(*) FROM e WHERE src = area) AS n_graph, n AS n_values, round(v, 6) AS v FROM cells LEFT JOIN (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS v FROM customer GROUP BY 1) ON c_nationkey = area")
def topology_with_values(spark, sf_dir):
    areas = cells(spark, sf_dir)
    edges = spatial.contiguity(areas, "area", "wkt").groupBy(F.col("src").alias("area")).agg(F.count("*").alias("n"))
    graph = areas.select("area").join(edges, "area", "left").select("area", F.coalesce("n", F.lit(0)).alias("n"))
    values = area_values(spark, sf_dir).select("area", F.col("u").cast("long").alias("n"), "v")
    return joins.joined_with_suffixes(graph, values, ["area"], ("_graph", "_values")).select("area", "n_graph", "n_values", r6("v"))


# ---- manuscripts ----

_COUNT = lambda pattern, of="t": f"len(regexp_extract_all({of}, '{pattern}'))"
_TOKEN = T.TOKEN.replace("'", "''")
_TERMS = lambda terms: " + ".join(f"(length(low) - length(replace(low, '{x}', ''))) // {len(x)}" for x in terms)


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents),
           s AS (SELECT doc_id, list_sort(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(t, '{T.BLANK}+', ' ', 'g'), '([.!?])({T.CITED}) +([A-Z(])', '\\1\\2' || chr(1) || '\\3', 'g'), '([.!?]) +([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
                 lambda x: len(regexp_extract_all(regexp_replace(trim(x), '([.!?]){T.CITED}$', '\\1'), '{_TOKEN}'))), lambda n: n >= 4)) AS l FROM d)
           SELECT doc_id, {_COUNT(_TOKEN)}::INT AS n_words, len(l)::INT AS n_sentences, round(list_avg(l), 6) AS mean_sentence, round(list_aggregate(l, 'quantile_cont', 0.25), 6) AS p25_sentence, round(list_aggregate(l, 'quantile_cont', 0.5), 6) AS p50_sentence,
                  round(list_aggregate(l, 'quantile_cont', 0.75), 6) AS p75_sentence, {_COUNT(chr(92) + "b(?:" + T.PASSIVES + ")" + chr(92) + "b", "low")}::INT AS passives, {_COUNT(chr(92) + "b" + T.NOUNS + chr(92) + "b", "low")}::INT AS nominalisations,
                  {_COUNT(chr(92) + "b" + T.NUMBERS + "%?" + chr(92) + "b")}::INT AS numbers, ({_TERMS(T.HEDGE_TERMS)})::INT AS hedges, ({_TERMS(T.TRANSITION_TERMS)})::INT AS transitions FROM d JOIN s USING (doc_id)""")
def writing_style(spark, sf_dir):
    """Words, sentences with citations aside and their lengths, passives, nominalisations, numbers, hedges and transitions of whole texts."""
    texts = read(spark, sf_dir, "documents").select("doc_id", "text").repartition(3 * spark.sparkContext.defaultParallelism, "doc_id")  # a file may be one part
    rows = texts.select("doc_id", "text", T.sentence_lengths("text").alias("lengths"))  # once for all that hangs on it
    out = rows.select("doc_id", *T.style_counts("text", F.col("lengths")))
    return out.select("doc_id", "n_words", "n_sentences", *[r6(c) for c in ("mean_sentence", "p25_sentence", "p50_sentence", "p75_sentence")], "passives", "nominalisations", "numbers", "hedges", "transitions")


#: Lines of capitals or of few words without an end, as headings are.
_HEADING = "[A-Z][A-Za-z]*(?: [A-Za-z]+){0,4}"


@query(f"""WITH l AS (SELECT doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS place FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS w FROM documents)),
           h AS (SELECT *, regexp_full_match(trim(line), '{_HEADING}') AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY place) AS section FROM h)
           SELECT doc_id, section::BIGINT AS section, max(trim(line)) FILTER (head) AS name, min(place)::INT AS first_line, max(place)::INT AS last_line, coalesce(sum({_COUNT(_TOKEN, "line")}) FILTER (NOT head), 0)::BIGINT AS n_words FROM s GROUP BY doc_id, section""")
def text_sections(spark, sf_dir):
    """Sections of whole texts, from one heading to the next, with their lines and words."""
    return T.sections(read(spark, sf_dir, "documents"), "doc_id", "text", _HEADING)


# ---- audits and grids ----


@query(f"WITH {FACTS}, f AS (SELECT unit, condition, period, CASE WHEN numerator < 20 AND unit % 3 = 0 THEN 0 WHEN numerator < 20 THEN NULL ELSE numerator END AS shown, numerator < 20 AS withheld FROM facts) SELECT condition, count(*) AS rows, count(*) FILTER (withheld) AS withheld, count(*) FILTER (withheld AND shown = 0) AS shown_as_zero FROM f GROUP BY condition")
def suppressed_as_zero(spark, sf_dir):
    withheld = F.col("numerator") < 20
    rows = facts(spark, sf_dir).select("condition", F.when(withheld & (F.col("unit") % 3 == 0), 0).when(~withheld, F.col("numerator")).alias("shown"), withheld.alias("withheld"))
    return rows.groupBy("condition").agg(F.count("*").alias("rows"), F.count_if("withheld").alias("withheld"), F.count_if(quality.suppressed_as_zero("shown", F.col("withheld"))).alias("shown_as_zero"))


@query(f"""WITH {FACTS}, g AS (SELECT a.area, p.period, c.condition FROM (SELECT DISTINCT area FROM facts) a, (SELECT DISTINCT period FROM facts) p, (SELECT DISTINCT condition FROM facts) c),
           s AS (SELECT area, period, condition, sum(numerator)::BIGINT AS numerator FROM facts GROUP BY ALL) SELECT area, period, condition, coalesce(numerator, 0) AS numerator FROM g LEFT JOIN s USING (area, period, condition)""")
def three_way_grid(spark, sf_dir):
    """Every area in every year and condition, with zero where nothing was counted."""
    rows = facts(spark, sf_dir).groupBy("area", "period", "condition").agg(F.sum("numerator").alias("numerator"))
    grid = joins.grid(*[rows.select(c).distinct() for c in ("area", "period", "condition")])
    return joins.densified(rows, grid, ["area", "period", "condition"], {"numerator": 0})


@query("""WITH x AS (SELECT c_nationkey AS area, c_mktsegment AS segment, c_acctbal AS capture, c_custkey AS weight, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS crossing, c_nationkey % 5 AS zone FROM customer)
          SELECT area, max(zone) AS zone, CASE WHEN count(DISTINCT segment) <= 1 THEN max(segment) END AS segment, round(avg(capture), 6) AS capture, min(weight) AS weight, bool_or(coalesce(crossing, TRUE)) AS crossing, CASE WHEN count(DISTINCT segment) > 1 THEN 'segment' ELSE '' END AS conflicts FROM x GROUP BY area""")
def metadata_collapse(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("area"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("capture"), k.alias("weight"), F.when(k % 5 > 0, k % 5 == 1).alias("crossing"), (F.col("c_nationkey") % 5).alias("zone"))
    out = cohort.metadata_collapse(rows, ["area"], ["zone", "segment"], "capture", "weight", "crossing")
    return out.select("area", "zone", "segment", r6("capture"), "weight", "crossing", F.array_join("conflicts", ",").alias("conflicts"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents), k AS (SELECT doc_id, list_filter(w, lambda x: NOT regexp_full_match(trim(x), '.*(?:[Cc]opyright|[Ll]icen[sc]e).*', 's')) AS w FROM l)
          SELECT doc_id, md5(trim(regexp_replace(array_to_string(w, chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g'), ' ')) AS cleaned FROM k""")
def cleaned_texts(spark, sf_dir):
    """Whole texts without lines of copyright or licence, runs of blank lines made one."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.cleaned(F.col("text"), "(?s)^.*(?:[Cc]opyright|[Ll]icen[sc]e).*$")).alias("cleaned"))


_REPLICATES = 100
_NORMAL = "sqrt(-2 * ln((" + _DRAW.format("'53|' || r || '|' || unit || '|' || condition") + " + 0.5) / 4294967296.0::DOUBLE)) * cos(6.283185307179586 * (" + _DRAW.format("'54|' || r || '|' || unit || '|' || condition") + " + 0.5) / 4294967296.0::DOUBLE)"


@query(f"""WITH {FACTS}, m AS (SELECT unit, condition, pooled, 1 + comparator * 20 AS se FROM pooled), d AS (SELECT unit, condition, r, least(100, greatest(0, pooled + se * {_NORMAL})) AS v FROM m, range({_REPLICATES}) t(r)),
           k AS (SELECT unit, condition, r, (rank() OVER (PARTITION BY condition, r ORDER BY v) + (count(*) OVER (PARTITION BY condition, r, v) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY condition, r) AS k FROM d)
           SELECT unit, condition, count(*) AS estimable, round(quantile_cont(k, 0.025), 6) AS rank_lo, round(quantile_cont(k, 0.975), 6) AS rank_hi, round(avg((k <= 0.25)::INT), 6) AS q1, round(avg((k > 0.25 AND k <= 0.5)::INT), 6) AS q2, round(avg((k > 0.5 AND k <= 0.75)::INT), 6) AS q3, round(avg((k > 0.75)::INT), 6) AS q4 FROM k GROUP BY ALL""")
def interval_propagation(spark, sf_dir):
    """Intervals of ranks and shares of quartiles when every unit's value is drawn anew from its own interval."""
    rows = pooled(spark, sf_dir).select("unit", "condition", "pooled", (1 + F.col("comparator") * 20).alias("se"))
    out = resample.propagated_ranks(rows, ["unit", "condition"], "pooled", "se", ["condition"], _REPLICATES, 53)
    return out.select("unit", "condition", "estimable", *[r6(c) for c in ("rank_lo", "rank_hi", "q1", "q2", "q3", "q4")])
