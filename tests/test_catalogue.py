"""Every query against its SQL, run by DuckDB on the same files."""

import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from arealis.functions import columns as C
from arealis.plans import catalogue, records

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]) or not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
        else:
            df[c] = df[c].astype(float).round(5) + 0.0
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


#: Queries that SQL can't express; tests of their operators hold them against plain versions.
WITHOUT_SQL = {"connecting_band_of_units", "spatial_error_sensitivity"}


def test_all_but_few_queries_have_sql():
    assert catalogue.QUERIES.keys() - catalogue.SQL.keys() == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, db, name):
    got, want = comparable(catalogue.QUERIES[name](spark, DATA).toPandas()), comparable(db.sql(catalogue.SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-5)


def test_entry_and_registration(spark):
    assert entry_point.entry(spark).count() >= 0
    assert set(catalogue.QUERIES) <= set(entry_point.queries()) and set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_nothing_but_the_entry_point_knows_the_llm_subpackage():
    root = os.path.dirname(os.path.abspath(entry_point.__file__))
    for folder, _, names in os.walk(os.path.join(root, "arealis")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "arealis.llm" not in (text := f.read()) and "from .llm" not in text


def test_draws_are_as_many_as_the_references(spark):
    rows = catalogue.QUERIES["cluster_bootstrap_whole"](spark, DATA)
    assert rows.select("replicate").distinct().count() == 1000
    assert {r.estimable for r in catalogue.QUERIES["bootstrap_rank_gap_whole"](spark, DATA).collect()} == {1000}
    r = catalogue.QUERIES["moran_permutation_whole"](spark, DATA).first()
    assert r.p == round((r.extreme + 1) / 10000, 6)


def test_whole_union_has_all_rows(spark):
    rows = sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("customer", "supplier"))
    assert catalogue.QUERIES["union_by_name_whole"](spark, DATA).count() == rows


def copies_of_lines(spark, path):
    """Six suppliers of one nation with the same lines in other orders, in seven files."""
    lines = [(unit, flag, f"{year}-03-05", (37 * k % 11) / 100.0, 0.0, 1.0, (k * (unit * 2 + 3) % 101)) for unit in range(6) for flag in "AR" for year in (1996, 1997, 1998) for k in range(101)]
    names = ["l_suppkey", "l_returnflag", "l_shipdate", "l_discount", "l_tax", "l_quantity", "_at"]
    rows = pd.DataFrame(lines, columns=names).sort_values(["_at", "l_suppkey"]).drop(columns="_at")
    rows["l_shipdate"] = pd.to_datetime(rows["l_shipdate"])
    for k in range(7):
        os.makedirs(f"{path}/lineitem.parquet", exist_ok=True)
        rows.iloc[k::7].to_parquet(f"{path}/lineitem.parquet/part-{k}.parquet", coerce_timestamps="us")
    pd.DataFrame({"s_suppkey": range(6), "s_nationkey": 0}).to_parquet(f"{path}/supplier.parquet")
    return str(path)


def test_suppliers_with_equal_lines_tie(spark, tmp_path):
    here = copies_of_lines(spark, tmp_path)
    assert {(r.r, r.s) for r in catalogue.percentile_ranks(spark, here).collect()} == {(round(3.5 / 6, 9), round(3.5 / 6, 9))}
    assert {r.category for r in catalogue.discordance_by_rank(spark, here).collect()} == {"other"}


def test_gates_count_averages_as_the_sql_does_in_file_order(spark, tmp_path):
    """Three copies of lines in seven files: each supplier's sums must follow the rows, whatever tasks read them."""
    copy, k = pd.Series(range(60000)) // 20000, pd.Series(range(60000)) % 20000
    lines = pd.DataFrame({"l_suppkey": k * 31 % 97 + copy * 97, "l_extendedprice": k * 37 % 1009 / 10.0, "l_returnflag": (k * 13 % 7 < 3).map({True: "R", False: "N"}), "l_discount": k * 7919 % 104729 / 1e5, "l_quantity": 1.0})
    os.makedirs(tmp_path / "lineitem.parquet")
    for i in range(7):  # of sizes that let Spark read them in another order
        lines.iloc[sum(range(i + 1)) * 60000 // 28 : sum(range(i + 2)) * 60000 // 28].to_parquet(tmp_path / f"lineitem.parquet/part-{i}.parquet")
    db = duckdb.connect(config={"threads": 1})
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {r[0]: r[2] for r in db.execute(catalogue.SQL["collinearity_gates"]).fetchall()}
    assert {r.predictor: r.distinct for r in catalogue.collinearity_gates(spark, str(tmp_path)).collect()} == want


def test_steady_mean_of_what_decimals_do_not_hold(spark):
    rows = [("a", 1e300), ("a", 1e300), ("b", float("nan")), ("b", 1.0), ("c", None), ("d", 2e-9), ("d", 4e-9), ("e", 0.0), ("f", 0.1), ("f", None)]
    got = {r.g: r.m for r in spark.createDataFrame(rows, "g string, v double").groupBy("g").agg(C.steady_mean("v").alias("m")).collect()}
    assert got["a"] == 1e300 and got["b"] != got["b"] and got["c"] is None and got["d"] == pytest.approx(3e-9) and got["e"] == 0.0 and got["f"] == 0.1


def test_survivors_are_not_lost_when_values_differ_from_run_to_run(spark, monkeypatch):
    drawn = F.udf(lambda k: 40.0 + random.random(), "double").asNondeterministic()
    rows = spark.range(200).select(F.col("id").alias("unit"), F.lit("A").alias("condition"), drawn("id").alias("pooled"), F.lit(0.0).alias("comparator"))
    monkeypatch.setattr(records, "pooled", lambda spark, sf_dir: rows)
    r = records.fdr_survivors(spark, DATA).first()
    assert (r.tests, r.raw_hits, r.survivors) == (200, 200, 200)
