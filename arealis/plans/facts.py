"""Binding of the operators' roles to the driver's tables, once as a DataFrame and once as SQL.

unit: supplier; area: nation; condition: return flag; period: year of shipment. The numerator counts a unit's lines
with a flag in a year, the denominator all its lines of that year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.sinks import written

#: Parameters of the binding.
PERIODS, LEAST, SUPPRESSED_BELOW = (1996, 1997, 1998), 70, 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_file_order(df: DataFrame) -> DataFrame:
    """df, as read from Parquet, with _file and _row: the place of a row's file in the order of their paths, and the row's place in it."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    files = df.select(F.col("_metadata.file_path").alias("_path")).distinct()
    return rows.join(F.broadcast(files.withColumn("_file", F.row_number().over(Window.orderBy("_path")))), "_path").drop("_path")


def dealt(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """df in parts enough for all cores, as a table: a small file is one part, however long the work on its rows.

    Filters with Python functions would be pushed below a mere repartition(), back into the one part.
    """
    return written(df.repartition(3 * spark.sparkContext.defaultParallelism, key), "dealt")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per unit, condition and period; lines are scanned once."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("condition"), F.year("l_shipdate").alias("period"), "l_discount", "l_tax", "l_quantity")
    counts = lines.groupBy("unit", "period", "condition").agg(F.count("*").alias("numerator"), C.steady_mean("l_discount").alias("comparator"), F.avg("l_tax").alias("capture"), F.sum("l_quantity").alias("weight"))
    counts = counts.withColumn("denominator", F.sum("numerator").over(Window.partitionBy("unit", "period")))  # over a row for each condition
    areas = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("area"))
    return counts.join(areas, "unit").withColumn("proportion", F.col("numerator") / F.col("denominator").cast("double"))


FACTS = f"""
    counts AS (SELECT l_suppkey AS unit, year(l_shipdate) AS period, l_returnflag AS condition, count(*) AS numerator,
                      avg(l_discount) AS comparator, avg(l_tax) AS capture, sum(l_quantity) AS weight
               FROM lineitem GROUP BY ALL),
    totals AS (SELECT unit, period, sum(numerator)::BIGINT AS denominator FROM counts GROUP BY ALL),
    facts AS (SELECT c.*, t.denominator, s_nationkey AS area, c.numerator / t.denominator::DOUBLE AS proportion
              FROM counts c JOIN totals t USING (unit, period) JOIN supplier ON s_suppkey = c.unit),
    pooled AS (SELECT unit, any_value(area) AS area, condition, sum(numerator)::BIGINT AS numerator, sum(denominator)::BIGINT AS denominator,
                      sum(numerator) * 100.0::DOUBLE / sum(denominator)::DOUBLE AS pooled, avg(comparator) AS comparator
               FROM facts WHERE period IN {PERIODS} AND denominator >= {LEAST}
               GROUP BY unit, condition HAVING count(DISTINCT period) = 3),
    ranked AS (SELECT *, (rank() OVER (PARTITION BY condition ORDER BY pooled) + (count(*) OVER (PARTITION BY condition, pooled) - 1) / 2.0::DOUBLE)
                         / count(*) OVER (PARTITION BY condition) AS r,
                      (rank() OVER (PARTITION BY condition ORDER BY comparator) + (count(*) OVER (PARTITION BY condition, comparator) - 1) / 2.0::DOUBLE)
                         / count(*) OVER (PARTITION BY condition) AS s FROM pooled),
    quartiles AS (SELECT *, CASE WHEN r <= 0.25 THEN 1 WHEN r <= 0.5 THEN 2 WHEN r <= 0.75 THEN 3 ELSE 4 END AS q,
                         CASE WHEN s <= 0.25 THEN 1 WHEN s <= 0.5 THEN 2 WHEN s <= 0.75 THEN 3 ELSE 4 END AS p FROM ranked)
"""
