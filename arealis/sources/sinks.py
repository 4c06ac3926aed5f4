"""Sinks: validated publication, twelve-digit CSV, snapshots that never overwrite, manifests."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import require_columns, require_unique


def _twelve(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else format(v, ".12g"))


def twelve_digits(x: str | Column) -> Column:
    """Numbers as C's %.12g prints them: no trailing zeros, which Java's %g keeps."""
    return F.pandas_udf(_twelve, "string")(F.col(x) if isinstance(x, str) else x)


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    doubles = {c: twelve_digits(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    df.withColumns(doubles).orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def publish(df: DataFrame, path: str, key: Sequence[str], columns: Sequence[str]) -> None:
    """Writes sorted Parquet once columns and key are checked. What is written is read back and counted; the
    committer shows either all files or none, and an existing table is never replaced."""
    require_columns(df, columns)
    require_unique(df, key)
    rows = df.select(*columns)
    rows.orderBy(*key).write.mode("errorifexists").parquet(path)
    found, expected = df.sparkSession.read.parquet(path).count(), rows.count()
    if found != expected:
        raise RuntimeError(f"{path} holds {found} rows of {expected}")


def manifest(df: DataFrame, name: str) -> str:
    """JSON of a dataset's schema, rows and a digest of its rows that doesn't hang on their order."""
    row = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("x")).first()
    body = {"name": name, "rows": row["n"], "rows_digest": str(row["x"]), "schema": json.loads(df.schema.json())}
    return json.dumps(body | {"sha256": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}, sort_keys=True, indent=2)


def rebuild_reason(before: dict | None, inputs: dict[str, str], parameters: dict) -> str | None:
    """Why a stored result can't be used again; None if it can. before is what a manifest kept of the last run."""
    if before is None:
        return "no_manifest"
    if before.get("parameters") != parameters:
        return "parameters_changed"
    if before.get("inputs", {}).keys() != inputs.keys():
        return "inputs_differ"
    if before["inputs"] != inputs:
        return "input_changed"
    return None if before.get("complete") else "incomplete"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, else one under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # when the driver ends
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its plan begins there, so a lost executor costs no more than its tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
