"""Positional delimited text, JSON matrices and pages, hex geometry; files with checksums."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col

#: Literals of the strict reader.
NULL = "\\N"
PATTERNS = {"long": r"^[+-]?[0-9]+$", "double": r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$", "boolean": "^[tf]$", "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})$", "string": r"(?s)^.*$"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    nullable: bool = True


def read_lenient(spark: SparkSession, path: str, names: Sequence[str], sep: str = "|") -> DataFrame:
    """Rows of text as trimmed strings, bytes that are no UTF-8 replaced. Blank lines are skipped; a row of another width fails the query."""
    rows = spark.read.text(path).select(F.make_valid_utf8("value").alias("value")).where(F.trim("value") != "")
    parts = F.split("value", f"[{sep}]", -1)
    checked = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {len(names)} fields, found "), F.size(parts).cast("string"))))
    return rows.select(checked.alias("_p")).select(*[F.trim(F.col("_p")[i]).alias(n) for i, n in enumerate(names)])


def parsed(text: str | Column, kind: str) -> Column:
    """The typed value of a literal; NULL is null, and what doesn't match the kind's pattern or isn't finite fails the query."""
    t = col(text)
    value = {"boolean": t == "t", "timestamp": F.try_to_timestamp(t), "string": t}.get(kind, t.try_cast(kind) if kind != "string" else t)
    bad = F.raise_error(F.concat(F.lit(f"not a {kind}: "), t)).cast(kind)
    good = t.rlike(PATTERNS[kind]) & value.isNotNull() & ((F.abs(value) < float("inf")) if kind == "double" else F.lit(True))
    return F.when(t.isNull() | (t == NULL), None).when(good, value).otherwise(bad)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, source_file, source_row (from 1) and source_offset (in bytes) of the lines, ended by line feeds, of each file.

    Lines are numbered within each split of a file, then shifted by the counts of the splits before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    size = F.octet_length("value") + 1
    within = Window.partitionBy("_f", "_b").orderBy("_m")
    lines = lines.withColumns({"_row": F.row_number().over(within), "_at": F.sum(size).over(within) - size})
    splits = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.sum(size).alias("_s"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_bytes"))
    return lines.join(splits, ["_f", "_b"]).select("value", "source_file", (F.col("_row") + F.col("_rows")).alias("source_row"), (F.col("_at") + F.col("_bytes")).alias("source_offset"))


def read_strict(spark: SparkSession, path: str, fields: Sequence[Field], key: Sequence[str] = (), source_id: str = "", snapshot_id: str = "", sep: str = "|") -> DataFrame:
    """Typed rows with source_id, snapshot_id, source_file, source_row and source_offset. Fails on a bad literal, on bytes that
    are no UTF-8, a null in a field that has none, a row of another width and, before it returns, on a repeated key."""
    rows = numbered_lines(spark, path).withColumn("value", F.validate_utf8("value"))
    parts = F.split("value", f"[{sep}]", -1)
    checked = F.when(F.size(parts) == len(fields), parts).otherwise(F.raise_error(F.lit(f"a row has not {len(fields)} fields")))
    rows = rows.select(checked.alias("_p"), "source_file", "source_row", "source_offset")
    cols = []
    for i, f in enumerate(fields):
        value = parsed(F.col("_p")[i], f.kind)
        cols.append((value if f.nullable else F.coalesce(value, F.raise_error(F.lit(f"null in {f.name}")).cast(f.kind))).alias(f.name))
    out = rows.select(*cols, F.lit(source_id).alias("source_id"), F.lit(snapshot_id).alias("snapshot_id"), "source_file", "source_row", "source_offset")
    if key and not out.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"rows repeat the key {list(key)}")
    return out


def repeated_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that several rows have, with the first two of their row numbers and the count."""
    out = df.groupBy(*key).agg(F.count("*").alias("rows"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"))
    return out.where("rows > 1")


def read_header_csv(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """Rows of a CSV file with a header, as strings; a byte order mark is no part of the first name. Columns that are named must be there."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def widths(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """One row: rows, and the different numbers of fields."""
    return spark.read.text(path).agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.size(F.split("value", f"[{sep}]", -1)))).alias("widths"))


def optional_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one of this schema if there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def json_matrix(df: DataFrame, c: str, id_parts: Sequence[str]) -> DataFrame:
    """Rows of a JSON array of arrays whose first row is the header: record_id (id_parts joined) and a map of values."""
    m = F.from_json(c, "array<array<string>>")
    rows = df.select(m.alias("_m")).select(F.col("_m")[0].alias("_h"), F.posexplode("_m").alias("_i", "_r")).where("_i > 0")
    rows = rows.select(F.map_from_arrays("_h", "_r").alias("values"))
    return rows.select(F.concat(*[F.col("values")[p] for p in id_parts]).alias("record_id"), "values")


def geojson_features(df: DataFrame, c: str, properties: str) -> DataFrame:
    """Properties (a DDL struct), geometry type and coordinates (JSON) of each feature; other geometries than polygons fail."""
    schema = f"struct<features:array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>>"
    f = df.select(F.explode(F.from_json(c, schema)["features"]).alias("f"))
    kind = F.col("f.geometry.type")
    return f.select("f.properties.*", F.when(kind.isin("Polygon", "MultiPolygon"), kind).otherwise(F.raise_error(F.lit("geometry is no polygon"))).alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def ewkb_to_wkt(hexes: str | Column) -> Column:
    """Well-known text of hex EWKB polygons and multipolygons; null for null and what is neither."""
    return F.pandas_udf(_wkt, "string")(col(hexes))


def _wkt(hexes: pd.Series) -> pd.Series:
    import struct

    def read(data: bytes, at: int) -> tuple[str, str, int]:
        e = "<" if data[at] else ">"
        kind, at = struct.unpack_from(e + "I", data, at + 1)[0], at + 5
        if kind & 0x20000000:
            at += 4
        kind &= 0xFFFF
        n, at = struct.unpack_from(e + "I", data, at)[0], at + 4
        parts = []
        for _ in range(n):
            if kind == 3:
                m, at = struct.unpack_from(e + "I", data, at)[0], at + 4
                xy = struct.unpack_from(f"{e}{2 * m}d", data, at)
                at += 16 * m
                parts.append("(" + ", ".join(f"{x:.17g} {y:.17g}" for x, y in zip(xy[::2], xy[1::2])) + ")")
            else:
                _, inner, at = read(data, at)
                parts.append(inner)
        return ("POLYGON", "MULTIPOLYGON")[kind == 6], "(" + ", ".join(parts) + ")", at

    def text(h: str | None) -> str | None:
        try:
            data = bytes.fromhex(h)
            if struct.unpack_from(("<" if data[0] else ">") + "I", data, 1)[0] & 0xFFFF not in (3, 6):
                return None
            kind, body, _ = read(data, 0)
            return f"{kind} {body}"
        except (TypeError, ValueError, IndexError, struct.error):
            return None

    return pd.Series([text(h) for h in hexes], dtype=object)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose checksum differs from the ledger's, or that only one side knows: (path, problem)."""
    both = found.select("path", "sha256").join(ledger.select("path", F.col("sha256").alias("expected")), "path", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("sha256") != F.col("expected"), "changed")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def read_headed(spark: SparkSession, path: str, fields: Sequence[str], patterns: dict[str, str], sep: str = "|") -> DataFrame:
    """Rows of separated text, as strings, whose header must be exactly fields.

    A header that differs is an error at once; a row with another number of fields, or a value that its column's
    pattern doesn't match as a whole, is one when it is read.
    """
    lines = numbered_lines(spark, path).select(F.col("source_row").alias("_n"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"))
    heads = {r["value"] for r in lines.where("_n = 1").select("value").distinct().take(2)}  # of all files
    if heads != {sep.join(fields)}:
        raise ValueError(f"the header of {path} is not {sep.join(fields)}")
    parts = F.split("value", f"[{sep}]", -1)
    good = F.size(parts) == len(fields)
    for name, pattern in patterns.items():
        good &= F.coalesce(F.try_element_at(parts, F.lit(list(fields).index(name) + 1)).rlike(f"^(?:{pattern})$"), F.lit(False))
    rows = lines.where("_n > 1").where(F.assert_true(good, F.concat(F.lit("malformed row "), F.col("_n").cast("string"))).isNull())
    return rows.select(*[parts[i].alias(n) for i, n in enumerate(fields)])


def probed_count(text: str | Column, most: int = 2**31 - 1) -> Column:
    """The count that a page states: [{"count": n}], a feature collection of one such feature, or CSV of a header and a row.

    Null for anything else: more rows than one, signs, leading zeros, fractions, a number above most.
    """
    c = F.trim(col(text))
    listed = F.from_json(F.when(c.startswith("["), c), "array<struct<count:string>>")
    features = F.from_json(F.when(F.get_json_object(c, "$.type") == "FeatureCollection", c), "features array<struct<properties:struct<count:string>>>")["features"]
    table = F.when(c.rlike(r'^"?count"?\r?\n"?\d+"?$'), F.regexp_extract(c, r'(\d+)"?$', 1))
    one = lambda rows, value: F.when(F.size(rows) == 1, value)
    said = F.coalesce(one(listed, F.try_element_at(listed, F.lit(1))["count"]), one(features, F.try_element_at(features, F.lit(1))["properties"]["count"]), table)
    n = F.when(said.rlike("^(0|[1-9][0-9]{0,17})$"), said.try_cast("long"))
    return F.when(n <= most, n)


def read_verified_json(spark: SparkSession, path: str, schema: str, ledger: DataFrame) -> DataFrame:
    """JSON lines of path's files, which must be the ledger's (path, sha256) and no others, unchanged."""
    wrong = verified(checksums(spark, path), ledger).orderBy("path").take(5)
    if wrong:
        raise ValueError(f"files differ from the ledger: {[tuple(r) for r in wrong]}")
    return spark.read.schema(schema).json(path)
