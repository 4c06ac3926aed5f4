"""Exact deduplication by a stateful stream."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch_path, stored

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's store takes megabytes before it holds a key
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, name: str = "docs") -> DataFrame:
    """docs' columns as c0, c1 and so on, and loc: file and row number of each row.

    A table that is no file scan, or hides what tells a scan's rows, is written to files first.
    """
    renamed = [F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    if "_metadata" not in docs.columns:
        try:
            return docs.select(*renamed, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("loc"))
        except AnalysisException as e:
            if not any(k in str(e) for k in ("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND", "AMBIGUOUS")):
                raise
    return located(stored(docs.select(*renamed), name), name)


def update_state(spark: SparkSession, arrivals: str, schema, state: str, groups: str, files_at_once: int = 1_000_000) -> None:
    """Feeds the files under arrivals (id, loc, digest) to the keyed state under state; each micro-batch leaves its changed keys under groups.

    The state lives in RocksDB on the executors' disks, with its log under state. For each digest it holds the identifier
    that stays, the locator of its content and how many came. It has no watermark, so no key expires: a later call
    with the same paths and more files goes on from what earlier calls have seen.
    """

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{groups}/batch={number}")

    with _settings(spark, STATE):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(arrivals)
        keyed = stream.groupBy("digest").agg(F.max(F.struct("id", "loc")).alias("keep"), F.count("*").alias("n"))
        keyed.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def state_of(spark: SparkSession, groups: str) -> DataFrame:
    """What the state holds of each digest after the last micro-batch: digest, keep (id, loc), n."""
    rows = spark.read.parquet(groups).groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("v"))
    return rows.select("digest", "v.keep", "v.n")


#: Rows of a group that are compared with one copy of its content.
BESIDE = 1000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per row of docs: id, locator, digest, keep_id, keep_locator, group_size, kept.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays (one
    without an id only if none has one), and of rows that repeat that id too, the one that lies last (by file, then row).
    The stream's state says what stays, where its content lies and how many there are. Rows whose digest was met before are hits:
    their whole texts are compared with the content at the state's locator, in salted parts, so that no group lands in one
    task. If the bytes of a digest differ, its rows are told apart by their texts. An empty table gives no rows; further
    columns are ignored, whatever their names.
    """
    return _groups(located(docs.select(id_col, text_col)).select(F.col("c0").alias("id"), F.col("c1").alias("text"), "loc"), digest)


def _groups(source: DataFrame, digest=sha256) -> DataFrame:
    spark = source.sparkSession
    source = source.select("id", F.coalesce("text", F.lit("")).alias("text"), "loc").withColumn("digest", digest(F.col("text")))
    arrivals, groups = scratch_path(spark, "arrivals"), scratch_path(spark, "groups")
    slim = source.select("id", "loc", "digest")
    slim.write.parquet(arrivals)
    slim = spark.read.schema(slim.schema).parquet(arrivals)
    out = [F.col("id"), F.col("loc").alias("locator"), "digest", F.col("keep.id").alias("keep_id"), F.col("keep.loc").alias("keep_locator"), F.col("n").alias("group_size"), (F.col("keep.loc") == F.col("loc")).alias("kept")]
    if slim.isEmpty():
        return slim.withColumns({"keep": F.struct("id", "loc"), "n": F.lit(1).cast("long")}).select(*out)
    update_state(spark, arrivals, slim.schema, scratch_path(spark, "state"), groups)
    state = stored(state_of(spark, groups), "state")

    # whole texts of hits beside copies of the content that the state's locator names
    hits = state.where("n > 1").withColumn("parts", F.ceil(F.col("n") / F.lit(float(BESIDE))).cast("int"))
    met = source.join(hits, "digest").withColumn("part", F.pmod(F.xxhash64("loc"), F.col("parts")).cast("int"))
    first = met.where("keep.loc = loc").select("digest", F.col("text").alias("content"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    differing = stored(met.join(first, ["digest", "part"]).where("text <> content").select("digest").distinct(), "differing")

    result = slim.join(state, "digest")
    if differing.isEmpty():
        return result.select(*out)
    apart = source.join(differing, "digest").withColumn("part", F.pmod(F.xxhash64("loc"), F.lit(64)))
    same = apart.groupBy("digest", "part", "text").agg(F.max(F.struct("id", "loc")).alias("keep"), F.count("*").alias("n")).groupBy("digest", "text").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    return result.join(differing, "digest", "left_anti").select(*out).unionByName(source.join(same, ["digest", "text"]).select(*out))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    source = located(docs)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    dropped = _groups(source.select(F.col(at[id_col]).alias("id"), F.col(at[text_col]).alias("text"), "loc")).where(~F.col("kept")).select(F.col("locator").alias("loc"))
    return source.join(dropped, "loc", "left_anti").select(*[F.col(at[c]).alias(c) for c in docs.columns])
