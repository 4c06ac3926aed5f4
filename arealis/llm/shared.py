"""What the operators of this subpackage share: scratch tables in the shared folder, and small array helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a folder under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again.

    This cuts the lineage: a lost executor costs the tasks that read the table, not those that made it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sets by the size of the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of the graph that links (a, b) spans; root is the smallest node of its component.

    Alternating large-star and small-star steps: each replaces links by links to a smaller neighbour, so
    the number of rounds grows with the logarithm of the longest chain. Every round is a written table.
    A node of very many links is handled by aggregates with map-side partial results, never by a list.
    """
    print_of = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())  # noqa: E731  # of edges without repeats
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = print_of(edges)
    for _ in range(max_rounds):
        # large star: each neighbour above a node is linked to the least of the node and its neighbours
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        after = stored(small, "cc")
        edges, last, before = after, before, print_of(after)
        if before == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))


# ---- arrays ----

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit of the result hangs on every bit of x."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Bytes of ASCII white space, the ends of words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_spans(buffer: np.ndarray, ends: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one byte of each run of bytes that are no white space; texts end at ends."""
    ink, edge = np.concatenate([[False], ~blank[buffer], [False]]), np.zeros(len(buffer) + 1, bool)
    edge[ends] = True
    return np.flatnonzero(ink[1:] & (~ink[:-1] | edge)), np.flatnonzero(ink[:-1] & (~ink[1:] | edge))


def word_hashes(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time through a bijective finaliser: no pattern within makes collisions."""
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([buffer, np.zeros(8, np.uint8)]), 8)
    out = mixed((stop - start).astype(np.uint64), 61)
    long = np.flatnonzero(stop - start > 4096)
    live = np.flatnonzero(stop - start <= 4096)
    at = start[live]
    while len(live):
        rest = stop[live] - at
        block = eight[at].view("<u8").ravel()
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.maximum(8 - rest, 0) * 8).astype(np.uint64)
        out[live] = mixed(out[live] ^ block, 62)
        more = rest > 8
        live, at = live[more], at[more] + 8
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(buffer[start[k] : stop[k]].tobytes())
    return out


def distinct_words(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of a word of each kind, kind of each word); words of one hash are compared byte by byte."""
    _, first, kind = np.unique(word_hashes(buffer, start, stop), return_index=True, return_inverse=True)
    kind = kind.ravel()
    one = first[kind]
    live = np.flatnonzero(one != np.arange(len(one)))
    good = bool((stop[live] - start[live] == stop[one[live]] - start[one[live]]).all())
    eight, x, y = np.lib.stride_tricks.sliding_window_view(np.concatenate([buffer, np.zeros(8, np.uint8)]), 8), start[live], start[one[live]]
    while good and len(live):
        rest = stop[live] - x
        low = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.maximum(8 - rest, 0) * 8).astype(np.uint64)
        good = not ((eight[x].view("<u8").ravel() ^ eight[y].view("<u8").ravel()) & low).any()
        more = rest > 8
        live, x, y = live[more], x[more] + 8, y[more] + 8
    if not good:  # different words with one hash
        numbers, data = {}, buffer.tobytes()
        kind = np.fromiter((numbers.setdefault(data[i:j], len(numbers)) for i, j in zip(start.tolist(), stop.tolist())), np.int64, len(start))
        first = np.unique(kind, return_index=True)[1]
    return first, kind


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand: substring hashes from prefix sums.

    Such hashes choose and sort out; they never stand for equality, since strings with equal hashes can be made.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            self.up = np.full(size, self.base, np.uint64)
            self.up[0] = 1
            np.cumprod(self.up, out=self.up)
            self.down = np.full(size, self.inverse, np.uint64)
            self.down[0] = 1
            np.cumprod(self.down, out=self.down)
        return self.up, self.down


class Prefix:
    """Hashes of any substring of a sequence, from one pass."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start], seed)


def slices(sizes, most: int):
    """(first, last) of consecutive items whose sizes add up to about most; an item above it stands alone."""
    first, held, sizes = 0, 0, list(sizes)
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


# ---- Arrow batches ----


def as_bytes(column: pa.Array) -> pa.Array:
    """Strings as their UTF-8 bytes, without a copy."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()) if not pa.types.is_binary(column.type) else column


def text_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """(first, last, texts) of consecutive rows with about most bytes of text, so that only those are ever Python objects."""
    texts = as_bytes(batch.column(column))
    for a, b in slices(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).tolist(), most):
        yield a, b, texts.slice(a, b - a).to_pylist()
