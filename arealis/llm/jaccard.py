"""Exact joins of texts by Jaccard similarity of their word n-grams, with adaptive multi-match prefixes.

Grams of a document stand in one order for all, rare ones first. Of two documents that are alike at threshold t, the
first size - ceil(t * size) + m grams of either share at least m, for every m up to ceil(t * size). A longer prefix
(a larger m) has more candidates by single grams but asks for more shared ones, so each document takes the m whose
estimated cost, of places read and of candidates verified, is least; a pair must share as many grams of its prefixes as
the smaller m of the two says before its whole sets are compared.

How many documents hold a gram comes from slices of texts: a slice sends its different grams, each once, to the task that
owns their range of hashes, and gets the sums back. A hash's leading bits stand for a gram there, which can only make a
gram look more frequent than it is, alike for every document that holds it. Slices lie in a table bucketed by their
number, so sums come to them without moving them, and whole sets are taken from there for the few pairs that are left.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import packed, rows_by, unpacked
from .minhash import BESIDE, BLOCK, BLOCK_SHINGLES, each_across, linked, shingle_vectors
from .shared import connected, scratch_path, shuffle_width, stored, text_slices

#: Bytes of text that are turned into grams at a time.
SLICE = 1_500_000
#: The longest multi-match that a document may take, and what comparing one gram of a candidate costs against reading one place of a bucket.
MOST_MATCHES, VERIFY = 8, 0.125
#: Rounds in which each document is compared with one other of its buckets, and members up to which all pairs of a bucket that are still apart are counted.
ROUNDS, SMALL = 3, 60


def asked(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Grams that a document shares at least with any other that is alike: ceil(percent * size / 100)."""
    return -(-percent * sizes // 100)


def ranges(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard's part of ascending keys ends, from 0."""
    return np.searchsorted(keys, [(k << bits) // shards for k in range(shards)] + [1 << bits])


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """df written to the shared folder in buckets, so that joins by that column need not move it; nothing stays in the catalog."""
    spark, entry = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(shuffle_width(spark), by).option("path", scratch_path(spark, name)).saveAsTable(entry)
    table = spark.table(entry)
    table.schema  # resolved, with its files, before the entry goes; those of an external table stay
    spark.sql(f"DROP TABLE {entry}")
    return table


def planes(x: np.ndarray) -> bytes:
    """Ascending numbers as their differences, in as few bytes each as the largest takes, after a byte that tells how many."""
    gaps = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    width = data[0]
    part = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :width] = part
    return out.view("<u8").ravel().cumsum(dtype=np.uint64)


def grams_held(slices: DataFrame) -> DataFrame:
    """(slice, totals): of each different key of a slice's grams, in ascending order, how many documents hold it, by (shard, packed sums)."""
    shards = key_shards(slices)
    bits = key_bits(shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                keys, times = np.unique(np.frombuffer(row["hashes"], "<u8") >> np.uint64(64 - bits), return_counts=True)
                cuts = ranges(keys.astype(np.int64), bits, shards)
                some = []
                for shard, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if j > i:
                        more = np.flatnonzero(times[i:j] > 1)
                        some.append((shard, planes(keys[i:j] - np.uint64((shard << bits) // shards)), planes(more), packed(times[i:j][more])))
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["slice"])), *[pa.array(x, k) for x, k in zip(zip(*some), (pa.int32(), *[pa.binary()] * 3))]], names=["slice", "shard", "keys", "more", "times"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in rows_by(batches, "shard"):
            names, keys, held = [], [], []  # the share of one range of hashes: about as many keys as a task has grams
            for row in rows:
                names.append(row["slice"])
                keys.append(unplanes(row["keys"]).astype(np.uint32))
                times = np.ones(len(keys[-1]), np.int64)
                times[unplanes(row["more"]).astype(np.int64)] = unpacked(row["times"])
                held.append(times)
            kind = np.unique(np.concatenate(keys), return_inverse=True)[1].ravel()
            total = np.zeros(int(kind.max()) + 1, np.int64)
            np.add.at(total, kind, np.concatenate(held))
            ends = np.cumsum([*map(len, keys)])
            for name, i, j in zip(names, [0, *ends], ends):
                yield pa.RecordBatch.from_pydict({"slice": [name], "shard": pa.array([shard], pa.int32()), "totals": [packed(total[kind[i:j]])]})

    blocks = slices.mapInArrow(deal, "slice long, shard int, keys binary, more binary, times binary")
    sums = blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(add, "slice long, shard int, totals binary")
    return sums.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("shard", "totals"))).alias("totals"))  # as many as there are shards


def key_shards(df: DataFrame) -> int:
    """Ranges of keys: some for each task, which takes one after the other."""
    return 4 * shuffle_width(df.sparkSession)


def key_bits(shards: int) -> int:
    return 27 + shards.bit_length()  # 28 bits within a shard, whose gaps mostly fit three bytes


def chosen_prefix(dfs: np.ndarray, percent: int) -> tuple[int, int]:
    """(grams of the prefix, matches asked for) of least estimated cost; dfs of a document's grams in ascending order.

    Reading a prefix costs a place for each other document of its buckets. By Markov's inequality at most a share of 1 / m
    of these places belongs to candidates that are met m times, and each of those costs a comparison of whole sets.
    """
    n = len(dfs)
    least = int(asked(np.array(n), percent))
    matches = np.arange(1, min(MOST_MATCHES, least) + 1)
    places = np.cumsum(np.maximum(dfs - 1, 0))[n - least + matches - 1].astype(float)
    best = int(np.argmin(places * (1 + VERIFY * n / matches)))
    return n - least + int(matches[best]), int(matches[best])


class Candidates:
    """Pairs of documents that share enough of their prefixes, and classes of those that are alike.

    made has (id, slice, size, matches, keys): keys are the grams of a prefix that other documents hold too. vectors() gives
    (id, hashes, counts) of chosen ids.
    """

    def __init__(self, made: DataFrame, vectors, percent: int):
        self.made, self.vectors, self.percent = made, vectors, percent
        buckets = made.select("id", F.explode("keys").alias("key"))
        shared = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        self.rest = stored(buckets.join(shared, "key").select("key", "id"), "buckets")
        self.place = stored(self.rest.select("id").distinct().withColumn("root", F.col("id")), "place")

    def opened(self, turn: int) -> DataFrame:
        """Members of buckets that hold several classes: key, id, root, members, and a pivot, another one each turn."""
        here = self.rest.join(self.place, "id")
        first = F.min(F.struct((F.xxhash64("id", F.lit(turn)) if turn else F.col("id")).alias("o"), "id", "root"))
        heads = here.groupBy("key").agg(first.alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi")
        return here.join(heads.select("key", "members", F.col("p.o").alias("o"), F.col("p.id").alias("a"), F.col("p.root").alias("a_root")), "key")

    def compared(self, pairs: DataFrame, name: str) -> DataFrame:
        """Links among different pairs (a, b): copies of a's set, each beside its share of the others."""
        chosen = self.vectors(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        per = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(BESIDE))).cast("int").alias("slots"))
        dealt = pairs.join(per, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slots")).alias("slot"), F.lit(1).alias("role"), F.col("b").alias("id"))
        pivots = per.select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(0).alias("role"), F.col("a").alias("id"))
        sides = pivots.unionByName(dealt).join(chosen, "id").repartition("a", "slot").sortWithinPartitions("a", "slot", "role")
        threshold = self.percent / 100
        return stored(sides.mapInArrow(lambda batches: linked(batches, threshold), "a long, b long"), name)

    def join(self, links: DataFrame) -> bool:
        """Whether links joined classes."""
        root = lambda c: self.place.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        between = stored(links.join(root("a"), "a").join(root("b"), "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "between")
        if between.isEmpty():
            return False
        roots = connected(between).select(F.col("node").alias("root"), F.col("root").alias("less"))
        self.place = stored(self.place.join(roots, "root", "left").select("id", F.coalesce("less", "root").alias("root")), "place")
        return True

    def of_pivots(self, turn: int) -> DataFrame:
        """Each document with the first pivot of its open buckets that is in another class, if their prefixes share enough."""
        pairs = self.opened(turn).where("root <> a_root").groupBy(F.col("id").alias("b")).agg(F.min(F.struct("o", "a")).alias("p")).select("p.a", "b")
        side = lambda c: self.made.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("keys", "matches", "size")])
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * self.percent)
        return both.where(F.size(F.array_intersect("keys_a", "keys_b")) >= F.least("matches_a", "matches_b")).select("a", "b")

    def of_small_buckets(self, members: DataFrame) -> DataFrame:
        """Pairs of different classes that meet in open buckets as often as both ask for.

        All buckets in which such a pair meets are open. Large ones aren't paired here; as many as both are in may add to a pair's count.
        """
        large = members.groupBy("id").agg(F.count_if(F.col("members") > SMALL).alias("large"))
        side = members.where(F.col("members") <= SMALL).join(self.made.select("id", "size", "matches"), "id").join(large, "id").select("key", "id", "root", "size", "matches", "large")
        other = side.withColumnsRenamed({c: f"{c}_b" for c in side.columns if c != "key"})
        met = side.join(other, "key").where(f"id < id_b AND root <> root_b AND least(size, size_b) * 100 >= greatest(size, size_b) * {self.percent}")
        met = met.groupBy("id", "id_b").agg(F.count("*").alias("n"), F.least(F.max("matches"), F.max("matches_b")).alias("asked"), F.least(F.max("large"), F.max("large_b")).alias("more"))
        return met.where("n + more >= asked").select(F.col("id").alias("a"), F.col("id_b").alias("b"))

    def of_large_buckets(self, members: DataFrame) -> DataFrame:
        """Links that join what is apart in large buckets, compared block by block.

        Where the same documents meet in many buckets, it costs less to compare all of them with each other once: buckets that
        hang together through their members are taken as one if that moves fewer sets.
        """
        left = members.where(F.col("members") > SMALL).select("key", "id", "root")
        heads = left.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("m"))
        near = connected(left.join(heads, "key").select("a", F.col("id").alias("b")))
        blocks = lambda n: n * F.ceil(n / F.lit(float(BLOCK)))
        apart = heads.join(near, F.col("a") == F.col("node")).groupBy(F.col("root").alias("group")).agg(F.sum(blocks(F.col("m"))).alias("apart"))
        groups = near.groupBy(F.col("root").alias("group")).agg(F.count("*").alias("m")).join(apart, "group").select("group", (blocks(F.col("m")) < F.col("apart")).alias("whole"))
        left = left.join(near.select(F.col("node").alias("id"), F.col("root").alias("group")), "id").join(groups, "group")
        left = left.select(F.when(F.col("whole"), F.xxhash64("group", F.lit("group"))).otherwise(F.col("key")).alias("key"), "id", "root").distinct()
        left = left.join(self.vectors(left.select("id").distinct()), "id").withColumn("size", F.expr("octet_length(hashes) div 8"))
        weight = left.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / F.lit(float(BLOCK))), F.ceil(F.sum("size") / F.lit(float(BLOCK_SHINGLES)))).cast("int").alias("blocks"))
        parts = left.join(weight, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        parts = parts.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "id", "root", "hashes", "counts")
        threshold = self.percent / 100
        return parts.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(lambda batches: each_across(batches, threshold), "a long, b long")

    def classes(self) -> DataFrame:
        """(id, root): the smallest id that a chain of links reaches."""
        for turn in range(ROUNDS):
            pairs = stored(self.of_pivots(turn), "pairs")
            links = self.compared(pairs, "links")
            if not self.join(links) or links.count() < pairs.count() / 4:  # what is still apart is so mostly because it isn't alike
                break
        members = stored(self.opened(0).select("key", "id", "root", "members"), "open")
        pairs = stored(self.of_small_buckets(members), "pairs")
        if not pairs.isEmpty():
            self.join(self.compared(pairs, "links"))
        if not members.where(F.col("members") > SMALL).isEmpty():
            self.join(stored(self.of_large_buckets(members), "late"))
        return self.place


def linked_groups(docs: DataFrame, percent: int = 85, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are what lies between ASCII white space, A to Z in lower case. A document's set has its different sequences of
    width words, or with fewer words its whole sequence; two documents are linked when 100 * shared >= percent * all of
    both. component_id is the smallest id that a chain of links reaches. Texts without a word, null among them, are linked with
    nothing. Documents of the same words stand for each other by a 128-bit digest of them and count once; a group of copies
    or near copies is joined through members that are compared with all others, never by all its pairs.
    Rows that repeat an id are one document, with the text of greatest digest; rows without an id are each alone, with a
    null component. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    bits = key_bits(key_shards(docs))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document its digest and size; of each slice the grams of its different documents."""
        kinds = {"slice": pa.int64(), "id": pa.int64(), "name": pa.binary(), "n": pa.int64(), "docs": pa.binary(), "sizes": pa.binary(), "hashes": pa.binary()}
        for batch in batches:
            for a, b, texts in text_slices(batch, "text", SLICE):
                texts = [(t or b"").lower() for t in texts]  # of bytes: A to Z only
                owner, hashes, _ = shingle_vectors(texts, width)
                names, n, at = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts], np.bincount(owner, minlength=b - a), batch.column("row")[a].as_py()
                blank = pa.nulls(b - a, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, at)), batch.column("id").slice(a, b - a), pa.array(names, pa.binary()), pa.array(n), blank, blank, blank], names=[*kinds])
                first: dict[bytes, int] = {}
                for i, name in enumerate(names):
                    first.setdefault(name, i)
                once = np.array([i for i in first.values() if n[i]], np.int64)
                if len(once):
                    pick = np.repeat((n.cumsum() - n)[once] - (n[once].cumsum() - n[once]), n[once]) + np.arange(n[once].sum())
                    whole = [at, None, None, None, b"".join(names[i] for i in once), packed(n[once]), hashes[pick].astype("<u8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(whole, kinds.values())], names=[*kinds])

    def documents(row: dict) -> Iterator[tuple[int, int, int, int]]:
        """(id, first gram, end, least number of shared grams) of the documents that a slice keeps."""
        n, ids, at = unpacked(row["sizes"]), {k["name"]: k["id"] for k in row["keep"]}, 0
        for k, (size, least) in enumerate(zip(n.tolist(), asked(n, percent).tolist())):
            if (i := ids.get(row["docs"][16 * k : 16 * k + 16])) is not None:
                yield i, at, at + size, least
            at += size

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefixes of documents that share enough with others together; only grams that others hold are told."""
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                hashes = np.frombuffer(row["hashes"], "<u8")
                kind = np.unique(hashes >> np.uint64(64 - bits), return_inverse=True)[1].ravel()
                dfs, out = np.concatenate([unpacked(t["totals"]) for t in row["totals"]])[kind], []
                for i, x, y, least in documents(row):
                    mine, df = hashes[x:y], dfs[x:y]
                    if np.count_nonzero(df > 1) >= least:
                        order = np.lexsort((mine, df))
                        mine, df = mine[order], df[order]
                        prefix, matches = chosen_prefix(df, percent)
                        out.append((i, row["slice"], y - x, matches, mine[:prefix][df[:prefix] > 1].view("<i8")))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["id", "slice", "size", "matches", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                found = [(i, row["hashes"][8 * x : 8 * y], b"") for i, x, y, _ in documents(row)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), (pa.int64(), pa.binary(), pa.binary()))], names=["id", "hashes", "counts"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    first = bucketed(source.mapInArrow(sketch, "slice long, id long, name binary, n long, docs binary, sizes binary, hashes binary"), "grams", "slice")
    said, slices = first.where("docs IS NULL").select("id", "name", "n", "slice"), first.where("docs IS NOT NULL").select("slice", "docs", "sizes", "hashes")
    known = stored(said.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("name", "n", "slice")).alias("v")).select("id", "v.*"), "known")
    groups = stored(known.where("n > 0").groupBy("name").agg(F.min(F.struct("id", "slice")).alias("v"), F.count("*").alias("copies")).select("name", F.col("v.id").alias("rep"), "v.slice", "copies"), "groups")

    def kept(rows: DataFrame) -> DataFrame:
        """(slice, keep): names and ids of chosen documents, of one slice each."""
        return rows.groupBy("slice").agg(F.collect_list(F.struct("name", "id")).alias("keep"))

    names = groups.select("slice", "name", F.col("rep").alias("id"))
    made = slices.join(grams_held(slices.select("slice", "hashes")), "slice").join(kept(names), "slice")
    made = stored(made.mapInArrow(prefixed, "id long, slice long, size int, matches int, keys array<long>"), "prefixes")
    vectors = lambda ids: slices.join(kept(names.join(ids, "id", "left_semi")), "slice").mapInArrow(sets, "id long, hashes binary, counts binary")
    place = Candidates(made, vectors, percent).classes()

    copies = groups.where("copies > 1").select("name", "rep")
    members = known.join(copies, "name", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep"))
    out = members.join(place.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
    return out.unionByName(said.where("id IS NULL").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
