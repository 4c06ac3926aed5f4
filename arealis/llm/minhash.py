"""Near-duplicate detection by ProbMinHash over weighted word shingles.

A text is a distribution over its shingles of five words, each weighted by how often it comes. Every shingle is
a Poisson process whose rate is that weight: its arrivals, drawn from the shingle's hash alone, fall at random
into registers, and each register keeps the shingle that comes first. Two texts agree in a register with
probability equal to their probability Jaccard similarity. Registers are banded to find candidates, and each
candidate pair is verified on the whole shingle vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected, mixed, stored, text_slices, word_hashes, word_spans

#: Bytes of text that are turned into arrays at a time.
SLICE = 1_500_000


def _factors(n: int) -> np.ndarray:
    """n odd factors, one for each place of a shingle."""
    return mixed(np.arange(n, dtype=np.uint64), 101) | np.uint64(1)


def shingle_vectors(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted by text and hash. A text of fewer words has one shingle, of all its words."""
    buffer, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    start, stop = word_spans(buffer, ends)
    words, n = word_hashes(buffer, start, stop), np.diff(np.searchsorted(start, ends))
    last = n.cumsum()
    per_text = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(texts)), per_text)
    at = np.arange(per_text.sum()) - np.repeat(per_text.cumsum() - per_text, per_text) + (last - n)[owner]
    end, hashes = last[owner], np.zeros(len(at), np.uint64)
    for k, factor in enumerate(_factors(width)):
        # a place beyond a short text's end counts too, so that shingles of different lengths differ
        hashes += np.where(at + k < end, words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else np.uint64(0), np.uint64(k + 1)) * factor
    hashes = mixed(hashes)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    where = np.flatnonzero(new)
    return owner[where], hashes[where], np.diff(np.append(where, len(hashes)))


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the shingle that arrives first in each register; 0 for a text without shingles.

    All shingles take their next arrival at once; one whose arrival is later than the last register of its text
    cannot come first any more and stops, so that long texts end after few arrivals of each shingle.
    """
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    time = np.zeros(len(hashes))
    live, turn = np.arange(len(hashes)), 0
    while len(live):
        draw = mixed(hashes[live], 2 * turn + 1)
        u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time[live] -= np.log(u) / counts[live]
        # the register is another draw of the same arrival
        cell = owner[live] * registers + (mixed(hashes[live], 2 * turn + 2) >> np.uint64(16)).astype(np.int64) % registers
        np.minimum.at(first, cell, time[live])
        won = time[live] == first[cell]
        winner[cell[won]] = hashes[live][won]
        latest = first.reshape(texts, registers).max(1)
        live, turn = live[time[live] < latest[owner[live]]], turn + 1
    return winner.reshape(texts, registers)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two vectors, hashes a and b in ascending order with weights x and y.

    The sum, over shared shingles d, of 1 / sum(max(x / x_d, y / y_d)). With shingles in order of x / y, the inner
    sum is a prefix of y over y_d and a suffix of x over x_d.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    p, q = x[i].astype(float), y[j].astype(float)
    only_x, only_y = x.sum() - p.sum(), y.sum() - q.sum()
    ratio = p / q
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    below = np.concatenate([[0.0], np.cumsum(q)])
    above = p.sum() - np.concatenate([[0.0], np.cumsum(p)])
    at = np.searchsorted(ratio, ratio, side="left")
    return float((1.0 / ((above[at] + only_x) / p + (below[at] + only_y) / q)).sum())


#: Of several documents of a bucket, so many in turn are compared with all the others; what is still open then is compared in blocks.
PIVOTS = 3
#: Documents and shingles of a block, about, and documents that are compared with one copy of a pivot.
BLOCK, BLOCK_SHINGLES, BESIDE = 400, 400_000, 500
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def vector(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts; no counts are ones."""
    h = np.frombuffer(hashes, "<u8")
    return h, np.frombuffer(counts, "<u4") if counts else np.ones(len(h), np.uint32)


def runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows, as they come, grouped by equal neighbours; a row at a time is held."""
    rows = (row for batch in batches for k in range(0, batch.num_rows, 64) for row in batch.slice(k, 64).to_pylist())
    return groupby(rows, key=lambda row: tuple(row[k] for k in key))


def linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each pivot a, whose row comes first in its run, with the run's other rows."""
    out: list[tuple[int, int]] = []
    for (a, _), rows in runs(batches, ("a", "slot")):
        first = next(rows)
        if first["role"]:
            raise RuntimeError("a pivot is missing")
        pivot = vector(first["hashes"], first["counts"])
        out += [(a, row["id"]) for row in rows if probability_jaccard(*pivot, *vector(row["hashes"], row["counts"])) >= threshold - 1e-12]
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=LINKS)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=LINKS)


class Joined:
    """Union of numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def across(rows: list[dict], threshold: float) -> list[tuple[int, int]]:
    """Links between documents of two blocks of a bucket that join what roots leave apart: a spanning forest, each link verified.

    Shared shingles are counted by products of zero-one matrices. Where no shingle repeats within a text, the count
    gives the similarity; else the weight of shared shingles, as a share of either text's, bounds it from above, and
    what it lets through is compared in full, unless it is joined already.
    """
    lo, hi = rows[0]["lo"], rows[0]["hi"]
    n, ids = len(rows), [r["id"] for r in rows]
    vectors = [vector(r["hashes"], r["counts"]) for r in rows]
    sizes, total = np.array([len(h) for h, _ in vectors]), np.array([int(c.sum()) for _, c in vectors])
    _, column, holders = np.unique(np.concatenate([h for h, _ in vectors]), return_inverse=True, return_counts=True)
    owner, weight = np.repeat(np.arange(n), sizes), np.concatenate([c for _, c in vectors]).astype(np.float32)
    several = holders[column] > 1
    owner, weight, column = owner[several], weight[several], np.unique(column[several], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, weight, column = owner[order], weight[order], column[order]
    left, right = (np.array([i for i, r in enumerate(rows) if r["block"] == k]) for k in (lo, hi))
    if not len(left) or not len(right):
        return []
    plain = total == sizes
    weighted = not plain.all()
    shared, held_left, held_right = (np.zeros((len(left), len(right)), np.float32) for _ in range(3))
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(max(1, 1_500_000 // n), max(columns, 1))
    for first in range(0, columns, width):
        x, y = np.searchsorted(column, [first, first + width])
        zero_one = np.zeros((n, width), np.float32)
        zero_one[owner[x:y], column[x:y] - first] = 1
        shared += zero_one[left] @ zero_one[right].T
        if weighted:
            weights = np.zeros((n, width), np.float32)
            weights[owner[x:y], column[x:y] - first] = weight[x:y]
            held_left += weights[left] @ zero_one[right].T
            held_right += zero_one[left] @ weights[right].T
    number = {r: k for k, r in enumerate(dict.fromkeys(r["root"] for r in rows))}
    label, parts, out = np.array([number[r["root"]] for r in rows]), Joined(len(number)), []
    both = plain[left][:, None] & plain[right]
    like = both & (shared >= (threshold - 1e-12) * (sizes[left][:, None] + sizes[right] - shared).astype(np.float64))
    while True:  # links of texts without repeats: of every row the first that joins it to something else
        now = np.array([parts.find(k) for k in range(len(number))])[label]
        open_ = like & (now[left][:, None] != now[right])
        hit = np.flatnonzero(open_.any(1))
        if not len(hit):
            break
        for i, j in zip(left[hit].tolist(), right[open_[hit].argmax(1)].tolist()):
            if parts.join(int(label[i]), int(label[j])):
                out.append((ids[i], ids[j]))
    if weighted:
        bound = np.minimum(held_left / total[left][:, None], held_right / total[right])
        for i, j in zip(*np.nonzero(~both & (bound >= threshold - 1e-4))):
            i, j = int(left[i]), int(right[j])
            if parts.find(int(label[i])) != parts.find(int(label[j])) and probability_jaccard(*vectors[i], *vectors[j]) >= threshold - 1e-12:
                parts.join(int(label[i]), int(label[j]))
                out.append((ids[i], ids[j]))
    return out


def each_across(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """across() for each run of rows with the same key, lo and hi."""
    for _, rows in runs(batches, ("key", "lo", "hi")):
        if out := across(list(rows), threshold):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=LINKS)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 26, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, rep_id and class_id.

    rep_id is the smallest id of the documents with the same words in order (told by a 128-bit digest of them),
    class_id the smallest id of the class: of all that a chain of verified links joins. Words are what lies between
    ASCII white space, in lower case. Texts without a word, null among them, form a class each of their own.

    A bucket holds the representatives that agree in a band. Its least member, the pivot, is compared with all others,
    then the next one, PIVOTS times, and links join classes in between; only buckets that hold several classes go on.
    What is still open is compared in blocks, all with all, where each pair of blocks gives a spanning forest
    of its links. So no link between classes is lost, no pair is ever a row unless a pivot or a link is in it, and a
    group of copies counts once. With 26 bands of 5 registers a pair at the threshold of 0.8 is missed with a chance
    of 3e-5, one at 0.9 with less than 1e-9. Rows that repeat an id are one document, whose text is that of greatest
    digest; rows without an id are one too, which can only join texts of its very words. An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text", SLICE):
                texts = [t or b"" for t in texts]
                owner, hashes, counts = shingle_vectors(texts, width)
                sig = signatures(owner, hashes, counts, b - a, bands * rows)
                keys = np.tile(np.arange(bands, dtype=np.uint64), (b - a, 1))
                for k in range(rows):
                    keys = mixed(keys ^ sig[:, k::rows], k)
                n = np.bincount(owner, minlength=b - a)
                names = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(names, pa.binary()), pa.array(n, pa.int64()), flat], names=["id", "name", "n", "keys"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text", SLICE):
                texts = [t or b"" for t in texts]
                owner, hashes, counts = shingle_vectors(texts, width)
                cuts = np.searchsorted(owner, np.arange(b - a + 1))
                parts = [*zip(cuts, cuts[1:])]
                names = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]
                many = [(c := counts[i:j]).max(initial=1) > 1 and c.astype("<u4").tobytes() or b"" for i, j in parts]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(names, pa.binary()), pa.array([hashes[i:j].tobytes() for i, j in parts], pa.binary()), pa.array(many, pa.binary())], names=["id", "name", "hashes", "counts"])

    sketches = source.mapInArrow(sketch, "id long, name binary, n long, keys array<long>")
    sketches = stored(sketches.groupBy("id").agg(F.max(F.struct("name", "n", "keys")).alias("v")).select("id", "v.*"), "sketches")
    reps = sketches.where("n > 0").groupBy("name").agg(F.min("id").alias("rep_id"), F.count("*").alias("copies"))
    copies = reps.where("copies > 1").select("name", "rep_id")
    members = stored(sketches.select("id", "name", "n").join(copies, "name", "left").select("id", F.when(F.col("n") > 0, F.coalesce("rep_id", "id")).otherwise(F.col("id")).alias("rep_id")), "members")

    alone = members.where("id = rep_id").select("id")
    banded = sketches.where("n > 0").join(alone, "id").select("id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rest = stored(banded.join(shared.select("key"), "key"), "buckets")

    place = stored(rest.select("id").distinct().withColumn("root", F.col("id")), "place")
    made = source.join(place.select("id"), "id", "left_semi").mapInArrow(vectors, "id long, name binary, hashes binary, counts binary")
    made = made.groupBy("id").agg(F.max(F.struct("name", "hashes", "counts")).alias("v")).select("id", "v.hashes", "v.counts")
    made = stored(made.withColumn("size", F.expr("octet_length(hashes) div 8")), "vectors")

    def opened(rest: DataFrame) -> DataFrame:
        """Members of buckets that hold several classes: key, id, root, a (the least member), a_root, size and shingles of the bucket."""
        here = rest.join(place, "id")
        heads = here.groupBy("key").agg(F.min(F.struct("id", "root")).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi")
        return here.join(heads.select("key", F.col("p.id").alias("a"), F.col("p.root").alias("a_root"), "size"), "key")

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        """Links of pairs (a, b, size): copies of the pivot a's vector, each beside its share of the others."""
        pairs = pairs.groupBy("a", "b").agg(F.max("size").alias("size"))
        pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / F.lit(float(BESIDE)))).cast("int").alias("slot"))
        pivots = pairs.groupBy("a").agg(F.max("slot").alias("slots")).select("a", F.explode(F.sequence(F.lit(0), "slots")).alias("slot"), F.lit(0).alias("role"), F.col("a").alias("id"))
        sides = pivots.unionByName(pairs.select("a", "slot", F.lit(1).alias("role"), F.col("b").alias("id"))).join(made.select("id", "hashes", "counts"), "id")
        sides = sides.select("a", "slot", "role", "id", "hashes", "counts").repartition("a", "slot").sortWithinPartitions("a", "slot", "role")
        return stored(sides.mapInArrow(lambda batches: linked(batches, threshold), "a long, b long"), name)

    def joined(links: DataFrame) -> DataFrame:
        """place after these links."""
        root = lambda c: place.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        between = stored(links.join(root("a"), "a").join(root("b"), "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "between")
        if between.isEmpty():
            return place
        roots = connected(between).select(F.col("node").alias("root"), F.col("root").alias("less"))
        return stored(place.join(roots, "root", "left").select("id", F.coalesce("less", "root").alias("root")), "place")

    for turn in range(PIVOTS):
        others = stored(opened(rest).where("id > a"), "open")
        if others.isEmpty():
            break
        place = joined(compared(others.where("root <> a_root").select("a", F.col("id").alias("b"), "size"), "links"))
        rest = others.select("key", "id")
    else:
        left = opened(rest).select("key", "id", "root").join(made, "id")
        weight = left.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / F.lit(float(BLOCK))), F.ceil(F.sum("size") / F.lit(float(BLOCK_SHINGLES)))).cast("int").alias("blocks"))
        parts = left.join(weight, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        parts = parts.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "id", "root", "hashes", "counts")
        late = parts.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(lambda batches: each_across(batches, threshold), "a long, b long")
        place = joined(stored(late, "late"))
    classes = members.join(place.withColumnRenamed("id", "rep_id"), "rep_id", "left")
    return classes.select(F.col("id").alias("doc_id"), "rep_id", F.coalesce("root", "rep_id").alias("class_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The document of smallest id of each class, with all its columns; rows that repeat an id stay or go together, rows without one stay."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings).where("doc_id <> class_id").select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
