"""Alignment of two tokenizers over a corpus: which ids of one go with which ids of the other.

Both tokenizers cut a text's bytes; an occurrence of one's token and one of the other's are linked where their bytes
overlap. The count of an id pair is the number of documents that hold it linked. Counts are kept as dense matrices, a
stripe of one side's ids by all of the other's: id a belongs to stripe a % stripes, so that frequent ids, which have
small numbers, are spread. Tasks turn slices of texts into blocks, one for each stripe, that hold the slice's pairs
and which document has which how often. Blocks are dealt by stripe, pairs are added into the stripe's matrix, and row
maxima tell each id's best partners. Links are scored in the same way: dealt by stripe, beside its matrix.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLANK, distinct_words, shuffle_width, stored, text_slices

#: Bytes of text that are turned into blocks at a time, and units that a worker remembers.
SLICE, UNITS_KEPT = 5_000_000, 300_000


def byte_characters() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: visible Latin-1 ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Last bytes of white space beyond ASCII, and the bytes that stand before them; and ASCII that some take for white space.
LATE, BEFORE, INK = np.zeros(256, bool), np.zeros(256, bool), ~BLANK
LATE[[*range(0x80, 0x8F), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
BEFORE[[0xC2, 0x80, 0x81, 0x9A, 0xA0]] = True
INK[0x1C:0x20] = False


class Aligner:
    """Both tokenizers, and the links and groups of units.

    A unit is a run of spaces with what follows, up to the next space that comes after something else. No pre-token
    of the first tokenizer and no piece of the second reaches across such a place, so the ids of a text are those of its units.
    """

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a.encode_special_tokens = True
        as_byte = byte_characters()
        self.ids_b = self.b.get_piece_size()
        self.ids_a = max(self.a.get_vocab().values()) + 1
        self.bytes_a = [b""] * self.ids_a
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.ids_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        # numbers with what follows them: within a side of a group, after its first side, after its second
        self.names = np.array([[f"{i}{sign}" for i in range(max(self.ids_a, self.ids_b))] for sign in ",|;"], object)
        self.known: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def ids_of(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides and how many each unit has; units that end surely without white space are one text for the first side."""
        calm = [not BLANK[u[-1]] and INK[u[-1]] and not (LATE[u[-1]] and BEFORE[u[-2]]) for u in units]
        together = self.a.encode(b"".join(u for u, c in zip(units, calm) if c).decode(), add_special_tokens=False).ids if any(calm) else []
        ids = np.array(together, np.int64)
        upto = np.searchsorted(self.size_a[ids].cumsum(), np.cumsum([len(u) for u, c in zip(units, calm) if c])) + 1
        n_a = np.zeros(len(units), np.int64)
        n_a[np.array(calm, bool)] = np.diff(upto, prepend=0)
        if not all(calm):
            cuts = [0, *upto.tolist()]
            known, rest = iter(zip(cuts, cuts[1:])), iter(self.a.encode_batch([u.decode() for u, c in zip(units, calm) if not c], add_special_tokens=False))
            found = [together[slice(*next(known))] if c else next(rest).ids for c in calm]
            n_a, ids = np.array([*map(len, found)], np.int64), np.fromiter(chain.from_iterable(found), np.int64)
        # the model itself writes a space before a text, but not before none
        found_b = [x or [self.space] for x in self.b.encode([u[1:].decode() for u in units], num_threads=1)]
        return ids, n_a, np.fromiter(chain.from_iterable(found_b), np.int64), np.array([*map(len, found_b)], np.int64)

    def learn(self, units: list[bytes]) -> None:
        """Units with (n_a, n_b, groups, pairs as bytes, groups as text), None for one whose bytes either side doesn't give back."""
        ids_a, n_a, ids_b, n_b = self.ids_of(units)
        data, over = b"".join(units), np.cumsum([*map(len, units)])
        end_a, end_b = self.size_a[ids_a].cumsum(), self.size_b[ids_b].cumsum()
        if not (np.array_equal(end_a[n_a.cumsum() - 1], over) and np.array_equal(end_b[n_b.cumsum() - 1], over) and b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == data == b"".join(map(self.bytes_b.__getitem__, ids_b.tolist()))):
            if len(units) == 1:
                self.known[units[0]] = None
            else:
                for half in (units[: len(units) // 2], units[len(units) // 2 :]):
                    self.learn(half)
            return
        ends = np.union1d(end_a, end_b)  # each of them ends one link
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pairs = (ids_a[at_a] * self.ids_b + ids_b[at_b]).astype("<u4").tobytes()
        both = ends[(end_a[at_a] == ends) & (end_b[at_b] == ends)]
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        written = np.empty(len(ids_a) + len(ids_b), object)
        written[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = self.names[np.where(both[group_a] == end_a, 1, 0), ids_a]
        written[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")] = self.names[np.where(both[group_b] == end_b, 2, 0), ids_b]
        written, links, groups = written.tolist(), [0, *(4 * np.searchsorted(ends, over) + 4).tolist()], [0, *(np.searchsorted(both, over) + 1).tolist()]
        tokens = [0, *(n_a + n_b).cumsum().tolist()]
        for u, a, b, i, j, g, h, x, y in zip(units, n_a.tolist(), n_b.tolist(), links, links[1:], groups, groups[1:], tokens, tokens[1:]):
            self.known[u] = (a, b, h - g, pairs[i:j], "".join(written[x:y]))

    def of(self, units: list[bytes]) -> list[tuple | None]:
        fresh = [u for u in units if u not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > UNITS_KEPT:
                self.old, self.known, fresh = self.known, {}, units
            self.known.update((u, self.old[u]) for u in fresh if u in self.old)
            fresh = [u for u in fresh if u not in self.known]
            # the second side reads this sign as a space, so it never gives it back
            self.known.update((u, None) for u in fresh if b"\xe2\x96\x81" in u)
            fresh = [u for u in fresh if u not in self.known]
            for k in range(0, len(fresh), 20_000):
                self.learn(fresh[k : k + 20_000])
        return [*map(self.known.__getitem__, units)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each pair of vocabularies and worker; workers outlive their tasks."""
    if (byte_path, piece_path) not in _aligners:
        _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _aligners[byte_path, piece_path]


def unit_starts(buffer: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of a space after what is surely no white space, and the beginnings of texts (two bytes long at least)."""
    cut = np.zeros(len(buffer), bool)
    cut[1:] = (buffer[1:] == 32) & INK[buffer[:-1]]
    cut[2:] &= ~(LATE[buffer[1:-1]] & BEFORE[buffer[:-2]])
    cut[begins] = True
    return np.flatnonzero(cut)


class Slice:
    """Alignment of some texts: figures and group digests of each, and which holds which pairs how often."""

    def __init__(self, texts: list[bytes], both: Aligner):
        self.n = np.zeros((4, len(texts)), np.int64)  # tokens of a and b, groups, links
        self.digests = [""] * len(texts)
        rows = [i for i, t in enumerate(texts) if t]
        self.text = self.pair = self.times = np.zeros(0, np.int64)
        if not rows:
            return
        data = b"".join(b" " + texts[i] for i in rows)
        begins = np.cumsum([0, *(len(texts[i]) + 1 for i in rows)])
        buffer = np.frombuffer(data, np.uint8)
        start = unit_starts(buffer, begins[:-1])
        stop = np.append(start[1:], len(buffer))
        first, kind = distinct_words(buffer, start, stop)
        found = both.of([data[i:j] for i, j in zip(start[first].tolist(), stop[first].tolist())])
        good = np.array([f is not None for f in found])
        empty = (0, 0, 0, b"", "")
        a, b, groups, links, named = zip(*[f or empty for f in found])
        size = np.array([*map(len, links)], np.int64) // 4
        cuts = np.searchsorted(start, begins)
        whole = np.add.reduceat(~good[kind], cuts[:-1]) == 0
        for k, values in enumerate((np.array(a), np.array(b), np.array(groups), size)):
            self.n[k, rows] = np.add.reduceat(values[kind], cuts[:-1]) * whole
        kinds = kind.tolist()
        for i, ok, x, y in zip(rows, whole.tolist(), cuts.tolist(), cuts[1:].tolist()):
            if ok:
                self.digests[i] = hashlib.sha256("".join([named[k] for k in kinds[x:y]])[:-1].encode()).hexdigest()
        # units of each text, then the pairs of those units
        owner = np.repeat(np.arange(len(rows)), np.diff(cuts))
        keep = whole[owner]
        used, times = np.unique(owner[keep] * len(first) + kind[keep], return_counts=True)
        owner, unit = np.divmod(used, len(first))
        pool, n = np.frombuffer(b"".join(links), "<u4").astype(np.int64), size[unit]
        upto = n.cumsum() - n
        pairs = pool[np.repeat((size.cumsum() - size)[unit] - upto, n) + np.arange(n.sum())]
        key = (np.repeat(owner, n) << 32) | pairs
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.repeat(times, n)[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.times = np.add.reduceat(times, new) if len(new) else times
        self.text, self.pair = np.array(rows)[key[new] >> 32], key[new] & 0xFFFFFFFF

    def blocks(self, ids_b: int, stripes: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
        """(stripe, pairs, documents that hold each; then of each text and pair: place of the pair, text, times)."""
        order = np.lexsort((self.text, self.pair // ids_b % stripes))
        text, pair, times = self.text[order], self.pair[order], self.times[order]
        stripe = pair // ids_b % stripes
        cuts = np.concatenate([[0], np.flatnonzero(stripe[1:] != stripe[:-1]) + 1, [len(stripe)]]) if len(stripe) else []
        for i, j in zip(cuts, cuts[1:]):
            pairs, slot, held = np.unique(pair[i:j], return_inverse=True, return_counts=True)
            yield int(stripe[i]), packed(pairs), packed(held), packed(slot.ravel()), packed(text[i:j]), packed(times[i:j])


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest takes, after a byte that tells how many."""
    size = next(s for s in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << (8 * s - (s == 8)))
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def rows_by(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows as they come, grouped by equal neighbours; a few at a time are held."""
    rows = (row for batch in batches for k in range(0, batch.num_rows, 32) for row in batch.slice(k, 32).to_pylist())
    return groupby(rows, key=lambda row: tuple(row[k] for k in key))


class Stripe:
    """The count matrix of one stripe: rows are ids of a (every stripes-th), columns ids of b."""

    def __init__(self, ids_a: int, ids_b: int, stripes: int):
        self.ids_b, self.stripes = ids_b, stripes
        self.block = np.zeros((-(-ids_a // stripes), ids_b), np.int64)
        self.seen: list[np.ndarray] = []

    def places(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pairs // self.ids_b // self.stripes, pairs % self.ids_b

    def fill(self, rows: Iterator[dict]) -> None:
        for row in rows:
            pairs = unpacked(row["pairs"])
            np.add.at(self.block, self.places(pairs), unpacked(row["held"]))
            self.seen.append(pairs)
            if sum(map(len, self.seen)) > 4 * self.block.size:
                self.seen = [np.unique(np.concatenate(self.seen))]

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs with a count, and their counts; all are 0 then."""
        pairs = np.unique(np.concatenate(self.seen))
        at, self.seen = self.places(pairs), []
        held = self.block[at]
        self.block[at] = 0
        return pairs, held


def aligned(docs: DataFrame, byte_path: str, piece_path: str, stripes: int = 256, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of all docs.

    rows has one row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. counts has
    one row per id pair that is linked anywhere: a, b, documents, best (no pair of a has more; ties are best alike).
    A text that is null or empty, or whose bytes either side doesn't give back, has zeros and no digest. Rows that
    repeat an id are documents of their own, so are rows without one. An empty table gives no rows; other columns are
    ignored, whatever their names. A text is one slice at least, however long it is.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = "slice long, at int, id long, n_a long, n_b long, n_groups long, n_links long, digest string, stripe int, pairs binary, held binary, slot binary, text binary, times binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        blank = lambda n, kind: pa.nulls(n, kind)
        for batch in batches:
            for i, j, texts in text_slices(batch, "text", SLICE):
                some = Slice([t or b"" for t in texts], both)
                n, name = j - i, batch.column("row")[i].as_py()
                doc = [pa.array(np.full(n, name)), pa.array(np.arange(n), pa.int32()), batch.column("id").slice(i, n), *map(pa.array, some.n), pa.array(some.digests), blank(n, pa.int32()), *[blank(n, pa.binary())] * 5]
                yield pa.RecordBatch.from_arrays(doc, names=NAMES)
                if found := [*some.blocks(both.ids_b, stripes)]:
                    m = len(found)
                    block = [pa.array(np.full(m, name)), *[blank(m, k) for k in (pa.int32(), *[pa.int64()] * 5, pa.string())], *[pa.array(x, k) for x, k in zip(zip(*found), (pa.int32(), *[pa.binary()] * 5))]]
                    yield pa.RecordBatch.from_arrays(block, names=NAMES)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, matrix = aligner(byte_path, piece_path), None
        for (stripe, salt), rows in rows_by(batches, "stripe", "salt"):
            matrix = matrix or Stripe(both.ids_a, both.ids_b, stripes)
            matrix.fill(rows)
            pairs, held = matrix.drain()
            yield pa.RecordBatch.from_pydict({"stripe": pa.array([stripe], pa.int32()), "salt": pa.array([salt], pa.int32()), "pairs": [packed(pairs)], "held": [packed(held)]})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, matrix = aligner(byte_path, piece_path), None
        for (stripe, _), rows in rows_by(batches, "stripe", "salt"):
            matrix = matrix or Stripe(both.ids_a, both.ids_b, stripes)
            matrix.fill([next(rows)])  # the counts come first
            most = matrix.block.max(1)
            for row in rows:
                a, b = matrix.places(unpacked(row["pairs"]))
                held = matrix.block[a, b]
                slot, (text, at), times = unpacked(row["slot"]), np.unique(unpacked(row["text"]), return_inverse=True), unpacked(row["times"])
                best, total = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
                np.add.at(best, at.ravel(), times * (held == most[a])[slot])
                np.add.at(total, at.ravel(), times * held[slot])
                yield pa.RecordBatch.from_pydict({"slice": [row["slice"]], "text": [packed(text)], "best": [packed(best)], "total": [packed(total)]})
            matrix.drain()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), rows in rows_by(batches, "slice"):
            best, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for row in rows:
                text = unpacked(row["text"])
                if len(best) <= text[-1]:
                    best, total = (np.concatenate([x, np.zeros(max(len(x), text[-1] + 1 - len(x)), np.int64)]) for x in (best, total))
                best[text] += unpacked(row["best"])
                total[text] += unpacked(row["total"])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(np.full(len(at), name)), "at": pa.array(at, pa.int32()), "n_best": best[at], "count_sum": total[at]})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        for batch in batches:
            for row in batch.to_pylist():
                pairs, held = unpacked(row["pairs"]), unpacked(row["held"])
                a = pairs // both.ids_b
                new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))  # pairs come in order of a
                best = held == np.repeat(np.maximum.reduceat(held, new), np.diff(np.append(new, len(a))))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int32()), "b": pa.array(pairs % both.ids_b, pa.int32()), "documents": held, "best": best})

    made = stored(source.mapInArrow(cut, schema), "aligned")
    # beyond as many tasks as there are stripes, each stripe's blocks are dealt to several, and so are its counts
    salts = max(1, shuffle_width(spark) // stripes)
    blocks = made.where("stripe IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("slice"), F.lit(salts)).cast("int"))
    dealt = lambda df, *by: df.repartition(*by).sortWithinPartitions(*by)
    counts = "stripe int, salt int, pairs binary, held binary"
    partial = dealt(blocks.select("stripe", "salt", "pairs", "held"), "stripe", "salt").mapInArrow(counted, counts)
    whole = stored(dealt(partial.withColumn("salt", F.lit(0)), "stripe", "salt").mapInArrow(counted, counts), "counts")
    beside = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("stripe", "salt", F.lit(0).alias("role"), F.lit(None).cast("long").alias("slice"), "pairs", "held", *[F.lit(None).cast("binary").alias(c) for c in ("slot", "text", "times")])
    links = blocks.select("stripe", "salt", F.lit(1).alias("role"), "slice", "pairs", F.lit(None).cast("binary").alias("held"), "slot", "text", "times")
    scores = beside.unionByName(links).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "role").mapInArrow(scored, "slice long, text binary, best binary, total binary")
    scores = dealt(scores, "slice").mapInArrow(summed, "slice long, at int, n_best long, count_sum long")
    rows = made.where("stripe IS NULL").join(scores, ["slice", "at"], "left")
    rows = rows.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.col("digest").alias("groups_sha256"))
    return rows, whole.select("pairs", "held").mapInArrow(listed, "a int, b int, documents long, best boolean")


NAMES = ["slice", "at", "id", "n_a", "n_b", "n_groups", "n_links", "digest", "stripe", "pairs", "held", "slot", "text", "times"]
