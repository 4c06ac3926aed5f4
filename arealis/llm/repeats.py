"""Windows of consecutive tokens that repeat across documents, and what is left without them.

Both operators here remove each token covered by a window that also starts in a document of smaller id. They
treat words (remove_repeated_words) or bytes (remove_repeated_bytes), and share one frame:

* Documents travel in chunks of some megabytes, in order of id and compressed, bucketed by chunk, so that no later step
  shuffles texts again.
* Every window has an anchor, its leftmost gram of least hash. Equal windows have equal anchors, at the same place
  within. A run of windows of one anchor, with all tokens it covers, is a context.
* Three levels ask the other chunks what repeats: a filter that only ever overestimates, then equal contexts, told by
  128-bit digests of their tokens, then, for contexts that share an anchor but differ, the windows themselves, whose
  real tokens are compared. What a chunk asks goes to shards by hash, once per chunk and key with the chunk's smallest
  document, so a key that a third of all documents hold costs one entry a chunk. Answers are bits in the order asked.
* The number of shards grows with the number of tokens.

Hashes choose and sort out; equality is never told by less than 128 bits of digest, nor is a key dropped, capped or sampled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Powers, Prefix, as_bytes, mixed, scratch_path, shuffle_width, stored, word_hashes, word_spans

CHUNK_BYTES, CHUNK_DOCS = 3_000_000, 60_000
#: The identifier that stands for null: the smallest one.
NO_ID = -(1 << 63)
CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("blob", pa.binary()), ("tokens", pa.int64())])
ASK = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("entries", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("shard", pa.int32()), ("hits", pa.binary())])
_BYTES = Powers(0x9E3779B97F4A7C15)


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def chunks(docs: DataFrame, id_col: str, text_col: str, words: bool) -> DataFrame:
    """Documents as rows of CHUNK, each chunk in order of id, null texts empty; a table bucketed by chunk in the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, nulls, texts, held = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            order = np.argsort(np.array(ids), kind="stable")
            parts = [texts[i] for i in order]
            blob, tokens = zstandard.ZstdCompressor(level=3).compress(b"".join(parts)), sum(len(t.split()) if words else len(t) for t in parts)
            row = [(task << 32) + made, np.array(ids, "<i8")[order].tobytes(), np.array(nulls, np.uint8)[order].tobytes(), np.array([len(t) for t in parts], "<i8").tobytes(), blob, tokens]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, CHUNK.types)], schema=CHUNK)

        for batch in batches:
            column, texts_of = batch.column("id"), as_bytes(batch.column("text"))
            for first in range(0, batch.num_rows, 256):
                part = column.slice(first, 256)
                for i, null, t in zip(pc.fill_null(part, NO_ID).to_pylist(), part.is_null().to_pylist(), texts_of.slice(first, 256).to_pylist()):
                    t = t or b""
                    if held and (held + len(t) > CHUNK_BYTES or len(ids) >= CHUNK_DOCS):
                        yield chunk()
                        ids, nulls, texts, held, made = [], [], [], 0, made + 1
                    ids.append(i)
                    nulls.append(null)
                    texts.append(t)
                    held += len(t)
        if ids:
            yield chunk()

    spark = docs.sparkSession
    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, ddl(CHUNK))
    name, width = f"chunks_{uuid.uuid4().hex}", shuffle_width(spark)
    made.repartition(width, "chunk").write.format("parquet").bucketBy(width, "chunk").option("path", scratch_path(spark, "chunks")).saveAsTable(name)
    return spark.table(name)


@dataclass
class Chunk:
    """Tokens of a chunk's documents, one after another."""

    ids: np.ndarray
    nulls: np.ndarray
    data: bytes
    ends: np.ndarray  # in bytes
    values: np.ndarray  # a hash of each word, or the bytes
    bounds: np.ndarray  # document i holds tokens bounds[i] to bounds[i + 1]
    spans: tuple[np.ndarray, np.ndarray] | None  # first and last-but-one byte of each word

    @staticmethod
    def of(row: dict, words: bool) -> Chunk:
        ids, sizes, nulls = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["nulls"], bool)
        data, ends = zstandard.ZstdDecompressor().decompress(row["blob"]), np.concatenate([[0], sizes.cumsum()])
        buffer = np.frombuffer(data, np.uint8)
        if not words:
            return Chunk(ids, nulls, data, ends, buffer, ends, None)
        start, stop = word_spans(buffer, ends)
        return Chunk(ids, nulls, data, ends, word_hashes(buffer, start, stop), np.searchsorted(start, ends), (start, stop))

    def document(self, token: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, token, side="right") - 1

    def contents(self, first: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Real tokens from first to end - 1: bytes, or words joined by one blank."""
        if self.spans is None:
            return [self.data[x:y] for x, y in zip(first.tolist(), end.tolist())]
        return [b" ".join(self.data[x:y].split()) for x, y in zip(self.spans[0][first].tolist(), self.spans[1][end - 1].tolist())]


def gram_hashes(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of the n values from each place: sums from prefixes for bytes, products with odd factors for hashes of words."""
    many = max(len(values) - n + 1, 0)
    if values.dtype == np.uint8:
        at = np.arange(many)
        return Prefix(values, _BYTES).hash(at, at + n, seed)
    out = np.zeros(many, np.uint64)
    for k, factor in enumerate(mixed(np.arange(n, dtype=np.uint64), 200 + seed) | np.uint64(1)):
        out += values[k : k + many] * factor
    return mixed(out, seed)


@dataclass
class Anchors:
    """Runs of windows first .. last with one anchor, whose gram has the hash gram."""

    gram: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray


_PLACE = np.uint64((1 << 26) - 1)


def window_starts(c: Chunk, window: int) -> np.ndarray:
    """First tokens of the windows that lie within one document."""
    begin, count = c.bounds[:-1], np.maximum(np.diff(c.bounds) - window + 1, 0)
    return np.arange(count.sum()) + np.repeat(begin - (count.cumsum() - count), count)


def anchors(c: Chunk, window: int, gram: int, start: np.ndarray) -> Anchors:
    """Of the windows that begin at start, in ascending order."""
    if not len(start):
        none = np.zeros(0, np.int64)
        return Anchors(np.zeros(0, np.uint64), none, none, none)
    value, span = gram_hashes(c.values, gram, 3), window - gram + 1
    anchor, many = np.zeros(len(start), np.int64), int(_PLACE) + 2 - span
    for base in range(0, len(value), many):  # places are told within a stretch, so that a text may be of any length
        i, j = np.searchsorted(start, [base, base + many])
        if j > i:
            part, reach = value[base : base + many + span - 1], 1
            low = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)  # of equal hashes the leftmost counts
            while reach < span:
                step = min(reach, span - reach)
                low = np.minimum(low[step:], low[:-step])
                reach += step
            anchor[i:j] = base + (low[start[i:j] - base] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    lead = np.flatnonzero(new)
    first, last = start[lead], start[np.append(lead[1:], len(start)) - 1]
    return Anchors(value[anchor[lead]], c.document(first), first, last)


# ---- asking and answering ----


def planes(x: np.ndarray, width: int) -> bytes:
    """The low width bytes of each number, all first bytes first: what is alike in neighbours then lies together."""
    return np.ascontiguousarray(x.astype("<u8" if x.dtype != np.int64 else "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :width] = part.T
    return out.view("<u8").ravel()


class Groups:
    """Runs of equal rows of some key arrays, in sorted order; first member of a run is that of least position."""

    def __init__(self, *keys: np.ndarray):
        n = len(keys[0])
        self.order = np.lexsort(keys[::-1])  # stable
        self.new = np.ones(n, bool)
        if n:
            self.new[1:] = np.logical_or.reduce([k[self.order][1:] != k[self.order][:-1] for k in keys])
        self.head = np.flatnonzero(self.new)
        self.run = np.cumsum(self.new) - 1  # of each in sorted order

    def __len__(self) -> int:
        return len(self.head)

    def firsts(self) -> np.ndarray:
        return self.order[self.head]

    def number(self) -> np.ndarray:
        """The run of each, in the order given."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self.run
        return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def ask_rows(chunk: int, shard: np.ndarray, entries: Callable[[int, int], bytes]) -> pa.Table:
    """Rows of ASK for entries in ascending order of shard; entries(a, b) writes those from a to b - 1."""
    many = np.bincount(shard, minlength=1) if len(shard) else np.zeros(0, int)
    cuts = np.concatenate([[0], many.cumsum()])
    some = np.flatnonzero(many)
    return pa.table([pa.array(some, pa.int32()), pa.array(np.full(len(some), chunk), pa.int64()), pa.array([entries(int(cuts[k]), int(cuts[k + 1])) for k in some], pa.binary())], schema=ASK)


def gaps(x: np.ndarray, width: int) -> bytes:
    """Ascending numbers below 256 ** width."""
    return planes(np.diff(x.astype(np.uint64), prepend=np.uint64(0)), width)


def answer_rows(level: int, asks: list[dict], hits: list[bytes]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(([a["chunk"] for a in asks], [level] * len(asks), [a["shard"] for a in asks], hits), ANSWER.types)], schema=ANSWER)


def said(answers: dict, level: int, shard: np.ndarray, bits: int = 1) -> list[np.ndarray]:
    """Answers of a level to entries in ascending order of shard, as so many arrays of booleans."""
    many = np.bincount(shard, minlength=1) if len(shard) else np.zeros(0, int)
    out = [np.zeros(len(shard), bool) for _ in range(bits)]
    at = 0
    for k in np.flatnonzero(many):
        n = int(many[k])
        flags = np.unpackbits(np.frombuffer(answers[level, int(k)], np.uint8), count=n * bits).astype(bool)
        for b in range(bits):
            out[b][at : at + n] = flags[b * n : (b + 1) * n]
        at += n
    return out


# ---- level 2: contexts ----


@dataclass
class Contexts:
    """Contexts of a chunk, each different one once, in order of shard."""

    shard: np.ndarray
    key: np.ndarray
    digest: np.ndarray  # two 64-bit halves of each
    id: np.ndarray  # the smallest document that holds it here
    lead: np.ndarray  # number of the anchor that does
    number: np.ndarray  # of each anchor, its context


def contexts_of(c: Chunk, a: Anchors, window: int, shards: int) -> Contexts:
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, c.contents(a.first, a.last + window))), "<u8").reshape(-1, 2)
    shard, key = shard_of(a.gram, shards), a.gram & np.uint64(0xFFFFFFFF)
    g = Groups(shard, key, digest[:, 0], digest[:, 1])
    lead = g.firsts()
    return Contexts(shard[lead], key[lead], digest[lead], c.ids[a.doc[lead]], lead, g.number())


def context_asks(chunk: int, x: Contexts) -> pa.Table:
    return ask_rows(chunk, x.shard, lambda i, j: gaps(x.key[i:j], 4) + x.digest[i:j].tobytes() + planes(x.id[i:j], 8))


def context_answers(table: pa.Table) -> pa.Table:
    """Two bits of each context: whether a smaller document holds it, and whether its gram has other contexts too."""
    asks = table.to_pylist()
    sizes = [len(a["entries"]) // 28 for a in asks]
    key = np.concatenate([unplanes(a["entries"][: 4 * n], 4).cumsum() for a, n in zip(asks, sizes)])
    digest = np.concatenate([np.frombuffer(a["entries"], "<u8", 2 * n, 4 * n) for a, n in zip(asks, sizes)]).reshape(-1, 2)
    doc = np.concatenate([unplanes(a["entries"][20 * n :], 8).view(np.int64) for a, n in zip(asks, sizes)])
    g = Groups(key, digest[:, 0], digest[:, 1])
    run = g.number()
    least = np.minimum.reduceat(doc[g.order], g.head)
    leads = key[g.firsts()]  # ascending
    many = np.searchsorted(leads, leads, side="right") - np.searchsorted(leads, leads, side="left")
    later, several = doc > least[run], many[run] > 1
    cuts = np.cumsum([0, *sizes])
    return answer_rows(2, asks, [np.packbits(np.concatenate([later[i:j], several[i:j]])).tobytes() for i, j in zip(cuts, cuts[1:])])


# ---- level 3: windows ----


def radix_groups(group: np.ndarray, digits: Callable[[int, np.ndarray], np.ndarray], depth: int) -> np.ndarray:
    """Numbers that are equal for members of one group with the same digits; -1 where a member is the only one.

    A radix sort, most significant digit first and no deeper than depth: each pass orders what still shares its group
    with another by the next digit and splits groups by it. digits(k, members) gives the k-th digit.
    """
    group, live = group.copy(), np.arange(len(group))
    for k in range(depth):
        g = Groups(group[live], digits(k, live))
        alone = np.diff(np.append(g.head, len(live))) == 1
        run = g.number()
        group[live] = np.where(alone[run], -1, run)
        live = live[~alone[run]]
        if not len(live):
            break
    return group


def byte_digits(contents: list[bytes], window: int) -> tuple[np.ndarray, Callable, int]:
    """Windows in each content, digits of eight bytes at a time, and their number."""
    buffer = np.frombuffer(b"".join(contents) + bytes(8), np.uint8)
    whole = np.zeros(len(buffer) - 7, np.uint64)
    for k in range(8):
        whole = (whole << np.uint64(8)) | buffer[k : k + len(whole)]
    sizes = np.array([len(x) for x in contents])
    count = sizes - window + 1
    start = np.arange(count.sum()) + np.repeat(sizes.cumsum() - sizes - (count.cumsum() - count), count)

    def digit(k: int, members: np.ndarray) -> np.ndarray:
        return whole[start[members] + 8 * k] >> np.uint64(max(0, 8 * (8 * k + 8 - window)))

    return count, digit, -(-window // 8)


def word_digits(contents: list[bytes], window: int) -> tuple[np.ndarray, Callable, int]:
    split, numbers = [x.split(b" ") for x in contents], {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(split)), np.int64, sum(map(len, split)))
    sizes = np.array([len(x) for x in split])
    count = sizes - window + 1
    start = np.arange(count.sum()) + np.repeat(sizes.cumsum() - sizes - (count.cumsum() - count), count)
    return count, lambda k, members: words[start[members] + k], window


def window_asks(chunk: int, c: Chunk, a: Anchors, x: Contexts, which: np.ndarray, window: int) -> pa.Table:
    """Contexts number which, with their real content."""
    contents = c.contents(a.first[x.lead[which]], a.last[x.lead[which]] + window)
    sizes = np.array([len(t) for t in contents], np.int64)
    return ask_rows(chunk, x.shard[which], lambda i, j: np.array([j - i], "<i8").tobytes() + gaps(x.key[which][i:j], 4) + planes(x.id[which][i:j], 8) + planes(sizes[i:j], 4) + b"".join(contents[i:j]))


def window_answers(table: pa.Table, words: bool, window: int) -> pa.Table:
    """One bit for each window of each content: whether it starts in a smaller document."""
    asks = table.to_pylist()
    keys, docs, contents = [], [], []
    for a in asks:
        e = a["entries"]
        n = int.from_bytes(e[:8], "little")
        keys.append(unplanes(e[8 : 8 + 4 * n], 4).cumsum())
        docs.append(unplanes(e[8 + 4 * n : 8 + 12 * n], 8).view(np.int64))
        ends = np.cumsum([8 + 16 * n, *unplanes(e[8 + 12 * n : 8 + 16 * n], 4).astype(np.int64)]).tolist()
        contents.append([e[i:j] for i, j in zip(ends, ends[1:])])
    count, digit, depth = (word_digits if words else byte_digits)([*chain.from_iterable(contents)], window)
    group = radix_groups(np.repeat(np.concatenate(keys), count).astype(np.int64), digit, depth)
    doc = np.repeat(np.concatenate(docs), count)
    hit, pairs = np.zeros(len(group), bool), np.flatnonzero(group >= 0)
    if len(pairs):
        least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group[pairs], doc[pairs])
        hit[pairs] = doc[pairs] > least[group[pairs]]
    ends, cuts = np.concatenate([[0], count.cumsum()]), np.cumsum([0, *map(len, contents)])
    return answer_rows(3, asks, [np.packbits(hit[ends[i] : ends[j]]).tobytes() for i, j in zip(cuts, cuts[1:])])


def covered(tokens: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the ranges first .. end - 1."""
    step = np.bincount(first, minlength=tokens + 1) - np.bincount(end, minlength=tokens + 1)
    return step[:tokens].cumsum() > 0


# ---- the frame ----


@dataclass
class Filter:
    """Level 1: what a chunk asks, what a shard answers, which windows or anchors pass, and the anchors of what passed."""

    ask: Callable[[int, Chunk], pa.Table]
    answer: Callable[[pa.Table], pa.Table]
    passed: Callable[[Chunk, dict], np.ndarray]
    anchors: Callable[[Chunk, np.ndarray], Anchors]


def _removal(docs: DataFrame, held: DataFrame, first: Filter, words: bool, window: int, shards: int, out: Callable, schema: pa.Schema) -> DataFrame:
    def asks1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield from first.ask(row["chunk"], Chunk.of(row, words)).combine_chunks().to_batches()

    def opened(chunk: pa.Table, answered: pa.Table):
        row, answers = chunk.to_pylist()[0], {(r["level"], r["shard"]): r["hits"] for r in answered.to_pylist()}
        c = Chunk.of(row, words)
        mask = first.passed(c, answers) if (0, -1) not in answers else np.unpackbits(np.frombuffer(answers[0, -1], np.uint8)).astype(bool)
        return row["chunk"], c, mask, first.anchors(c, mask), answers

    def settled(c: Chunk, a: Anchors, x: Contexts, answers: dict):
        """Anchors all of whose windows are met before, and the contexts whose windows are to be asked one by one."""
        later, several = said(answers, 2, x.shard, 2)
        gone = later[x.number] | (c.ids[a.doc] > x.id[x.number])
        return np.flatnonzero(gone), np.flatnonzero(several & ~later)

    def asks2(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        number, c, mask, a, _ = opened(chunk, answered)
        passed = pa.table([pa.array([x], t) for x, t in zip((-1, number, np.packbits(mask).tobytes()), ASK.types)], schema=ASK)
        return pa.concat_tables([passed, context_asks(number, contexts_of(c, a, window, shards))])

    def asks3(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        number, c, _, a, answers = opened(chunk, answered)
        x = contexts_of(c, a, window, shards)
        return window_asks(number, c, a, x, settled(c, a, x, answers)[1], window)

    def finish(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        _, c, _, a, answers = opened(chunk, answered)
        x = contexts_of(c, a, window, shards)
        gone, which = settled(c, a, x, answers)
        starts, ends = [a.first[gone]], [a.last[gone] + window]
        # one bit a window of each asked context, in the order asked
        many = (a.last - a.first + 1)[x.lead[which]]
        bits = said(answers, 3, np.repeat(x.shard[which], many))[0]
        base = np.full(len(x.lead), -1)
        base[which] = many.cumsum() - many
        own = np.flatnonzero((base[x.number] >= 0) & (c.ids[a.doc] == x.id[x.number]))  # every anchor with such a context in its smallest document
        n = (a.last - a.first + 1)[own]
        inner = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        hit = bits[np.repeat(base[x.number[own]], n) + inner]
        begin = (np.repeat(a.first[own], n) + inner)[hit]
        cover = covered(len(c.values), np.concatenate([*starts, begin]), np.concatenate([*ends, begin + window]))
        return pa.table([pa.array(v, t) for v, t in zip(out(c, cover), schema.types)], schema=schema)

    chunked = held.drop("tokens").groupBy("chunk")
    given = lambda asks, answer: stored(asks.groupBy("shard").applyInArrow(answer, ddl(ANSWER)), "answers")
    one = given(held.drop("tokens").mapInArrow(asks1, ddl(ASK)), first.answer)
    second = stored(chunked.cogroup(one.groupBy("chunk")).applyInArrow(asks2, ddl(ASK)), "asks")  # with what passed, as shard -1
    passed = second.where("shard < 0").select("chunk", F.lit(0).alias("level"), "shard", F.col("entries").alias("hits"))
    two = passed.unionByName(given(second.where("shard >= 0"), context_answers))
    three = two.unionByName(given(chunked.cogroup(two.groupBy("chunk")).applyInArrow(asks3, ddl(ASK)), lambda t: window_answers(t, words, window)))
    return chunked.cogroup(three.groupBy("chunk")).applyInArrow(finish, ddl(schema))


def _tokens(held: DataFrame) -> int:
    return held.agg(F.sum("tokens")).first()[0] or 0


def _id_column(c: Chunk) -> list:
    return [None if null else i for i, null in zip(c.ids.tolist(), c.nulls.tolist())]


# ---- words, by count-min sketches ----

SKETCH_ROWS = 2
#: Cells of a row of the sketch, for each window; cells of a segment; words of a shard.
CELLS_PER_WINDOW, SEGMENT, WORDS_PER_SHARD = 4, 1 << 22, 2_000_000


def count_min(segments: int, width: int, windows_of: Callable[[Chunk], np.ndarray], anchors_of: Callable[[Chunk, np.ndarray], Anchors]) -> Filter:
    """A sketch of SKETCH_ROWS rows, each of segments x width cells, dealt to shards by segment.

    A chunk sends the cells that its windows touch and whether once or more; shards add up the chunks' partial sketches
    in arrays of fixed width and say which cells hold two or more. A window's estimate is the least of its cells.
    """

    def touched(c: Chunk, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different cells in order, the cell of each window, and how often each is touched."""
        h = mixed(windows_of(c), 300 + row)
        return np.unique(h % np.uint64(segments * width), return_inverse=True, return_counts=True)

    def ask(chunk: int, c: Chunk) -> pa.Table:
        tables = []
        for row in range(SKETCH_ROWS):
            cell, _, count = touched(c, row)
            shard, place, often = (cell // np.uint64(width)).astype(np.int64) + row * segments, cell % np.uint64(width), np.minimum(count, 2) > 1
            tables.append(ask_rows(chunk, shard, lambda i, j: np.array([j - i], "<i8").tobytes() + gaps(place[i:j], 4) + np.packbits(often[i:j]).tobytes()))
        return pa.concat_tables(tables)

    def answer(table: pa.Table) -> pa.Table:
        asks, sketch, cells = table.to_pylist(), np.zeros(width, np.uint8), []
        for a in asks:
            n = int.from_bytes(a["entries"][:8], "little")
            cell = unplanes(a["entries"][8 : 8 + 4 * n], 4).cumsum().astype(np.int64)
            often = np.unpackbits(np.frombuffer(a["entries"], np.uint8, -1, 8 + 4 * n), count=n)
            sketch[cell] = np.minimum(sketch[cell] + 1 + often, 2)
            cells.append(cell)
        return answer_rows(1, asks, [np.packbits(sketch[cell] >= 2).tobytes() for cell in cells])

    def passed(c: Chunk, answers: dict) -> np.ndarray:
        repeated = True
        for row in range(SKETCH_ROWS):
            cell, of, _ = touched(c, row)
            repeated = repeated & said(answers, 1, (cell // np.uint64(width)).astype(np.int64) + row * segments)[0][of.ravel()]
        return np.asarray(repeated, bool)

    return Filter(ask, answer, passed, anchors_of)


def remove_repeated_words(docs: DataFrame, window: int = 13, gram: int = 6, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Removes words under windows of words that also start in a document of smaller id; one row per row of docs.

    Columns: doc_id, n_words, n_removed, kept_sha256 and, with with_text, kept_text (the words left, joined by one
    blank). Words lie between ASCII white space and are taken as they are; null texts have none. A document
    shorter than the window loses nothing, nor does a window that repeats within its own document only.

    First pass: a count-min sketch of all windows, CELLS_PER_WINDOW times as wide as there are words, merged from the
    chunks' partial sketches. As cells only ever add, estimates are never too small and no repeated window is lost.
    Second pass: windows estimated repeated, and no others, are grouped exactly: runs of them by equal contexts, then
    the windows of contexts that share an anchor by their real words.

    Rows that repeat an id count as one document, and so do rows without an id, as the smallest. Columns beside the named
    ones are ignored, whatever their names. An empty table gives no rows.
    """
    held = chunks(docs, id_col, text_col, True)
    words = _tokens(held)
    # per shard, so many windows of a row fall into one segment
    segments = max(1, -(-words * CELLS_PER_WINDOW // SEGMENT))
    shards = max(shuffle_width(docs.sparkSession), -(-words // WORDS_PER_SHARD))

    def windows(c: Chunk) -> np.ndarray:
        return gram_hashes(c.values, window, 7)[window_starts(c, window)] if len(c.values) >= window else np.zeros(0, np.uint64)

    def anchors_of(c: Chunk, repeated: np.ndarray) -> Anchors:
        start = window_starts(c, window)
        return anchors(c, window, gram, start[repeated[: len(start)]])

    def out(c: Chunk, gone: np.ndarray) -> list[list]:
        n_words, removed, digests, kept = [], [], [], []
        for i, j, x, y in zip(c.bounds.tolist(), c.bounds[1:].tolist(), c.ends.tolist(), c.ends[1:].tolist()):
            words, mask = c.data[x:y].split(), gone[i:j]
            n = int(np.count_nonzero(mask))
            text = b" ".join(compress(words, (~mask).tolist()) if n else words)
            n_words.append(j - i)
            removed.append(n)
            digests.append(hashlib.sha256(text).hexdigest())
            if with_text:
                kept.append(text.decode("utf-8", "replace"))
        return [_id_column(c), n_words, removed, digests, *([kept] if with_text else [])]

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] if with_text else [])])
    return _removal(docs, held, count_min(segments, SEGMENT, windows, anchors_of), True, window, shards, out, schema)


# ---- bytes, by radix passes ----

BYTES_PER_SHARD = 12_000_000


def first_digit(shards: int, anchors_of: Callable[[Chunk], Anchors]) -> Filter:
    """The first pass deals suffixes at anchors by their first digit, the gram, as 32 bits of its hash within the shard.

    Digits that come once in all are done; two grams with one hash only let more through.
    """

    def digits(a: Anchors):
        key = (shard_of(a.gram, shards).astype(np.uint64) << np.uint64(32)) | (a.gram & np.uint64(0xFFFFFFFF))
        return np.unique(key, return_inverse=True, return_counts=True)

    def ask(chunk: int, c: Chunk) -> pa.Table:
        key, _, count = digits(anchors_of(c))
        low, often = key & np.uint64(0xFFFFFFFF), count > 1
        return ask_rows(chunk, (key >> np.uint64(32)).astype(np.int64), lambda i, j: np.array([j - i], "<i8").tobytes() + gaps(low[i:j], 4) + np.packbits(often[i:j]).tobytes())

    def answer(table: pa.Table) -> pa.Table:
        asks, keys, often = table.to_pylist(), [], []
        for a in asks:
            n = int.from_bytes(a["entries"][:8], "little")
            keys.append(unplanes(a["entries"][8 : 8 + 4 * n], 4).cumsum())
            often.append(np.unpackbits(np.frombuffer(a["entries"], np.uint8, -1, 8 + 4 * n), count=n))
        _, of, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        several = (count[of] > 1) | (np.concatenate(often) > 0)
        cuts = np.cumsum([0, *map(len, keys)])
        return answer_rows(1, asks, [np.packbits(several[i:j]).tobytes() for i, j in zip(cuts, cuts[1:])])

    def passed(c: Chunk, answers: dict) -> np.ndarray:
        key, of, _ = digits(anchors_of(c))
        return said(answers, 1, (key >> np.uint64(32)).astype(np.int64))[0][of.ravel()]

    def of_those(c: Chunk, several: np.ndarray) -> Anchors:
        a = anchors_of(c)
        several = several[: len(a.gram)]
        return Anchors(a.gram[several], a.doc[several], a.first[several], a.last[several])

    return Filter(ask, answer, passed, of_those)


def remove_repeated_bytes(docs: DataFrame, window: int = 50, gram: int = 24, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Removes bytes under strings of window bytes that also start in a document of smaller id; one row per row of docs.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with with_text, kept
    (the bytes left, which need not be whole characters). Null texts are empty; strings never cross documents.

    A radix sort of suffixes, most significant digit first and no deeper than the window. The first digit is the gram
    at a suffix's anchor: suffixes whose digit nobody shares are done. The next is the context, all bytes that the anchor's
    windows cover: all but the smallest document of equal contexts are settled as repeated. What shares a gram
    but not the context goes on as real bytes, of which every suffix is sorted by digits of eight bytes, pass by
    pass, through the window's last byte and no deeper; the groups left are exactly the repeated strings.

    Rows that repeat an id count as one document, and so do rows without an id, as the smallest. Columns beside the named
    ones are ignored, whatever their names. An empty table gives no rows.
    """
    held = chunks(docs, id_col, text_col, False)
    shards = max(shuffle_width(docs.sparkSession), -(-_tokens(held) // BYTES_PER_SHARD))

    def out(c: Chunk, gone: np.ndarray) -> list[list]:
        buffer, sizes, removed, spans, digests, kept = np.frombuffer(c.data, np.uint8), [], [], [], [], []
        for i, j in zip(c.ends.tolist(), c.ends[1:].tolist()):
            mask, part = gone[i:j], buffer[i:j]
            n = int(np.count_nonzero(mask))
            left = (part[~mask] if n else part).tobytes()
            sizes.append(j - i)
            removed.append(n)
            spans.append(int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if n else 0)
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left)
        return [_id_column(c), sizes, removed, spans, digests, *([kept] if with_text else [])]

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])
    return _removal(docs, held, first_digit(shards, lambda c: anchors(c, window, gram, window_starts(c, window))), False, window, shards, out, schema)
