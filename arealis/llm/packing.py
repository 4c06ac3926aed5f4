"""Harmonic packing of token sequences.

A piece of length n belongs to the reciprocal-capacity class m = capacity // n: a bin of class m takes
exactly m pieces, at offsets that are multiples of the class's slot, capacity // m. Since a document may be
cut anywhere, its tail is cut into pieces that fill the slots of their classes exactly, so that a full bin
wastes fewer than m tokens and no more than one slot.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import distinct_words, slices, stored, text_slices, word_spans

#: Words that a worker remembers with their ids. A full memory becomes the old one, whose words are remembered while
#: they are met again; what is forgotten costs time only.
WORDS_KEPT = 300_000
KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("class", pa.int32())] + [(c, pa.int64()) for c in ("slot", "bin", "nth")] + [("ids", pa.binary())])


def cut_table(capacity: int) -> list[list[int]]:
    """For each tail length below capacity, the lengths of its pieces: each the largest slot that still fits."""
    slots = sorted({capacity // m for m in range(1, capacity + 1)})
    table: list[list[int]] = [[]]
    at = 0
    for n in range(1, capacity):
        while at + 1 < len(slots) and slots[at + 1] <= n:
            at += 1
        table.append([slots[at], *table[n - slots[at]]])
    return table


#: A word of letters that lower case and composition leave one to one, then signs that neither of them touches.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#%$*&()]*)")


#: Ends of parts: blanks and line ends.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[10, 32]] = True


class WordIds:
    """Ids of whole texts as unsigned 32-bit numbers, from the ids of their words.

    The vocabulary's pre-tokeniser drops white space and looks at nothing beyond it, so the ids of a text are
    those of its parts between blanks and line ends, one after another. Each different part of some texts is looked
    up once, and encoded once while remembered. A plain part is one or two pre-tokens, letters and signs; such parts are
    encoded many at a time, as the last id of a pre-token shows by its end of word.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, fresh: list[bytes]) -> None:
        parts = [w.decode("utf-8", "surrogatepass") for w in fresh]
        plain = [bool(PLAIN.fullmatch(t)) for t in parts]
        for i in range(0, len(fresh), 2000):
            some = [*compress(range(i, min(i + 2000, len(fresh))), plain[i : i + 2000])]
            ids = np.array(self.tokenizer.encode(" ".join(parts[k] for k in some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([1 if parts[k][-1].isalpha() else 2 for k in some], dtype=np.int64) - 1
            if some and len(ends) == last[-1] + 1:
                cuts, data = (4 * ends[last]).tolist(), ids.tobytes()
                self.known.update((fresh[k], data[x:y]) for k, x, y in zip(some, [0, *cuts], cuts))
            else:  # a vocabulary without ends of words
                plain[i : i + 2000] = [False] * len(plain[i : i + 2000])
        other = [k for k, p in enumerate(plain) if not p]
        for i in range(0, len(other), 2000):
            found = self.tokenizer.encode_batch([parts[k] for k in other[i : i + 2000]], add_special_tokens=False)
            self.known.update((fresh[k], np.array(e.ids, "<u4").tobytes()) for k, e in zip(other[i : i + 2000], found))

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for a, b in slices(map(len, texts), 3_000_000):
            data, text_ends = b"".join(texts[a:b]), np.cumsum([0, *map(len, texts[a:b])])
            buffer = np.frombuffer(data, np.uint8)
            start, stop = word_spans(buffer, text_ends, SEPARATORS)
            first, kind = distinct_words(buffer, start, stop)
            words = [data[i:j] for i, j in zip(start[first].tolist(), stop[first].tolist())]
            values = [*map(self.known.get, words)]
            fresh = [w for w, v in zip(words, values) if v is None]
            if fresh:
                if len(self.known) + len(fresh) > WORDS_KEPT:
                    self.old, self.known, fresh = self.known, {}, words
                self.known.update((w, v) for w, v in zip(fresh, map(self.old.get, fresh)) if v is not None)
                self.learn([w for w in fresh if w not in self.known])
                values = [*map(self.known.__getitem__, words)]
            sizes, pool = np.fromiter(map(len, values), np.int64, len(values)) // 4, np.frombuffer(b"".join(values), "<u4")
            n = sizes[kind]
            upto = np.concatenate([[0], n.cumsum()])
            ids = pool[np.repeat((sizes.cumsum() - sizes)[kind] - upto[:-1], n) + np.arange(upto[-1])]
            cuts = upto[np.searchsorted(start, text_ends)].tolist()
            for x, y in zip(cuts, cuts[1:]):
                yield ids[x:y]


_coders: dict[str, WordIds] = {}


def word_ids(tokenizer_path: str) -> WordIds:
    """One coder for each vocabulary and worker; workers outlive their tasks."""
    if tokenizer_path not in _coders:
        _coders[tokenizer_path] = WordIds(tokenizer_path)
    return _coders[tokenizer_path]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class; with_ids adds its ids as little-endian unsigned 32-bit bytes.

    A document is its text's ids, without special tokens, followed by end_id; a null or empty text is end_id
    alone. Whole sequences of capacity tokens are cut off first and the tail by cut_table(). Every task fills
    bins of its own; what remains, less than one bin for each class and task, is numbered across tasks by a sum
    over counts and fills further bins; what then remains, less than one bin for each class in all, is laid end
    to end and cut at capacity, the last of it into sequences whose lengths are powers of two. So only full bins
    are padded, by capacity % slot at most. Repeated rows (also those with the same id) are packed as often as
    they come, an empty table gives no rows, further columns are ignored.
    """
    spark = docs.sparkSession
    table = cut_table(capacity)
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, bins, end = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        held: dict[int, list] = {}

        def rows(of: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*of), PIECES.types)], schema=PIECES)

        for batch in batches:
            for a, b, texts in text_slices(batch, "text", 3_000_000):
                out: list[list] = []
                for doc, numbers in zip(batch.column("id").slice(a, b - a).to_pylist(), words.of([t or b"" for t in texts])):
                    ids = numbers.tobytes() + end
                    n, start = len(ids) // 4, 0
                    for length in [capacity] * (n // capacity) + table[n % capacity]:
                        part = ids[4 * start : 4 * (start + length)]
                        m = capacity // length
                        if m == 1:  # a bin of its own
                            out.append([doc, start, length, zlib.crc32(part), n, 1, capacity, (task << 32) + bins, 0, part if with_ids else None])
                            bins += 1
                        else:
                            waiting = held.setdefault(m, [])
                            waiting.append([doc, start, length, zlib.crc32(part), n, m, capacity // m, 0, 0, part])
                            if len(waiting) == m:
                                for k, full in enumerate(waiting):
                                    full[7], full[8] = (task << 32) + bins, k
                                    if not with_ids:
                                        full[9] = None
                                out += waiting
                                bins += 1
                                held[m] = []
                        start += length
                    if len(out) >= 10_000:
                        yield rows(out)
                        out = []
                if out:
                    yield rows(out)
        rest = []
        for waiting in held.values():
            for k, row in enumerate(waiting):
                row[7], row[8] = -1 - task, k
                rest.append(row)
        if rest:
            yield rows(rest)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = stored(source.mapInArrow(pieces, ", ".join(f"{f.name} {KINDS[f.type]}" for f in PIECES)), "pieces")
    extra = ["ids"] if with_ids else []
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", *extra]
    full = made.where("bin >= 0").select(*out, F.col("bin").alias("sequence_id"), (F.col("nth") * F.col("slot")).alias("offset"))

    # Less than one bin for each class and task: its number within the class is its number within the task plus the counts of earlier tasks.
    rest = made.where("bin < 0").withColumnRenamed("bin", "task")
    counts = rest.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy(F.desc("task"))
    counts = counts.select("class", "task", (F.sum("n").over(before) - F.col("n")).alias("earlier"), F.sum("n").over(Window.partitionBy("class")).alias("total"))
    rest = rest.join(counts, ["class", "task"]).withColumn("rank", F.col("earlier") + F.col("nth")).withColumn("k", F.expr("rank div class"))
    whole = F.col("k") < F.expr("total div class")
    second = rest.where(whole).select(*out, (F.lit(1 << 62) + F.col("class").cast("long") * (1 << 40) + F.col("k")).alias("sequence_id"), (F.col("rank") % F.col("class") * F.col("slot")).alias("offset"))

    # Less than one bin for each class in all, so fewer than capacity pieces for each of fewer than 2 * sqrt(capacity) classes.
    line = Window.partitionBy(F.lit(0))
    last = rest.where(~whole).withColumn("pos", F.sum("length").over(line.orderBy(F.desc("length"), "class", "rank")) - F.col("length")).withColumn("sum", F.sum("length").over(line))
    masks = [(capacity - 1) & ~((1 << k) - 1) for k in range(capacity.bit_length() - 2, -1, -1)]
    # Where sequences of the line begin: at multiples of capacity, then after each of the powers of two that make up what is left.
    ends = [F.expr(f"sum - sum % {capacity} + (sum & {mask}L)") for mask in masks]
    last = last.withColumn("ends", F.array_sort(F.array_distinct(F.concat(F.expr(f"transform(sequence(0L, sum div {capacity}), x -> x * {capacity}L)"), F.array(*ends)))))
    last = last.withColumn("seqs", F.expr("filter(transform(sequence(1, size(ends) - 1), i -> struct(ends[i - 1] AS lo, ends[i] AS hi)), s -> s.hi > pos AND s.lo < pos + length)"))
    last = last.withColumn("seq", F.explode("seqs")).withColumn("a", F.greatest("pos", "seq.lo")).withColumn("b", F.least(F.expr("pos + length"), F.col("seq.hi")))
    last = last.withColumn("ids", F.expr("substring(ids, cast(4 * (a - pos) + 1 as int), cast(4 * (b - a) as int))"))
    third = last.select("doc_id", (F.col("start") + F.col("a") - F.col("pos")).alias("start"), (F.col("b") - F.col("a")).alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "class", *extra, (F.lit(3 << 61) + F.col("seq.lo")).alias("sequence_id"), (F.col("a") - F.col("seq.lo")).alias("offset"))
    return full.unionByName(second).unionByName(third)
