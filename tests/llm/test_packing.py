import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arealis.llm import shared
from arealis.llm.packing import WordIds, cut_table, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, class int, ids string"


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check_sequences(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        used += at if at & (at - 1) == 0 else capacity
    return used


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta,", "it's", "été", "x9", "###", "<|endoftext|>", "longerwordhere", "　wide ", "é"]
    texts = [None, "", " \n ", *[" ".join(rng.choices(words, k=rng.randint(1, 900))).replace("Beta, it's", "Beta,\nit's") for _ in range(120)], "word " * 9000]
    docs = [(i, t, 7, "x") for i, t in enumerate(texts)]
    docs.append(docs[5])  # a repeated row
    rows = pack(spark.createDataFrame(docs, SCHEMA).repartition(5), PATH, with_ids=True).collect()
    tokens = check_sequences(rows, 2048)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text, *_ in docs[:-1]:
        want = np.array(ids_of(text), "<u4").tobytes()
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        if i == 5:
            pieces = [*{r.start: r for r in pieces if 2 * len([x for x in pieces if x.start == r.start]) >= 2}.values()] if len({r.start for r in pieces}) * 2 == len(pieces) else pieces
        if i != 5:
            assert b"".join(bytes(r.ids) for r in pieces) == want
            assert all(r.doc_tokens == len(want) // 4 for r in pieces)
        else:
            assert sum(r.length for r in by_doc[i]) == 2 * len(want) // 4
    total = sum(r.length for r in rows)
    assert tokens - total <= 0.02 * total


@pytest.mark.parametrize("capacity", [8, 2048])
def test_cut_table_fills_slots(capacity):
    slots = {capacity // m for m in range(1, capacity + 1)}
    for n, pieces in enumerate(cut_table(capacity)):
        assert sum(pieces) == n and set(pieces) <= slots


def test_small_capacity_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "one two three " * (i % 9), 0, "") for i in range(60)], SCHEMA)
    rows = pack(docs, PATH, capacity=16).collect()
    check_sequences(rows, 16)
    assert sum(r.length for r in rows) == sum(len(ids_of("one two three " * (i % 9))) for i in range(60))
    assert pack(docs.where("doc_id < 0"), PATH).count() == 0


def test_words_apart_give_the_ids_of_whole_texts():
    texts = ["İstanbul ΑΣ ΟΔΟΣ. don't 12.5", "a\tb\r\n\x0bc\x1cd e  f", "<|startoftext|>x <|endoftext|>", "́lone accent ́", "漢字 ﬁ Ⅷ 🙂🙂"]
    assert [b.tolist() for b in WordIds(PATH).of([t.encode() for t in texts])] == [ids_of(t)[:-1] for t in texts]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    texts = [b"one two three one", b"two", b"", b"three  \n one"]
    want = [ids_of(t.decode())[:-1] for t in texts]
    monkeypatch.setattr(shared, "word_hashes", lambda buffer, start, stop: np.zeros(len(start), np.uint64))
    assert [b.tolist() for b in WordIds(PATH).of(texts)] == want
