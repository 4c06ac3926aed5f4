import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from arealis.llm import repeats
from arealis.llm.repeats import remove_repeated_bytes, remove_repeated_words

SCHEMA = "doc_id long, text string, chunk int, n_words string"


def covered(tokens_by_row, ids, window):
    """For each row, which tokens lie under windows that start in a row of smaller id."""
    least = {}
    for i, t in zip(ids, tokens_by_row):
        for s in range(len(t) - window + 1):
            k = t[s : s + window]
            least[k] = min(least.get(k, i), i)
    out = []
    for i, t in zip(ids, tokens_by_row):
        gone = [False] * len(t)
        for s in range(len(t) - window + 1):
            if least[t[s : s + window]] < i:
                gone[s : s + window] = [True] * window
        out.append(gone)
    return out


def brute_words(rows, window):
    tokens = [tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    out = []
    for (i, _), t, gone in zip(rows, tokens, covered(tokens, [i for i, _ in rows], window)):
        out.append((i, len(t), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(t, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def brute_bytes(rows, window):
    tokens = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, gone in zip(rows, tokens, covered(tokens, [i for i, _ in rows], window)):
        spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, alphabet):
    rng = random.Random(seed)
    text = lambda n: " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 4))) for _ in range(n))
    shared = [text(n) for n in (12, 13, 14, 30, 80)]
    rows = []
    for i in rng.sample(range(1000), 60):
        parts = [text(rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n", "  \t", "\x0b"]).join(parts)))
    rows += [(2000 + k, rows[k][1]) for k in range(5)]  # copies
    rows += [(3000, None), (3001, ""), (3002, " \n "), (3003, "a b c"), (3004, shared[4]), (3005, f"{shared[3]} {shared[3]}"), (3006, "é\xa0" * 300), (3007, "x" + "é\xa0" * 300), (3008, "aaaa " * 300), (3009, "b" + "aaaa " * 200), (3010, "z" * 500), (3011, "z" * 400)]
    rows += [rows[3], rows[-1]]  # rows that repeat an id
    return rows


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefghijk"), (2, "ab"), (3, "aéß🙂")])
def test_against_brute_force(spark, monkeypatch, seed, alphabet):
    rows = corpus(seed, alphabet)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 1500)
    docs = spark.createDataFrame([(i, t, 1, "") for i, t in rows], SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in remove_repeated_words(docs).collect()) == brute_words(rows, 13)
    assert sorted(tuple(r) for r in remove_repeated_bytes(docs).collect()) == brute_bytes(rows, 50)


def test_one_chunk_and_texts(spark):
    rows = corpus(7, "abcd")
    docs = spark.createDataFrame([(i, t, 1, "") for i, t in rows], SCHEMA).coalesce(1)
    got = remove_repeated_words(docs, with_text=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute_words(rows, 13)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    got = remove_repeated_bytes(docs, with_text=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute_bytes(rows, 50)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_other_windows_and_empty_tables(spark):
    rows = corpus(5, "ab")
    docs = spark.createDataFrame([(i, t, 1, "") for i, t in rows], SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in remove_repeated_words(docs, window=4, gram=2).collect()) == brute_words(rows, 4)
    assert sorted(tuple(r) for r in remove_repeated_bytes(docs, window=9, gram=9).collect()) == brute_bytes(rows, 9)
    assert remove_repeated_words(docs.where("doc_id < 0")).count() == 0 == remove_repeated_bytes(docs.where("doc_id < 0")).count()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_equal_polynomial_hashes_are_not_equal_words(spark):
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    line = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{line} {x}"), (2, f"{line} {y}"), (3, x), (4, y), (5, f"{line} {x}")]
    docs = spark.createDataFrame([(i, t, 1, "") for i, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in remove_repeated_words(docs).collect()) == brute_words(rows, 13)
    assert sorted(tuple(r) for r in remove_repeated_bytes(docs).collect()) == brute_bytes(rows, 50)


def test_rows_without_an_id_are_the_smallest_document(spark):
    text = " ".join(f"w{i}" for i in range(30))
    big = (1 << 53) + 1
    docs = spark.createDataFrame([(None, text, 1, ""), (None, text, 1, ""), (big, text, 1, ""), (7, "b " + text, 1, "")], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated_words(docs).collect()) == [(0, 0), (0, 0), (7, 30), (big, 30)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated_bytes(docs).collect()) == [(0, 0), (0, 0), (7, len(text)), (big, len(text))]


def test_small_sketches_and_many_shards_lose_nothing(spark, monkeypatch):
    rows = corpus(11, "abc")
    docs = spark.createDataFrame([(i, t, 1, "") for i, t in rows], SCHEMA).repartition(4)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 2500)
    for cells, segment, per in ((1, 64, 500), (4, 1 << 10, 100_000)):
        monkeypatch.setattr(repeats, "CELLS_PER_WINDOW", cells)
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        monkeypatch.setattr(repeats, "WORDS_PER_SHARD", per)
        monkeypatch.setattr(repeats, "BYTES_PER_SHARD", per)
        assert sorted(tuple(r) for r in remove_repeated_words(docs).collect()) == brute_words(rows, 13)
        assert sorted(tuple(r) for r in remove_repeated_bytes(docs).collect()) == brute_bytes(rows, 50)


def test_radix_groups_match_plain_comparison():
    rng = random.Random(4)
    parts = ["".join(rng.choices("ab", k=rng.randint(9, 30))).encode() for _ in range(60)]
    for digits, parts_, window in ((repeats.byte_digits, parts, 9), (repeats.word_digits, [b" ".join(bytes([c]) for c in p) for p in parts], 5)):
        count, digit, depth = digits(parts_, window)
        group = repeats.radix_groups(np.zeros(count.sum(), np.int64), digit, depth)
        tokens = [p if digits is repeats.byte_digits else tuple(p.split()) for p in parts_]
        plain = [t[i : i + window] for t in tokens for i in range(len(t) - window + 1)]
        many = Counter(plain)
        assert [g >= 0 for g in group] == [many[w] > 1 for w in plain]
        pairs = {(w, g) for w, g in zip(plain, group.tolist()) if g >= 0}
        assert len(pairs) == len({w for w, _ in pairs}) == len({g for _, g in pairs})


@pytest.mark.parametrize("words", [False, True])
def test_anchors_of_texts_longer_than_places_tell(monkeypatch, words):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab c", k=5000)), "short", "".join(rng.choices("abcd ", k=3000))]
    data = [t.encode() for t in texts]
    row = {"ids": np.arange(3).astype("<i8").tobytes(), "nulls": bytes(3), "sizes": np.array([*map(len, data)], "<i8").tobytes(), "blob": zstandard.compress(b"".join(data))}
    c = repeats.Chunk.of(row, words)
    window, gram = (13, 5) if words else (50, 16)
    start = repeats.window_starts(c, window)
    whole = repeats.anchors(c, window, gram, start)
    for bits in (6, 9):
        monkeypatch.setattr(repeats, "_PLACE", np.uint64((1 << bits) - 1))
        parts = repeats.anchors(c, window, gram, start)
        assert all(np.array_equal(getattr(whole, f), getattr(parts, f)) for f in ("gram", "doc", "first", "last"))
