import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arealis.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(docs):
    """Whole texts encoded at once, links by their bytes, counts in dictionaries."""
    import sentencepiece

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table = {c: n for c, n in align.byte_characters().items()}
    found = []
    for i, text in docs:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(table[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            found.append((i, [], [], [], ""))
            continue
        owner = [[k for k, x in enumerate(xs) for _ in x] for xs in (bytes_a, bytes_b)]
        links = sorted(set(zip(*owner)))
        ends = [{sum(map(len, xs[: k + 1])) for k in range(len(xs))} for xs in (bytes_a, bytes_b)]
        groups, x, y = [], 0, 0
        for e in sorted(ends[0] & ends[1]):
            last_a, last_b = owner[0][e - 1] + 1, owner[1][e - 1] + 1
            groups.append(",".join(map(str, ids_a[x:last_a])) + "|" + ",".join(map(str, ids_b[y:last_b])))
            x, y = last_a, last_b
        found.append((i, ids_a, ids_b, [(ids_a[p], ids_b[q]) for p, q in links], ";".join(groups)))
    counts = Counter(pair for _, _, _, links, _ in found for pair in set(links))
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    rows = [(i, len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, x, y, links, g in found]
    return rows, {(p, q, n, n == most[p]) for (p, q), n in counts.items()}


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "one  two   three\n\n four\t five \n", "x  y   z　 w", " ", "<|endoftext|> <s> hi </s> <unk> <0x41>", "it's we'll they're I'D 'S don't",
    "a▁b stays out", "naïve ÀÉÎ ﬁ ½ é ́", "日本語のテキスト 中文 한국어", "emoji 👩‍👩‍👧 🇩🇪 ok", "123 45.6 7,890 $%#@! --- ...", "\x00 \x01 \x1c x \x1f y", "привет мир, как дела", "न मस्ते दुनिया", "\u0085 line   sep   nb", "tab\there \r\n crlf", "the the the the", "﻿bom ​ zero",
]


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = "the of Language models tokenizer's alignment corpus-wide überall größer naïveté niño 2024 foo_bar https://x.org/a?b=c don't e.g. — “quoted” …".split() + [f"zq{i}x" for i in range(40)]
    texts = ODD + ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", " \n", ", "]) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    texts += ["".join(rng.choice("ab 1'é \n\t▁中.S") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    return [*enumerate(texts)] + [(3, "repeated id"), (3, "repeated id"), (None, "no id here")]


@pytest.mark.parametrize("stripes,width,slice_bytes", [(64, None, None), (7, "16", 700)])
def test_rows_and_counts_match_whole_texts(spark, monkeypatch, stripes, width, slice_bytes):
    if slice_bytes:
        monkeypatch.setattr(align, "SLICE", slice_bytes)
        monkeypatch.setattr(align, "UNITS_KEPT", 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if width:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        docs = corpus()
        rows, counts = align.aligned(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, stripe int, slice int").repartition(3), A, B, stripes)
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        want, pairs = brute(docs)
        assert sorted(map(tuple, rows.collect()), key=key) == sorted(want, key=key)
        assert {tuple(r) for r in counts.collect()} == pairs
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_text_and_empty_table(spark):
    rng = random.Random(5)
    docs = [(1, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(30_000))), (2, "x" * 20_000), (3, " " * 5000 + "end")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows, _ = align.aligned(frame, A, B, 8)
    got = {r.doc_id: r for r in rows.collect()}
    a, b = Tokenizer.from_file(A), align.aligner(A, B).b
    for i, text in docs:
        assert (got[i].n_a, got[i].n_b) == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))
        assert got[i].n_links == got[i].n_a + got[i].n_b - got[i].n_groups
    rows, counts = align.aligned(frame.where("doc_id < 0"), A, B, 8)
    assert rows.count() == 0 and counts.count() == 0
