import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from arealis.llm import sampling
from arealis.llm.sampling import NONE, decode, encode, sample_segmentations, sample_texts, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def v():
    return vocabulary(PATH)


def weights(v):
    rows = np.flatnonzero(v.key)
    return {v.model.id_to_piece(int(v.id[r])): float(v.score[r]) for r in rows}


def segmentations(text, w, byte_score):
    """All ways to write text as pieces, with their weights."""
    if not text:
        return {(): 0.0}
    out = {}
    for n in range(1, min(16, len(text)) + 1):
        head = text[:n]
        s = w.get(head, byte_score * len(head.encode()) if n == 1 else None)
        if s is not None:
            for tail, t in segmentations(text[n:], w, byte_score).items():
                out[(head, *tail)] = s + t
    return out


def keys(n):
    return np.random.default_rng(5).integers(1, 2**63, n).astype(np.uint64)


@pytest.mark.parametrize("text", ["the cat", "a  b", "ß漢x", "one\nto"])
def test_draws_follow_the_law(v, text):
    ways = segmentations("▁" + text.replace(" ", "▁"), weights(v), v.byte_score)
    top = max(ways.values())
    total = top + math.log(sum(math.exp(s - top) for s in ways.values()))
    p = {k: math.exp(s - total) for k, s in ways.items()}
    n = 4000
    found = sample_texts(v, [text] * n, keys(n), 3, True)
    name = lambda f: tuple(np.frombuffer(f[5], "<u4").tolist())
    by_ids = {}
    for way in ways:
        ids = []
        for piece in way:
            i = v.model.piece_to_id(piece)
            ids += [i] if piece in weights(v) else [int(v.byte_ids[b]) for b in piece.encode()]
        by_ids[tuple(ids)] = p[way]
    first, pairs = Counter(), Counter()
    for samples in found:
        assert len({name(f) for f in samples}) == len(samples) == min(3, len(ways))
        assert [f[2] for f in samples] == sorted((f[2] for f in samples), reverse=True)
        for f in samples:
            assert abs(f[1] - math.log(by_ids[name(f)])) < 1e-6 and f[3] <= 0
        first[name(samples[0])] += 1
        if len(samples) > 1:
            pairs[name(samples[0]), name(samples[1])] += 1
    for a, share in by_ids.items():
        assert abs(first[a] / n - share) < 5 * math.sqrt(share / n) + 1e-3
        for b in by_ids:
            if a != b and share > 1e-6:
                want = share * by_ids[b] / max(1 - share, 1e-12)
                assert abs(pairs[a, b] / n - want) < 5 * math.sqrt(want / n) + 2e-3
    # weighted by 1 / inclusion, the k - 1 above the last give an unbiased count of everything
    assert abs(np.mean([sum(math.exp(f[1] - f[3]) for f in s) for s in found]) - 1) < 0.1


def test_round_trips_and_seeds(spark, v):
    texts = [None, "", " ", "Hello  world\n\n foo", "ééé 漢字 🙂", "x" * 3000, "word and word " * 2000, "tab\tand\x01control", "▁ literal"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0)], "doc_id long, text string, sample int").repartition(3)
    rows = decode(sample_segmentations(docs, PATH, k=3, with_ids=True), PATH).collect()
    seen = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_pieces
        if r.doc_id != 8:
            assert r.text == (texts[r.doc_id] or "")
        seen.setdefault(r.doc_id, set()).add((r.sample, r.ids_crc32))
    assert {i: len(s) for i, s in seen.items()} == {0: 1, 1: 1, 2: 2, 3: 3, 4: 2, 5: 3, 6: 3, 7: 3, 8: 3}
    again = sample_segmentations(docs.coalesce(1), PATH, k=3).collect()
    assert {(r.doc_id, r.sample, r.ids_crc32) for r in again} == {(r.doc_id, r.sample, r.ids_crc32) for r in rows}
    assert sample_segmentations(docs.where("doc_id < 0"), PATH).count() == 0
    best = decode(encode(docs, PATH), PATH, text_col="back").collect()
    assert all(r.back == r.text for r in best if r.doc_id != 8)
    assert NONE < -1e200


def test_only_empty_texts_and_code_points_that_are_no_piece(v):
    assert [[f[0] for f in found] for found in sample_texts(v, ["", ""], keys(2), 2, False)] == [[0], [0]]
    texts = ["🦄🦄 x𝕏é 中文字 — ½\n\nend", "", "ᚠᛇᚻ", "x" * 5000, "\x00\x01 tab\tq"]
    for text, found in zip(texts, sample_texts(v, texts, keys(5), 3, True)):
        assert {v.model.decode(np.frombuffer(f[5], "<u4").astype(int).tolist()) for f in found} == {text}


def test_remembered_units_and_left_out_draws_change_nothing(monkeypatch):
    texts = ["the cat and the dog", "", "the dog sat. " * 300, "ééé 漢字 and the cat", "x" * 3000, "the cat and the dog", " ".join(f"word{i} of {i * i}" for i in range(400))]
    plain = sample_texts(sampling.Vocabulary(PATH), texts, keys(7), 4, True)
    made, fill = [], sampling.Lattices._fill
    monkeypatch.setattr(sampling.Lattices, "_fill", staticmethod(lambda v, units, *rest: made.append(units) or fill(v, units, *rest)))
    own = sampling.Vocabulary(PATH)
    assert sample_texts(own, texts, keys(7), 4, True) == plain == sample_texts(own, texts, keys(7), 4, True)
    assert {"▁the", "▁cat", "▁dog"} <= set(made[0]) and not {"▁the", "▁cat", "▁dog"} & set(made[1]) and "▁" + "x" * 3000 in made[1]
    for limits in ({"ROOM": 500}, {"KEPT": 9}, {"SPREAD": 1e9}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(sampling, name, value)
            small = sampling.Vocabulary(PATH)
            assert [sample_texts(small, [t], keys(7)[i : i + 1], 4, True)[0] for i, t in enumerate(texts)] == plain
            assert small.held <= 9 or "KEPT" not in limits
