import random
from collections import Counter

import numpy as np
import pytest

from arealis.llm import minhash
from arealis.llm.minhash import near_duplicates, probability_jaccard, shingle_vectors, signatures
from arealis.llm.shared import connected


def brute_shingles(text, width=5):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def brute_jp(a, b):
    every = [*(a.keys() | b.keys())]
    x, y = [np.array([c[e] for e in every], float) for c in (a, b)]
    return sum(1 / np.maximum(x / a[d], y / b[d]).sum() for d in a.keys() & b.keys())


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.random()}"
    return words


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            texts.append(" ".join(edited(rng, base, rng.randint(0, 3))))
    line = " ".join(rng.choices(vocabulary, k=12))
    texts += [f"{line} {' '.join(rng.choices(vocabulary, k=8))}" for _ in range(30)]  # a common line, else unlike
    base = rng.choices(vocabulary, k=200)
    for _ in range(40):  # a chain: each is like the next
        texts.append(" ".join(base))
        base = edited(rng, base, 1)
    texts += [None, "", "  \n", "one", "One", "two words", texts[0] + " ", texts[0].upper(), "line again and again here " * 300]
    return texts


def brute_classes(texts, threshold=0.8):
    vectors = [brute_shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if vectors[i] and vectors[j] and brute_jp(vectors[i], vectors[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_probability_jaccard_matches_its_definition():
    rng = random.Random(8)
    for _ in range(60):
        a = Counter(rng.choices(range(30), k=rng.randint(1, 60)))
        b = Counter(rng.choices(range(30), k=rng.randint(1, 60)))
        arrays = [np.array(v) for c in (a, b) for v in (sorted(c), [c[k] for k in sorted(c)])]
        assert abs(probability_jaccard(*arrays) - brute_jp(a, b)) < 1e-12


def test_registers_estimate_probability_jaccard():
    rng = random.Random(2)
    a = " ".join(rng.choices("abcdefgh", k=300))
    b = " ".join(edited(rng, a.split(), 12))
    owner, hashes, counts = shingle_vectors([a.encode(), b.encode()], 2)
    sig = signatures(owner, hashes, counts, 2, 4096)
    assert (sig != 0).all()
    assert abs((sig[0] == sig[1]).mean() - brute_jp(brute_shingles(a, 2), brute_shingles(b, 2))) < 0.03


@pytest.mark.parametrize("block,pivots,beside", [(400, 3, 2000), (5, 1, 3), (400, 0, 1)])
def test_classes_match_all_pairs(spark, monkeypatch, block, pivots, beside):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    monkeypatch.setattr(minhash, "BESIDE", beside)
    texts = corpus()
    rows = near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int").repartition(4)).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(texts)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(50)] + [(5, 5)], "a long, b long")
    got = {r.node: r.root for r in connected(links).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(docs).collect()) == [(1, 1), (2, 1)]
    assert near_duplicates(docs.where("doc_id < 0")).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_texts_with_equal_polynomial_hashes_stay_apart(spark):
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x} b c d e f"), (4, f"{y} b c d e f")], "doc_id long, text string")
    assert all(r.class_id == r.doc_id for r in near_duplicates(docs).collect())


def test_rows_without_an_id_and_clashing_columns(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text, 1, "x"), (None, "other", 2, "y"), (7, text, 3, "z"), (8, "x", 4, "w")], "doc_id long, text string, root int, rep_id string")
    rows = near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.class_id) for r in rows if r.doc_id is not None) == [(False, 7, 7), (False, 8, 8)] and len(rows) == 3
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 4


def test_large_group_of_mutual_near_copies(spark):
    rng = random.Random(3)
    base = rng.choices([f"w{i}" for i in range(500)], k=120)
    texts = [" ".join(edited(rng, base, 3)) for _ in range(3000)] + [" ".join(rng.choices([f"v{i}" for i in range(900)], k=80)) for _ in range(50)]
    rows = near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)).collect()
    roots = {r.doc_id: r.class_id for r in rows}
    vectors = [brute_shingles(t) for t in texts]
    # everything that any of some hundred members links to must be in one class
    for i in rng.sample(range(3000), 60):
        for j in rng.sample(range(3000), 200):
            if brute_jp(vectors[i], vectors[j]) >= 0.8:
                assert roots[i] == roots[j]
    assert all(roots[i] == i for i in range(3000, 3050))
