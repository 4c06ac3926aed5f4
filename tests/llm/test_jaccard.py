import random
import re

import numpy as np
import pytest

from arealis.llm import jaccard


def brute(docs, percent=85, width=4):
    """All pairs of sets, joined by hand."""
    sets = {}
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {(i, len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(2500)]
    texts = [None, "", " \t", "one", "One", "two words", "three little words", "just four words here", "Just FOUR words here", "É", "é"]
    line = " ".join(rng.choices(vocabulary, k=14))
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.choice([5, 9, 20, 60, 150, 300]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            near = list(base)
            for i in rng.sample(range(len(near)), min(len(near), rng.randint(0, max(1, len(near) // 40)))):
                near[i] = f"e{rng.random()}"
            texts.append("  ".join(near) if rng.random() < 0.5 else " ".join(near).upper())
    texts += [f"{line} {' '.join(rng.choices(vocabulary, k=6))} {line}" for _ in range(25)]  # frequent grams, few of their own
    base = rng.choices(vocabulary, k=240)
    for _ in range(40):  # a chain: each is like the next
        texts.append(" ".join(base))
        base = list(base)
        base[rng.randrange(len(base))] = f"c{rng.random()}"
    near = rng.choices(vocabulary, k=100)
    for k in range(60):  # about the threshold
        other = list(near)
        for i in rng.sample(range(100), 1 + k % 3):
            other[i] = f"t{rng.random()}"
        texts.append(" ".join(other))
    texts += [" ".join(["again and"] * 400), " ".join(["and again"] * 300), *[texts[12]] * 5]
    return [*enumerate(texts)]


@pytest.mark.parametrize("seed,percent,width,small", [(1, 85, 4, False), (2, 85, 4, True), (3, 60, 3, True), (4, 100, 4, False)])
def test_components_match_all_pairs(spark, monkeypatch, seed, percent, width, small):
    if small:
        monkeypatch.setattr(jaccard, "SLICE", 3000)
        monkeypatch.setattr(jaccard, "ROUNDS", 1)
        monkeypatch.setattr(jaccard, "SMALL", 5)
        monkeypatch.setattr(jaccard, "BLOCK", 6)
        monkeypatch.setattr(jaccard, "BESIDE", 4)
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, key int, name string").repartition(3)
    rows = jaccard.linked_groups(frame, percent, width).collect()
    assert len(rows) == len(docs) and {tuple(r) for r in rows} == brute(docs, percent, width)


def test_prefixes_of_pairs_that_are_alike_share_what_is_asked():
    rng = np.random.default_rng(5)
    hit = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = rng.choice(200, n, replace=False)
        b = np.array(sorted({*rng.permutation(a)[: n - int(rng.integers(0, max(1, n // 6) + 1))], *rng.choice(200, int(rng.integers(0, 3)))}))
        percent = int(rng.choice([50, 70, 85, 100]))
        inside = len(np.intersect1d(a, b))
        if not len(b) or 100 * inside < percent * len(np.union1d(a, b)):
            continue
        hit += 1
        df = rng.integers(1, 9, 200)
        (x, p, m), (y, q, k) = [(s, *jaccard.chosen_prefix(df[s], percent)) for s in (x[np.lexsort((x, df[x]))] for x in (a, b))]
        assert len(np.intersect1d(x[:p], y[:q])) >= min(m, k)
    assert hit > 500


def test_frequent_grams_lengthen_the_prefix():
    assert jaccard.chosen_prefix(np.r_[np.ones(80), np.full(20, 9)].astype(int), 85) == (16, 1)
    few, many = jaccard.chosen_prefix(np.full(100, 2), 85), jaccard.chosen_prefix(np.r_[np.full(16, 900), np.full(84, 901)], 85)
    assert many == few and many[1] > 1  # what is alike for all grams doesn't decide
    assert jaccard.chosen_prefix(np.r_[np.full(16, 3), np.full(84, 9000)], 85)[1] == 1


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = rng.choices([f"w{i}" for i in range(500)], k=130)
    texts = []
    for _ in range(2500):
        near = list(base)
        near[rng.randrange(130)] = f"e{rng.random()}"
        texts.append(" ".join(near))
    texts += [" ".join(rng.choices([f"v{i}" for i in range(900)], k=80)) for _ in range(50)] + [texts[7]] * 1500
    roots = {r.doc_id: r.component_id for r in jaccard.linked_groups(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)).collect()}
    assert len(roots) == len(texts) and all(roots[i] == 0 for i in [*range(2500), *range(2550, 4050)]) and all(roots[i] == i for i in range(2500, 2550))


def test_empty_repeated_and_without_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (None, "a b c d e"), (None, None), (4, None), (4, "x y")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.linked_groups(docs).collect() if r.doc_id is not None)
    assert [g[1:] for g in got if g[1] != 4] == [(1, 2, 1), (2, 2, 1)] and [g[3] for g in got if g[1] == 4] == [4]
    alone = [(r.n_shingles, r.component_id) for r in jaccard.linked_groups(docs).collect() if r.doc_id is None]
    assert sorted(alone) == [(0, None), (2, None)]
    assert jaccard.linked_groups(docs.where("doc_id > 10")).count() == 0
