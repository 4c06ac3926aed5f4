import re
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest

from arealis.llm import audit


def brute(docs, labels):
    """Each order walked document by document."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = words(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
             "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        said = [(q, x) for j, q, x in labels if j == i and i is not None]
        fails.append((part or "", {c for c in f if f[c]}, any(q == 1 for q, _ in said), any(x == 1 for _, x in said)))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[0]]
                left = [f for f in left if c not in f[0]]
                total[c] += len(gone)
                failing = sum(c in f[0] for f in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f[0] == {c} for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


LONG = "word " * 200_000
DOCS = [
    (1, "plain words " * 30, "a"), (2, "plain words " * 30, "b"), (3, "plain words " * 30, "a"), (3, "plain words " * 30, "a"), (None, "plain words " * 30, "a"), (None, "plain words " * 30, None),
    (4, None, "a"), (5, "", "b"), (6, " \t\n", ""), (7, "AB cd # x", None), (8, " ".join(f"w{i}" for i in range(60)), "b"), (9, " ".join(f"W{i}" for i in range(60)) + " |", "c"),
    (10, LONG, "c"), (11, LONG, "c"), (12, "ÀÉ Ü " * 60, "c"), (0, "only & here", "b"), (13, "only & here", "b"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (7, None, 1), (10, 1, None), (11, 1, 1), (None, 1, 1), (99, 1, 1)]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(*d, 5, "x") for d in DOCS], "doc_id long, text string, source string, n int, part string").repartition(5)
    return docs, spark.createDataFrame([(*x, 1) for x in LABELS], "doc_id long, quality int, toxic int, good int")


def test_audit_matches_orders_walked_by_hand(tables):
    rows = audit.interaction_audit(audit.failure_counts(*tables)).collect()
    got = {(r.part, r.filter_order, r.step): [*r[3:]] for r in rows}
    want = brute(DOCS, LABELS)
    assert len(rows) == len(want) and got == want


def test_empty_tables(tables):
    docs, labels = tables
    assert audit.interaction_audit(audit.failure_counts(docs.where("doc_id < 0"), labels)).count() == 0
    rows = audit.interaction_audit(audit.failure_counts(docs, labels.where("false"))).collect()
    assert len(rows) == 4 * 600 and not any(r.good_lost or r.toxic_lost for r in rows)


@pytest.mark.parametrize("k", [1, 3, 4])
def test_shapley_of_any_number_of_filters(spark, k):
    counts = [(p, m, (7 * m + len(p)) % 11, m % 3, m % 2) for p in ("x", "yy") for m in range(1 << k)]
    rows = audit.interaction_audit(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long"), "PQRS"[:k]).collect()
    assert len(rows) == 2 * factorial(k) * k
    for p in ("x", "yy"):
        share = {i: sum(Fraction(n, m.bit_count()) for q, m, n, _, _ in counts if q == p and m >> i & 1) for i in range(k)}
        assert {(r.filter_order[r.step - 1], r.shapley) for r in rows if r.part == p} == {("PQRS"[i], int(s * factorial(k))) for i, s in share.items()}
