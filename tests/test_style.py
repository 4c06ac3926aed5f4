import re
from statistics import mean

import pytest

from arealis.functions import text as T


def plain(text):
    """The same counts by a loop over the text."""
    token = lambda s: re.findall(r"[A-Za-z]+(?:[-'][A-Za-z]+)?|\d+(?:\.\d+)?%?", s)
    cited = r"\d+(?:[-–]\d+)?(?:,\d+(?:[-–]\d+)?)*"
    flat = re.sub(r"\s+", " ", text)
    flat = re.sub(rf"([.!?])({cited})\s+(?=[A-Z(])", "\\1\\2\x01", flat)
    parts = [re.sub(rf"([.!?]){cited}$", r"\1", p.strip()) for p in re.sub(r"([.!?])\s+(?=[A-Z(])", "\\1\x01", flat).split("\x01")]
    n = sorted(len(token(p)) for p in parts if len(token(p)) >= 4)
    low = text.lower()
    at = lambda q: n[int((len(n) - 1) * q)] * (1 - (len(n) - 1) * q % 1) + n[min(int((len(n) - 1) * q) + 1, len(n) - 1)] * ((len(n) - 1) * q % 1) if n else None
    return (
        len(token(text)), len(n), mean(n) if n else None, at(0.25), at(0.5), at(0.75), len(re.findall(r"\b(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?\w+(?:ed|en)\b", low)),
        len(re.findall(r"\b\w+(?:tion|sion|ment|ance|ence|ity|ness|ability|ization|isation)\b", low)), len(re.findall(r"\b\d+(?:\.\d+)?%?\b", text)),
        sum(low.count(t) for t in T.HEDGE_TERMS), sum(low.count(t) for t in T.TRANSITION_TERMS),
    )


TEXTS = [
    "The sample was chosen and results were widely used. It was broken by 3.5% in governance and performance.",
    "However, rates may differ.12 Although limited, the association was consistent.3-5,7 (See the note at the end.) While it might be 3.5abc or 10%x, nothing in contrast was taken.",
    "", "   ", "No. One. Two words.", "A well-known state-of-the-art thing's been given to them today! And 5 more things were quickly written down?\n\nIn addition, nothing else was found there.8", "x" * 50_000 + " is done. " * 2000,
]


def test_style_counts_match_a_plain_loop(spark):
    rows = spark.createDataFrame([*enumerate(TEXTS)], "k int, t string").select("k", *T.style_counts("t")).collect()
    for r in rows:
        assert tuple(r[1:]) == pytest.approx(plain(TEXTS[r.k]), abs=1e-9), TEXTS[r.k][:80]
    first = next(r for r in rows if r.k == 0)
    assert (first.passives, first.numbers, first.nominalisations) == (3, 1, 2)


def test_sections_with_repeated_and_missing_headings(spark):
    text = "before it all\nMethods\none two\n\nResults\nthree\r\nMethods\nfour five six"
    df = spark.createDataFrame([(1, text), (2, "no heading here."), (3, None), (4, "Methods"), (5, "")], "k int, t string")
    got = sorted(tuple(r) for r in T.sections(df, "k", "t", "Methods|Results").collect())
    assert got == sorted([(1, 0, None, 1, 1, 3), (1, 1, "Methods", 2, 4, 2), (1, 2, "Results", 5, 6, 1), (1, 3, "Methods", 7, 8, 3), (2, 0, None, 1, 1, 3), (4, 1, "Methods", 1, 1, 0), (5, 0, None, 1, 1, 0)], key=lambda r: r[:2])
