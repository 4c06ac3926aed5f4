import math
import unicodedata

import numpy as np
import pytest

from arealis.llm.language import codewords, fit, gram_means, grams, identify, normalised
from arealis.llm.queries import held_out, op9_language_codes

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 30])
def test_codewords_lie_apart(n):
    code = codewords(n)
    least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert least >= (1 if n == 2 else 2 if n == 3 else 4 if n <= 5 else 10)
    assert all(abs(c.sum()) < n for c in code.T)


def test_means_match_text_by_text():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(3, 1 << 16)).astype(np.float32)
    texts = [normalised(t) for t in ["a", "Ünï code", "x " * 400, "b", "###q"]]
    for t, got in zip(texts, gram_means(texts, weights)):
        assert np.allclose(got, weights[:, grams(np.frombuffer(t, np.uint8))].mean(1), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = op9_language_codes(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert sum(r.ambiguous for r in rows) / len(rows) < 0.02 and all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en", 0), (2, "le chat et la vache", "fr", 0), (3, None, "en", 0), (4, "123 ---", "fr", 0), (5, "the dog", None, 0), (5, "the dog", None, 0), (6, "vache " * 100_000, "fr", 0), (7, "", None, 0)],
        "doc_id long, text string, lang string, score int",
    )
    model = fit(docs)
    rows = identify(docs, model, keep=["lang"]).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5, 5, 6, 7]
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 4, 5, 7)] == ["en", "fr", "und", "und", "en", "und"]
    assert by_id[3].score == 0 and by_id[3].ambiguous and by_id[1].lang == "en"
    assert identify(docs.where("doc_id < 0"), model).count() == 0
    nothing = fit(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert {r.lang_pred for r in identify(docs, fit(docs.where("lang = 'en'"))).collect()} == {"en", "und"}
    assert docs.where(held_out()).count() >= 0


def plain_prediction(model, text):
    """One text after the letter of the method: every bit's mean weight, then the codeword of least weighted loss."""
    if text is None or not any(unicodedata.category(c).startswith("L") for c in text):
        return "und", 0.0
    data = normalised(text)
    row = lambda a, b, c: ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF) >> 16
    margins = [(sum(float(w[row(*data[i : i + 3])]) for i in range(len(data) - 2)) / (len(data) - 2) - o) / s for w, o, s in zip(model.weights, model.offset, model.scale)]
    loss = [sum(t * math.log1p(math.exp(-m * b)) for m, b, t in zip(margins, word.tolist(), model.trust)) for word in model.code]
    chance = [math.exp(-x + min(loss)) for x in loss]
    best = max(range(len(loss)), key=lambda k: chance[k])
    return model.languages[best], chance[best] / sum(chance)


def test_decoding_matches_plain_code(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = fit(docs.where(~held_out()))
    rows = docs.where("length(text) < 3000 OR text IS NULL").limit(150)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(rows, model).collect()}
    for r in rows.collect():
        lang, score = plain_prediction(model, r.text)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-4


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "\u00bd \u00b2 100"), (2, "\u2167 8"), (3, "\u0301"), (4, "\u6f22"), (5, "\u00aa")], "doc_id long, text string")
    model = fit(spark.createDataFrame([(1, "the dog", "en"), (2, "le chat", "fr")], "doc_id long, text string, lang string"))
    assert [r.lang_pred == "und" for r in identify(docs, model).orderBy("doc_id").collect()] == [True, True, True, False, False]


def test_sample_is_that_of_lowest_hashes(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "concat('word', id % 7) AS text", "if(id % 100 = 0, 'xx', 'en') AS lang")
    for bound in (5, 50, 100_000):
        model = fit(rows, rows_per_language=bound)
        assert model.languages == ["en", "xx"]
