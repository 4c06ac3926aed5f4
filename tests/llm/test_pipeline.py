import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from arealis.llm import exact, language, minhash, secrets
from arealis.llm.queries import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(6)
    parts = {"en": "the and ing tion er th ou", "fr": "é eau les tion oi ê ç"}
    rows = []
    for i in range(60):
        lang = rng.choice([*parts])
        syllables = parts[lang].split()
        rows.append((lang, ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(40, 120))]))
    texts = [(lang, " ".join(w)) for lang, w in rows]
    texts += [texts[0], texts[0], texts[5]]  # copies
    lang, words = rows[7]
    for k in range(3):  # near copies
        texts.append((lang, " ".join([*words[:-1], f"the{k}"])))
    texts[9] = (texts[9][0], texts[9][1] + ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ' + texts[10][1])
    texts += [(None, None), ("en", "12345 ---"), (None, "")]
    rng.shuffle(texts)
    return [(i, t, lang, "s", len(t or "")) for i, (lang, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_run_against_plain_code(spark, docs):
    rows = {r[0]: r for r in corpus()}
    assert {n: t for n, t in corpus_pipeline.STAGES}.keys() and 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    kept = {i: t for i, t, *_ in rows.values() if t and any(c.isalpha() for c in t)}
    last = {}
    for i, t in sorted(kept.items()):
        last[t] = i
    kept = {i: t for t, i in last.items()}
    from test_minhash import brute_jp, brute_shingles

    root = {i: i for i in kept}
    ids = sorted(kept)
    for b in ids:
        for a in ids:
            if a < b and brute_jp(brute_shingles(kept[a]), brute_shingles(kept[b])) >= 0.8:
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    kept = {i: t.replace("9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "[SECRET]") for i, t in kept.items() if root[i] == i}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    out = corpus_pipeline.run(spark, docs).collect()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_stages_return_documents_and_take_empty_tables(spark, docs):
    table = spark.read.parquet(f"{docs}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, docs).columns == table.columns, name
        assert stage(spark, table.where("doc_id < 0"), docs).count() == 0, name
    assert corpus_pipeline.packed(spark, table.where("doc_id < 0"), docs).count() == 0
    assert exact and language and minhash and secrets and held_out


def test_columns_that_stages_use_themselves(spark, docs):
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{docs}/documents.parquet").drop("n_chars", "source").withColumns({c: F.lit(7) for c in ("score", "lang_pred", "ambiguous", "c0", "id", "name")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, table, docs)
        assert left.columns == table.columns and {r.score for r in left.select("score").collect()} <= {7}, name
