"""The corpus pipeline: language, exact copies, near copies, secrets, packing.

run() applies STAGES to documents; each stage's result is written as Parquet in the shared folder and read again.
SQL cannot express the stages together (language classifier, signatures, forest and tokens), so ORACLE_SQL is None
and tests hold run() against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.llm import exact, language, minhash, packing, secrets
from arealis.llm.queries import _tokenizer, held_out
from arealis.llm.shared import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the output codes tell; those without a letter (null and empty texts too) and ambiguous ones go.

    Each row is judged alone, so rows that repeat an id stay or go by their own text; an empty table gives none.
    """
    model = language.fit(docs.where(~held_out()))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # whatever columns are called
    judged = language.identify(docs.toDF(*names.values()), model, names["doc_id"], names["text"], keep=[*names.values()])
    return judged.where("NOT ambiguous").select(*[F.col(n).alias(c) for c, n in names.items()])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of largest doc_id stays, of several with that id the last by file and row; null counts as empty text."""
    return exact.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of smallest doc_id stays, with all rows that repeat its id.

    Texts without a word are classes of their own and rows without an id always stay.
    """
    return minhash.drop_near_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that the forest confirms replaced by a mark, and n_chars, where there is one, to fit.

    Without a column source the forest knows no path.
    """
    found = stored(secrets.scan(docs, secrets.train(spark), path_col="source" if "source" in docs.columns else None), "secrets")
    clean = secrets.redact(docs, found)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a null text is its end token alone, repeated rows are packed each."""
    return packing.pack(docs, _tokenizer("word_bpe_49k.json"))


STAGES = [("language", known_language), ("exact copies", exact_copies), ("near copies", near_copies), ("secrets", without_secrets), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
