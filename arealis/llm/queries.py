"""Queries of this subpackage's operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, audit, exact, images, jaccard, language, mincut, minhash, packing, repeats, sampling, secrets
from .shared import shuffle_width, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_groups(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeated_words(table(spark, sf_dir, "documents"))


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(spark), path_col="source").drop("text_key")


def op7_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(table(spark, sf_dir, "pages"))


def op8_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_segmentations(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), k=2)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op9_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()))
    return language.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited crops of every twentieth image, searched among all images: one row for each, with the class and number of its answers."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(shuffle_width(spark), "vec_id")  # small rows, each of which becomes a picture
    asked = vectors.where("vec_id % 20 = 0")
    return images.answers_by_query(images.copies(images.rendered(vectors), images.rendered(asked, edited=True)), asked.select(F.col("vec_id").cast("long").alias("query_id")))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interaction_audit(audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))[0]


def op13_gram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_harmonic_packing, op2_exact_dedup, op3_probminhash, op4_repeated_words, op5_repeated_bytes, op6_secret_forest, op7_minimum_cut, op8_gumbel_segmentations, op9_language_codes, op10_image_copies, op11_filter_interactions, op12_token_alignment, op13_gram_jaccard, pipeline)}

SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
              FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
    """,
    "op4_repeated_words": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
        gone AS (SELECT doc_id, s FROM x JOIN (SELECT k, min(doc_id) AS least FROM x GROUP BY k) USING (k) WHERE least < doc_id),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        q AS (SELECT p.doc_id, p, word, coalesce(max(gone.s) OVER (PARTITION BY p.doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) >= p - 12, false) AS g
              FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.s = p.p),
        r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (g) AS m, string_agg(word, ' ' ORDER BY p) FILTER (NOT g) AS kept FROM q GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN r USING (doc_id)
    """,
    "op5_repeated_bytes": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        p AS (SELECT doc_id, octet_length(b) AS n, unnest(range(1, octet_length(b) + 1)) AS p, b FROM d),
        x AS (SELECT doc_id, p, b[p:p] AS c, CASE WHEN p <= n - 49 THEN b[p:p + 49] END AS k FROM p),
        l AS (SELECT k, min(doc_id) AS least FROM x WHERE k IS NOT NULL GROUP BY k),
        g AS (SELECT doc_id, p, c, coalesce(max(CASE WHEN least < doc_id THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) >= p - 49, false) AS g FROM x LEFT JOIN l USING (k)),
        e AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY p), false) AS edge FROM g),
        r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (g) AS m, count(*) FILTER (edge) AS spans, string_agg(hex(c), '' ORDER BY p) FILTER (NOT g) AS kept FROM e GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_bytes, coalesce(m, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN r USING (doc_id)
    """,
    "op11_filter_interactions": """
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM d),
        l AS (SELECT doc_id, bool_or(quality = 1) AS g, bool_or(toxic = 1) AS x FROM labels GROUP BY doc_id),
        m AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
                     + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(e, false)::INT AS mask, coalesce(g, false) AS g, coalesce(x, false) AS x FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (g) AS g, count(*) FILTER (x) AS x FROM m GROUP BY part, mask),
        o AS (SELECT '' AS filter_order, 0 AS step, 0 AS before, 0 AS after, 0 AS bit UNION ALL
              SELECT filter_order || substr('ABCDE', i::INT, 1), step + 1, after, after | (1 << (i - 1)::INT), 1 << (i - 1)::INT FROM o, range(1, 6) AS r(i) WHERE after & (1 << (i - 1)::INT) = 0),
        s AS (SELECT f.filter_order, p.step, p.before, p.after, p.bit FROM o AS f JOIN o AS p ON f.step = 5 AND p.step > 0 AND starts_with(f.filter_order, p.filter_order)),
        r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & after = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN x ELSE 0 END) AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
               toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
    """,
    "op13_gram_jaccard": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
        x AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM g),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM x AS a JOIN x AS b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 85 * (n + m - c)),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT doc_id, len(g) AS n_shingles, least(doc_id, (SELECT min(b) FROM r WHERE r.a = doc_id)) AS component_id FROM g
    """,
}
