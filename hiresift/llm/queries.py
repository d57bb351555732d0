"""The registered queries of the corpus operators, thin over the operators themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, html_text, minhash, mixing, quality, sharding, substring, token_counts, topk, toxicity, vector_codes, whitening
from .common import crc_remainder, table

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model).select(
        "doc_id", "held_out", "score", toxicity.predicted("score", 0.5).alias("predicted")
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("hashes")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        fingerprints.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, BYTE_VOCABULARY).select("doc_id", "bpe.*")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, texts=False).select(
        "doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept_sha256"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, WORD_VOCABULARY).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_remainder("doc_id", 4) == 2
    model = quality.fit(docs, labels.where(~held_out))
    return quality.score(docs.select("doc_id", "text", held_out.alias("held_out")), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    deviation = F.col("deviation").try_cast("long")  # null where a long is too short
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", deviation)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.encode(table(spark, sf_dir, "embeddings"), keep=("label",))
    return vector_codes.with_group_totals(coded, "label", "error", "label_error").select(
        "vec_id", "code", *[F.col(c).try_cast("long").alias(c) for c in ("error", "label_error")], "codebooks_sha256"
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_fingerprints": op2_fingerprints,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_bpe": op4_bpe,
    "op5_substrings": op5_substrings,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_html": op8_html,
    "op9_quality": op9_quality,
    "op10_topk": op10_topk,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_sharding": op13_sharding,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL = {
    "op3_near_duplicates": r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM split),
sized AS (SELECT doc_id, len(g) AS n FROM shingled),
flat AS (SELECT doc_id, n, unnest(g) AS t FROM shingled JOIN sized USING (doc_id)),
often AS (SELECT t FROM flat GROUP BY t HAVING count(*) > 1),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT * FROM flat WHERE t IN (SELECT t FROM often)) a JOIN flat b ON a.t = b.t AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM sized s JOIN (SELECT doc_id, min(other) AS c FROM reached GROUP BY doc_id) m USING (doc_id)
""",
    "op5_substrings": r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, s, array_to_string(list_slice(w, s, s + 49), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM split WHERE len(w) >= 50)),
late AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM late) GROUP BY doc_id),
kept AS (
    SELECT d.doc_id, len(w) AS n, CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END AS k FROM split d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
""",
    "op10_topk": """
WITH fine AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM fine q JOIN fine c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
""",
}
