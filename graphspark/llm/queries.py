"""The queries of this subpackage, and the SQL of those that SQL can express. Each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_whitening, exact_dedup, hard_negatives, hilbert_shard, html_extract, language_id, license_scan, mixing, quality_rules, secret_scan, simhash, toxicity
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read_table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate_one(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(read_table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(read_table(spark, sf_dir, "documents"))


def op9_hilbert_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shard.shard(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out()
    return language_id.predict(docs, docs.where(~held), ["doc_id", held.alias("held_out")])


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = language_id.held_out()
    labels = read_table(spark, sf_dir, "labels").where(~held)
    return toxicity.predict(read_table(spark, sf_dir, "documents"), labels, ["doc_id", held.alias("held_out")])


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_secret_scan, op2_bpe, op3_html_extract, op4_exact_dedup, op5_quality_rules, op6_mixing, op7_simhash, op8_license_scan, op9_hilbert_shard, op10_language_id, op11_toxicity, op12_whitening, op13_hard_negatives)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op5_quality_rules": r"""
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
            FROM documents
        ),
        p AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest(range(3)) AS v(k) GROUP BY doc_id),
        m AS (
            SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                coalesce(c.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
            FROM w LEFT JOIN c USING (doc_id)
        ),
        f AS (
            SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_upper > word_chars THEN 8 ELSE 0 END
                + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN n_dup_lines > 20 AND 10 * n_dup_lines > n_words THEN 32 ELSE 0 END AS failures
            FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures & 15 = 0 AS kept,
            CAST(failures AS INTEGER) AS failures
        FROM f
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS y
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_dot_product(a.y, b.y) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
            s.other_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT s.alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
}
