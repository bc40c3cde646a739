"""One registered query per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelens.llm import (chunks, codes, fingerprints, jaccard, lm, oracles, packing, pieces, quality, suffixes, toxicity,
                          tries, voronoi, warc)
from sitelens.llm.common import fold, table


def tokenizer_file(name: str) -> bytes:
    """A public vocabulary file; it is installed beside Python and never copied."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_products(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op4_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=fold("doc_id", 4) != 2)
    return toxicity.scored(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"),
                                               "score", "predicted")


def op8_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 10) == 0
    return lm.scored(table(spark, sf_dir, "documents"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json").decode())


def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.shared_prefix_trie(table(spark, sf_dir, "conversations"))


def op12_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json").decode())


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_voronoi_join": op2_voronoi_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_grouped_prefix_join": op4_grouped_prefix_join,
    "op6_warc_index": op6_warc_index,
    "op7_toxicity": op7_toxicity,
    "op5_piece_encoding": op5_piece_encoding,
    "op8_backoff_automaton": op8_backoff_automaton,
    "op9_fingerprints": op9_fingerprints,
    "op10_packing": op10_packing,
    "op11_burst_trie": op11_burst_trie,
    "op12_chunk_reuse": op12_chunk_reuse,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op11_burst_trie": oracles.PREFIX_TRIE,
    "op13_vector_codes": oracles.vector_codes(),
    "op2_voronoi_join": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op6_warc_index": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages
        ), f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (digest)""",
}
