"""Queries of the text operators over the driver's tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicate_components

    return near_duplicate_components(table(spark, sf_dir, "documents"), percent=85)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import removal_digests

    return removal_digests(table(spark, sf_dir, "documents"))


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches over the whole table; the rollup's folder is temporary, its totals are few rows."""
    import uuid

    from .rollup import TokenRollup, document_rollup
    from .spark import cut, shared_folder

    rollup = TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    out = cut(document_rollup(rollup, table(spark, sf_dir, "documents")))
    rollup.drop()
    return out


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_avi_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op9_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents"))


def op10_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import language_predictions

    return language_predictions(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_rollups": op3_token_rollups,
    "op4_vector_bin_packing": op4_vector_bin_packing,
    "op5_template_decontamination": op5_template_decontamination,
    "op6_site_style_tree": op6_site_style_tree,
    "op7_nb_ngram_toxicity": op7_nb_ngram_toxicity,
    "op8_avi_media_columns": op8_avi_media_columns,
    "op9_hidden_markov_scores": op9_hidden_markov_scores,
    "op10_cross_parsing_language": op10_cross_parsing_language,
}

SQL: dict[str, str] = {
    "op3_token_rollups": r"""
        WITH kept AS (
            SELECT source, lang, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL
        ), counted AS (
            SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM kept
            UNION ALL
            SELECT source, lang, 'pieces-1', len(regexp_extract_all(t, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) FROM kept
        )
        SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
        FROM counted GROUP BY source, lang, tokenizer
    """,
}
