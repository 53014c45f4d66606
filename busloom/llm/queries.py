"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.llm import ann, bpe, language, lexical, line_dedup, ngram_join, packing, quality, token_counts, url_filter, vector_dedup, warc, whitening


GOOD_SCORE = 0.3
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_power_of_two_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.piece_digests(pieces)


def _held_out(of: int, rest: int) -> Column:
    """Whether crc32 of the document id's text leaves ``rest``; a null id is never held out (and teaches nothing)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == rest, F.lit(False))


def language_model(docs: DataFrame) -> language.LanguageModel:
    return language.fit(docs, ~_held_out(4, 2))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.CompressionModel:
    return quality.fit(docs, labels, ~_held_out(5, 0))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language.identify(docs.select("doc_id", "text"), language_model(docs)).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op3_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality_model(docs, _table(spark, folder, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"))


def op4_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    labels = _table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.judge(_table(spark, folder, "pages"), labels, URL_RULES)


def op5_hilbert_search(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_minhash_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, folder, "documents"))


def op7_subspace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.dedup_vectors(_table(spark, folder, "embeddings"))


def op8_warc_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The pages have no capture times; page n counts as captured n seconds after a fixed moment."""
    captured = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    return warc.archive_pages(_table(spark, folder, "pages"), captured).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture", "position")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, folder, "documents"), **line_dedup.NEAR_EVERY).select(
        "doc_id", "lines_in", "lines_out", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.round_trip_digests(coded)


def op11_cholesky_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, folder, "embeddings"))


def op12_mask_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (
    op1_power_of_two_packing, op2_language_id, op3_compression_quality, op4_url_templates,
    op5_hilbert_search, op6_minhash_join, op7_subspace_dedup, op8_warc_merge, op9_line_dedup, op10_bpe_round_trip,
    op11_cholesky_whitening, op12_mask_search, op13_token_counts,
)}

SQL: dict[str, str] = {
    "op4_url_templates": url_filter.judge_sql(URL_RULES),
    "op8_warc_merge": warc.archive_sql(),
    "op12_mask_search": lexical.search_sql(),
}
