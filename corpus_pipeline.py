"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.  Its
result is written as Parquet in the shared folder and read again as the next one's ``docs``.  All
but the last return the columns of ``docs``.

Rows with null or empty texts have a defined way through: the language stage rejects them, as
they have no letter.  A row with a null doc_id is kept or rejected like any other by the first
two stages; it comes last in the order of lines, and is no one's near copy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once
from busloom.llm import language, line_dedup, ngram_join, packing, quality
from busloom.llm.common import unused
from busloom.llm.queries import GOOD_SCORE, language_model, quality_model

SURE_LANGUAGE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model recognises; without letters or in doubt, they go."""
    names = unused(docs, "lang_pred"), unused(docs, "score")
    found = language.identify(docs, language_model(docs), names)
    return found.where((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= SURE_LANGUAGE)).select(*docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on what is left and its labels, takes for good."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "score")
    return quality.score(docs, model, name).where(F.col(name) >= GOOD_SCORE).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those of which no line of their own is left go.

    A line of its own is any that is not blank and repeats no earlier one, however short.
    ``n_chars``, where there is one, follows the new text.
    """
    counts = tuple(unused(docs, n) for n in ("lines_in", "lines_out", "lines_own"))
    left = line_dedup.dedup_lines(docs, counts=counts, **line_dedup.NEAR_EVERY)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.where((F.col(counts[1]) == F.col(counts[0])) | (F.col(counts[2]) > 0)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies; rows that repeat a document count as copies.

    Documents that link with nothing (no words, or no id) stay as they are.
    """
    kept = ngram_join.jaccard_join(docs).where("kept").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id IS NULL"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document as power-of-two pieces."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", filter_quality),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack_sequences),
]

#: No SQL twin: tokenizers, trained models and compressors have no SQL form; tests/llm checks the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the intermediate tables are written while the frame is built."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
