"""The pipeline's stages on planted cases, and its whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from busloom.functions.reuse import written_once
from busloom.llm import line_dedup, ngram_join, packing

SMALL = "/root/testdata/sf0.01"


def test_stage_names_and_functions():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "line dedup", "n-gram Jaccard join", "packing"]


@pytest.fixture(scope="module")
def planted(spark):
    """The small table with rows that every stage has to get right, and columns that clash with the stages' own."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    base = docs.where("doc_id = 21").first()
    words = base.text.split(" ")
    near = list(words)
    for at in random.Random(1).sample(range(len(words)), max(1, len(words) // 100)):
        near[at] = "Ersatzwort"
    extra = [
        (900_001, None), (900_002, ""), (900_003, "12345 ... 678"), (900_004, base.text), (900_005, " ".join(near).replace("\n", " ")),
        (900_006, base.text.replace("\n", " ")), (None, "The words of this row have no id but they are of the plain sort that it is to be."),
    ]
    rows = spark.createDataFrame([(i, t, base.lang, base.source, None if t is None else len(t)) for i, t in extra], docs.schema)
    return written_once(docs.unionByName(rows).withColumns({"score": F.lit("s"), "lines_in": F.lit(1), "kept": F.lit(True), "LANG_PRED": F.lit("l")}))


def test_stages_in_order(spark, planted):
    docs, ids = planted, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written_once(stage(spark, docs, SMALL))
        assert docs.columns == planted.columns and docs.schema == before.schema, name
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.where("score <> 's' OR lines_in <> 1 OR NOT kept OR LANG_PRED <> 'l'").count() == 0
        if name == "line dedup":
            lines = docs
    language, quality, deduped, final = ids
    assert not {900_001, 900_002, 900_003} & language and {21, 900_004, 900_005, 900_006} <= language
    assert len(language) > 990 and 850 < len(quality) < 960  # one in eight is labelled as bad
    assert 900_004 in quality and 900_004 not in deduped  # all its lines are there already
    assert {21, 900_006} <= deduped and {21, 900_005, 900_006} & final == {21}  # one line each, and no longer equal lines: near copies
    changed = lines.where(F.length("text") != F.col("n_chars")).count()
    assert changed == 0
    # Exactly one document of each group of the last comparison stays.
    groups = ngram_join.jaccard_join(lines)
    expected = {r.class_id for r in groups.collect() if r.doc_id is not None} | {r.doc_id for r in groups.collect() if r.class_id is None}
    assert final == expected


def test_a_list_keeps_its_own_short_lines(spark):
    footer = "this footer stands below every single page of the site"
    items = ["Tea", "Black coffee", "Cake", "Juice"]
    docs = [(1, f"Some first page\n{footer}"), (2, "\n".join([*items, footer])), (3, f"\n{footer}"), (4, f"TEA\n\n{footer}")]
    left = corpus_pipeline.remove_repeated_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), SMALL)
    assert sorted(tuple(r) for r in left.collect()) == [docs[0], (2, "\n".join(items))]


def test_repeated_rows_leave_one(spark):
    text = "a passage of some ten words that is twice here"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "other")], "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()) == [(1, text), (3, "other")]


def test_empty_input_passes_through(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SMALL)
        assert result.count() == 0
        docs = result if result.columns == docs.columns else docs


def test_run_packs_what_the_stages_keep(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(pieces.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    totals = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t")
    assert pieces.count() > 0 and totals.count() == 0
    assert packing.LONGEST == 2048 and line_dedup.NEAR_WORDS == 8
