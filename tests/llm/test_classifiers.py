"""Language and quality models: held-out accuracy, bounds and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from busloom.llm import language, quality, queries
from busloom.llm.linear import calibrate, fit_svm, rising_curve

FOLDER = "/root/testdata/sf0.01"
EDGE = [(1, None, "en", 0.5), (2, "", "en", 0.5), (3, "12 ### 34", "en", 0.5), (None, "the of and that", "en", 0.5), (5, "the of and that", "en", 0.5), (5, "the of and that", "en", 0.5), (6, "x" * 300_000, "en", 0.1)]
EDGE_DDL = "doc_id long, text string, lang string, score double"


def test_svm_and_calibration():
    random = np.random.default_rng(1)
    y = np.where(np.arange(400) % 4 == 0, 1.0, -1.0)
    x = random.normal(size=(400, 5)) + np.outer(y, [1.5, 0, 0, 0, 0])
    w, b = fit_svm(x, y)
    assert np.mean(np.sign(x @ w + b) == y) > 0.9 and abs(w[0]) > 5 * abs(w[1:]).max() / 2
    slope, offset = calibrate(x @ w + b, y > 0)
    assert slope > 0
    assert calibrate(np.array([1.0, 2.0]), np.array([True, True]))[0] == 0
    knots, values = rising_curve(np.array([0.0, 1, 2, 3]), np.array([False, True, False, True]), np.ones(4))
    assert knots == [0, 1, 2, 3] and values == sorted(values) and values[1] == values[2] == 0.5


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def language_model(docs):
    return queries.language_model(docs)


def test_language_held_out_accuracy(spark, docs):
    found = queries.op2_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert held[0] > 200 and held[1] > 0.98
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_structure(language_model):
    assert language_model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert language_model.pairs == [("de", "en"), ("es", "fr")]
    assert language_model.weights.shape == (language.DIMENSIONS, 4)  # two families, two pairs


def test_language_words_in_small_tables_give_the_same(language_model):
    text = "The quick brown fox and the lazy dog, über alles là-bas. " * 30
    small = language.WordTable(language_model.weights, size=0)
    assert np.allclose(small.sums(text), language.WordTable(language_model.weights).sums(text))


def test_language_edges(spark, language_model):
    rows = language.identify(spark.createDataFrame(EDGE, EDGE_DDL), language_model).collect()
    assert len(rows) == len(EDGE) and set(rows[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score"}
    for r in rows:
        assert (r.lang_pred, r.score) == ("und", 0.0) if r.doc_id in (1, 2, 3) else r.lang_pred != "und"
    assert language.identify(spark.createDataFrame([], EDGE_DDL), language_model).count() == 0
    nothing = language.fit(spark.createDataFrame([(1, None, "en", 0.0), (2, "a b", None, 0.0)], EDGE_DDL), F.lit(True))
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(EDGE, EDGE_DDL), nothing).collect()} == {"und"}
    one = language.fit(spark.createDataFrame([(i, "ein haus", "xx", 0.0) for i in range(5)], EDGE_DDL), F.lit(True))
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(EDGE, EDGE_DDL), one).collect()} == {"und", "xx"}


def test_repeated_ids_teach_once(spark, docs):
    """A hot id is one row of the sample; an id that also comes with a null text is no trouble."""
    own = docs.select("doc_id", "text", "lang").limit(40)
    hot = [(1_000_000, f"der text nummer {i} und mehr", "de") for i in range(300)] + [(1_000_000, None, "de"), (1_000_001, "ein wort", "de"), (1_000_001, None, "de")]
    rows = own.unionByName(spark.createDataFrame(hot, own.schema))
    sample = language._sample(rows, F.lit(True), 4000).collect()
    assert len(sample) == len({r.doc_id for r in sample}) == 42
    assert language.fit(rows, F.lit(True)).members
    labels = spark.createDataFrame([(1_000_000, 1)] * 3 + [(1_000_001, 0)], "doc_id long, quality int")
    texts = quality.least_text(rows.join(quality.sample_of(labels, F.lit(True), 10), "doc_id"), "doc_id", "quality", "rank").collect()
    assert sorted(r.doc_id for r in texts) == [1_000_000, 1_000_001]
    assert 0 <= quality.fit(rows, labels, F.lit(True)).probability(0, 10) <= 1


def plain_language(model, text):
    """Machine by machine and word by word, without tables."""
    counts = np.zeros(language.DIMENSIONS)
    for word in text.lower().split():
        for feature in language.word_features(word):
            counts[feature] += 1
    if not counts.sum():
        return "und"
    sure = 1 / (1 + np.exp(-(model.slopes * (counts / counts.sum() @ model.weights + model.biases) + model.offsets)))
    first = len(model.family_machines)
    family = model.family_machines[int(np.argmax(sure[:first]))]
    votes = {x: 0.0 for x in model.members[family]}
    for k, (a, b) in enumerate(model.pairs, start=first):
        if a in votes:
            votes[a if sure[k] >= 0.5 else b] += 1
    return max(votes, key=votes.get)


def test_language_equals_the_plain_definition(docs, language_model):
    rows = language.identify(docs.where("doc_id % 10 = 3"), language_model).collect()
    assert len(rows) > 50
    for r in rows:
        assert r.lang_pred == plain_language(language_model, r.text or ""), r.doc_id


def test_quality_equals_the_plain_definition(spark, docs):
    import zstandard

    model = queries.quality_model(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))

    def size(data, content, trained):
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        packer = zstandard.ZstdCompressor(
            level=model.level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind),
            write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(packer.compress(data[i : i + model.chunk])) for i in range(0, len(data), model.chunk))

    for r in quality.score(docs.where("doc_id % 25 = 4"), model).collect():
        data = (r.text or "").encode()
        good, bad = (size(data, c, t) for c, t in zip((model.good, model.bad), model.trained, strict=True))
        margin = (bad - good + quality.PRIOR_BYTES * model.typical) / (len(data) + quality.PRIOR_BYTES)
        smooth = 1 / (1 + np.exp(-(model.slope * margin + model.offset)))
        expected = 0.95 * np.interp(margin, model.knots, model.values) + 0.05 * smooth
        assert r.score == pytest.approx(expected, abs=1e-9), r.doc_id


def test_held_out_languages_teach_nothing(spark, docs, language_model):
    changed = docs.withColumn("lang", F.when(queries._held_out(4, 2), "xx").otherwise(F.col("lang")))
    again = queries.language_model(changed)
    assert np.array_equal(again.weights, language_model.weights)


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = queries.op3_compression_quality(spark, FOLDER).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert wins > 0.9  # a few dozen bad documents to learn from
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_edges(spark):
    bad = "zzz ### !!! %%% "
    docs = spark.createDataFrame([(i, (bad if i % 2 else "the plain words of a text ") * 40, "en", 0.0) for i in range(200)], EDGE_DDL)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(0, 0), (None, 1), (7, None), (9, 5)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.col("doc_id") >= 0)
    rows = quality.score(spark.createDataFrame([*EDGE, (7, bad * 9, "en", 0.0), (8, "the plain words of a text " * 9, "en", 0.0)], EDGE_DDL), model).collect()
    assert len(rows) == len(EDGE) + 2 and all(0 <= r.score <= 1 for r in rows)
    at = {r.doc_id: r.score for r in rows}
    assert at[7] < 0.3 < 0.7 < at[8] and at[1] == at[2]
    assert quality.score(spark.createDataFrame([], EDGE_DDL), model).count() == 0


def test_quality_without_labels_is_a_constant(spark):
    docs = spark.createDataFrame(EDGE, EDGE_DDL)
    for labels in ([], [(5, 1)], [(5, 1), (5, 0)]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
        assert len({r.score for r in quality.score(docs, model).collect()}) == 1


def test_quality_sample_is_bounded_and_fair(spark):
    labels = spark.createDataFrame([(i, int(i % 50 > 0)) for i in range(5000)], "doc_id long, quality int")
    counts = {r.quality: r["count"] for r in quality.sample_of(labels, F.lit(True), 60).groupBy("quality").count().collect()}
    assert counts == {0: 60, 1: 60}
