"""Lexical search against the plain definition."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from busloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [t.encode() for t in TERM.findall((text or "").translate(UPPER))]


def plain(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 25 + 25 * c.total() * n // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        rows += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows, key=str)


def frames(spark, docs, items):
    made = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("terms", F.lit(1))
    return made.repartition(3), spark.createDataFrame(items, "item_id long, text string").withColumn("cls", F.lit(2))


def rows_of(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)] + ["Éa", "日本", "x y", "ABC", "q2"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(60)] + [(7, docs[7][1]), (7, "w1 w2"), (None, "w3 W140"), (None, "w3 W140"), (901, None), (902, ""), (903, "-- !")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(20, " ".join(words)), (21, docs[3][1]), (21, docs[3][1]), (None, "w3, w3; W140"), (22, None), (23, "..."), (24, "unheard"), (25, "abc-Q2 unheard")]
    return docs, items


def test_equals_the_plain_definition(spark, corpus):
    docs, items = corpus
    expected = plain(docs, items)
    assert rows_of(lexical.search(*frames(spark, docs, items))) == expected


def test_small_segments_and_blocks_change_nothing(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "FIRST_DOCS", 2)
    assert rows_of(lexical.search(*frames(spark, docs, items), k=5, block_bytes=60)) == plain(docs, items, 5)


def test_most_documents_are_never_evaluated():
    rng = random.Random(2)
    docs = [[(t, 1) for t in range(40) if rng.random() < 1 / (t + 1)] for _ in range(4000)]
    table = pa.table({
        "doc_id": pa.array(range(4000)), "n": pa.array([len(d) + 5 for d in docs], pa.int64()),
        "terms": pa.array([[t for t, _ in d] for d in docs], pa.list_(pa.int32())), "counts": pa.array([[c for _, c in d] for d in docs], pa.list_(pa.int64()))})
    segment, weights = lexical.Segment(table, 40, 4000, 30_000), np.arange(40) * 100
    best = lexical.Best(20)
    done = lexical.search_segment(segment, np.arange(1, 40), weights, best)
    assert 20 <= done < 1000
    scores = [sum(int(t) * 100 * int(i) for t, i in zip(segment.terms[a:b], segment.impact[a:b], strict=True)) for a, b in zip(segment.starts, segment.starts[1:])]
    expected = sorted((-s, i) for i, s in enumerate(scores))[:20]
    assert list(zip((-best.score).tolist(), best.doc_id.tolist())) == expected


def test_long_texts_are_counted_in_steps(monkeypatch):
    text = "Aé b-c " * 50 + "x" * 300 + " end\x00E"
    whole = Counter(terms_of(text))
    for step in (1, 2, 3, 7, 64):
        monkeypatch.setattr(lexical, "STEP", step)
        assert lexical.term_counts(text.encode()) == whole
    assert lexical.term_counts(None) == lexical.term_counts(b"") == {}


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert rows_of(lexical.search(*frames(spark, [], items))) == []
    assert rows_of(lexical.search(*frames(spark, docs, []))) == []
