"""The n-gram join, line deduplication and vector deduplication against brute force."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from xxhash import xxh64_intdigest

from busloom.llm import line_dedup, ngram_join, vector_dedup

RANDOM = random.Random(11)


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[RANDOM.randrange(len(words))] = f"new{RANDOM.randrange(10**6)}"
    return words


def near_texts():
    rows = []
    for group in range(12):
        base = [f"w{RANDOM.randrange(5000)}" for _ in range(RANDOM.choice([20, 60, 200]))]
        for _ in range(RANDOM.choice([1, 2, 5])):
            rows.append(" ".join(edited(base, RANDOM.choice([0, 0, 1, 2, 4]))))
    hot = [f"h{i}" for i in range(120)]
    rows += [" ".join(edited(hot, RANDOM.choice([0, 1, 1, 2, 3]))) for _ in range(150)]  # a hot group of near copies
    rows += ["all the same text of seven words"] * 80  # and one of copies
    RANDOM.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


ODD = [(1000, None), (1001, ""), (1002, "  \n "), (1003, "one two"), (1004, "One  TWO"), (1005, "one two three"), (1006, "z " * 100_000), (1006, "z " * 100_000)]


def brute_links(rows, similarity=0.8):
    sets = [(i, set(ngram_join.shingles(t or "").tolist())) for i, t in rows if i is not None]
    links = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            common = len(a & b)
            if common and common >= similarity * (len(a) + len(b) - common) - 1e-9:
                links.append((i, j))
    return links


def test_bands():
    bands, rows = ngram_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 96
    assert ngram_join.choose_bands(1.0) == (1, 96)


def test_shingles_are_the_word_ngrams():
    text = "A b c d e F g b c d e f"
    words = text.lower().split()
    assert len(ngram_join.shingles(text)) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert np.array_equal(ngram_join.shingles("a B"), ngram_join.shingles(" A\nb ")) and not len(ngram_join.shingles(" "))


@pytest.mark.parametrize("block", [16, 256])
def test_jaccard_join_equals_brute_force(spark, block):
    rows = near_texts() + ODD
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows] + [(None, "all the same text of seven words", 1, "x")], "doc_id long, text string, n_links int, cls string")
    found = {}
    for r in ngram_join.jaccard_join(docs, block=block).collect():
        assert found.setdefault(r.doc_id, r) == r  # the repeated row has the same result
    links = brute_links(rows)
    number = defaultdict(int)
    for a, b in links:
        number[a] += 1
        number[b] += 1
    number[1006] = 1
    component = components_of({i for i, _ in rows}, links)
    for i, _ in rows:
        assert (found[i].n_links, found[i].class_id, found[i].kept) == (number[i], component[i], component[i] == i), i
    assert tuple(found[None]) == (None, 0, None, False)
    assert len(found) == len({i for i, _ in rows}) + 1


def test_jaccard_join_of_nothing(spark):
    assert ngram_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def place_of(doc, text, n):
    """Where a line stands in the order: by id (none last), then the text's hash, then its number."""
    x = xxh64_intdigest(text.encode(), 42)
    return line_dedup.LAST if doc is None else doc, x - (1 << 64) if x >> 63 else x, n


def brute_lines(rows):
    """Place of every kept line, from all pairs of distinct lines."""
    first = {}
    for doc, text in (r for r in rows if r[1] is not None):
        for n, line in enumerate(text.split("\n")):
            words, place = tuple(line_dedup.words_of(line)), place_of(doc, text, n)
            if len(words) >= line_dedup.LEAST_WORDS:
                first[words] = min(first.get(words, place), place)
    near = set()
    every = [(w, p) for w, p in first.items() if len(w) >= line_dedup.NEAR_WORDS]
    for x, (a, p) in enumerate(every):
        for b, q in every[x + 1 :]:
            if edit_distance(a, b) <= 1:
                near.add(a if p > q else b)
    return first, near


def edit_distance(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_rows():
    base = [[f"w{RANDOM.randrange(30)}" for _ in range(RANDOM.randrange(1, 16))] for _ in range(30)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(RANDOM.randrange(1, 7)):
            words = list(RANDOM.choice(base))
            for _ in range(RANDOM.choice([0, 0, 1, 1, 2])):
                at = RANDOM.randrange(len(words) + 1)
                words[at : at + RANDOM.randrange(2)] = [f"x{RANDOM.randrange(4)}"] * RANDOM.randrange(2)
            lines.append(" ".join(words))
        rows.append((doc, "\n".join(lines)))
    hot = [f"h{i}" for i in range(10)]  # a hot group: each differs from every other by one word
    rows += [(100 + i, " ".join([*hot[:4], f"v{i}", *hot[5:]]) + "\n\nend of it") for i in range(120)]
    return rows + [(400, None), (401, ""), (402, "\n\n"), (None, "H0 h1  h2 h3 q h5 h6 h7 h8 h9"), (403, "a b\na b\nc d e\nC  d e"), (404, "k " * 50_000), (100, rows[0][1])]


def test_one_edit():
    a = "a b c d".split()
    assert all(line_dedup.within_one_edit(a, b.split()) for b in ("a b c d", "a x c d", "b c d", "a b c", "a b x c d", "a b c d d", "x b c d", "a b c x"))
    assert not any(line_dedup.within_one_edit(a, b.split()) for b in ("a c b d", "a b", "x b c x", "a b c d e f"))
    for _ in range(3000):
        x, y = ([RANDOM.choice("ab") for _ in range(RANDOM.randrange(7))] for _ in range(2))
        assert line_dedup.within_one_edit(x, y) == (edit_distance(x, y) <= 1)


def test_lines_within_one_edit_share_a_rest_and_a_variant():
    for _ in range(2000):
        a = [RANDOM.choice("abc") for _ in range(RANDOM.randrange(8, 14))]
        b, at = list(a), RANDOM.randrange(len(a))
        b[at : at + RANDOM.randrange(2)] = ["x"] * RANDOM.randrange(2)
        if a == b or edit_distance(a, b) > 1:
            continue
        keys = [line_dedup.rest_keys(" ".join(w).encode()) for w in (a, b)]
        shared = set(keys[0]) & set(keys[1])
        assert shared
        emitted = [set(line_dedup.variants(w, [i for i, k in enumerate(ks) if k in shared])) for w, ks in zip((a, b), keys)]
        same = {(0, k) for kind, k in emitted[0] if kind == 0} & emitted[1]
        across = {k for kind, k in emitted[0] if kind == 1} & {k for kind, k in emitted[1] if kind == 2}
        across |= {k for kind, k in emitted[1] if kind == 1} & {k for kind, k in emitted[0] if kind == 2}
        assert same or across


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, 3, "p") for d, t in rows], "doc_id long, text string, lines_in int, place string")
    found = line_dedup.dedup_lines(docs).collect()
    assert set(found[0].asDict()) == {"doc_id", "text", "lines_in", "lines_out", "lines_own", "place"} and len(found) == len(rows)
    first, near = brute_lines(rows)
    expected = []
    for doc, text in rows:
        if text is None:
            expected.append((doc, None, 0, 0))
            continue
        kept = []
        for n, line in enumerate(text.split("\n")):
            words = tuple(line_dedup.words_of(line))
            if len(words) < line_dedup.LEAST_WORDS or first[words] == place_of(doc, text, n) and words not in near:
                kept.append(line)
        expected.append((doc, "\n".join(kept), len(text.split("\n")), len(kept)))
    assert sorted(((r.doc_id, r.text, r.lines_in, r.lines_out) for r in found), key=str) == sorted(expected, key=str)


def test_every_line_is_compared(spark):
    """The bounds of the query and the pipeline: equality for all lines that are not blank, one edit if the longer has three words."""
    rows = [(d, t) for d, t in line_rows() if d is not None]
    rows += [(500 + i, "\n".join(" ".join(RANDOM.choice("abcd") for _ in range(RANDOM.randrange(1, 5))) for _ in range(3))) for i in range(40)]
    rows += [(600, "les."), (601, "Les.\nonly here"), (602, "e1 e2 e3 e4 e5 e6 e7 e8"), (603, "e1 e2 e3 e4 e6 e7 e8"), (604, "f1 f2 f3"), (605, "f1 f3"), (606, "f1"), (607, "g1 g2"), (608, "g1 x2")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), **line_dedup.NEAR_EVERY).collect()
    first = {}
    for doc, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for n, line in enumerate(text.split("\n")):
            words, place = tuple(line_dedup.words_of(line)), place_of(doc, text, n)
            first[words] = min(first.get(words, place), place)
    every, near = list(first.items()), set()
    for x, (a, p) in enumerate(every):
        for b, q in every[x + 1 :]:
            if max(len(a), len(b)) >= 3 and min(len(a), len(b)) and edit_distance(a, b) <= 1:
                near.add(a if p > q else b)
    expected = []
    for doc, text in rows:
        lines = [] if text is None else text.split("\n")
        own = [bool(w) and first[w] == place_of(doc, text, n) and w not in near for n, w in enumerate(tuple(line_dedup.words_of(x)) for x in lines)]
        left = [x for x, o in zip(lines, own) if o or not x.strip()]
        expected.append((doc, None if text is None else "\n".join(left), len(left), sum(own)))
    assert sorted(((r.doc_id, r.text, r.lines_out, r.lines_own) for r in found), key=str) == sorted(expected, key=str)
    left = {r.doc_id: r.text for r in found}
    assert [left[i] for i in range(600, 609)] == ["les.", "only here", "e1 e2 e3 e4 e5 e6 e7 e8", "", "f1 f2 f3", "", "f1", "g1 g2", "g1 x2"]


def test_a_line_of_200_000_words_costs_its_length(spark):
    words = [f"w{i % 977}" for i in range(200_000)]
    other = [*words[:70_000], "odd", *words[70_001:]]
    parts = list(range(2 * line_dedup.PARTS))
    start = time.perf_counter()
    emitted = [set(line_dedup.variants(w, parts)) for w in (words, other, words[:-1])]
    assert time.perf_counter() - start < 20
    assert {k for kind, k in emitted[0] if kind == 0} & {k for kind, k in emitted[1] if kind == 0}
    assert {k for kind, k in emitted[0] if kind == 2} & {k for kind, k in emitted[2] if kind == 1}
    rows = [(1, " ".join(words)), (2, " ".join(other) + "\nits own end"), (3, " ".join(words[:-1]))]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), **line_dedup.NEAR_EVERY)
    assert {r.doc_id: r.text for r in found.collect()} == {1: rows[0][1], 2: "its own end", 3: ""}


def test_rows_without_an_id_have_lines_of_their_own(spark):
    rows = [(None, f"the only line that number {i} has for itself {i * i}\nand one they share") for i in range(300)] + [(9, "and one they share")] * 2
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in found if r.doc_id is None) == sorted(t.split("\n")[0] for d, t in rows if d is None)
    assert [r.text for r in found if r.doc_id == 9] == ["and one they share"] * 2


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def vector_rows():
    random_ = np.random.default_rng(3)
    rows = []
    for _ in range(25):
        centre = random_.normal(size=12)
        for _ in range(int(random_.integers(1, 6))):
            rows.append(centre + random_.normal(size=12) * random_.choice([0.01, 0.1, 0.3]))
    hot = random_.normal(size=12)
    rows += [hot + random_.normal(size=12) * 0.05 for _ in range(150)]  # a hot group of near copies
    rows += [np.ones(12)] * 60  # and one of copies
    rows += [np.ones(12) * 3, -np.ones(12)]  # the same direction, and the opposite one
    return [(i, r.tolist()) for i, r in enumerate(rows)]


ODD_VECTORS = [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] + [1.0] * 11), (904, [float("inf")] + [1.0] * 11), (905, [None] + [1.0] * 11), (906, [1.0] * 5), (None, [1.0] * 12)]


@pytest.mark.parametrize("chunk", [16, 2048])
def test_vector_dedup_equals_brute_force(spark, chunk):
    rows = vector_rows()
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in [*rows, *ODD_VECTORS, rows[0]]], "vec_id long, embedding array<double>, block int, cls int")
    found = {}
    for r in vector_dedup.dedup_vectors(vectors, chunk=chunk).collect():
        assert found.setdefault(r.vec_id, r) == r
    x = np.array([v for _, v in rows])
    length = np.linalg.norm(x, axis=1)
    linked = x @ x.T / length[:, None] / length >= 0.95
    np.fill_diagonal(linked, False)
    component = components_of(range(len(rows)), zip(*np.nonzero(linked)))
    for i in range(len(rows)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (linked[i].sum(), component[i], component[i] == i), i
    for i, _ in ODD_VECTORS:
        assert tuple(found[i]) == (i, 0, i, i is not None)


def test_vector_dedup_of_nothing(spark):
    ddl = "vec_id long, embedding array<float>"
    assert vector_dedup.dedup_vectors(spark.createDataFrame([], ddl)).count() == 0
    assert [tuple(r) for r in vector_dedup.dedup_vectors(spark.createDataFrame([(1, None)], ddl)).collect()] == [(1, 0, 1, True)]


def test_components_of_a_long_path(spark):
    from busloom.llm.common import components

    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "a long, b long"))
    found = {r.node: r.component for r in components(links).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[500] == found[501] == 500 and len(found) == 203


def test_vectors_link_with_those_of_their_length(spark):
    rows = [(i, [1.0, 0.01 * (i % 3)]) for i in range(8)] + [(20, [1.0, 0.0, 0.0]), (21, [1.0, 0.0, 0.01]), (22, [3e200, 0.0, 0.0]), (23, [0.0, 1e-200, 0.0]), (24, [0.0, 2e-200, 0.0])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(found[i] == (7, 0) for i in range(8))
    assert [found[i] for i in (20, 21, 22)] == [(2, 20)] * 3 and [found[i] for i in (23, 24)] == [(1, 23)] * 2


def test_cells_hold_every_near_pair():
    """A point meets every point within the radius: at home together, or the one of the earlier cell visits."""
    random_ = np.random.default_rng(6)
    points = np.vstack([random_.normal(size=(600, 5)), random_.normal(size=(900, 5)) * 0.05 + random_.normal(size=(30, 5)).repeat(30, 0)])
    for radius in (0.01, 0.2, 0.6):
        tree = vector_dedup.fit_splits(points[::2], radius, 10_000_000)
        assert len(tree.axis) > 3
        at_home, held = {}, set()
        for cell, rows, home in tree.cells(points, radius):
            at_home.update(dict.fromkeys(rows[home].tolist(), cell))
            held |= {(r, cell) for r in rows.tolist()}
        assert len(at_home) == len(points)
        i, j = np.nonzero(np.triu(((points[:, None] - points) ** 2).sum(2) <= radius**2, 1))
        for a, b in zip(i.tolist(), j.tolist()):
            first, last = sorted((a, b), key=at_home.get)
            assert (first, at_home[last]) in held


def test_compared_pairs_grow_slowly_on_clustered_vectors(spark):
    """Ten times the clusters, well below a hundred times the pairs."""
    def pairs(clusters):
        random_ = np.random.default_rng(7)
        spread = 1 / np.sqrt(np.arange(1, 33))  # as embeddings have it: some directions hold most of the spread
        x = (random_.normal(size=(clusters, 32)) * spread).repeat(4, 0) + random_.normal(size=(4 * clusters, 32)) * 0.01
        rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "cls long, vec array<double>, copies long").repartition(4)
        spaces = vector_dedup.fit_subspaces(rows, 0.95, 4)
        return vector_dedup.compared_pairs(vector_dedup._placed(rows, spaces, vector_dedup.fit_cells(rows, spaces)))

    small, large = pairs(300), pairs(3000)
    assert large < 60 * small and large < 0.6 * 4 * 12_000**2 / 2
