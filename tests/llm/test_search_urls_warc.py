"""Nearest neighbours, URL filter and archives."""

import gzip
import random

import numpy as np
import pyarrow.fs as pafs
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from busloom.llm import ann, queries, url_filter, warc

SMALL = "/root/testdata/sf0.001"
ODD_VECTORS = [(9000, None), (9020, [0.0] * 8), (9040, [float("nan")] + [1.0] * 7), (None, [1.0] * 8), (9060, [1.0] * 3)]


class Registered:
    def __init__(self, name):
        self.name = name

    def run(self, spark, folder):
        return queries.QUERIES[self.name](spark, folder)

    def oracle(self):
        return queries.SQL[self.name]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    assert compare(spark, connect(SMALL), Registered(name), SMALL) is None


def test_hilbert_neighbours_touch():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = ann.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_best_keeps_ties_by_name():
    best = ann.Best(2, 3)
    best.add(np.array([[1.0, 2, 2, 2, 2], [0, 0, 0, 0, 1]]), np.array([9, 8, 7, 6, 5]))
    best.add(np.array([[2.0, 3], [0, 0]]), np.array([1, 2]))
    found = {}
    for q, name, score in best.rows(np.array([100, 200])):
        found.setdefault(q, []).append((name, score))
    assert found == {100: [(2, 3.0), (1, 2.0), (5, 2.0)], 200: [(5, 1.0), (1, 0.0), (2, 0.0)]}


def test_search_recall_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 64)  # many cells and pieces at this size
    monkeypatch.setattr(ann, "PIECE", 100)
    random_ = np.random.default_rng(4)
    centres = random_.normal(size=(30, 8))
    x = centres[random_.integers(0, 30, 1500)] + random_.normal(size=(1500, 8)) * 0.3
    x[400:900] = x[400]  # a third are equal
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    vectors = spark.createDataFrame([*rows, rows[40], *((i, v, 0) for i, v in ODD_VECTORS)], "vec_id long, embedding array<double>, rank int")
    found = {}
    for r in ann.search(vectors, F.col("vec_id") % 20 == 0, nearest=10).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(found) == list(range(0, 1500, 20))
    hit = 0
    for q, answers in found.items():
        assert sorted(answers) == list(range(1, 11))
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:10]
        got = [answers[k] for k in range(1, 11)]
        assert q not in [v for v, _ in got] and np.allclose([s for _, s in got], [score[v] for v, _ in got])
        assert got == sorted(got, key=lambda r: (-r[1], r[0]))
        hit += len(set(order) & {v for v, _ in got})
        if 400 <= q < 900 and order[0] == 400 + (q == 400):
            assert [v for v, _ in got] == order
    assert hit / 750 >= 0.9


def test_search_with_few_or_no_rows(spark):
    ddl = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], ddl), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(1, [1.0]), (3, [1.0])], ddl), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], ddl), F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 1, 2.0), (0, 2, 2, 0.0)]


URLS = {
    "https://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "http://x.net/de/": ("x.net", "/de/", "net/", "block"),
    "http://net/": ("net", "/", "net/", "block"),
    "http://internet/": ("internet", "/", None, None),
    "http://x.net": ("x.net", "", None, None),
    "http://www.example.com/de/5": ("www.example.com", "/de/5", "example.com/de/", "block"),
    "http://myexample.com/de/5": ("myexample.com", "/de/5", None, None),
    "ftp://a.org/fr/?q=http://x.net/": ("a.org", "/fr/", "org/fr/", "allow"),
    "a.org/fr/": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
    "://Ä.NET/x": ("Ä.net", "/x", "net/", "block"),
}


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>", "r") for i, u in enumerate(URLS)], "page_id long, url string, html string, rule string")
    rows = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame([], "page_id long, good int"), queries.URL_RULES).collect()}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, rule, verdict or "allow")


def test_templates_learn_from_labels(spark):
    random_ = random.Random(2)
    pages, labels = [], []
    for i in range(900):
        section = ("news", "spam", "blog")[i % 3]
        pages.append((i, f"http://h.example/{section}/user{random_.randrange(10**6)}/{i}.html"))
        if i % 2:
            labels.append((i, int(section != "spam")))
    pages += [(5000, f"http://h.example/{'/'.join('abcdefghijkl')}"), (None, "http://h.example/spam/1"), (1, pages[1][1])]
    labels += [(3, 0), (3, 1), (None, 0), (5, 7)]
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), {}).collect()
    assert len(found) == len(pages)
    verdicts = {(r.path.split("/")[1], r.verdict) for r in found if r.page_id is not None and r.page_id < 900}
    assert verdicts == {("news", "allow"), ("spam", "block"), ("blog", "allow")}
    assert {r.template for r in found if "/spam/user" in r.path} == {"h.example/spam/*/*"}
    plan = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), {})
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, good int"), {}).count() == 0


def test_few_labels_prove_nothing_and_many_do(spark):
    from math import comb

    cases = [(g, n, share) for n in (1, 2, 5, 40, 999) for g in {0, 1, n // 2, n - 1, n} if g <= n for share in (0.001, 0.3, 0.5, 0.9, 0.999)]
    frame = spark.createDataFrame(cases, "good long, labelled long, share double")
    for r in frame.withColumn("differs", url_filter._differs(F.col("good"), F.col("labelled"), F.col("share"))).collect():
        mass = [comb(r.labelled, k) * r.share**k * (1 - r.share) ** (r.labelled - k) if r.labelled < 999 else None for k in range(r.labelled + 1)]
        if mass[0] is not None:
            assert r.differs == (2 * min(sum(mass[: r.good + 1]), sum(mass[r.good:])) < 0.01)
        elif abs(r.good / r.labelled - r.share) > 0.1:
            assert r.differs
    assert not [r for r in frame.where("labelled = 1 AND share = 0.9").withColumn("d", url_filter._differs(F.col("good"), F.col("labelled"), F.col("share"))).collect() if r.d]


def test_deep_trees_equal_the_twin_and_take_few_rounds(spark, monkeypatch, tmp_path):
    import duckdb

    stem = "/".join(f"{'abcdefghij'[k % 10]}x" for k in range(300))
    paths = [f"{stem}/{('good', 'bad')[i % 2]}/{'uvw'[i % 3]}/{i}" for i in range(60)]
    paths += [f"{stem}/bad", stem, f"{stem[:500]}", "a/b/c/d/e/f/g/h/good/1", "a/b/c/d/e/f/g/h/bad/1", "", "/", "x//y"]
    random_ = random.Random(3)
    paths += ["/".join(random_.choice("pqr") for _ in range(random_.randrange(1, 10))) for _ in range(400)]
    pages = [(i, f"http://deep.example/{p}") for i, p in enumerate(paths)] + [(900, None), (901, "http://other.example/a/b")]
    labels = [(i, int("bad" not in p and not p.startswith("p/q/r"))) for i, p in enumerate(paths)]
    spark.createDataFrame(pages, "page_id long, url string").toPandas().to_parquet(tmp_path / "pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").toPandas().to_parquet(tmp_path / "labels.parquet")
    rounds, real = [], url_filter.written_once
    monkeypatch.setattr(url_filter, "written_once", lambda df, name: rounds.append(name) or real(df, name))
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), queries.URL_RULES)
    assert rounds.count("templates") < 20
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    twin = db.execute(f"SELECT page_id, host, path, rule, verdict, template FROM ({url_filter.judge_sql(queries.URL_RULES)})").fetchall()
    rows = [tuple(r) for r in found.select("page_id", "host", "path", "rule", "verdict", "template").collect()]
    assert sorted(rows, key=repr) == sorted(twin, key=repr) and len(rows) == len(pages)
    by_page = {r[0]: r for r in rows}
    assert {by_page[i][4] for i in range(0, 60, 2)} == {"allow"} and {by_page[i][4] for i in range(1, 60, 2)} == {"block"}
    assert by_page[1][5].startswith("deep.example/" + "*/" * 300 + "bad/") or by_page[1][5].count("/bad") == 1


def test_a_small_bad_section_of_a_hot_host_is_blocked(spark):
    def path(i):
        return f"bad/{i}" if i % 200 == 7 else f"s{'abcdefghijklmnop'[i % 16]}/{i}"

    pages = [(i, f"http://hot.example/{path(i)}") for i in range(20_000)]
    # A host of 150 sections, each with under 1 % of its pages; one in ten is bad.
    names = ["".join("abcdefghij"[int(c)] for c in f"{k:03d}") for k in range(150)]
    pages += [(20_000 + i, f"http://wide.example/{names[i % 150]}/{i}") for i in range(6000)]
    labels = [(i, int(i % 200 != 7)) for i in range(20_000)] + [(20_000 + i, int(i % 150 % 10 != 3)) for i in range(6000)]
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), {}).collect()
    bad = {p for p, good in labels if not good}
    assert {r.page_id for r in found if r.verdict == "block"} == bad


def test_branches_of_any_depth(spark):
    sections = {"/en/shop/a/b/c/d/good": 1, "/en/shop/a/b/c/d/spam": 0, "/x/a/b/c/d/e/f/g/h/i/j/good": 1, "/x/a/b/c/d/e/f/g/h/i/j/spam": 0}
    pages = [(i, f"http://deep.example{list(sections)[i % 4]}/{i}") for i in range(400)]
    labels = [(i, list(sections.values())[i % 4]) for i in range(400)]
    pages += [(1000, f"http://deep.example/{'/'.join(str(i) for i in range(500))}"), (1001, "http://deep.example"), (1002, "http://deep.example/en/shop/a/b/c/d/spam"), (1003, "http://deep.example/en/shop")]
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), {}).collect()
    assert len(found) == len(pages) and {(r.page_id % 4, r.verdict) for r in found if r.page_id < 400} == {(0, "allow"), (1, "block"), (2, "allow"), (3, "block")}
    templates = {r.page_id: r.template for r in found}
    assert templates[0] == "deep.example/*/*/*/*/*/*/good/*" and templates[3] == "deep.example/*/*/*/*/*/*/*/*/*/*/*/spam/*"
    assert templates[1000] == "deep.example" + "/*" * 500 and templates[1001] == "deep.example" and templates[1002] == "deep.example/*/*/*/*/*/*/spam"


def test_one_longer_vector_removes_no_other(spark):
    rows = [(i, [float(i), 1.0]) for i in range(40)] + [(100, [1.0, 2.0, 3.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, nearest=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (20, 1, 39), (20, 2, 38), (20, 3, 37)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    random_ = random.Random(k)
    runs = [sorted((random_.randrange(50), random_.randrange(3)) for _ in range(random_.randrange(40))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)  # several archives from a task
    monkeypatch.setattr(warc, "ROWS_PER_RANGE", 20)
    long, short = "ü" * 600, "s" * 500
    pages = [(i, f"http://{'ba'[i % 2]}.example/{i % 7}", long if i % 3 == 0 else f"page {i}\r\n\r\nWARC/1.1\r\n" * 30) for i in range(60)]
    pages += [(70, None, None), (71, "no scheme", ""), (72, "http://x\r\ny/", short), (73, "http://x/", short), (74, "http://big/", "x" * 3_000_000), (75, "http://x", long), (75, "http://x", long), (None, "http://n/", long)]
    frame = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, archive string, seq int")
    rows = warc.archive_pages(frame, F.timestamp_seconds(F.col("page_id") % 10)).collect()
    assert len(rows) == len(pages) and sorted(r.position for r in rows) == list(range(len(pages)))
    import hashlib

    by_page = {r.page_id: r for r in rows}
    for page, _, html in pages:
        data = (html or "").encode()
        assert (by_page[page].payload_bytes, by_page[page].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        copy = html == long and page != 75
        assert (by_page[page].record_type, by_page[page].refers_to) == (("revisit", 75) if copy else ("response", None))
    ordered = sorted(rows, key=lambda r: r.position)
    keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in ordered]
    assert keys == sorted(keys) and by_page[70].url_key == ")" and by_page[0].url_key == "example,b)/0"
    assert all(r.capture == 1 + sum(o.url_key == r.url_key for o in ordered[: r.position]) for r in ordered)
    # Any record can be read on its own, by gzip alone.
    store, root = pafs.FileSystem.from_uri(_archive_folder(spark))
    some = by_page[74]
    with store.open_input_file(f"{root}/{some.archive}") as f:
        assert warc.parse(gzip.decompress(f.read_at(some.length, some.start)))[:2] == (74, 3_000_000)


def test_archives_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    pages = spark.range(400).selectExpr("id AS page_id", "'http://a/' || id AS url", "repeat(sha2(CAST(id AS STRING), 256), 20) AS html").repartition(4)
    tasks = []
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda archives, folder: read(tasks.append(archives.rdd.getNumPartitions()) or archives, folder))
    rows = warc.archive_pages(pages, F.lit(None).cast("timestamp")).collect()
    assert len(rows) == 400 and tasks[0] > 8


def test_revisits_name_their_response():
    data = warc.record(1, "http://x", "1970-01-01T00:00:00Z", None, 3, "a9993e364706816aba3e25717850c26c9cd0d89d", 7, "http://y", "1999-01-01T00:00:00Z")
    assert b"WARC-Refers-To-Target-URI: http://y\r\n" in data and b"WARC-Refers-To-Date: 1999-01-01T00:00:00Z\r\n" in data
    assert warc.parse(data) == (1, 3, "a9993e364706816aba3e25717850c26c9cd0d89d", "revisit", 7)


def _archive_folder(spark):
    """The archives' folder of the last test run: the newest below the shared one."""
    from busloom.session import shared_dir

    folder = shared_dir(spark)
    store, root = pafs.FileSystem.from_uri(folder)
    infos = [i for i in store.get_file_info(pafs.FileSelector(root)) if "archives-" in i.path]
    return max(infos, key=lambda i: i.mtime_ns).path


def test_archives_of_nothing(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), F.lit(None).cast("timestamp")).count() == 0


def test_damaged_records_are_noticed():
    data = warc.record(1, "http://x", "1970-01-01T00:00:00Z", b"abc", 3, "a9993e364706816aba3e25717850c26c9cd0d89d", None)
    assert warc.parse(data) == (1, 3, "a9993e364706816aba3e25717850c26c9cd0d89d", "response", None)
    for damaged in (data[:-5], data.replace(b"abc", b"abd")):
        with pytest.raises(ValueError):
            warc.parse(damaged)
