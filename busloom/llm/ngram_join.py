"""Jaccard join of documents on word n-grams by MinHash banding, with links verified on whole n-gram sets.

1. *Classes.*  Documents with equal n-gram sets are one class; from here on only classes are compared,
   so a text with any number of copies is compared once.
2. *Bands.*  ``choose_bands`` takes the most rows per band that reach the target recall within the
   hash budget (18 bands of 4 rows for 0.9999 at 0.8).  A shuffle on band hashes finds the buckets.
3. *Leaders.*  A bucket is named after its smallest class.  Near copies share most of their buckets, so a
   class that meets others in 18 bands has few distinct leaders, and its n-gram set is sent to a leader's
   group once, not once per bucket.  Nothing is paired here.
4. *Verification.*  A group is cut into blocks of ``BLOCK`` classes, and every pair of blocks is a task's
   group of its own: no group is unbounded, and none is capped.  Inside, intersections of whole n-gram sets are a
   matrix product.  A pair that shares several leaders is counted by the smallest.
   What leaves the task are counts of links per class and the links of a spanning forest, never all pairs.
5. *Components* of those links are the near-duplicate classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from busloom.functions.reuse import written_once
from busloom.llm.common import blocks_for, components, grouped, pairs_of, to_batches

WORDS = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.9999
MOST_HASHES = 96
BLOCK = 256
VOCABULARY_AT_ONCE = 4096
SHINGLES_AT_ONCE = 2048

_SEEDS = np.random.default_rng(20240607)
_MULTIPLY = _SEEDS.integers(0, 1 << 63, 4096, np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _SEEDS.integers(0, 1 << 63, 4096, np.uint64)


def choose_bands(similarity: float = SIMILARITY, recall: float = TARGET_RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band for which enough bands fit the budget to find a pair at
    ``similarity`` with probability ``recall``; (most_hashes, 1) if none does."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(min(similarity, 1 - 1e-12) ** rows))))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-case n-grams between blanks.

    A text of fewer words is one n-gram; one without words has none.
    """
    split = text.lower().split()
    hashes = np.fromiter(map(xxh3_64_intdigest, split), np.uint64, len(split))
    n = max(1, len(hashes) - words + 1)
    if not len(hashes):
        return hashes
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(hashes))):
        total += hashes[k : k + n] * _MULTIPLY[k]
    return np.unique(_mixed(total + np.uint64(min(words, len(hashes)))))


def band_hashes(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of the least values of the band's hash functions."""
    k = bands * rows
    least = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SHINGLES_AT_ONCE):
        part = found[at : at + SHINGLES_AT_ONCE]
        np.minimum(least, (part[None, :] * _MULTIPLY[:k, None] + _ADD[:k, None]).min(1), out=least)
    grid = least.reshape(bands, rows)
    return _mixed((grid * _MULTIPLY[:rows]).sum(1, dtype=np.uint64) + _mixed(np.arange(1, bands + 1, dtype=np.uint64)))


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, cls (digest of the n-gram set; null without words), bands of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for doc_id, text in pairs_of(batches, "doc_id", "text"):
                found = shingles(text or "", words)
                if len(found) and doc_id is not None:
                    yield doc_id, xxh3_128_digest(found.tobytes()), band_hashes(found, bands, rows).view(np.int64)
                else:
                    yield doc_id, None, None

        yield from to_batches(made(), schema)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, cls binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls and its n-gram set, from the text of the class's first document; ``wanted``: doc_id, cls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for cls, text in pairs_of(batches, "cls", "text"):
                found = shingles(text or "", words).tobytes()
                if xxh3_128_digest(found) == cls:  # an id may be repeated with another text
                    yield cls, found

        yield from to_batches(made(), pa.schema([("cls", pa.binary()), ("grams", pa.binary())]))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(wanted, "doc_id").select("cls", "text").mapInArrow(run, "cls binary, grams binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; values that occur once can't be in any and are left out."""
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    column = column[place]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    row, column = row[column >= 0], column[column >= 0]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(shared), VOCABULARY_AT_ONCE):
        inside = (column >= at) & (column < at + VOCABULARY_AT_ONCE)
        dense = np.zeros((len(sets), min(VOCABULARY_AT_ONCE, len(shared) - at)), np.float32)
        dense[row[inside], column[inside] - at] = 1
        total += dense @ dense.T
    return total


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric matrix of links."""
    found, free = [], linked.any(1)
    for root in np.flatnonzero(free):
        if not free[root]:
            continue
        free[root] = False
        border = [root]
        while border:
            node = border.pop()
            new = np.flatnonzero(linked[node] & free)
            free[new] = False
            found += [(node, x) for x in new]
            border += list(new)
    return found


def verified(groups: DataFrame, similarity: float) -> DataFrame:
    """Links inside groups of (leader, first, second): rows (a, b null, n links of a) and (a, b, null) of a forest."""

    def links(leader: bytes, first: int, second: int, rows: pa.Table) -> Iterator[tuple]:
        unique = {c: i for i, c in enumerate(rows.column("cls").to_pylist())}  # a repeated row is one class
        names, at = list(unique), list(unique.values())
        if len(names) < 2:
            return
        grams, leaders, copies, block = (rows.column(c).to_pylist() for c in ("grams", "leaders", "copies", "block"))
        sets = [np.frombuffer(grams[i], np.uint64) for i in at]
        size = np.array([len(s) for s in sets], np.float64)
        common = intersections(sets).astype(np.float64)
        linked = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if first != second:
            side = np.array([block[i] == first for i in at])
            linked &= side[:, None] != side[None, :]
        smaller = sorted({x for i in at for x in leaders[i] if x < leader})
        if smaller and linked.any():  # pairs that meet under a smaller leader are counted there
            place = {x: k for k, x in enumerate(smaller)}
            under = np.zeros((len(at), len(smaller)), np.float32)
            for r, i in enumerate(at):
                under[r, [place[x] for x in leaders[i] if x < leader]] = 1
            linked &= (under @ under.T) == 0
        numbers = linked.astype(np.float64) @ np.array([copies[i] for i in at], np.float64)
        for r in np.flatnonzero(numbers):
            yield names[r], None, int(numbers[r])
        for x, y in forest(linked):
            yield names[x], names[y], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for key, rows in grouped(batches, "leader", "first", "second") for r in links(*key, rows))
        yield from to_batches(found, pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())]))

    keys = ("leader", "first", "second")
    return groups.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary, n long")


def jaccard_join(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = TARGET_RECALL,
    most_hashes: int = MOST_HASHES, block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_links, class_id, kept: one row per document.

    n_links counts the other documents at ``similarity`` or more (equal texts included), class_id
    is the smallest doc_id reachable by links, kept says whether the document is that one.
    Repeated rows are copies of each other.  A null or empty text, or one of blanks, links with
    nothing and is its own class; a row with a null doc_id links with nothing either (class_id
    null, kept false).  A text shorter than ``words`` is one n-gram.  Columns other than doc_id
    and text are ignored.  An empty table gives no rows.  Intermediates are written to the shared
    folder while the frame is built.
    """
    bands, rows = choose_bands(similarity, recall, most_hashes)
    sketch = written_once(sketches(docs, words, bands, rows), "sketches")
    classes = written_once(
        sketch.where("cls IS NOT NULL").groupBy("cls").agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")),
        "classes")
    in_bands = classes.select("cls", F.explode("bands").alias("band"))
    buckets = in_bands.groupBy("band").agg(F.min("cls").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader")
    met = written_once(
        in_bands.join(buckets, "band").groupBy("cls").agg(F.collect_set("leader").alias("leaders")), "leaders")  # at most ``bands`` leaders
    sets = written_once(shingle_sets(docs, classes.select("doc_id", "cls").join(met.select("cls"), "cls"), words), "sets")
    under = met.select("cls", "leaders", F.explode("leaders").alias("leader"))
    sizes = under.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select("leader", blocks_for(F.col("n"), block).alias("blocks"))
    placed = under.join(sizes, "leader").withColumn("block", F.pmod(F.xxhash64("cls", "leader"), F.col("blocks")).cast("int"))
    spread = placed.select(
        "cls", "leaders", "leader", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select("cls", "leaders", "leader", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    groups = spread.join(sets.dropDuplicates(["cls"]).join(classes.select("cls", "copies"), "cls"), "cls")
    links = written_once(verified(groups, similarity), "verified")
    counts = links.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cls")
    roots = components(links.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "cls", "component": "root"})
    named = classes.select("cls", "doc_id", "copies").join(counts, "cls", "left").join(roots, "cls", "left").select(
        "cls", F.coalesce("root", "cls").alias("root"), "doc_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    first = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    result = named.join(first, "root").select("cls", "n_links", "class_id")
    return sketch.select("doc_id", "cls").join(result, "cls", "left").select(
        "doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("class_id", "doc_id"), F.lit(False)).alias("kept"))
