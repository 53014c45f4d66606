"""Ranked lexical search by presence masks: every item's best documents under an integer tf-idf score.

*Terms.*  A pass over the texts counts, document by document, the terms that some item asks for; the counts are
written as a table, from which the corpus' statistics and the ranking are worked out.  Nothing is shuffled but sums.

*Masks.*  A task takes its documents in segments.  For each item every term's presence is one bit, and a document's
bits are its mask.  Documents with equal masks are a group; a group's score is at most the sum, over the
mask's terms, of weight times the largest impact the term has in the segment.  Groups are evaluated by
falling maximum, until none that is left can reach the item's worst kept score.  Evaluation is exact, and
a group whose maximum equals that score is still evaluated, as a smaller id would win the tie.  What one segment found
bounds the next.

The best of each task meet in one ranking per item.  Items with the same terms are one class; classes are worked off in
blocks of bounded size, so neither many nor long items grow what a task holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from busloom.functions.reuse import written_once
from busloom.llm.common import pairs_of, to_batches

BEST = 20
BLOCK_BYTES = 16 << 20  # of item terms that are worked off, and broadcast, at once
STEP = 1 << 20  # bytes of text that are cut into terms at once
SEGMENT_DOCS = 1 << 16
SEGMENT_POSTINGS = 1 << 22
FIRST_DOCS = 64  # documents evaluated before the first look at the bound; then twice as many each time
MASKS_AT_ONCE = 1 << 14

#: Every byte as it counts: letters and digits, A-Z in lower case, all bytes beyond ASCII; blank for the rest.
_FOLDED = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

ITEMS = pa.schema([("item_id", pa.int64()), ("cls", pa.binary()), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("size", pa.int64())])
ITEMS_DDL = "item_id long, cls binary, terms array<binary>, counts array<long>, size long"
COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
COUNTED_DDL = "doc_id long, n long, terms array<int>, counts array<long>"
FOUND = pa.schema([("cls", pa.binary()), ("doc_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "cls binary, doc_id long, score long"


def term_counts(text: bytes | None) -> Counter[bytes]:
    """How often each term occurs in a text (UTF-8), a bounded step at a time."""
    found: Counter[bytes] = Counter()
    at, size = 0, len(text or b"")
    while at < size:
        end = at + STEP
        part = text[at:end].translate(_FOLDED)
        if end < size:
            cut = part.rfind(b" ")
            while cut < 0 and end < size:  # a term longer than a step
                end += STEP
                part = text[at:end].translate(_FOLDED)
                cut = part.rfind(b" ")
            if end < size:
                part, end = part[:cut], at + cut + 1
        found.update(part.split())
        at = end
    return found


def _bytes_of(frame: DataFrame, key: str) -> DataFrame:
    return frame.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").cast("binary").alias("text"))


def item_classes(items: DataFrame) -> DataFrame:
    """item_id, cls, terms, counts, size of every item that has a term; items with equal terms and counts share a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for item_id, text in pairs_of(batches, "item_id", "text"):
                found = sorted(term_counts(text).items())
                if found:
                    terms, counts = zip(*found, strict=True)
                    yield item_id, xxh3_128_digest(b"\n".join(b"%b %d" % x for x in found)), list(terms), list(counts), sum(map(len, terms))

        yield from to_batches(rows(), ITEMS)

    return written_once(_bytes_of(items, "item_id").mapInArrow(run, ITEMS_DDL), "items")


def count_terms(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all its terms), terms and counts (of those in ``numbers``): a row per document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def rows() -> Iterator[tuple]:
            for doc_id, text in pairs_of(batches, "doc_id", "text"):
                found = term_counts(text)
                if found:
                    asked = sorted((known[t], c) for t, c in found.items() if t in known)
                    yield doc_id, found.total(), [t for t, _ in asked], [c for _, c in asked]

        yield from to_batches(rows(), COUNTED)

    return written_once(_bytes_of(docs, "doc_id").mapInArrow(run, COUNTED_DDL), "counted")


class Segment:
    """Documents with their counted terms, and for each term the documents that hold it."""

    def __init__(self, part: pa.Table, vocabulary: int, documents: int, terms_in_all: int):
        ids = part.column("doc_id").combine_chunks()
        self.no_id = np.asarray(ids.is_null())
        self.doc_id = ids.fill_null(0).to_numpy()
        lists = part.column("terms").combine_chunks()
        self.starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        self.terms = lists.flatten().to_numpy()
        count = part.column("counts").combine_chunks().flatten().to_numpy()
        n = part.column("n").to_numpy()
        if 25 * int(n.max()) * documents >= 1 << 63:
            n = n.astype(object)
        length = (75 + 25 * n * documents // terms_in_all).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(self.starts))
        self.impact = 1_000_000_000 * count // (1000 * count + 12 * length[doc])
        order = np.argsort(self.terms, kind="stable")
        self.docs_of = doc[order]
        self.term_starts = np.searchsorted(self.terms[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.most, self.terms, self.impact)

    def masks(self, terms: np.ndarray) -> np.ndarray:
        """For each document a row of 64-bit words; bit j says whether it holds ``terms[j]``."""
        words = np.zeros((len(self.doc_id), -(-len(terms) // 64)), np.uint64)
        for j, term in enumerate(terms):
            words[self.docs_of[self.term_starts[term] : self.term_starts[term + 1]], j // 64] |= np.uint64(1 << j % 64)
        return words

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores; ``weights`` has a weight for every term of the vocabulary."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        return np.add.reduceat(weights[self.terms[at]] * self.impact[at], ends - sizes)


def groups_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``words``, and for each row the number of its group."""
    group = np.zeros(len(words), np.int64)
    for j in range(words.shape[1]):
        _, of = np.unique(words[:, j], return_inverse=True)
        _, group = np.unique(group * (int(of.max(initial=0)) + 1) + of, return_inverse=True)
    first = np.zeros(int(group.max(initial=-1)) + 1, np.int64)
    first[group] = np.arange(len(words))
    return words[first], group


def bounds_of(masks: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each mask the sum of ``most`` over its bits."""
    out = np.zeros(len(masks), np.int64)
    for at in range(0, len(masks), MASKS_AT_ONCE):
        bits = np.unpackbits(np.ascontiguousarray(masks[at : at + MASKS_AT_ONCE]).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        out[at : at + MASKS_AT_ONCE] = bits[:, : len(most)] @ most if most.sum() >= 1 << 52 else (bits[:, : len(most)].astype(float) @ most).astype(np.int64)
    return out


class Best:
    """The best documents of one item so far: score down, then id up, rows without an id last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.no_id, self.doc_id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def worst(self) -> int:
        """What a document must reach to matter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, no_id: np.ndarray, doc_id: np.ndarray) -> None:
        new = score >= self.worst
        score, no_id, doc_id = (np.concatenate([a, b[new]]) for a, b in ((self.score, score), (self.no_id, no_id), (self.doc_id, doc_id)))
        order = np.lexsort((doc_id, no_id, -score))[: self.k]
        self.score, self.no_id, self.doc_id = score[order], no_id[order], doc_id[order]


def search_segment(segment: Segment, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Bring ``best`` up to date with the segment's documents; how many were evaluated."""
    most = weights[terms] * segment.most[terms]
    words = segment.masks(terms)
    docs = np.flatnonzero(words.any(1))
    if not len(docs):
        return 0
    masks, group = groups_of(words[docs])
    bounds = bounds_of(masks, most)
    order = np.argsort(-bounds, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(masks))[order])
    docs = docs[np.argsort(np.argsort(order)[group], kind="stable")]  # group by group, in the order of their bounds
    done, at, size = 0, 0, FIRST_DOCS
    while at < len(order) and bounds[order[at]] >= best.worst:
        live = int(np.searchsorted(-bounds[order], -best.worst, side="right"))
        at = min(max(int(np.searchsorted(ends, done + size)) + 1, at + 1), live)
        part = docs[done : int(ends[at - 1])]
        best.add(segment.scores(part, weights), segment.no_id[part], segment.doc_id[part])
        done, size = int(ends[at - 1]), 2 * size
    return done


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, postings = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            docs, postings = docs + part.num_rows, postings + len(part.column("terms").flatten())
            if docs >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _search_block(docs: DataFrame, block: list, k: int) -> DataFrame:
    """cls, doc_id, score: each task's best documents for the classes of one block."""
    numbers = {t: i for i, t in enumerate(sorted({bytes(t) for r in block for t in r.terms}))}
    counted = count_terms(docs, numbers)
    documents, terms_in_all = (int(x or 0) for x in counted.agg(F.count("*"), F.sum("n")).first())
    # As many rows as the block has distinct terms.
    holding = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weight = np.array([floor(1000 * log((2 * documents + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(numbers))], np.int64)
    asked = []
    for r in block:
        terms = np.array([numbers[bytes(t)] for t in r.terms], np.int64)
        times = np.array(r.counts, np.int64) * weight[terms]
        asked.append((bytes(r.cls), terms[times > 0], times[times > 0]))
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    size = len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = [Best(k) for _ in items]
        weights = np.zeros(size, np.int64)
        for part in _segments(batches):
            segment = Segment(part, size, documents, terms_in_all)
            for (_, terms, times), mine in zip(items, best, strict=True):
                if len(terms):
                    weights[terms] = times
                    search_segment(segment, terms, weights, mine)
                    weights[terms] = 0
        yield from to_batches((
            (cls, None if none else doc_id, score) for (cls, _, _), mine in zip(items, best, strict=True)
            for doc_id, none, score in zip(mine.doc_id.tolist(), mine.no_id.tolist(), mine.score.tolist(), strict=True)), FOUND)

    return counted.mapInArrow(run, FOUND_DDL)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents with a score above 0 for every row of ``items``.

    Input: doc_id and text of ``docs``, item_id and text of ``items``; other columns are ignored.  A null or
    empty text has no terms: such a document counts nowhere, such an item has no rows.  Every row is a document
    or item of its own, so repeated rows count and rank each; equal scores go by ascending doc_id, null ids last.
    Empty tables give no rows.  What is broadcast is one block of items, ``block_bytes`` of terms or one item;
    the counted terms are written while the frame is built, once for each block.
    """
    asked = item_classes(items)
    classes = asked.groupBy("cls").agg(F.first("terms").alias("terms"), F.first("counts").alias("counts"), F.first("size").alias("size"))
    blocks = max(1, -(-int(classes.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    found = []
    for number in range(blocks):
        block = sorted(classes.where(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == number).collect(), key=lambda r: r.cls)
        if block or not (found or number < blocks - 1):
            found.append(_search_block(docs, block, k))
    order = Window.partitionBy("cls").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.select("item_id", "cls").join(ranked, "cls").select("item_id", "rank", "doc_id", "score")


def search_sql(k: int = BEST) -> str:
    """The same ranking of ``documents`` for ``benchmark`` in DuckDB's SQL, by scoring every pair that shares a term."""
    terms = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH doc AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, {terms} AS terms FROM documents WHERE text IS NOT NULL),
counted AS (SELECT r, doc_id, len(terms) AS n, terms FROM doc WHERE len(terms) > 0),
whole AS (SELECT COUNT(*) AS documents, SUM(n)::BIGINT AS terms_in_all FROM counted),
item AS (SELECT ROW_NUMBER() OVER () AS i, item_id, {terms} AS terms FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT i, item_id, t, COUNT(*) AS times FROM (SELECT i, item_id, unnest(terms) AS t FROM item) GROUP BY ALL),
tf AS (SELECT r, t, COUNT(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM counted) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln(CAST(2 * MAX(documents) + 2 AS DOUBLE) / CAST(2 * COUNT(*) + 1 AS DOUBLE)))::BIGINT AS w FROM tf, whole GROUP BY t),
impact AS (
  SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * documents) // terms_in_all)) AS impact
  FROM tf JOIN counted USING (r), whole),
scored AS (
  SELECT i, item_id, r, doc_id, SUM(times * w * impact)::BIGINT AS score
  FROM asked JOIN weight USING (t) JOIN impact USING (t) GROUP BY ALL),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
