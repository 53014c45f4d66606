"""Line deduplication by a deletion-neighbourhood join: lines within one word of an earlier line go.

Lines are compared as lower-case word sequences.  A line goes if the corpus holds an earlier equal
line, or (from ``near_words`` words on) an earlier line within one edit: a word replaced, put in or
left out.  With ``meet_shorter`` the longer line of a pair decides, so a line at that bound meets those
of one word less too.  Earlier means a smaller document id, then a smaller line number; the earliest stays.

Leaving one word out of both lines makes two lines within the bound equal, so equal variants are the
candidates.  Four things keep this small at scale:

* Equal lines are merged first, by an aggregate on their digest.
* *Which part.*  Lines are cut into ``PARTS`` parts.  If two lines differ by one edit, it lies in one
  part and the rest is equal; only lines whose rest is shared with another line emit variants, and
  only for that part.  No such pair is lost.
* *Which key.*  A variant for a replaced word keeps the word's place, so all lines that share it are
  neighbours of each other.  A variant for a word put in equals exactly one whole line.  Either way
  the earliest neighbour is a minimum per key: no pairs within a group are made, however large it is.
* *One step per variant.*  A variant's key is a polynomial in the line's word hashes, so leaving a word out or
  replacing it changes one term: a line of n words costs n, not n squared.

Each line's candidates, one per shared variant, are then verified by their edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from busloom.functions.reuse import written_once
from busloom.llm.common import pairs_of, to_batches, unused

PARTS = 3
NEAR_WORDS = 8
LEAST_WORDS = 1
NEAR_EVERY = {"near_words": 3, "meet_shorter": True}  # below, one edit may leave no word in common
LAST = (1 << 63) - 1  # place of documents without an id
PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME
MARK = 0x0A  # stands for a replaced word
INSERTED, REPLACED = 0, 1 << 61  # told apart above the prime


def words_of(line: str) -> list[str]:
    return line.lower().split()


def _joined(words: list[str]) -> bytes:
    return " ".join(words).encode()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def part_bounds(length: int) -> list[tuple[int, int]]:
    return [(length * i // PARTS, length * (i + 1) // PARTS) for i in range(PARTS)]


def rest_keys(joined: bytes) -> list[int]:
    """For the length n, then n - 1 (the line as the longer of a pair): for each part the hash of the rest.

    Key number i of length l is the hash of what a pair whose shorter line has l words shares if
    its edit lies in part i: the words before the part, and as many words from the end as follow it.
    """
    starts = [0, *accumulate(len(w) + 1 for w in joined.split(b" "))]
    n, found = len(starts) - 1, []
    for short in (n, n - 1):
        for i, (start, end) in enumerate(part_bounds(short)):
            rest = b"%b\n%b" % (joined[: starts[start]], joined[starts[n - (short - end)] :])
            found.append(_signed(xxh3_64_intdigest(rest, PARTS * short + i)))
    return found


def variants(words: list[str], parts: list[int], near_words: int = 0) -> Iterator[tuple[int, int]]:
    """(kind, key) of a line for the given numbers of ``rest_keys``.

    Kind 0: a word replaced, the variant has a mark in its place.  Kind 1: the line itself, kind 2: the
    line without one word; a line of kind 1 is the shorter of a pair with each line of kind 2.
    A line of less than ``near_words`` words is only ever the shorter of a pair.
    """
    n, whole = len(words), False
    hashes = list(map(xxh3_64_intdigest, words))
    before = list(accumulate(hashes, lambda sum_, h: (sum_ * BASE + h) % PRIME, initial=0))
    powers = list(accumulate(range(n), lambda power, _: power * BASE % PRIME, initial=1))
    bounds = [part_bounds(n), part_bounds(n - 1)]
    for number in parts:
        longer, i = divmod(number, PARTS)
        start, end = bounds[longer][i]
        if longer:
            for at in range(start, end + 1):
                yield 2, INSERTED | (before[n] - (before[at + 1] - before[at]) * powers[n - 1 - at]) % PRIME
        else:
            for at in range(start, end if n >= near_words else start):
                yield 0, REPLACED | (before[n] - (hashes[at] - MARK) * powers[n - 1 - at]) % PRIME
            if not whole:
                whole = True
                yield 1, INSERTED | before[n]


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two word sequences is at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    return a[start + (len(a) == len(b)) :] == b[start + 1 :]


def _lines(docs: DataFrame, near_words: int, least_words: int, meet_shorter: bool) -> DataFrame:
    """digest, doc, tie, line, keys of every line of ``least_words`` words or more."""
    schema = pa.schema([("digest", pa.binary()), ("doc", pa.int64()), ("tie", pa.int64()), ("line", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for doc, tie, text in pairs_of(batches, "doc", "tie", "text"):
                for number, line in enumerate((text or "").split("\n")):
                    words = words_of(line)
                    if len(words) >= least_words:
                        joined = _joined(words)
                        keys = rest_keys(joined) if len(words) >= near_words - meet_shorter else None
                        yield xxh3_128_digest(joined), doc, tie, number, keys[:PARTS] if keys and len(words) < near_words else keys

        yield from to_batches(found(), schema)

    return docs.select("doc", "tie", "text").mapInArrow(run, "digest binary, doc long, tie long, line int, keys array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest, doc, tie, line, parts and text of wanted lines (digest, doc, tie, line, parts), by their place."""
    schema = pa.schema([
        ("digest", pa.binary()), ("doc", pa.int64()), ("tie", pa.int64()), ("line", pa.int32()), ("parts", pa.list_(pa.int32())), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for doc, tie, text, places in pairs_of(batches, "doc", "tie", "text", "places"):
                lines = (text or "").split("\n")
                for place in places:
                    joined = _joined(words_of(lines[place["line"]])) if place["line"] < len(lines) else b""
                    if xxh3_128_digest(joined) == place["digest"]:  # two texts of an id may have the same tie
                        yield place["digest"], doc, tie, place["line"], place["parts"], joined.decode()

        yield from to_batches(found(), schema)

    # A list has at most as many places as the text has lines.
    lists = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("line", "digest", "parts")).alias("places"))
    return docs.select("doc", "tie", "text").join(lists, ["doc", "tie"]).mapInArrow(
        run, "digest binary, doc long, tie long, line int, parts array<int>, words string")


def _neighbours(texts: DataFrame, near_words: int) -> DataFrame:
    """digest and candidate place of the earliest line that shares a variant, if earlier than the line itself."""
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("digest", pa.binary()), ("doc", pa.int64()), ("tie", pa.int64()), ("line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (key, kind, digest, doc, tie, line)
            for digest, doc, tie, line, parts, words in pairs_of(batches, "digest", "doc", "tie", "line", "parts", "words")
            for kind, key in variants(words.split(" "), parts, near_words)
        )
        yield from to_batches(rows, schema)

    emitted = texts.mapInArrow(run, "key long, kind int, digest binary, doc long, tie long, line int").withColumn("place", F.struct("doc", "tie", "line"))
    emitted = written_once(emitted.select("key", "kind", "digest", "place"), "variants")
    earliest = emitted.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min(F.expr("IF(kind = 0, place, NULL)")).alias("replaced"),
        F.min(F.expr("IF(kind = 1, place, NULL)")).alias("whole"),
        F.min(F.expr("IF(kind = 2, place, NULL)")).alias("shortened"),
    ).where("n > 1").drop("n")
    candidate = F.expr("CASE kind WHEN 0 THEN replaced WHEN 1 THEN shortened ELSE whole END")
    return emitted.join(earliest, "key").select("digest", "place", candidate.alias("candidate")).where("candidate < place").select(
        "digest", F.col("candidate.doc").alias("doc"), F.col("candidate.tie").alias("tie"), F.col("candidate.line").alias("line")).distinct()


def _too_near(texts: DataFrame, near_words: int) -> DataFrame:
    """Digests of lines with a verified earlier neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (digest,) for digest, mine, other in pairs_of(batches, "digest", "mine", "other")
            if within_one_edit(mine.split(" "), other.split(" "))
        )
        yield from to_batches(rows, pa.schema([("digest", pa.binary())]))

    pairs = _neighbours(texts, near_words).join(
        texts.select("doc", "tie", "line", F.col("words").alias("other")), ["doc", "tie", "line"])
    pairs = pairs.select("digest", "other").join(texts.select("digest", F.col("words").alias("mine")), "digest")
    return pairs.mapInArrow(run, "digest binary").distinct()


def dedup_lines(
    docs: DataFrame, near_words: int = NEAR_WORDS, least_words: int = LEAST_WORDS, counts: tuple[str, str, str] = ("lines_in", "lines_out", "lines_own"),
    meet_shorter: bool = False,
) -> DataFrame:
    """``docs`` with the text left after deduplication, and how many lines it had, has left, and has
    left of those long enough to be compared (``counts``).

    Lines of fewer than ``least_words`` words (blank ones too) always stay; from ``near_words`` words
    on (of both lines, or of the longer one with ``meet_shorter``) the bound is one edit, below it
    equality.  A line whose earlier neighbour goes itself still
    goes.  All columns of ``docs`` come back, text changed; one row per row.  A null text stays null
    (0 lines), an empty one has one empty line.  Rows with a null doc_id come last in the order.  Among them, and
    among rows of one doc_id, texts follow each other by their hash; rows that repeat both count as one document,
    so what stays of it stays in every copy.  An empty table gives no rows.  Columns called as ``counts`` are
    replaced, others come back.  Intermediates are written while the frame is built.
    """
    whole, order = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    placed = docs.select(order.alias("doc"), F.xxhash64(whole).alias("tie"), whole.alias("text"))
    lines = written_once(
        _lines(placed, near_words, least_words, meet_shorter).groupBy("digest").agg(F.min(F.struct("doc", "tie", "line")).alias("place"), F.first("keys").alias("keys")),
        "lines").select("digest", "place.doc", "place.tie", "place.line", "keys")
    # A short stand-in for the digest: if two collide, a line emits variants in vain.
    keyed = lines.where("keys IS NOT NULL").select(F.xxhash64("digest").alias("id"), F.posexplode("keys").alias("part", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    parts = keyed.join(shared, "key").groupBy("id").agg(F.collect_set("part").alias("parts"))  # at most 2 * PARTS numbers
    wanted = lines.select(F.xxhash64("digest").alias("id"), "digest", "doc", "tie", "line").join(parts, "id").drop("id")
    # The same line may come back twice, from two rows with one doc_id and text.
    texts = written_once(_texts(placed, wanted).dropDuplicates(["digest"]), "near-lines")
    near = written_once(_too_near(texts, near_words), "too-near")
    place, tie, stays_in = unused(docs, "place"), unused(docs, "tie"), unused(docs, "stay")
    stay = lines.join(near, "digest", "left_anti").groupBy(F.col("doc").alias(place), F.col("tie").alias(tie)).agg(
        F.collect_list(F.struct("line", "digest")).alias(stays_in))
    joined = docs.withColumns({place: order, tie: F.xxhash64(whole)}).join(stay, [place, tie], "left")
    out = StructType.fromDDL(f"text string, `{counts[0]}` int, `{counts[1]}` int, `{counts[2]}` int")
    old = [f for f in joined.schema.fields if f.name not in (*out.names, place, tie, stays_in)]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rest_of(text: str | None, stays: list[dict] | None) -> tuple:
            if text is None:
                return None, 0, 0, 0
            found = {(s["line"], s["digest"]) for s in stays or ()}
            every, rest, own = text.split("\n"), [], 0
            for number, line in enumerate(every):
                words = words_of(line)
                long = len(words) >= least_words
                if not long or (number, xxh3_128_digest(_joined(words))) in found:
                    rest.append(line)
                    own += long
            return "\n".join(rest), len(every), len(rest), own

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                text, *numbers = zip(*(rest_of(*row) for row in pairs_of([part], "text", stays_in)), strict=True)
                fresh = [pa.array(text, pa.string()), *(pa.array(n, pa.int32()) for n in numbers)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in old), *fresh], names=[*(f.name for f in old), *out.names])

    return joined.mapInArrow(rebuild, StructType([*old, *out.fields]))
