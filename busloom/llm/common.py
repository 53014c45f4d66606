"""What several of the operators share: Arrow batches in tasks, groups in sorted partitions, components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from busloom.functions.reuse import written_once

BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20


def to_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pack row tuples into Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES of text and bytes."""
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def pairs_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of the named columns as tuples, a few hundred at a time so that long texts are not all copied at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores added until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def appended(docs: DataFrame, made: Callable[[], Callable[[str | None], tuple]], ddl: str) -> DataFrame:
    """``docs`` with columns worked out from each row's text, whole and row by row; nothing is shuffled.

    ``made`` is called once in each task and gives the function from a text (or null) to the new
    columns' values; ``ddl`` names them.  Columns of ``docs`` with these names are replaced.
    """
    new = StructType.fromDDL(ddl)
    old = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in new.names}]
    types = to_arrow_schema(new)
    whole = unused(docs, "whole_text")
    texted = docs.select(*(F.col(f"`{f.name}`") for f in old), F.col("text").cast("string").alias(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = made()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [value(text) for (text,) in pairs_of([part], whole)]
                fresh = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(old)], *fresh], names=[*(f.name for f in old), *new.names])

    return texted.mapInArrow(run, StructType([*old, *new.fields]))


def grouped(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a partition that is sorted by ``keys``, one table each; only one group is held."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        found = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(1, len(found) + 1):
            if i < len(found) and found[i] == found[start]:
                continue
            if held and found[start] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = found[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield current, pa.Table.from_batches(held)


def blocks_for(count: Column, size: int) -> Column:
    """How many blocks of about ``size`` rows a group of ``count`` rows is cut into."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(size))).cast("int")


def hash_sample(rows: DataFrame, kind: str, per_kind: int) -> DataFrame:
    """doc_id, ``kind``, rank of at most ``per_kind`` documents of each kind (few kinds), those with the least hash of doc_id.

    An id counts once, however many rows repeat it; with several kinds it is of the least.  A share
    fixed by each kind's number of ids, four times what is wanted, passes first; so what meets for ranking is
    bounded however many rows and tasks there are.
    """
    ids = rows.groupBy(kind).agg(F.approx_count_distinct("doc_id").alias("n")).collect()
    shares = {r[0]: min(1.0, 4 * per_kind / max(1, r[1])) for r in ids}
    if not shares:
        return rows.select("doc_id", kind, F.lit(0).alias("rank"))
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col(kind)]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    passed = rows.where(place < share * (1 << 31)).groupBy("doc_id").agg(F.min(kind).alias(kind))
    ranked = passed.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(place, "doc_id")))
    return ranked.where(F.col("rank") <= per_kind)


def least_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per ``keys``: of the texts that share them, the one with the least digest."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.sha1(F.encode("text", "UTF-8"))).alias("text"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): node, component (its smallest node), for nodes with a link.

    Alternating large-star and small-star rounds: each round hangs every node on the smallest
    node it sees, minima are aggregated map-side and joined back, and the links of a round are
    written to the shared folder.  About log(longest path) rounds; nothing is collected but a
    count and a checksum of the links, which tell whether a round changed anything.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    edges, before = written_once(edges, "links"), None
    while True:
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = state
        both = edges.selectExpr("hi AS u", "lo AS v").unionAll(edges.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(root, "hi").select(
            F.inline(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        )
        edges = written_once(hung.where("hi <> lo").distinct(), "links")
