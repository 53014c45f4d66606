"""WARC archives of captures, and one globally ordered index of them by external merging.

*Writing.*  Captures with equal payloads of ``least_bytes`` or more are one response and revisits of
it.  Each task sorts its captures by URL key, time and id (Spark's spilling sort), writes them to gzip
archives in the shared folder, a member per record, and reports where each record lies.  Those
reports, kept as a table, are the sorted runs; they also say which archives count: what a failed
attempt has left is in no report.

*Index merge.*  The key space is cut into ranges of like size (the id is part of the key, so a hot
URL is cut too), slices of all runs meet per range, and a loser tree merges them: each step
replays one path of log2(k) comparisons.  Ranges are numbered on, which gives every capture its
place in the history of all captures.

*Reading* parses the archives record by record and works lengths and digests out anew.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once
from busloom.llm.common import pairs_of, to_batches
from busloom.session import shared_dir

LEAST_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
GZIP_LEVEL = 4
READ_BYTES = 1 << 20
ROWS_PER_RANGE = 50_000
READERS_PER_CORE = 4

RUNS = pa.schema([
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("run", pa.int32()), ("seq", pa.int64()),
    ("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
RUNS_DDL = "url_key string, captured string, page_id long, run int, seq long, archive string, start long, length long"
RECORDS = pa.schema([
    ("archive", pa.string()), ("start", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORDS_DDL = "archive string, start long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """Host parts in reverse, then the rest, in lower case: ``https://A.example.com/x`` becomes ``com,example,a)/x``."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.substr(rest, F.length(host) + 1))


def _headers(fields: Iterable[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join(x.replace("\r", "%0D").replace("\n", "%0A") for x in lines).encode() + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, captured: str, payload: bytes | None, size: int, digest: str, refers_to: int | None,
           first_url: str | None = None, first_captured: str | None = None) -> bytes:
    """One record: a response with the payload, or a revisit without it that names the response's page, URL and date."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if payload is None else http + payload
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"),
        ("WARC-Target-URI", url), ("WARC-Date", captured), ("Page-ID", page_id),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if payload is None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Target-URI", first_url), ("WARC-Refers-To-Date", first_captured), ("Refers-To-Page-ID", refers_to), ("Payload-Length", size)]
    return _headers([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload digest (hex), type and the page referred to, of one record.

    A response's length and digest are worked out from its payload and must be what its header says.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record is cut short")
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page = int(fields["Page-ID"]) if "Page-ID" in fields else None
    if fields["WARC-Type"] == "revisit":
        return page, int(fields["Payload-Length"]), stated, "revisit", int(fields["Refers-To-Page-ID"])
    payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"the payload of page {page} does not have its digest")
    return page, len(payload), digest, "response", None


def captures(pages: DataFrame, captured: Column, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, url_key, captured, payload (null for a revisit), size, digest, refers_to and the response's first_url, first_captured."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")).alias("captured"), payload.alias("payload")
    ).withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    copied = keyed.where(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.max(F.struct("page_id", "captured", "url")).alias("one"), F.count("*").alias("n")).where("n > 1")
    copied = copied.select(
        F.col("digest").alias("meets"), F.col("one.page_id").alias("first"), F.col("one.captured").alias("first_captured"), F.col("one.url").alias("first_url"))
    # Short payloads meet nothing, so they are spread instead of sharing a few digests.
    meets = F.when(F.col("size") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64("page_id", "url"))))
    known = keyed.withColumn("meets", meets).join(copied, "meets", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.select(
        "page_id", "url", url_key(F.col("url")).alias("url_key"), "captured",
        F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest",
        *(F.when(revisit, F.col(c)).alias(as_) for c, as_ in (("first", "refers_to"), ("first_url", "first_url"), ("first_captured", "first_captured"))))


def write_archives(found: DataFrame, folder: str) -> DataFrame:
    """Write captures to archives below ``folder``; the sorted runs, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        number = task.partitionId()

        def rows() -> Iterator[tuple]:
            stream, name, at, seq = None, "", 0, 0
            try:
                columns = ("url", "payload", "size", "digest", "refers_to", "first_url", "first_captured")
                for key, captured, page_id, *rest in pairs_of(batches, "url_key", "captured", "page_id", *columns):
                    if stream is None or at >= ARCHIVE_BYTES:
                        if stream is not None:
                            stream.close()
                        name, at = f"{number:06d}-{uuid4().hex}.warc.gz", 0
                        stream = store.open_output_stream(f"{root}/{name}", compression=None)
                    url, *rest = rest
                    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, captured, *rest)) + packer.flush()
                    stream.write(member)
                    yield key, captured, page_id, number, seq, name, at, len(member)
                    at, seq = at + len(member), seq + 1
            finally:
                if stream is not None:
                    stream.close()

        yield from to_batches(rows(), RUNS)

    order = found.sortWithinPartitions("url_key", "captured", F.col("page_id").asc_nulls_first())
    return written_once(order.mapInArrow(run, RUNS_DDL), "runs")


class LoserTree:
    """Merge of k sorted iterators: inner nodes hold the loser of their match, each step replays the winner's path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * len(runs)
        for i in range(len(runs)):
            self._enter(i)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _enter(self, i: int) -> None:
        """A run climbs until it meets an empty place; later runs play those that wait there."""
        node = (i + len(self.runs)) // 2
        while node:
            waiting = self.losers[node]
            if waiting < 0:
                self.losers[node] = i
                return
            if self._before(waiting, i):
                self.losers[node], i = i, waiting
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        while (head := self.heads[i := self.winner]) is not None:
            yield head
            self.heads[i] = next(self.runs[i], None)
            node = (i + len(self.runs)) // 2
            while node:
                if self._before(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merged_index(runs: DataFrame) -> DataFrame:
    """The captures of all runs with their place in the global order: ``position`` from 0, ``capture`` from 1 for each URL key."""
    ranges = max(1, -(-runs.count() // ROWS_PER_RANGE))
    schema = pa.schema([*RUNS, ("range", pa.int32()), ("place", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        slices: dict[int, list[tuple]] = {}
        for url, captured, page_id, run, *rest in pairs_of(batches, *RUNS.names):
            # A null id comes first, as in the runs; ids that are equal stay in the order of the runs.
            slices.setdefault(run, []).append(((url, captured, page_id is not None, page_id or 0), (run, *rest)))
        tree = LoserTree([((key, *rest) for key, rest in s) for s in slices.values()])
        rows = ((k[0], k[1], k[3] if k[2] else None, *rest, number, place) for place, (k, *rest) in enumerate(tree))
        yield from to_batches(rows, schema)

    key = ["url_key", "captured", F.col("page_id").asc_nulls_first()]
    cut = runs.repartitionByRange(ranges, *key, "run", "seq").sortWithinPartitions("run", "seq")
    placed = written_once(cut.mapInArrow(merge, RUNS_DDL + ", range int, place long"), "merged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    positioned = placed.join(offsets, "range").withColumn("position", F.col("offset") + F.col("place"))
    first = positioned.groupBy("url_key").agg(F.min("position").alias("_first"))
    return positioned.join(first, "url_key").select(
        "position", "url_key", (F.col("position") - F.col("_first") + 1).alias("capture"), "captured", "page_id", "archive", "start", "length")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives (column ``archive``): where it lies, page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)

        def rows() -> Iterator[tuple]:
            for (name,) in pairs_of(batches, "archive"):
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for start, data in members(stream):
                        yield name, start, *parse(data)

        yield from to_batches(rows(), RECORDS)

    return archives.mapInArrow(run, RECORDS_DDL)


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Start and content of each gzip member of a stream, one at a time."""
    start, held = 0, b""
    while held or (held := stream.read(READ_BYTES)):
        unpacker, parts, size = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not held and not (held := stream.read(READ_BYTES)):
                raise ValueError("the archive is cut short")
            parts.append(unpacker.decompress(held))
            size += len(held) - len(unpacker.unused_data)
            held = unpacker.unused_data
        yield start, b"".join(parts)
        start += size


def archive_pages(pages: DataFrame, captured: Column, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archive all pages, merge the index, read everything back.

    Input: page_id, url, html; ``captured`` is each capture's time.  Result, a row per row of
    ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to as read from the
    archives, and position, url_key, capture, captured, archive, start, length of the merged index.
    Null html is an empty payload, a null url has an empty key, a null time counts as 1970.  Rows
    that share the largest page_id of a group of copies (repeated rows) are all responses; a null page_id
    is below every other, and copies that all have none are all responses.  Other columns are
    ignored; an empty table gives no rows.  Archives are written while the frame is built, below the
    session's shared folder, and are removed with it.
    """
    folder = f"{shared_dir(pages.sparkSession)}/archives-{uuid4().hex}"
    path = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)
    runs = write_archives(captures(pages, captured, least_bytes), folder)
    index = merged_index(runs)
    archives = runs.select("archive").distinct()
    # A few short names that stand for much work: an explicit number of tasks, which runtime re-planning leaves as it is.
    readers = min(archives.count(), READERS_PER_CORE * pages.sparkSession.sparkContext.defaultParallelism)
    archives = archives.repartition(max(1, readers))
    # The planner takes the archives' few names for the size of what is read from them.
    read = read_archives(archives, folder).hint("merge")
    return index.drop("page_id").join(read, ["archive", "start"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        "position", "url_key", "capture", "captured", "archive", "start", "length")


def archive_sql() -> str:
    """What must come out for ``pages`` captured page_id seconds after a fixed moment, in DuckDB's SQL."""
    return f"""
WITH sized AS (
  SELECT page_id, COALESCE(html, '') AS payload, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest,
         lower(regexp_replace(COALESCE(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')) AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*', 0) AS host FROM sized),
keyed AS (
  SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || substr(rest, length(host) + 1) AS url_key,
         MAX(page_id) OVER (PARTITION BY payload) AS last FROM hosts)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> last THEN last END AS refers_to,
       url_key, ROW_NUMBER() OVER (PARTITION BY url_key ORDER BY page_id) AS capture,
       ROW_NUMBER() OVER (ORDER BY url_key, page_id) - 1 AS position
FROM keyed"""
