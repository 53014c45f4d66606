"""Tables that are published version by version: days are replaced, a pointer is switched last.

A published table is a folder:

* ``data/<version>/service_day=.../`` holds the days that a version wrote, and only those;
* ``manifests/<version>.json`` says for every day which version's files are current;
* ``CURRENT`` names the manifest that readers use, and is replaced in one step once all else is written.

So a reader sees one whole version or the one before, never files of an unfinished write, and a version costs as much as
the days it touches.  A writer that dies leaves files that no manifest names.  One writer at a time is
assumed.  The driver handles names only: one entry per service day.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DAY = "service_day"


class _Store:
    """Small files and names below a folder, through the file system that Spark uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """New content for ``name`` in one step: readers find the old or the new one."""
        draft = f"{name}.{uuid4().hex}"
        self.write(draft, text)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        how[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        context.rename(self.path(draft), self.path(name), how)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))] if self.fs.exists(self.path(name)) else []

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def manifest(spark: SparkSession, folder: str) -> dict:
    """The current manifest: ``version``, ``schema``, ``days`` (day to the version that holds it) and ``notes``; empty if there is none."""
    store = _Store(spark, folder)
    current = store.read("CURRENT")
    return json.loads(store.read(f"manifests/{current}.json")) if current else {"version": None, "schema": None, "days": {}, "notes": {}}


def read_published(spark: SparkSession, folder: str, days: Iterable[str] | None = None) -> DataFrame | None:
    """The current version, or some of its days; None if nothing is published yet.

    Only the folders of the days asked for are listed and read.
    """
    found = manifest(spark, folder)
    if found["schema"] is None:
        return None
    schema = StructType.fromJson(found["schema"])
    wanted = found["days"] if days is None else {d: found["days"][d] for d in sorted(set(days)) if d in found["days"]}
    if not wanted:
        return spark.createDataFrame([], schema)
    plain = StructType([f for f in schema.fields if f.name != DAY])
    # The day is read off the folder's name; the versions' folders differ, so they are no partition column for the reader.
    paths = [f"{folder}/data/{v}/{DAY}={d}" for d, v in sorted(wanted.items())]
    rows = spark.read.schema(plain).parquet(*paths)
    day = F.regexp_extract(F.col("_metadata.file_path"), rf"{DAY}=([0-9-]+)", 1).cast("date")
    return rows.withColumn(DAY, day).select(*schema.names)


def publish_days(rows: DataFrame, folder: str, days: Iterable[str] | None = None, notes: dict | None = None) -> dict:
    """Replace service days by ``rows`` and make that the current version; the new manifest.

    ``days`` names the days that are replaced: those of them without rows are empty from now on, and rows
    of others are an error.  Without it, the days of ``rows`` are.  ``service_day`` (a date, never null) is a column
    of ``rows``; other days stay as they are, without being read.
    """
    spark = rows.sparkSession
    store, before = _Store(spark, folder), manifest(spark, folder)
    version = f"{int((before['version'] or '0').split('-')[0]) + 1:06d}-{uuid4().hex[:8]}"
    known = F.when(F.col(DAY).isNotNull(), F.col(DAY)).otherwise(F.raise_error(F.lit("a row has no service day")).cast("date"))
    # A day's rows come together, so that it gets few files; a hot day is still several tasks' work.
    rows.withColumn(DAY, known).hint("rebalance", DAY).write.partitionBy(DAY).parquet(f"{folder}/data/{version}")
    written = {n.split("=", 1)[1] for n in store.names(f"data/{version}") if n.startswith(f"{DAY}=")}
    replaced = written if days is None else set(map(str, days))
    if written - replaced:
        raise ValueError(f"rows of days that are not to be replaced: {sorted(written - replaced)[:5]}")
    kept = {d: v for d, v in before["days"].items() if d not in replaced}
    now = {"version": version, "schema": json.loads(rows.schema.json()), "days": kept | dict.fromkeys(sorted(written), version), "notes": before["notes"] | (notes or {})}
    store.write(f"manifests/{version}.json", json.dumps(now))
    store.replace("CURRENT", version)
    return now


def drop_old_versions(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove files that neither the current manifest nor the ``keep`` - 1 before it name; what was removed.

    Readers of an older version, and a writer that is still at work, must have ended.
    """
    store, current = _Store(spark, folder), manifest(spark, folder)["version"]
    names = sorted(n.removesuffix(".json") for n in store.names("manifests") if n.endswith(".json"))
    live = [n for n in names if current is not None and n <= current][-keep:]
    used = {v for n in live for v in json.loads(store.read(f"manifests/{n}.json"))["days"].values()}
    gone = [v for v in store.names("data") if v not in used and v not in live]
    for v in gone:
        store.drop(f"data/{v}")
    for n in names:
        if n not in live:
            store.drop(f"manifests/{n}.json")
    return gone
