"""Stage tables that many queries read: written once per session and state of the input."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from busloom.functions.reuse import written_once

_written: dict[tuple, DataFrame] = {}


def listing(spark: SparkSession, folder: str) -> tuple:
    """Path, size and time of every file below ``folder``: the state a stage was built from.

    A listing of names only; it grows with the number of input files, not with their rows.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def staged(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write the frame to the shared folder on first use; read it back while the input stays as it was."""

    @wraps(build)
    def read(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, build.__module__, build.__qualname__, folder, listing(spark, folder))
        if key not in _written:
            _written[key] = written_once(build(spark, folder), "stage")
        return _written[key]

    return read


def forget() -> None:
    """Build every stage anew on its next use."""
    _written.clear()
