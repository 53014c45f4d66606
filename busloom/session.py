"""Session settings the operators rely on, and the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime re-planning does the size checks: small sides are broadcast only after
# their real size is known, hot shuffle partitions are split.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

_own_folders: dict[str, str] = {}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("busloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: this application's own, below ``spark.checkpoint.dir``.

    The folder is removed when the driver's JVM ends.  A cluster session must name
    ``spark.checkpoint.dir``, and it must be a place that every executor can reach (a mounted
    ``file:`` path is as good as an object store, so the scheme is not judged).  Only a session
    in one process (``local[...]``) falls back to a temporary folder of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError(
                    "spark.checkpoint.dir is not set: intermediates need a folder that the driver and all executors share"
                )
            base = tempfile.mkdtemp(prefix="busloom-")
        folder = f"{base.rstrip('/')}/busloom-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)  # a folder that isn't there yet can't be marked
        store.deleteOnExit(path)
        _own_folders[app] = folder
    return _own_folders[app]
