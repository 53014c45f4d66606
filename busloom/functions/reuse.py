"""Intermediates that are read more than once."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame

from busloom.session import shared_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_once(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    For a frame that several branches need: it is worked out once, later stages see a
    plain scan with column pruning, and a lost executor costs no recomputation.  The write
    happens in this call; queries that use it run jobs while they are built.  The write's own
    shuffle files are of no more use once it has ended, so Spark removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
