"""File sources and sinks, profiles and fingerprints of tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from busloom.functions.columns import count_if


def read_dataset(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV (with header) or Parquet, by suffix."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.rstrip("/").endswith(".csv"):
        return reader.option("header", True).csv(path)
    if path.rstrip("/").endswith(".parquet"):
        return reader.parquet(path)
    raise ValueError(f"neither .csv nor .parquet: {path}")


def read_if_present(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The dataset, or an empty frame of the schema when the path does not exist."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return read_dataset(spark, path, schema) if there else spark.createDataFrame([], schema)


def write_series(series: DataFrame, path: str) -> None:
    """One folder per route and bin width; readers prune on both.

    Rows are gathered by folder and month first, so that a folder gets few, even files.
    """
    month = F.date_format("timestamp", "yyyy-MM")
    (series.repartition("route_id", "gran_min", month).write.mode("overwrite")
     .partitionBy("route_id", "gran_min").parquet(path))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_named_files(spark: SparkSession, glob: str, pattern: str, names: dict[str, str]) -> DataFrame:
    """Parquet files whose path tells some columns: ``names`` maps a column to its type,
    in the order of the pattern's groups."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(glob)
    path = F.col("_metadata.file_path")
    return rows.select("*", *[
        F.regexp_extract(path, pattern, i).cast(t).alias(n) for i, (n, t) in enumerate(names.items(), start=1)])


def write_snapshot(df: DataFrame, folder: str, name: str, stamp: str, *, csv: bool = True) -> dict[str, str]:
    """The latest version under a stable name plus a frozen copy under ``stamp``.

    The copy is made from the written table, so the plan runs once.
    """
    paths = {"latest": f"{folder}/{name}.parquet", "frozen": f"{folder}/snapshot={stamp}/{name}.parquet"}
    df.write.mode("overwrite").parquet(paths["latest"])
    written = df.sparkSession.read.schema(df.schema).parquet(paths["latest"])
    written.write.mode("overwrite").parquet(paths["frozen"])
    if csv:
        paths["csv"] = f"{folder}/snapshot={stamp}/{name}.csv"
        written.write.mode("overwrite").option("header", True).csv(paths["csv"])
    return paths


def write_quality_split(flagged: DataFrame, folder: str) -> dict[str, str]:
    """All flagged trips in one table partitioned by the hard verdict.

    Readers of the passing or excluded part prune to their partition.
    """
    path = f"{folder}/trips_qc.parquet"
    flagged.write.mode("overwrite").partitionBy("qc_hard_fail").parquet(path)
    return {"all": path, "pass": f"{path}/qc_hard_fail=false", "excluded": f"{path}/qc_hard_fail=true"}


def profile(df: DataFrame, value: str, enum: str) -> DataFrame:
    """(item, value) rows: size, counts per enumeration value."""
    size = df.agg(F.count(F.lit(1)).alias("n"), count_if(F.col(value).isNull()).alias("nulls"))
    head = size.select(F.inline(F.array(
        F.struct(F.lit("rows").alias("item"), F.col("n").alias("value")),
        F.struct(F.lit("columns").alias("item"), F.lit(len(df.columns)).cast("long").alias("value")),
        F.struct(F.lit(f"{value}_missing").alias("item"), F.col("nulls").alias("value")))))
    counts = df.groupBy(enum).agg(F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit(f"{enum}="), F.coalesce(F.col(enum).cast("string"), F.lit("null"))).alias("item"), "value")
    return head.unionByName(counts)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a checksum of the content that does not depend on row order.

    The sum of 60 bits of each row's MD5, over a text that any engine can form: columns parted
    by ``|``, nulls as a backslash and N, times as microseconds, fractions with ten digits.
    """
    def text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("float", "double") or kind.startswith("decimal"):
            c = F.format_string("%.9e", c.cast("double"))
        elif kind.startswith("timestamp"):
            c = F.unix_micros(c.cast("timestamp"))
        return F.when(F.col(f"`{name}`").isNull(), "\\N").otherwise(c.cast("string"))

    row = F.concat_ws("|", *[text(n, t) for n, t in df.dtypes])
    bits = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("checksum"))


def identical_columns(df: DataFrame, key: str) -> DataFrame:
    """Pairs of columns with the same content in every row.

    One pass makes a checksum per column; columns of one type with equal checksums are
    then compared row by row in a second pass.
    """
    types = {n: t for n, t in df.dtypes if n != key}
    sums = df.agg(*[F.sum(F.xxhash64(key, n).cast("decimal(38,0)")).alias(n) for n in types]).first()
    pairs = [(a, b) for a, b in combinations(types, 2) if types[a] == types[b] and sums[a] == sums[b]]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "column_a string, column_b string")
    row = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias("same"))
        for i, (a, b) in enumerate(pairs)]))).filter("same").drop("same")


