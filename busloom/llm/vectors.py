"""What the two vector operators share: which vectors take part, one row per distinct vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matrix(batch: pa.RecordBatch | pa.Table, name: str = "vec", scaled: bool = False) -> np.ndarray:
    """A column of equally long lists as rows of doubles.

    ``scaled``: each row times a power of two, so that its largest part is below 1 and squares neither
    overflow nor vanish; cosines stay what they are, to the last digit.
    """
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0))[1][:, None]) if scaled else rows


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec: one row per id with a usable vector.

    Null, empty and zero vectors, those with null or non-finite parts, and null ids take no part.  An id that is
    repeated with different vectors has the least of them.
    """
    finite = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).where(
        "vec_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0"
        " AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)")
    return finite.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def by_length(found: DataFrame) -> list[DataFrame]:
    """Usable vectors apart by their length: only equally long ones can be compared.  One number per length reaches the driver."""
    lengths = sorted(r[0] for r in found.select(F.size("vec")).distinct().collect())
    return [found.where(F.size("vec") == n) for n in lengths] if len(lengths) > 1 else [found] * len(lengths)


def distinct_vectors(found: DataFrame, most_ids: int) -> DataFrame:
    """cls (its smallest id), vec, ids (the ``most_ids`` smallest, ascending), copies: one row per distinct vector.

    The ids beyond are counted, not carried, so a vector with any number of copies is one short row.
    """
    counts = found.groupBy("vec").agg(F.count("*").alias("copies"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("n") <= most_ids)
    lists = first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return lists.join(counts, "vec").select(F.col("ids")[0].alias("cls"), "vec", "ids", "copies")
