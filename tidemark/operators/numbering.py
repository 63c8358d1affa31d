"""Global numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def numbered(df: DataFrame, order: list[str], name: str = "row_no", parts: int | None = None) -> DataFrame:
    """df with its 1-based position in the total order of ``order``, nulls first.

    Rows are range-partitioned by the order; each partition numbers its own rows and is shifted by the count of those
    before it. Only one count per partition is summed up. The order should be total (end with a unique column): tied rows
    get neighbouring numbers in no fixed order. An empty table stays empty."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    inside = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")
