"""A global order without a single task: positions from a range-partitioned sort, and row windows over blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.session import durable

BLOCK = 50_000


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """`df` with the 0-based position of each row by `order` (a total order).

    Rows are range-partitioned, written, and numbered within their partition; partitions add the sizes of those
    before them. Only partition sizes are ordered in one task.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "ranged")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("pid").agg(F.count("*").alias("size")).select("pid", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("pid").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(sizes, "pid").withColumn(name, F.col("start") + F.col("inside")).drop("pid", "inside", "start")


def following(df: DataFrame, values: dict[str, tuple[str, int]], position: str = "position", block: int = BLOCK) -> DataFrame:
    """`df` with columns name -> (column, k): the column's value k rows later in the global order.

    Rows go to blocks of consecutive positions; the first rows of a block are also sent to the block before, so that
    lead() finds them there.
    """
    reach = max(k for _, k in values.values())
    own = df.withColumn("block", F.floor(F.col(position) / block)).withColumn("copy", F.lit(False))
    halo = own.where(F.col(position) % block < reach).withColumn("block", F.col("block") - 1).withColumn("copy", F.lit(True))
    w = Window.partitionBy("block").orderBy(position)
    led = own.union(halo).select("*", *[F.lead(c, k).over(w).alias(n) for n, (c, k) in values.items()])
    return led.where(~F.col("copy")).drop("block", "copy")
