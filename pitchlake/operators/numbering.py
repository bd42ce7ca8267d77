"""Numbers over a whole table without a task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """Rows numbered from ``first`` in ``order``, which must be total.

    Rows are dealt by range, counted by part (one row a part meets in a window) and numbered within their part. The dealt
    rows are kept, as their parts are read twice.
    """
    part = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.withColumn("_within", within).join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_before") + F.col("_within") + (first - 1)).drop("_part", "_within", "_before")
