"""Numbers in a global order, without one task that sees every row."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.state import shared_folder


def numbered(df: DataFrame, name: str, *order: str | Column, after: int = 0) -> DataFrame:
    """df with name: after + 1, after + 2, ... in the given order, which must tell all rows apart.

    Rows are dealt by ranges of the order and written, numbered within their range, and moved up by the sizes
    of the ranges before: one number a range, the only rows that meet in one task.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    # Written, since another evaluation might cut the ranges elsewhere.
    dealt = df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    line = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(line), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = dealt.withColumn("__own", own).join(F.broadcast(sizes), "__part")  # as many rows as ranges
    return out.withColumn(name, (F.col("__before") + F.col("__own") + after).cast("long")).drop("__part", "__own", "__before")
