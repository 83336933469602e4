"""Quantiles from counts in buckets whose bounds grow by a fixed ratio.

A bucket is a row; merging sketches adds counts. A value read from a sketch is within the stream's accuracy
of the value of nearest rank.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import window_start
from tidemark.policy import Stream

#: The bucket of zero and of negative numbers, read as 0.
ZERO = -1_000_000


def gamma(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket(x: Column, accuracy: float) -> Column:
    x = x.cast("double")
    return F.when(x > 0, F.ceil(F.ln(x) / F.lit(math.log(gamma(accuracy)))).cast("long")).otherwise(F.lit(ZERO).cast("long"))


def value_of(b: Column, accuracy: float) -> Column:
    g = gamma(accuracy)
    return F.when(b == ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(g), b) / (g + 1))


def counts(events: DataFrame, by: list[str | Column], v: str, accuracy: float) -> DataFrame:
    return events.groupBy(*by, bucket(F.col(v), accuracy).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, by: list[str | Column]) -> DataFrame:
    return sketch.groupBy(*by, "b").agg(F.sum("n").alias("n"))


def windows(events: DataFrame, s: Stream, v: str) -> DataFrame:
    """(res, w, keys, b, n) for every rollup that keeps quantiles of v, each from the next finer that divides it."""
    made: dict[int, DataFrame] = {}
    for r in (r for r in s.rollups if v in r.quantiles):
        finer = max((f for f in made if r.res % f == 0), default=None)
        if finer is None:
            made[r.res] = counts(events, [window_start(F.col("ts"), r.res).alias("w"), *s.key_names], v, s.accuracy)
        else:
            made[r.res] = merge(made[finer].withColumn("w", window_start(F.col("w"), r.res)), ["w", *s.key_names])
    return reduce(DataFrame.unionByName, (df.select(F.lit(res).cast("long").alias("res"), "*") for res, df in made.items()))


def quantile(sketch: DataFrame, by: list[str], q: float, accuracy: float, name: str = "value") -> DataFrame:
    """The quantile of each group: the first bucket whose cumulative count reaches q of all. Without
    by there is one row, null if the sketch is empty."""
    part = Window.partitionBy(*by)
    cum = F.sum("n").over(part.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    reached = sketch.withColumns({"__cum": cum, "__all": F.sum("n").over(part)}).filter(F.col("__cum") >= F.lit(q) * F.col("__all"))
    return reached.groupBy(*by).agg(F.min("b").alias("b")).select(*by, value_of(F.col("b"), accuracy).alias(name))
