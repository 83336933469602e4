"""Joins by time that Spark has no operator for: as of a time, and within a range of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import window_start


def as_of(asked: DataFrame, known: DataFrame, by: list[str], at: str, t: str, span: int = 86400) -> DataFrame:
    """asked with the columns of known's last row of the same keys whose t is before at; null where there is none.

    known has one row for each key and t. Both are put in order within stretches of span seconds of a key, and
    what a stretch ends with is carried to the next ones, one row a stretch: a key of any length is many
    tasks' work. Rows with a null key or time find nothing.
    """
    kept = [c for c in known.columns if c not in by]
    side = [F.struct(*(F.col(c) for c in kept)).alias("__row"), F.lit(None).cast(_kind(asked)).alias("__asked")]
    left = known.select(*by, F.col(t).alias("__t"), F.lit(1).alias("__side"), *side)
    right = asked.select(*by, F.col(at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(_kind(known.select(*kept))).alias("__row"), F.struct(*asked.columns).alias("__asked"))
    both = left.unionByName(right).withColumn("__span", window_start(F.col("__t"), span))
    # At one time what is asked comes first, so that only what is before it is seen.
    inner = Window.partitionBy(*by, "__span").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("__found", F.last("__row", ignorenulls=True).over(inner))
    tops = both.groupBy(*by, "__span").agg(F.max_by("__row", F.when(F.col("__side") == 1, F.col("__t"))).alias("__top"))
    line = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "__span", F.last("__top", ignorenulls=True).over(line).alias("__carried"))
    out = both.filter("__side = 0").join(tops, [*by, "__span"], "left")
    found = F.coalesce("__found", "__carried")
    return out.select("__asked.*", *(found[c].alias(c) for c in kept))


def _kind(df: DataFrame) -> str:
    return df.schema.simpleString()


def in_range(asked: DataFrame, known: DataFrame, start: str, end: str, w: str, every: int) -> DataFrame:
    """asked beside each row of known whose w, a multiple of every, lies from start to before end.

    An equi-join on the multiples in the range, of which there are (end - start) / every.
    """
    first = window_start(F.col(start) + (every - 1), every)
    some = asked.filter(first < F.col(end)).withColumn("__w", F.explode(F.sequence(first, F.col(end) - 1, F.lit(every).cast("long"))))
    return some.join(known, F.col("__w") == F.col(w)).drop("__w")
