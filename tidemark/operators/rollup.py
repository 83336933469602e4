"""Window summaries at several resolutions, and their merge.

The finest rollup aggregates the events; the coarser ones that it divides merge its windows, so an event is
read and aggregated once however many rollups there are. All buffers are numbers, so that Spark
keeps to hash aggregation with a partial step before the shuffle: first and last order by (ts, seq)
as one decimal. ``first_seq`` and ``last_seq`` are kept beside first_ts and last_ts so that ties still
go by arrival after a merge.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import window_start
from tidemark.policy import Stream


def place(ts: str, seq: str) -> Column:
    """(ts, seq) as one ordered number."""
    return F.col(ts).cast("decimal(18,0)") * F.lit(Decimal(10**19)) + F.col(seq).cast("decimal(20,0)")


def summarize(df: DataFrame, by: list[str | Column], numbers: list[str], an: Column | None = None) -> DataFrame:
    """One row a group with all that is kept of a group of events."""
    whole = {c for c, t in df.dtypes if t == "bigint"}
    at = place("ts", "seq")
    aggs = [F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(an if an is not None else F.lit(0)).cast("long").alias("an")]
    aggs += [F.min_by("seq", at).alias("first_seq"), F.max_by("seq", at).alias("last_seq")]
    for v in numbers:
        # Whole numbers are added as whole numbers; answers are reals.
        total = F.sum(F.col(v)) if v in whole else F.sum(F.col(v).cast("double"))
        x = F.col(v).cast("double")
        aggs += [total.cast("double").alias(f"{v}_sum"), F.sum(x * x).alias(f"{v}_sumsq"), F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max")]
        aggs += [F.min_by(x, at).alias(f"{v}_first"), F.max_by(x, at).alias(f"{v}_last")]
    return df.groupBy(*by).agg(*aggs)


def merge(df: DataFrame, by: list[str | Column], numbers: list[str]) -> DataFrame:
    """Summaries of the same group into one, by the rules that made them."""
    first, last = place("first_ts", "first_seq"), place("last_ts", "last_seq")
    aggs = [F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("an").alias("an")]
    aggs += [F.min_by("first_seq", first).alias("first_seq"), F.max_by("last_seq", last).alias("last_seq")]
    for v in numbers:
        aggs += [F.sum(f"{v}_sum").alias(f"{v}_sum"), F.sum(f"{v}_sumsq").alias(f"{v}_sumsq"), F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max")]
        aggs += [F.min_by(f"{v}_first", first).alias(f"{v}_first"), F.max_by(f"{v}_last", last).alias(f"{v}_last")]
    return df.groupBy(*by).agg(*aggs)


def windows(events: DataFrame, s: Stream, an: Column | None = None) -> DataFrame:
    """(res, w, keys, n, first_ts, last_ts, an, ...) for every rollup of the stream.

    Events are read once for each rollup that no finer one divides (mostly the finest alone); its windows are
    then dealt to all lengths that it divides, and merged in one further step.
    """
    made, left = [], sorted({r.res for r in s.rollups})
    while left:
        own = [r for r in left if r % left[0] == 0]
        fine = summarize(events, [window_start(F.col("ts"), own[0]).alias("w"), *s.key_names], s.numbers, an)
        if len(own) > 1:
            fine = fine.withColumn("res", F.explode(F.array(*(F.lit(r).cast("long") for r in own))))
            fine = fine.withColumn("w", F.col("w") - F.pmod("w", "res"))
            fine = merge(fine, ["res", "w", *s.key_names], s.numbers)
        made.append(fine.select(F.lit(own[0]).cast("long").alias("res") if len(own) == 1 else "res", *(c for c in fine.columns if c != "res")))
        left = [r for r in left if r not in own]
    return reduce(DataFrame.unionByName, made)


def coarser(df: DataFrame, every: int, by: list[str], numbers: list[str]) -> DataFrame:
    """Windows merged to windows of every seconds, and to the keys by."""
    return merge(df.withColumn("w", window_start(F.col("w"), every)), ["w", *by], numbers)


def deviation(v: str) -> Column:
    """Standard deviation of the population, from a summary."""
    mean = F.col(f"{v}_sum") / F.col("n")
    return F.sqrt(F.greatest(F.lit(0.0), F.col(f"{v}_sumsq") / F.col("n") - mean * mean))
