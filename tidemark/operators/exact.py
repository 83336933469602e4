"""Exact streams: which events are refused, and why.

An event is judged by the newest event that was accepted before it, over the whole stream. That order is
found as a fixpoint: from labels follow the running maximum and the identifiers seen, and from those the
labels; every round puts at least the first wrong label right, and few rounds are needed since what is
refused as late or closed never was the newest. The running maximum is taken within ranges of arrival and
carried from range to range, one number each, so no task sees the whole stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.times import period_end
from tidemark.policy import Stream
from tidemark.state import remove, shared_folder

#: Each round puts at least the first wrong label right, and in practice all but what hangs on it; a stream on
#: which so many did not do is an error, not a guess.
ROUNDS = 50


def _newest_before(df: DataFrame, clock: int | None) -> DataFrame:
    """df with newest: the largest ts accepted before each row, from clock on."""
    part = Window.partitionBy("__part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    accepted = F.when(F.col("label").isNull(), F.col("ts"))
    tops = df.groupBy("__part").agg(F.max(accepted).alias("__top"))  # one row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__part", F.max("__top").over(before).alias("__carry"))
    # As many rows as there are partitions.
    df = df.withColumn("__in", F.max(accepted).over(part)).join(F.broadcast(tops), "__part")
    return df.withColumn("newest", F.greatest("__in", "__carry", F.lit(clock).cast("long"))).drop("__in", "__carry")


def _marked(df: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    """df, written and read again, and a mark of its labels, taken while it is written."""
    seen = Observation()
    df.observe(seen, F.count("label").alias("n"), F.sum(F.xxhash64("seq", "label").cast("decimal(38,0)")).alias("h")).write.parquet(path)
    got = seen.get
    return df.sparkSession.read.schema(df.schema).parquet(path), (got["n"], got["h"])


def label(events: DataFrame, s: Stream, *, wall: int | None = None, clock: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """events with label: null if accepted, else ahead, late, closed or repeat, tried in that order.

    wall is the counting machine's clock (without it no event is ahead), clock the newest event accepted
    before these, and seen the identifiers that were counted before. seq is unique. Rounds work on (seq, ts,
    label) alone; only events that share an identifier carry it, and all others are joined at the end.
    """
    spark = events.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    ahead = (F.col("ts") > wall + s.ahead) if s.ahead and wall is not None else F.lit(False)
    df = events.select("seq", "ts", *([F.col(s.id.name).alias("__id")] if s.id else []))
    if s.id:
        if seen is not None:
            known = seen.select(F.col(s.id.name).alias("__id"), F.lit(True).alias("__known")).distinct()
            df = df.join(known, "__id", "left")
        else:
            df = df.withColumn("__known", F.lit(None).cast("boolean"))
        shared = F.count(F.lit(1)).over(Window.partitionBy("__id")) > 1
        df = df.withColumn("__id", F.when(shared, F.col("__id")))
    df = df.repartitionByRange(n, "seq").withColumn("__part", F.spark_partition_id()).withColumn("label", F.when(ahead, "ahead"))
    df, before = _marked(df, f"{folder}/0")
    for k in range(1, ROUNDS):
        stood = _newest_before(df, clock)
        repeat = F.lit(False)
        if s.id:
            # The first accepted one of each shared identifier; the rows without one need no join.
            first = df.filter("__id IS NOT NULL AND label IS NULL").groupBy("__id").agg(F.min("seq").alias("__first"))
            twins = stood.filter("__id IS NOT NULL").join(first, "__id", "left")
            stood = stood.filter("__id IS NULL").withColumn("__first", F.lit(None).cast("long")).unionByName(twins)
            repeat = F.col("__known").isNotNull() | F.coalesce(F.col("__first") < F.col("seq"), F.lit(False))
        now = F.when(ahead, "ahead")
        if s.late:
            now = now.when(F.col("ts") < F.col("newest") - s.late, "late")
        now = now.when(F.col("newest") >= period_end(F.col("ts"), s.period) + s.close, "closed").when(repeat, "repeat")
        df, marks = _marked(stood.withColumn("label", now).select(df.columns), f"{folder}/{k}")
        remove(spark, f"{folder}/{k - 1}")
        if marks == before:
            return events.join(df.select("seq", "label"), "seq").select(*events.columns, "label")
        before = marks
    raise RuntimeError("refusals did not settle")


def refused(labelled: DataFrame, s: Stream) -> DataFrame:
    """(reason, keys, n)."""
    return labelled.filter("label IS NOT NULL").groupBy(F.col("label").alias("reason"), *s.key_names).agg(F.count(F.lit(1)).alias("n"))


def accepted(labelled: DataFrame) -> DataFrame:
    return labelled.filter("label IS NULL").drop("label", "newest")


def ids(labelled: DataFrame, s: Stream) -> DataFrame:
    """Identifiers counted, with the time that they expire by."""
    return accepted(labelled).select(s.id.name, "ts")


def expired(ids: DataFrame, s: Stream, now: Column | int) -> DataFrame:
    """Identifiers that are still remembered at now."""
    return ids.filter(F.col("ts") >= F.lit(now) - s.repeats)
