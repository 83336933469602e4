"""Whole events kept from each window, chosen by arithmetic on their arrival number within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import window_start
from tidemark.policy import Stream


def samples(events: DataFrame, s: Stream, before: DataFrame | None = None) -> DataFrame:
    """(res, w, keys, slot, event): of a window's events those chosen, the later ones in their slots.

    before is (w, keys, n): events that the windows had already. Event n (from 1) is chosen if n <= N or (n * 2654435761 + 97) mod 2**32 mod n < N; its slot is n - 1, or
    (n * 1103515245 + 12345) mod 2**31 mod N.
    """
    size, per = s.samples.n, s.samples.per
    w = window_start(F.col("ts"), per)
    df = events.withColumn("w", w).withColumn("__n", F.row_number().over(Window.partitionBy("w", *s.key_names).orderBy("seq")).cast("long"))
    if before is not None:
        had = before.select("w", *s.key_names, F.col("n").alias("__had"))
        df = df.join(had, ["w", *s.key_names], "left").withColumn("__n", F.col("__n") + F.coalesce("__had", F.lit(0))).drop("__had")
    n = F.col("__n")
    df = df.filter((n <= size) | ((n * F.lit(2654435761) + 97) % F.lit(4294967296) % n < size))
    slot = F.when(n <= size, n - 1).otherwise((n * F.lit(1103515245) + 12345) % F.lit(2147483648) % size)
    rest = [c for c in events.columns if c not in s.key_names]
    df = df.groupBy("w", *s.key_names, slot.alias("slot")).agg(F.max_by(F.struct(*rest), "__n").alias("__e"))
    return df.select(F.lit(per).cast("long").alias("res"), "w", *s.key_names, "slot", "__e.*")
