"""Unusual events against a running baseline of their own key.

The baseline is a fold in order of arrival that no aggregate expresses. Events are dealt by key, sorted by
(key, seq), and folded in one pass over each partition that holds one key's state at a time, so memory does
not grow with a key's history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import window_start
from tidemark.policy import Anomalies, Stream

#: An event moves the baseline by so many standard deviations at most.
CLIP = 1.5


def huber() -> float:
    """Share of the variance that is left of a normal variable cut off at CLIP."""
    density = math.exp(-CLIP * CLIP / 2) / math.sqrt(2 * math.pi)
    tail = math.erfc(CLIP / math.sqrt(2)) / 2
    return 1 - 2 * tail - 2 * CLIP * density + 2 * CLIP * CLIP * tail


HUBER = huber()


class Baseline:
    """Mean and variance of one key, and what it makes of the next event."""

    __slots__ = ("rule", "n", "m", "var", "prev")

    def __init__(self, rule: Anomalies, n: int = 0, m: float = 0.0, var: float = 0.0, prev: float | None = None):
        self.rule, self.n, self.m, self.var, self.prev = rule, n, m, var, prev

    def see(self, value: float) -> tuple[bool, float | None]:
        """Is it unusual, and by how many standard deviations (None if there is no deviation)?"""
        r = self.rule
        if r.log:
            if value <= 0:
                return False, None
            value = math.log(value)
        if r.change:
            before, self.prev = self.prev, value
            if before is None:
                return False, None
            value -= before
        d = value - self.m
        if self.n >= r.warmup and d * d > r.z * r.z * self.var:
            return True, d / math.sqrt(self.var) if self.var > 0 else None
        if self.n < r.warmup:
            m = self.m + d / (self.n + 1) if self.n else value
            self.var = (self.n * self.var + d * (value - m)) / (self.n + 1) if self.n else 0.0
            self.m = m
        else:
            a, most = 1 / r.memory, CLIP * math.sqrt(self.var)
            step = min(max(d, -most), most)
            self.m += a * step
            self.var = (1 - a) * (self.var + a * step * step / HUBER)
        self.n += 1
        return False, None


def judge(events: DataFrame, s: Stream, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events with unusual and z, baselines with keys, n, m, var, prev).

    state is the baselines before these events. Only keys, the value and seq pass through the fold, which holds
    one baseline at a time but sees a key's values one after the other: one key is one task's work. What is
    unusual, few by its nature, comes back to the events by seq, which is unique.
    """
    rule, keys = s.anomalies, s.key_names
    base = events.select("seq", *keys, rule.field).withColumns({"__old": F.lit(1), "__n": F.lit(0).cast("long"), "__m": F.lit(0.0), "__var": F.lit(0.0), "__prev": F.lit(None).cast("double")})
    if state is not None:
        seeds = state.select(*keys, F.lit(0).alias("__old"), F.col("n").alias("__n"), F.col("m").alias("__m"), F.col("var").alias("__var"), F.col("prev").alias("__prev"))
        base = base.unionByName(seeds, allowMissingColumns=True)
    base = base.withColumn("__key", F.struct(*keys) if keys else F.struct(F.lit(1)))
    base = base.withColumn("__key", F.to_json("__key")).repartition("__key").sortWithinPartitions("__key", "__old", "seq")
    columns = base.columns
    out = base.withColumns({"unusual": F.lit(False), "z": F.lit(0.0)})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])  # nothing but keys is known not to be null

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, b = None, Baseline(rule)
        for batch in batches:
            get = {c: batch.column(c).to_pylist() for c in ("__key", "__old", "__n", "__m", "__var", "__prev", rule.field)}
            flags, zs, ns, ms, vs, ps = [], [], [], [], [], []
            for k, old, n, m, var, prev, x in zip(*get.values()):
                if k != key:
                    key, b = k, Baseline(rule)
                flag, z = False, None
                if old:
                    flag, z = b.see(float(x))
                else:
                    b = Baseline(rule, n, m, var, prev)
                flags.append(flag)
                zs.append(z)
                ns.append(b.n)
                ms.append(b.m)
                vs.append(b.var)
                ps.append(b.prev)
            columns_out = {"__n": pa.array(ns, pa.int64()), "__m": pa.array(ms, pa.float64()), "__var": pa.array(vs, pa.float64()), "__prev": pa.array(ps, pa.float64())}
            arrays = [columns_out[c] if c in columns_out else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(flags, pa.bool_()), pa.array(zs, pa.float64())], names=[*columns, "unusual", "z"])

    judged = base.mapInArrow(run, schema)
    flags = judged.filter("__old = 1 AND unusual").select("seq", "unusual", "z")
    kept = events.join(flags, "seq", "left").select(*events.columns, F.coalesce("unusual", F.lit(False)).alias("unusual"), "z")
    place = F.when(F.col("__old") == 0, F.lit(-1)).otherwise(F.col("seq"))
    last = judged.groupBy(*keys).agg(F.max_by(F.struct(F.col("__n").alias("n"), F.col("__m").alias("m"), F.col("__var").alias("var"), F.col("__prev").alias("prev")), place).alias("__b")).select(*keys, "__b.*")
    return kept, last


def kept_whole(judged: DataFrame, s: Stream, before: DataFrame | None = None) -> DataFrame:
    """The unusual events that are kept: the first so many of each key and window of the rule.

    before is (w, keys, an): unusual events that the windows had already.
    """
    rule, keys = s.anomalies, s.key_names
    df = judged.filter("unusual").withColumn("__w", window_start(F.col("ts"), rule.per))
    df = df.withColumn("__k", F.row_number().over(Window.partitionBy("__w", *keys).orderBy("seq")))
    if before is not None:
        had = before.select(F.col("w").alias("__w"), *keys, F.col("an").alias("__had"))
        df = df.join(had, ["__w", *keys], "left").withColumn("__k", F.col("__k") + F.coalesce("__had", F.lit(0))).drop("__had")
    return df.filter(F.col("__k") <= rule.keep).drop("__w", "__k", "unusual")
