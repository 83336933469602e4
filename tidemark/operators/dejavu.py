"""Incidents recognised again: which templates run faster or slower than usual, and what that looked like before."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["service", "level", "template"]


def _stands_out(df: DataFrame) -> DataFrame:
    score = F.ln((F.col("now_rate") + 2) / (F.col("usual_rate") + 2))
    return df.withColumn("score", score).filter((F.abs("score") >= math.log(3)) & (F.abs(F.col("now_rate") - F.col("usual_rate")) >= 6))


def _usual(hour: DataFrame, by: list[str]) -> DataFrame:
    """Median lines a minute of an hour: minutes without lines are zero, so ranks 30 and 31 of sixty decide."""
    ranked = hour.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"))))
    return ranked.groupBy(*by).agg((F.sum(F.when(F.col("__k").isin(30, 31), F.col("n")).otherwise(0)) / 2.0).alias("usual_rate"))


def fingerprint(minutes: DataFrame, now: int) -> DataFrame:
    """(service, level, template, now_rate, usual_rate, score) of minute windows (w, key, n) at now.

    A rising template is judged by the last minute or two, one going quiet by one minute more.
    """
    since = now // 60 * 60 - 60
    rows = minutes.filter("level <> 'DEBUG'")
    rate = lambda test, length: F.sum(F.when(test, F.col("n")).otherwise(0)) * 60.0 / length
    w: Column = F.col("w")
    current = rows.filter(w >= since - 60).groupBy(*KEY).agg(rate(w >= since, now + 1 - since).alias("fast"), rate(F.lit(True), now + 61 - since).alias("slow"))
    usual = _usual(rows.filter((w >= since - 3600) & (w < since)), KEY)
    both = current.join(usual, KEY, "full").fillna(0.0, ["fast", "slow", "usual_rate"])
    quiet = F.least(F.greatest("fast", "slow"), "usual_rate")
    return _stands_out(both.select(*KEY, F.when(F.col("fast") >= F.col("usual_rate"), F.col("fast")).otherwise(quiet).alias("now_rate"), "usual_rate"))


#: Incidents are judged by stretches of so many seconds, to which the hour before and the minute after are added.
STRETCH = 4 * 3600


def minute_of(started: Column) -> Column:
    return started - F.pmod(started, F.lit(60))


def minute_fingerprints(minutes: DataFrame, asked: DataFrame) -> DataFrame:
    """(since, service, level, template, now_rate, usual_rate, score) of each minute asked (since): two minutes from
    it on against the hour before.

    A window goes to its stretch and at times to the one after; there a frame over the hour gives what is usual.
    """
    stretch = lambda at: F.floor(at / STRETCH)
    w = F.col("w")
    rows = minutes.filter("level <> 'DEBUG'").select(F.explode(F.sequence(stretch(w - 119), stretch(w + 3600))).alias("__s"), *KEY, "w", F.col("n").cast("long").alias("n"), F.lit(False).alias("__asked"))
    asked = asked.select("since").distinct().withColumn("__s", stretch(F.col("since")))
    judged = rows.select("__s", *KEY).distinct().join(asked, "__s").select("__s", *KEY, F.col("since").alias("w"), F.lit(None).cast("long").alias("n"), F.lit(True).alias("__asked"))
    line = Window.partitionBy("__s", *KEY).orderBy("w")
    # Minutes without lines are zero, so ranks 30 and 31 of sixty decide.
    hour = F.sort_array(F.collect_list("n").over(line.rangeBetween(-3600, -1)), False)
    df = rows.union(judged).withColumns({"__now": F.sum("n").over(line.rangeBetween(0, 119)), "__hour": hour}).filter("__asked")
    rank = lambda k: F.coalesce(F.get("__hour", F.lit(k - 1)), F.lit(0))
    return _stands_out(df.select(F.col("w").alias("since"), *KEY, (F.coalesce("__now", F.lit(0)) / 2.0).alias("now_rate"), ((rank(30) + rank(31)) / 2.0).alias("usual_rate")))


def incident_fingerprints(minutes: DataFrame, incidents: DataFrame) -> DataFrame:
    """The first two minutes of incidents (id, started) against the hour before.

    Incidents of one minute have one fingerprint, which is found once. The join is never a broadcast: both sides grow.
    """
    i = incidents.select(F.col("id").alias("incident"), minute_of(F.col("started")).alias("since"))
    return i.join(minute_fingerprints(minutes, i).hint("merge"), "since").drop("since")


def save(prints: DataFrame, incidents: DataFrame, lines: DataFrame) -> DataFrame:
    """prints with example: the newest line of each template during its incident (an hour where it has no end)."""
    i = incidents.select(F.col("id").alias("incident"), minute_of(F.col("started")).alias("since"), F.coalesce("ended", F.col("started") + 3600).alias("until"))
    wanted = prints.join(i, "incident")
    newest = wanted.join(lines.select(*KEY, "ts", "seq", "line"), KEY).filter("ts >= since AND ts < until").groupBy("incident", *KEY).agg(F.max_by("line", F.struct("ts", "seq")).alias("example"))
    return prints.join(newest, ["incident", *KEY], "left")


def deja_vu(now: DataFrame, saved: DataFrame) -> DataFrame:
    """(incident, similarity, shared, keys): cosine of the fingerprint of now with each saved one."""
    norm = now.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm")).filter("norm > 0")  # one row
    kept = saved.groupBy("incident").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("own"), F.count(F.lit(1)).alias("keys"))
    both = now.select(*KEY, F.col("score").alias("s")).join(saved, KEY).groupBy("incident").agg(F.sum(F.col("s") * F.col("score")).alias("dot"), F.count(F.lit(1)).alias("shared"))
    out = kept.join(both, "incident", "left").crossJoin(F.broadcast(norm))
    return out.select("incident", (F.coalesce("dot", F.lit(0.0)) / (F.col("norm") * F.col("own"))).alias("similarity"), F.coalesce("shared", F.lit(0)).alias("shared"), "keys")
