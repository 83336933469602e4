"""Streams over the tables at hand: which columns of which table are the events of a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.policy import parse

LATENCY = parse("""
stream latency {
  key endpoint text
  value ms real
  raw keep 5d
  rollup 10m keep 7d
  rollup 1h keep 30d quantiles ms
  rollup 1d keep forever quantiles ms
  samples 3 per 1h
  anomalies ms log z > 3 memory 300 warmup 50 keep 2 per 1h
}
precompute requests = count(latency) by endpoint
precompute avg_ms = avg(latency.ms) by endpoint
precompute p50_ms = p50(latency.ms) by endpoint
precompute p95_ms = p95(latency.ms) by endpoint
precompute p99_ms = p99(latency.ms) by endpoint
precompute p999_ms = p999(latency.ms)
precompute requests_hour = count(latency) by endpoint per hour
precompute sum_day = sum(latency.ms) by endpoint per day
precompute max_month = max(latency.ms) per month
precompute requests_total = count(latency)
""")

STEPS = parse("""
stream latency {
  key endpoint text
  value ms real
  rollup 1h keep forever
  anomalies ms log change z > 3 memory 200 warmup 40 keep 5 per 1h
}
""")

LEVEL = parse("""
stream latency {
  key endpoint text
  value ms real
  rollup 1h keep forever
  anomalies ms z > 2.5 memory 200 warmup 40 keep 5 per 1h
}
""")

DEALS = parse("""
stream deals {
  key paper text
  value rate real
  value lots integer
  derive worth = lots * rate
  rollup 1w keep forever
  rollup 1d keep 400d
}
precompute newest_rate = last(deals.rate) by paper
precompute opening = first(deals.rate) by paper per day
precompute highest = max(deals.rate) by paper per day
precompute lowest = min(deals.rate) by paper per day
precompute lots_day = sum(deals.lots) by paper per day
precompute worth_day = sum(deals.worth) by paper per day
precompute deals_day = count(deals) by paper per day
""")

METER = parse("""
stream meter exact {
  key account integer
  key tariff text
  id ticket refuse repeats 7d
  value units_in integer
  value units_out integer
  derive units = units_out + units_in
  period day close 6h
  late 48h
  ahead 10m
  rollup 1h keep 400d
  raw until closed + 10d
}
precompute units_day = sum(meter.units) by account per day
precompute tickets_day = count(meter) by account, tariff per day
precompute in_day = sum(meter.units_in) by account, tariff per day
precompute out_day = sum(meter.units_out) by account, tariff per day
quota daily_units = units_day
""")

#: The machine's clock of the meter scenario: the end of 2024-01-30, so that what is ahead is the same each run.
WALL = 1706659200


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def latency(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("endpoint"), F.col("value").alias("ms"))


LATENCY_SQL = "SELECT event_id AS seq, floor(epoch(ts))::BIGINT AS ts, event_type AS endpoint, value AS ms FROM events"


def deals(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    seq = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")
    return x.select(seq.alias("seq"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.concat("l_returnflag", "l_linestatus").alias("paper"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"), F.col("l_quantity").cast("long").alias("lots"), F.col("l_partkey"), F.col("l_suppkey"))


def meter(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th event repeats the identifier of the one 40 before it, every 97th is 30 hours late, every
    250th five days, and every 400th is stamped beyond the clock."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    ts = F.unix_timestamp(F.col("ts").cast("timestamp"))
    ts = F.when(i % 400 == 399, F.lit(WALL + 86400) + i).when(i % 250 == 249, ts - 432000).when(i % 97 == 96, ts - 108000).otherwise(ts)
    rid = F.concat(F.lit("r"), F.when(i % 50 == 49, i - 40).otherwise(i))
    units = F.floor(F.abs("value") * 10).cast("long")
    return e.select(i.alias("seq"), ts.alias("ts"), rid.alias("ticket"), (F.col("user_id") % 20).alias("account"), F.col("event_type").alias("tariff"), units.alias("units_in"), (units % 7).alias("units_out"))


METER_SQL = f"""
SELECT event_id AS seq,
  CASE WHEN event_id % 400 = 399 THEN {WALL} + 86400 + event_id WHEN event_id % 250 = 249 THEN floor(epoch(ts))::BIGINT - 432000
    WHEN event_id % 97 = 96 THEN floor(epoch(ts))::BIGINT - 108000 ELSE floor(epoch(ts))::BIGINT END AS ts,
  'r' || (CASE WHEN event_id % 50 = 49 THEN event_id - 40 ELSE event_id END) AS ticket,
  user_id % 20 AS account, event_type AS tariff, floor(abs(value) * 10)::BIGINT AS units_in, floor(abs(value) * 10)::BIGINT % 7 AS units_out
FROM events"""
