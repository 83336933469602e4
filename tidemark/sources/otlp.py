"""OpenTelemetry logs and metrics in their JSON encoding: records, points, and deltas of cumulative series."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.events import TYPES
from tidemark.policy import Stream
from tidemark.sources import loglines

_VALUE = "struct<stringValue:string,boolValue:string,intValue:string,doubleValue:double,arrayValue:string,kvlistValue:string>"
_ATTR = f"array<struct<key:string,value:{_VALUE}>>"
_NUMBER = f"array<struct<timeUnixNano:string,startTimeUnixNano:string,asDouble:double,asInt:string,attributes:{_ATTR}>>"
_HISTOGRAM = f"array<struct<timeUnixNano:string,startTimeUnixNano:string,count:string,sum:double,min:double,max:double,attributes:{_ATTR}>>"
_METRIC = f"struct<name:string,gauge:struct<dataPoints:{_NUMBER}>,sum:struct<aggregationTemporality:int,isMonotonic:boolean,dataPoints:{_NUMBER}>,histogram:struct<aggregationTemporality:int,dataPoints:{_HISTOGRAM}>,summary:struct<dataPoints:array<string>>,exponentialHistogram:struct<dataPoints:array<string>>>"
LOGS = f"struct<resourceLogs:array<struct<resource:struct<attributes:{_ATTR}>,scopeLogs:array<struct<scope:struct<name:string,attributes:{_ATTR}>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_VALUE},attributes:{_ATTR}>>>>>>>"
METRICS = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_ATTR}>,scopeMetrics:array<struct<scope:struct<name:string,attributes:{_ATTR}>,metrics:array<{_METRIC}>>>>>>"
#: Places that a request's records or points have in the order of arrival.
PLACES = 2**32
#: A series without a point for so long is forgotten, unless another time or none is asked for.
FORGET = 7 * 86400


#: Arrays and maps within arrays and maps are written out to this depth.
NESTED = 4


def plain(text: Column) -> Column:
    """An array or map of values as the JSON it stands for: [1,"a"] or {"k":"v"}."""
    for _ in range(NESTED):
        for pattern, to in (
            (r'\{"(?:stringValue|bytesValue)":("(?:[^"\\\\]|\\\\.)*")\}', "$1"),
            (r'\{"(?:intValue)":"?(-?\d+)"?\}', "$1"),
            (r'\{"(?:doubleValue|boolValue)":([^{}\[\]]*)\}', "$1"),
            (r'\{"key":("(?:[^"\\\\]|\\\\.)*"),"value":((?:"(?:[^"\\\\]|\\\\.)*"|[^"{}\[\]]+|\[[^{}]*\]|\{(?:"[^"]*":(?:"[^"]*"|[^"{}\[\]])*,?)*\}))\}', "\u0001$1:$2\u0002"),
            (r'\{"values":\[(\x01[^{}]*)\]\}', "{$1}"),
            (r'\{"arrayValue":(\[[^\]]*\])\}|\{"kvlistValue":(\{[^}]*\})\}', "$1$2"),
            (r'\{"values":(\[[^{}\x01]*\])\}', "$1"),
        ):
            text = F.regexp_replace(text, pattern, to)
        text = F.regexp_replace(text, "[\u0001\u0002]", "")
    return text


def text_of(value: Column) -> Column:
    return F.coalesce(value["stringValue"], value["boolValue"], value["intValue"], value["doubleValue"].cast("string"), plain(value["arrayValue"]), plain(value["kvlistValue"]))


def attributes(*lists: Column) -> Column:
    """One map of attribute lists, the later ones first in rank; dots and dashes in names become _."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    pairs = F.concat(*(F.coalesce(F.transform(x, lambda a: F.struct(F.regexp_replace(a["key"], "[.-]", "_").alias("k"), text_of(a["value"]).alias("v"))), none) for x in reversed(lists)))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def severity(number: Column) -> Column:
    out = F.when(number.between(1, 4), "TRACE")
    for low, name in ((5, "DEBUG"), (9, "INFO"), (13, "WARN"), (17, "ERROR"), (21, "FATAL")):
        out = out.when(number.between(low, low + 3), name)
    return out


def _seconds(nanos: Column) -> Column:
    return F.floor(nanos.cast("decimal(20,0)") / 1_000_000_000).cast("long")


#: Seconds for which a request is remembered, from the copy that was taken.
REMEMBER = 3600


def new_requests(requests: DataFrame, signal: str, known: DataFrame | None = None) -> DataFrame:
    """requests (seq, body, received) whose body was not taken within the last hour; adds digest.

    A copy that is refused does not renew the memory, so each digest's times are folded in order; only they
    pass through the fold, one digest at a time and without holding more than the last one taken. known is
    (digest, received) of what earlier batches took.
    """
    df = requests.withColumn("digest", F.sha2(F.concat(F.lit(signal).cast("binary"), F.lit(b"\x00"), F.col("body").cast("binary")), 256))
    times = df.select("digest", "received", "seq")
    if known is not None:
        times = times.unionByName(known.select("digest", "received", F.lit(-1).cast("long").alias("seq")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, last = None, None
        for batch in batches:
            taken = []
            for d, t, seq in zip(*(c.to_pylist() for c in batch.columns)):
                if d != digest:
                    digest, last = d, None
                if last is None or t - last > REMEMBER:
                    last = t
                    if seq >= 0:
                        taken.append(seq)
            yield pa.RecordBatch.from_pydict({"seq": taken}, schema=pa.schema([("seq", pa.int64())]))

    taken = times.repartition("digest").sortWithinPartitions("digest", "received", "seq").mapInArrow(run, "seq long")
    return df.join(taken, "seq")


def log_records(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, refused): records as (seq, ts, service, level, message, fields), in the order they came."""
    j = requests.withColumn("j", F.from_json("body", LOGS))
    bad = j.filter("j.resourceLogs IS NULL").select(F.lit("not readable").alias("reason"))
    r = j.select("seq", F.posexplode("j.resourceLogs").alias("a", "r")).select("seq", "a", "r.resource", F.posexplode("r.scopeLogs").alias("b", "s")).select("seq", "a", "b", "resource", "s.scope", F.posexplode("s.logRecords").alias("c", "x"))
    time = F.coalesce(F.nullif(F.col("x.timeUnixNano"), F.lit("0")), F.col("x.observedTimeUnixNano"))
    r = r.select("seq", "a", "b", "c", _seconds(time).alias("ts"), attributes(F.col("resource.attributes"), F.col("scope.attributes"), F.col("x.attributes")).alias("fields"), F.coalesce(F.nullif("x.severityText", F.lit("")), severity(F.col("x.severityNumber"))).alias("level"), text_of(F.col("x.body")).alias("message"))
    r = r.withColumn("service", F.col("fields")["service_name"])
    bad = bad.union(r.filter("ts IS NULL").select(F.lit("no time")))
    good = r.filter("ts IS NOT NULL").withColumn("seq", F.row_number().over(Window.partitionBy("seq").orderBy("a", "b", "c")) + F.col("seq") * F.lit(PLACES))
    return good.select("seq", "ts", "service", "level", "message", "fields"), bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def points(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, refused): (seq, metric, kind, cumulative, monotonic, ts, time, start, fields, value, count, sum, min, max)."""
    j = requests.withColumn("j", F.from_json("body", METRICS))
    m = j.select("seq", F.posexplode("j.resourceMetrics").alias("a", "r")).select("seq", "a", "r.resource", F.posexplode("r.scopeMetrics").alias("b", "s")).select("seq", "a", "b", "resource", "s.scope", F.posexplode("s.metrics").alias("c", "m"))
    null = lambda t: F.lit(None).cast(t)
    number = F.coalesce(F.col("p.asDouble"), F.col("p.asInt").cast("double"))
    parts = []
    for kind in ("gauge", "sum", "histogram"):
        p = m.select("seq", "a", "b", "c", "resource", "scope", F.col("m.name").alias("metric"), (F.col(f"m.{kind}.aggregationTemporality") == 2 if kind != "gauge" else F.lit(False)).alias("cumulative"), (F.col("m.sum.isMonotonic") if kind == "sum" else F.lit(kind == "histogram")).alias("monotonic"), F.posexplode(f"m.{kind}.dataPoints").alias("d", "p"))
        own = [F.col("p.count").cast("double"), F.col("p.sum"), F.col("p.min"), F.col("p.max")] if kind == "histogram" else [null("double")] * 4
        parts.append(p.select("seq", "a", "b", "c", "d", "metric", F.lit(kind).alias("kind"), "cumulative", "monotonic", _seconds(F.col("p.timeUnixNano")).alias("ts"), F.col("p.timeUnixNano").cast("decimal(20,0)").alias("time"), F.col("p.startTimeUnixNano").cast("decimal(20,0)").alias("start"), attributes(F.col("resource.attributes"), F.col("scope.attributes"), F.col("p.attributes")).alias("fields"), (null("double") if kind == "histogram" else number).alias("value"), *(c.alias(n) for c, n in zip(own, ("count", "sum", "min", "max")))))
    all_ = parts[0].union(parts[1]).union(parts[2])
    order = Window.partitionBy("seq").orderBy("a", "b", "c", "kind", "d")
    all_ = all_.withColumn("seq", F.row_number().over(order) + F.col("seq") * F.lit(PLACES)).drop("a", "b", "c", "d")
    bad = j.filter("j.resourceMetrics IS NULL").select(F.lit("not readable").alias("reason"))
    for kind in ("summary", "exponentialHistogram"):
        bad = bad.union(m.select(F.explode(f"m.{kind}.dataPoints")).select(F.lit(f"{kind} is not taken")))
    return all_, bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


#: What is kept of a cumulative series: its newest point.
LAST = "series string, time decimal(20,0), ts long, start decimal(20,0), total double, sum double"


def series_of() -> Column:
    return F.sha2(F.concat_ws("\x00", "metric", F.to_json(F.map_entries("fields"))), 256)


def _newer(rows: DataFrame) -> DataFrame:
    """Points with series, without cumulative ones that are not newer than the newest before them."""
    before = Window.partitionBy("series").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__high", F.max("time").over(before)).filter("NOT cumulative OR __high IS NULL OR time > __high").drop("__high")


def _with_last(rows: DataFrame, last: DataFrame | None) -> DataFrame:
    """rows with series, and the kept points of their series as rows of their own, before all others."""
    df = rows.withColumn("series", series_of()).withColumn("__kept", F.lit(False))
    if last is None:
        return df
    mine = last.join(df.select("series").distinct(), "series", "left_semi")
    mine = mine.select("series", "time", "ts", "start", F.col("total").alias("value"), F.col("sum"), F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("cumulative"), F.lit(True).alias("__kept"))
    return df.unionByName(mine, allowMissingColumns=True)


def last_points(rows: DataFrame, last: DataFrame | None = None, forget: int | None = FORGET) -> DataFrame:
    """What deltas of the next batch go on from: the newest point of each cumulative series, of rows and of last.

    Series without a point for forget seconds before the newest of all are dropped; with None all are kept.
    """
    df = rows.filter("cumulative").select(series_of().alias("series"), "time", "ts", "start", F.coalesce("value", "count").alias("total"), "sum")
    if last is not None:
        df = df.unionByName(last)
    df = df.groupBy("series").agg(F.max_by(F.struct("time", "ts", "start", "total", "sum"), "time").alias("p")).select("series", "p.*")
    if forget is None:
        return df
    newest = df.agg(F.max("ts").alias("__newest"))  # one row
    return df.crossJoin(F.broadcast(newest)).filter(F.col("__newest") - F.col("ts") <= forget).drop("__newest")


def deltas(rows: DataFrame, began: int, last: DataFrame | None = None, forget: int | None = FORGET) -> DataFrame:
    """Points with cumulative values as what happened since the series' last point.

    began is when the stream began to take the metric (seconds), last what last_points gave after the batch
    before. A point not newer than the newest before it is ignored. A first point, or one after forget seconds
    (with None, never), counts in full if its series started after began and else sets where counting starts; so does one after a
    restart (a later start, or a monotonic total that fell), which counts in full.
    """
    df = _newer(_with_last(rows, last))
    line = Window.partitionBy("series").orderBy("seq")
    a = F.coalesce("value", "count")
    df = df.withColumns({"__a": a, "__pa": F.lag(a).over(line), "__ps": F.lag("sum").over(line), "__pt": F.lag("ts").over(line), "__pstart": F.lag("start").over(line)})
    fresh = F.col("__pt").isNull()
    if forget is not None:
        fresh = fresh | (F.col("ts") - F.col("__pt") > forget)
    restart = (F.col("start") > F.col("__pstart")) | (F.col("monotonic") & (F.col("__a") < F.col("__pa")))
    whole = F.when(fresh, F.col("start") >= F.lit(began).cast("decimal(20,0)") * 1_000_000_000).otherwise(F.coalesce(restart, F.lit(False)))
    df = df.filter(~F.col("__kept") & (~F.col("cumulative") | whole | ~fresh))
    less = lambda c, p: F.when(~F.col("cumulative") | whole, F.col(c)).otherwise(F.col(c) - F.col(p))
    return df.withColumns({"value": less("value", "__pa"), "count": less("count", "__pa"), "sum": less("sum", "__ps"), "min": F.when(~F.col("cumulative"), F.col("min")), "max": F.when(~F.col("cumulative"), F.col("max"))}).drop("__kept", "__a", "__pa", "__ps", "__pt", "__pstart")


def routed(records: DataFrame, s: Stream) -> DataFrame:
    """Events of a stream from logs, of records: attributes by name, or else the message's key=value pairs."""
    line = F.concat_ws(" ", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "level", "service", "message")
    return loglines.route(records.withColumn("line", line), s)


def metric_events(rows: DataFrame, s: Stream) -> tuple[DataFrame, DataFrame]:
    """(events, refused) of a stream from metrics: keys and conditions read the attributes, values the point.

    A histogram fills values by their names and is passed over at a count of 0; others fill the one value.
    """
    df = rows.filter(F.col("metric") == s.from_metrics)
    for name in {*(n for n, _ in s.where), *s.key_names}:
        df = df.withColumn(f"k_{name}", F.col("fields")[name])
    for name, text in s.where:
        df = df.filter(F.col(f"k_{name}") == text)
    histogram = F.col("kind") == "histogram"
    only = s.values[0].name if len(s.values) == 1 else None
    df = df.filter(~histogram | (F.coalesce("count", F.lit(0.0)) > 0))
    keys = [F.col(f"k_{k.name}").try_cast(TYPES[k.type]).alias(k.name) for k in s.keys]
    values = [F.when(histogram, F.col(v.name) if v.name in ("count", "sum", "min", "max") else F.lit(None).cast("double")).otherwise(F.col("value") if v.name == only else F.lit(None).cast("double")).alias(v.name) for v in s.values]
    out = df.select("seq", "ts", *keys, *values)
    missing = F.lit(False)
    for name in [*s.key_names, *(v.name for v in s.values)]:
        missing = missing | F.col(name).isNull()
    return out.filter(~missing), out.filter(missing).select(F.lit("a key or value is missing").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["attributes", "deltas", "last_points", "log_records", "metric_events", "new_requests", "points", "routed", "severity"]
