"""Log lines to events: fields of the format, key=value pairs, masked messages, templates, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import templates
from tidemark.operators.events import TYPES, where
from tidemark.policy import Logs, Stream, log_pattern

# Fixed value: what a key=value pair is; a value in double quotes may hold spaces.
PAIR = r'(^|\s)([A-Za-z_][A-Za-z0-9_.]*)=("[^"]*"|\S*)'
#: Times of lines, tried in turn; a zone is UTC where none is given. A comma before the fraction is a point.
TIMES = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX]"]


def seconds(stamp: Column) -> Column:
    """Whole seconds of a line's time, or null: a number of seconds, or a date and time."""
    stamp = F.regexp_replace(F.trim(stamp), r"(:[0-9]{2}),([0-9])", "$1.$2")
    number = F.when(stamp.rlike(r"^[0-9][0-9.eE]*$"), stamp.try_cast("double").cast("long"))
    return F.coalesce(number, *(F.unix_timestamp(F.try_to_timestamp(stamp, F.lit(f))) for f in TIMES))


def pair(message: Column, name: str) -> Column:
    """The value of the first pair with that name, without its quotes; null if there is none."""
    found = F.regexp_extract(message, rf'(?:^|\s){name.replace(".", "[.]")}=("[^"]*"|\S*)', 1)
    has = message.rlike(rf"(^|\s){name.replace('.', '[.]')}=")
    return F.when(has, F.regexp_replace(found, r'^"([^"]*)"$', "$1"))


def masked(message: Column, logs: Logs) -> Column:
    out = F.regexp_replace(message, PAIR, "$1$2=<*>")
    for m in logs.masks:
        out = F.regexp_replace(out, m, templates.WILD.replace("$", r"\$"))
    return out


def parse(lines: DataFrame, logs: Logs) -> tuple[DataFrame, DataFrame]:
    """(parsed, unread) of lines (seq, value). parsed has seq, ts, the format's fields, masked and line."""
    pattern, names = log_pattern(logs.format)
    text = F.trim("value")
    parsed = lines.filter(text != "").withColumn("line", text)
    fit = F.col("line").rlike(pattern)
    good = parsed.filter(fit).select("seq", "line", *(F.regexp_extract("line", pattern, k + 1).alias(n) for k, n in enumerate(names)))
    stamp = F.col("timestamp") if "timestamp" in names else F.concat("date", F.lit("T"), "time")
    good = good.withColumn("ts", seconds(stamp)).withColumn("masked", masked(F.col("message"), logs))
    unread = parsed.filter(~fit).select("seq", "line").union(good.filter("ts IS NULL").select("seq", "line"))
    return good.filter("ts IS NOT NULL"), unread


def learn(parsed: DataFrame, logs: Logs, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(parsed with template, templates), going on from the templates known."""
    for name in ("service", "level"):
        if name not in parsed.columns:
            parsed = parsed.withColumn(name, F.lit(""))
    return templates.mine(parsed, logs.similarity, logs.depth, known)


def route(parsed: DataFrame, s: Stream) -> DataFrame:
    """Events of a stream from logs: lines that meet its conditions and have every key and value.

    A field is the format's, or else the first pair of its name in the message. Only the fields asked for
    are looked for.
    """
    df = parsed
    for name in {*(n for n, _ in s.where), *s.key_names, *(v.name for v in s.values)} - set(parsed.columns):
        # Records of OpenTelemetry bring attributes beside the message's pairs, and these come first.
        own = pair(F.col("message"), name)
        df = df.withColumn(name, F.coalesce(F.col("fields")[name], own) if "fields" in parsed.columns else own)
    df = where(df, s)
    for f in [*s.keys, *s.values]:
        df = df.withColumn(f.name, F.col(f.name).try_cast(TYPES[f.type])).filter(F.col(f.name).isNotNull())
    return df.select("seq", "ts", *s.key_names, *(v.name for v in s.values), "line")
