"""Events from comma-separated values, JSON lines and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.events import TYPES, fields
from tidemark.operators.numbering import numbered
from tidemark.policy import Stream


def _shape(s: Stream, numbered: bool) -> list[str]:
    return [*(["sent"] if numbered else []), *(n for n, _ in fields(s))]


def csv(lines: DataFrame, s: Stream, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of lines (seq, value): fields in the stream's order, split at every comma, trimmed.

    There is no quoting. Blank lines and lines that begin with # are skipped; a wrong number of fields
    refuses the line. With numbered the sender's number comes first.
    """
    names = _shape(s, numbered)
    parts = lines.filter("trim(value) <> '' AND NOT startswith(trim(value), '#')").withColumn("__p", F.transform(F.split("value", ","), lambda x: F.trim(x)))
    good = parts.filter(F.size("__p") == len(names)).select("seq", *(F.get("__p", k).alias(n) for k, n in enumerate(names)))
    return good, parts.filter(F.size("__p") != len(names)).select("seq", F.lit(f"expected {len(names)} fields").alias("reason"))


def json_lines(lines: DataFrame, s: Stream, default: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of lines (seq, value): an object a line by field name, of which those for the
    stream are taken: its name in stream, or none where the stream is the default. sent is their seq."""
    # Whole numbers come as decimals: as reals those beyond 2**53 would not be told apart.
    kinds = {"string": T.StringType(), "long": T.DecimalType(38, 16), "double": T.DoubleType()}
    schema = T.StructType([T.StructField("stream", T.StringType()), T.StructField("seq", T.LongType()), *(T.StructField(n, kinds[k]) for n, k in fields(s)), T.StructField("_bad", T.StringType())])
    read = lines.filter("trim(value) <> '' AND NOT startswith(trim(value), '#')").withColumn("j", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull()
    mine = (F.col("j.stream") == s.name) | (F.col("j.stream").isNull() if default else F.lit(False))
    rows = read.filter(~bad & mine).select("seq", F.col("j.seq").alias("sent"), *(F.col(f"j.{n}").alias(n) for n, _ in fields(s)))
    return rows, read.filter(bad).select("seq", F.lit("not a JSON object").alias("reason"))


def _placed(df: DataFrame) -> DataFrame:
    """Lines with the file and block they come from, and an order within the block. A large file is many blocks."""
    at = F.col("_metadata")
    return df.select("value", at["file_path"].alias("__file"), at["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__row"))


def in_order(placed: DataFrame, after: int = -1) -> DataFrame:
    """(seq, value) of lines as _placed gives them: by file name, then by line, from after + 1 on."""
    return numbered(placed, "seq", "__file", "__block", "__row", after=after).select("seq", "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) of text files, from 0: by file name, then by line. Files are read in blocks by many tasks."""
    return in_order(_placed(spark.read.text(path)))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of text files for ingest.stream_into, which numbers its lines by in_order, batch after batch."""
    return _placed(spark.readStream.text(path))


def typed(df: DataFrame, s: Stream) -> DataFrame:
    """A table with the stream's columns as its events, cast by name."""
    cast: list[Column] = [F.col(n).try_cast(k).alias(n) for n, k in fields(s)]
    return df.select("seq", *cast, *(["line"] if "line" in df.columns else []))


__all__ = ["TYPES", "csv", "in_order", "json_lines", "numbered_lines", "stream_lines", "typed"]
