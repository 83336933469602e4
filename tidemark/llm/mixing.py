"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A document of source s is to appear ``rate(s) = budget * total * weight(s) / size(s)`` times on
average. How often one document appears is read off the Poisson distribution of that mean at a
point in (0, 1) that a hash of seed and identifier gives: no state, no order, the same on every
run and every cluster. A mean over CHUNK is the sum of equal parts, each inverted at a point of its
own, which has the same distribution and never underflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, width

#: Largest mean that is inverted in one piece, and terms of the distribution kept for it: what lies
#: beyond 80 terms of a mean of 16 has probability 1e-27, less than one step of the 52-bit points.
CHUNK, TERMS = 16.0, 80
#: Sources whose rates go to every executor (of less than a KB each); more are joined by a shuffle.
FEW = 20_000


def _point(seed: str, ident: Column, part: Column) -> Column:
    """52 hashed bits as a number in (0, 1)."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(ident.cast("string"), F.lit("null")), part.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None, source: str, text: str, temperature: float, budget: float) -> DataFrame:
    """(mx_source, mx_rows, mx_parts, mx_cdf): for each source its rows, the parts of its mean and the distribution of one part.

    Sizes are UTF-8 bytes of all documents. Without weights a source's weight is its size to the
    power of temperature. A source of no bytes, or of no weight, has mean 0.
    """
    sizes = docs.groupBy(F.col(source).alias("mx_source")).agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")).alias("mx_size"), F.count(F.lit(1)).alias("mx_rows"))
    if weights is None:
        weight = F.pow(F.col("mx_size").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mx_source") == name, F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("mx_weight", F.when(F.col("mx_size") > 0, weight).otherwise(F.lit(0.0)))
    everywhere = Window.partitionBy()  # one row per source
    total = F.sum("mx_size").over(everywhere).cast("double")
    share = F.try_divide(F.col("mx_weight"), F.sum("mx_weight").over(everywhere))
    mean = F.coalesce(F.lit(float(budget)) * total * share / F.col("mx_size"), F.lit(0.0))
    sizes = sizes.select("mx_source", "mx_rows", F.when(F.col("mx_size") > 0, mean).otherwise(F.lit(0.0)).alias("mx_mean"))
    sizes = sizes.withColumn("mx_parts", F.greatest(F.lit(1), F.ceil(F.col("mx_mean") / CHUNK)).cast("int"))
    sizes = sizes.withColumn("mx_part", F.col("mx_mean") / F.col("mx_parts"))
    start = F.struct(F.exp(-F.col("mx_part")).alias("term"), F.exp(-F.col("mx_part")).alias("sum"), F.array(F.exp(-F.col("mx_part"))).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * F.col("mx_part") / k.cast("double")
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"), F.array_append(acc["all"], acc["sum"] + term).alias("all"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step)["all"]
    return sizes.select("mx_source", "mx_rows", "mx_parts", "mx_mean", cdf.alias("mx_cdf"))


def with_rates(docs: DataFrame, table: DataFrame, source: str, ident: str, few: int = FEW) -> DataFrame:
    """docs beside their source's rate. The texts stay where they are while the rates are few enough to go to
    them; else a source's rows are dealt over as many tasks as its share of all rows."""
    matches = F.col(source).eqNullSafe(F.col("mx_source"))
    if table.count() <= few:
        return docs.join(F.broadcast(table), matches)
    n = width(docs.sparkSession)
    share = F.ceil(F.col("mx_rows") * n / F.sum("mx_rows").over(Window.partitionBy())).cast("int")
    table = table.withColumn("mx_salts", F.greatest(F.lit(1), share))
    # No more than n sources have a share of over one task.
    hot = F.broadcast(table.filter("mx_salts > 1").select(F.col("mx_source").alias("mx_hot"), F.col("mx_salts").alias("mx_of")))
    rows = docs.join(hot, F.col(source).eqNullSafe(F.col("mx_hot")) & F.lit(True), "left")
    rows = rows.withColumn("mx_row_salt", F.pmod(F.xxhash64(F.col(ident)), F.coalesce("mx_of", F.lit(1))).cast("int"))
    salted = table.withColumn("mx_salt", F.explode(F.sequence(F.lit(0), F.col("mx_salts") - 1)))
    return rows.join(salted, matches & (F.col("mx_row_salt") == F.col("mx_salt")))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, ident: str = "doc_id", source: str = "source", text: str = "text", seed: str = "tidemark", temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """docs with each row as often as its source's rate gives, in a globally random order.

    Adds copy (1, 2, ...) and mix_key, the hash that rows are dealt out and sorted by; columns of
    those names in docs are replaced, names that begin with mx_ are used inside, all others stay. Rows with equal identifiers are replicated
    alike. A null identifier counts as the word null; null is a source of its own; null text has
    no bytes. An empty table gives an empty table.
    """
    table = Scratch(docs.sparkSession, "mixing").table("rates", rates(docs, weights, source, text, temperature, budget))
    docs = docs.drop("copy", "mix_key")
    columns = docs.columns
    rows = with_rates(docs, table, source, ident)
    drawn = lambda i: F.size(F.filter("mx_cdf", lambda c: c <= _point(seed, F.col(ident), i)))
    count = F.aggregate(F.sequence(F.lit(1), F.col("mx_parts")), F.lit(0), lambda n, i: n + drawn(i))
    rows = rows.withColumn("mx_count", count).filter("mx_count > 0")
    rows = rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("mx_count"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(ident).cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    rows = rows.withColumn("mix_key", key)
    return rows.repartition("mix_key").sortWithinPartitions("mix_key")


def op6_mix_sources(spark, sf_dir):
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixing_sql(docs: str, seed: str = "tidemark", power: str = "0.5", budget: str = "1.0") -> str:
    """DuckDB SQL for mix_sources over the relation docs, with weights from sizes."""
    return f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS size FROM {docs} GROUP BY source),
weighed AS (
  SELECT source, size, CASE WHEN size > 0 THEN pow(size::DOUBLE, {power}::DOUBLE) ELSE 0.0::DOUBLE END AS weight FROM sizes),
means AS (
  SELECT source, CASE WHEN size > 0 THEN coalesce({budget}::DOUBLE * (sum(size) OVER ())::DOUBLE
    * (weight / nullif(sum(weight) OVER (), 0)) / size, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS mean FROM weighed),
parts AS (SELECT source, mean, greatest(1, ceil(mean / 16.0::DOUBLE))::INT AS parts FROM means),
cdf AS (
  SELECT source, 0 AS k, exp(-(mean / parts)) AS term, exp(-(mean / parts)) AS total, mean / parts AS part FROM parts
  UNION ALL
  SELECT source, k + 1, term * part / (k + 1), total + term * part / (k + 1), part FROM cdf WHERE k < 79),
points AS (
  SELECT DISTINCT d.doc_id, d.source, i,
    (('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM {docs} d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.parts + 1) t(i)),
counts AS (
  SELECT x.doc_id, x.source, count(*) AS n FROM points x JOIN cdf c ON x.source IS NOT DISTINCT FROM c.source AND c.total <= x.u
  GROUP BY x.doc_id, x.source)
SELECT d.*, k::INT AS copy, md5('{seed}:order:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || k::VARCHAR) AS mix_key
FROM {docs} d JOIN counts n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.source IS NOT DISTINCT FROM n.source, range(1, n.n + 1) t(k)
"""


OP6_SQL = mixing_sql("documents")
