"""Calls of AI agents: metered by source, their messages stored once, requests rebuilt to the byte.

A run is a row (run, repo, model, start, tools, tools_tokens, messages), messages an array of
(raw, role, source, tokens, at). Every assistant message after the first message answers a call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.redact import redact
from tidemark.operators.numbering import numbered

#: Seconds for which a call's input is served from the provider's cache to the next call.
CACHED = 300
RUN = "run string, repo string, model string, start long, tools string, tools_tokens long, messages array<struct<raw:string,role:string,source:string,tokens:long,at:long>>"


def read_runs(spark, path: str) -> DataFrame:
    """Runs from JSON lines, plain or compressed (by the file's ending): an object a run, with its identifier as id.

    A run without an identifier or messages, or two with one identifier, is an error.
    """
    given = spark.read.schema(RUN.replace("run string", "id string")).json(path).withColumnRenamed("id", "run")
    bad = given.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("messages").isNotNull()).alias("whole")).filter("run IS NULL OR n > 1 OR NOT whole")
    found = bad.orderBy("run").limit(1).collect()
    if found:
        x = found[0]
        raise ValueError(f"run {x.run} is there {x.n} times" if x.run is not None and x.n > 1 else f"run {x.run} has no identifier or no messages")
    return given


def messages(runs: DataFrame) -> DataFrame:
    """One row a message, with its place, and before it: sent, the time of the message before."""
    m = runs.select("run", "repo", "model", "start", "tools", "tools_tokens", F.posexplode("messages").alias("at_k", "m")).select("run", "repo", "model", "start", "tools", "tools_tokens", F.col("at_k").alias("k"), "m.*")
    line = Window.partitionBy("run").orderBy("k")
    return m.withColumn("sent", F.col("start") + F.lag("at").over(line))


def calls(runs: DataFrame) -> DataFrame:
    """(run, repo, model, call, call_id, k, ts, sent, input_tokens, cached_tokens, output_tokens, cached_to).

    The input is the tool list and all messages before the reply. What the call before sent is cached if it
    was sent no more than CACHED seconds earlier: cached_to is the first message that is not, 0 if none is.
    """
    m = messages(runs)
    line = Window.partitionBy("run").orderBy("k")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("sum", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    replies = m.filter("k > 0 AND role = 'assistant'").withColumn("call", F.row_number().over(line).cast("long"))
    last = lambda c: F.lag(c).over(line)
    replies = replies.withColumns({"prev_k": last("k"), "prev_sent": last("sent"), "prev_sum": last("sum")})
    cached = F.col("prev_k").isNotNull() & (F.col("sent") - F.col("prev_sent") <= CACHED)
    return replies.select(
        "run", "repo", "model", "call", F.concat("run", F.lit("#"), F.col("call").cast("string")).alias("call_id"), "k", (F.col("start") + F.col("at")).alias("ts"), "sent",
        (F.col("tools_tokens") + F.col("sum")).alias("input_tokens"),
        F.when(cached, F.col("tools_tokens") + F.col("prev_sum")).otherwise(0).alias("cached_tokens"),
        F.col("tokens").alias("output_tokens"), F.when(cached, F.col("prev_k")).otherwise(0).alias("cached_to"))


def context(runs: DataFrame) -> DataFrame:
    """(part_id, run, repo, source, ts, tokens, cached_tokens, output_tokens): each call by source, and its output.

    A call's sums by source are running sums over the run's messages of that source, so the work grows with
    messages times sources and not with messages times calls.
    """
    c, m = calls(runs), messages(runs)
    sources = m.select("run", "source").distinct()
    asked = c.select("run", F.col("k").alias("at"), F.lit(1).alias("kind"), "call_id").union(c.filter("cached_to > 0").select("run", "cached_to", F.lit(2), "call_id")).join(sources, "run")
    given = m.select("run", "source", F.col("k").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("call_id"), "tokens")
    line = Window.partitionBy("run", "source").orderBy(F.col("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    # A question at message k comes before message k itself.
    both = given.unionByName(asked.withColumn("tokens", F.lit(None).cast("long"))).withColumn("sum", F.coalesce(F.sum("tokens").over(line), F.lit(0)))
    by = both.filter("kind > 0").groupBy("call_id", "source").agg(F.max(F.when(F.col("kind") == 1, F.col("sum"))).alias("tokens"), F.coalesce(F.max(F.when(F.col("kind") == 2, F.col("sum"))), F.lit(0)).alias("cached_tokens"))
    sent = both.filter("kind = 0").groupBy("run", "source").agg(F.min("at").alias("first_k"))
    head = c.select("call_id", "run", "repo", "ts", "k", "output_tokens", "cached_to")
    rows = by.join(head, "call_id").join(sent, ["run", "source"]).filter("first_k < k").select("call_id", "run", "repo", "source", "ts", "tokens", "cached_tokens", F.lit(0).cast("long").alias("output_tokens"))
    tools = c.join(runs.select("run", "tools_tokens"), "run").select("call_id", "run", "repo", F.lit("tools").alias("source"), "ts", F.col("tools_tokens").alias("tokens"), F.when(F.col("cached_to") > 0, F.col("tools_tokens")).otherwise(0).alias("cached_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    output = head.select("call_id", "run", "repo", F.lit("output").alias("source"), "ts", F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("cached_tokens"), "output_tokens")
    # A message may name itself tools, like the list.
    both = rows.union(tools).groupBy("call_id", "run", "repo", "source", "ts").agg(*(F.sum(x).alias(x) for x in ("tokens", "cached_tokens", "output_tokens")))
    return both.unionByName(output).select(F.concat("call_id", F.lit("/"), F.col("source")).alias("part_id"), "run", "repo", "source", "ts", "tokens", "cached_tokens", "output_tokens")


def pieces(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces, uses): each masked body once, numbered by its first use; and (run, k, piece), the tools at k = -1.

    First is by run and place in it, so numbers do not depend on how the data is dealt out.
    """
    m = messages(runs)
    body, secrets = redact(F.col("raw"))
    uses = m.select("run", F.col("k").cast("long").alias("k"), "source", "tokens", body.alias("body"), secrets.alias("secrets"))
    tools, found = redact(F.col("tools"))
    uses = uses.union(runs.select("run", F.lit(-1).cast("long"), F.lit("tools"), "tools_tokens", tools, found)).withColumn("hash", F.sha2(F.col("body").cast("binary"), 256))
    order = F.struct("run", "k")
    kept = uses.groupBy("hash").agg(F.min(order).alias("first"), *(F.min_by(c, order).alias(c) for c in ("body", "source", "tokens", "secrets")), F.count(F.lit(1)).alias("uses"))
    numbers = numbered(kept.select("hash", "first"), "piece", "first")
    kept = kept.join(numbers.select("hash", "piece"), "hash").select("piece", "hash", "source", "tokens", "secrets", "body", "uses")
    return kept, uses.join(numbers.select("hash", "piece"), "hash").select("run", "k", "piece")


def weighed(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows of call_rows with bytes and sha256 of the request, as it is rebuilt."""
    request = rebuild(rows, kept).select("call_id", F.octet_length("request").cast("long").alias("bytes"), F.sha2(F.col("request").cast("binary"), 256).alias("sha256"))
    return rows.join(request, "call_id")


def day_order(runs: DataFrame) -> DataFrame:
    """Calls of all runs as they come in on a day: by time, and by run and number where times are equal; from 1."""
    return numbered(calls(runs), "seq", "ts", "run", "call")


def call_rows(runs: DataFrame) -> DataFrame:
    """(call_id, run, model, call, messages, tools, reply): a call as the pieces of its request and its reply."""
    _, uses = pieces(runs)
    line = Window.partitionBy("run").orderBy("k")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    sent = uses.filter("k >= 0").withColumn("messages", F.collect_list("piece").over(before))
    tools = uses.filter("k = -1").select("run", F.col("piece").alias("tools"))
    c = calls(runs).select("call_id", "run", "model", "call", F.col("k").cast("long").alias("k"))
    return c.join(sent, ["run", "k"]).join(tools, "run").select("call_id", "run", "model", "call", "messages", "tools", F.col("piece").alias("reply"))


def rebuild(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(call_id, request): the request as it was sent, but for what was masked."""
    bodies = kept.select("piece", "body")
    parts = rows.select("call_id", F.posexplode("messages").alias("k", "piece")).join(bodies, "piece")
    text = parts.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]), ",").alias("sent"))
    tools = rows.join(bodies, rows.tools == bodies.piece).select("call_id", "model", F.col("body").alias("tool_list"))
    request = F.concat(F.lit('{"model":"'), "model", F.lit('","messages":['), F.coalesce("sent", F.lit("")), F.lit('],"tools":'), "tool_list", F.lit("}"))
    return tools.join(text, "call_id", "left").select("call_id", request.alias("request"))
