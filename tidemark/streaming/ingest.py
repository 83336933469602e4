"""Events into state: a whole batch or any cut of it into micro-batches gives the same state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators import anomaly, answers, events, exact, rollup, samples, sketch
from tidemark.policy import FOREVER, Policy, Stream, parse
from tidemark.sources import files, loglines, otlp
from tidemark.state import Manifest, Store, shared_folder

WEEK = 7 * 86400


def _cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _one(store: Store, manifest: Manifest, policy: Policy, s: Stream, rows: DataFrame, wall: int | None) -> None:
    spark, name, keys = store.spark, s.name, s.key_names
    # Streams from logs and metrics were held against their conditions when their rows were routed.
    good, bad = events.prepare(rows if s.from_logs or s.from_metrics else events.where(rows, s), s)
    good = _cut(spark, good, name)
    store.upsert(manifest, f"{name}_rejected", bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")), lambda d: d.groupBy("reason").agg(F.sum("n").alias("n")))
    if s.exact:
        clock = manifest.clocks.get(name)
        labelled = _cut(spark, exact.label(good, s, wall=wall, clock=clock, seen=store.table(manifest, f"{name}_ids")), "labelled")
        by = ["reason", *keys]
        store.upsert(manifest, f"{name}_refused", exact.refused(labelled, s), lambda d: d.groupBy(*by).agg(F.sum("n").alias("n")))
        now = labelled.filter("label IS NULL OR label <> 'ahead'").agg(F.max("ts")).first()[0]
        good = exact.accepted(labelled)
        top = good.agg(F.max("ts")).first()[0]
        if top is not None:
            manifest.clocks[name] = max(top, clock if clock is not None else top)
        if s.id:
            store.append(manifest, f"{name}_ids", good.select(s.id.name, "ts"))
    else:
        now = good.agg(F.max("ts")).first()[0]
    if now is not None:
        manifest.now = max(now, manifest.now if manifest.now is not None else now)
    before = store.table(manifest, f"{name}_win")
    week = F.concat_ws("-", "res", F.floor(F.col("w") / WEEK))
    flags = None
    if s.anomalies:
        judged, base = anomaly.judge(good, s, store.table(manifest, f"{name}_base"))
        good = _cut(spark, judged, "judged")
        base = _cut(spark, base, "base")
        had = before.filter(F.col("res") == s.anomalies.per) if before is not None else None
        store.append(manifest, f"{name}_anomaly", anomaly.kept_whole(good, s, had))
        store.replace(manifest, f"{name}_base", base)
        flags = F.col("unusual").cast("int")
    plain = good.drop("unusual", "z")
    if s.samples:
        had = before.filter(F.col("res") == s.samples.per).select("w", *keys, "n") if before is not None else None
        slots = ["res", "w", *keys, "slot"]
        rest = [c for c in plain.columns if c not in keys]
        latest = lambda d: d.groupBy(*slots).agg(F.max_by(F.struct(*rest), "seq").alias("e")).select(*slots, "e.*")
        store.upsert(manifest, f"{name}_sample", samples.samples(plain, s, had), latest, week)
    if s.rollups:
        store.upsert(manifest, f"{name}_win", rollup.windows(good, s, flags), lambda d: rollup.merge(d, ["res", "w", *keys], s.numbers), week)
        for v in s.sketched():
            store.upsert(manifest, f"{name}_{v}_sk", sketch.windows(plain, s, v), lambda d: sketch.merge(d, ["res", "w", *keys]), week)
    done = set()
    for p in policy.precomputes:
        if p.stream == name and (table := answers.state_name(p)) not in done:
            done.add(table)
            store.upsert(manifest, table, answers.state(plain, policy, p), lambda d, p=p: answers.merge_state(d, policy, p))
    if s.raw_keep or s.until_closed is not None:
        store.append(manifest, f"{name}_raw", plain)


def _new_of_senders(store: Store, manifest: Manifest, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """rows without those that a sender sent again. Where they have source and sent, a sender's numbers count over
    all streams of the batch and all batches before; what it sent last is kept with the commit."""
    told = {name: df for name, df in rows.items() if {"source", "sent"} <= set(df.columns)}
    if not told:
        return rows
    spark = store.spark
    sent = None
    for name, df in told.items():
        one = df.select("source", "sent", "seq", F.lit(name).alias("__stream"))
        sent = one if sent is None else sent.unionByName(one)
    committed = spark.createDataFrame(list(manifest.senders.items()), "source string, sent long")  # one row a sender
    new = _cut(spark, events.unsent(sent, committed), "sent")
    for r in new.filter("source IS NOT NULL").groupBy("source").agg(F.max("sent").alias("sent")).collect():  # one row a sender
        manifest.senders[r.source] = r.sent
    return rows | {name: df.join(new.filter(F.col("__stream") == name).select("seq"), "seq", "left_semi").drop("source", "sent") for name, df in told.items()}


def ingest(store: Store, rows: dict[str, DataFrame], *, batch: int | None = None, wall: int | None = None, lines: DataFrame | None = None, records: DataFrame | None = None, points: DataFrame | None = None, forget: int | None = otlp.FORGET) -> Manifest:
    """Applies rows (by stream, each with seq) and commits. A batch that was applied before changes nothing.

    Rows with source and sent are taken once for each sender's number. lines are log lines (seq, value), records
    log records of OpenTelemetry and points its metric points: they go to the policy's streams from logs and
    from metrics, and the templates learned and the newest points are kept with the state; a series without a point
    for forget seconds is forgotten, with None never.
    """
    manifest = store.read()
    if batch is not None and batch <= manifest.batch:
        return manifest
    policy = parse(manifest.policy)
    rows = _new_of_senders(store, manifest, rows)
    if lines is not None:
        parsed, unread = loglines.parse(lines, policy.logs)
        # Read by the fold, for the templates' examples and by every stream.
        parsed, found = loglines.learn(_cut(store.spark, parsed, "lines"), policy.logs, store.table(manifest, "templates"))
        store.replace(manifest, "templates", found)
        count = unread.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unread").alias("reason"), "n")
        store.upsert(manifest, "lines_rejected", count, lambda d: d.groupBy("reason").agg(F.sum("n").alias("n")))
        rows = rows | {s.name: loglines.route(parsed, s) for s in policy.streams if s.from_logs}
    if records is not None:
        rows = rows | {s.name: otlp.routed(records, s) for s in policy.streams if s.from_logs}
    if points is not None:
        last = store.table(manifest, "points_last")
        began = store.table(manifest, "points_began")
        if began is None:
            first = points.agg(F.min("ts")).first()[0]
            began = store.spark.createDataFrame([(first,)], "ts long")
            store.replace(manifest, "points_began", began)
        fresh = _cut(store.spark, otlp.deltas(points, began.first()[0] or 0, last, forget), "points")
        store.replace(manifest, "points_last", otlp.last_points(points, last, forget))
        rows = rows | {s.name: otlp.metric_events(fresh, s)[0] for s in policy.streams if s.from_metrics}
    for name, df in rows.items():
        _one(store, manifest, policy, policy.stream(name), df, wall)
    if batch is not None:
        manifest.batch = batch
    manifest.version += 1
    store.swap(manifest)
    return manifest


def set_limits(store: Store, quota: str, limits: DataFrame) -> Manifest:
    """The limits (keys of the quota's answer, lim) that a quota is held against from now on; each key once."""
    manifest = store.read()
    policy = parse(manifest.policy)
    q = next((q for q in policy.quotas if q.name == quota), None)
    if q is None:
        raise ValueError(f"there is no quota {quota}; there are {', '.join(q.name for q in policy.quotas)}")
    by = policy.precompute(q.precompute).by
    limits = limits.select(*by, F.col("lim").cast("double").alias("lim"))
    most = limits.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) > 1:
        raise ValueError(f"{quota} has more than one limit for a key")
    store.replace(manifest, f"{quota}_limit", limits)
    manifest.version += 1
    store.swap(manifest)
    return manifest


def distill(store: Store, now: int | None = None) -> Manifest:
    """Rewrites what has outlived its time at now (the newest event counted, if not given)."""
    manifest = store.read()
    now = manifest.now if now is None else now
    if now is None:
        return manifest
    for s in parse(manifest.policy).streams:
        if all(r.keep == FOREVER for r in s.rollups) and s.raw_keep == FOREVER and not s.exact:
            continue
        names = [f"{s.name}_raw", f"{s.name}_win", f"{s.name}_sample", f"{s.name}_ids", *(f"{s.name}_{v}_sk" for v in s.numbers)]
        tables = {n: t for n in names if (t := store.table(manifest, n)) is not None}
        for n in tables:
            entry = manifest.tables[n]
            for part in list(entry["parts"]):
                one = {n: store.table(manifest, n, {part})}
                kept = answers.distill(one, s, now)[n]
                if one[n].count() != kept.count():
                    store.replace(manifest, n, kept, part, keep_rest=True)
    manifest.version += 1
    store.swap(manifest)
    return manifest


def stream_into(store: Store, stream: DataFrame, route, checkpoint: str, wall: int | None = None) -> DataStreamWriter:
    """A streaming query that ingests each micro-batch; route(df) gives {stream name: rows with seq}.

    Spark may hand over a batch twice; its number, committed with the state, keeps it from counting twice. Lines
    of files.stream_lines get their seq here, from the last one committed on.
    """

    def each(df: DataFrame, batch: int) -> None:
        if "__file" in df.columns:
            manifest = store.read()
            if batch <= manifest.batch:
                return
            df = _cut(store.spark, files.in_order(df, manifest.seq), "lines")
            top = df.agg(F.max("seq")).first()[0]
            if top is not None:
                manifest.seq = top
                store.swap(manifest)  # numbers may be left out, but are never given twice
        ingest(store, route(df), batch=batch, wall=wall)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)

