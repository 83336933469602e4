"""The same events through Spark and through a plain event-at-a-time recount."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomaly, answers, events, exact, rollup, samples, sketch
from tidemark.policy import parse
from tidemark.state import Store
from tidemark.streaming import ingest

POLICY = """
stream latency {
  key endpoint text
  value ms real
  value size integer
  derive rate = ms / size
  derive twice = size * 2 - 1
  raw keep 1h
  rollup 10s keep 1d
  rollup 1m keep 30d quantiles ms
  rollup 1h keep forever quantiles ms
  samples 3 per 1m
  anomalies ms log z > 3 memory 100 warmup 30 keep 2 per 1m
}
precompute requests = count(latency) by endpoint
precompute avg_ms = avg(latency.ms) by endpoint
precompute last_size = last(latency.size)
precompute day_open = first(latency.ms) by endpoint per day
precompute p90_ms = p90(latency.ms) by endpoint
precompute p90_all = p90(latency.ms)
precompute hours = sum(latency.twice) per hour
quota cap = hours
"""
START = 1790586000


def made(seed, n=1500):
    r = random.Random(seed)
    out = []
    for k in range(n):
        ms = 0.0 if r.random() < 0.01 else r.lognormvariate(3, 0.4) * (20 if r.random() < 0.01 else 1)
        out.append((k, START + k // 3 - (r.randrange(900) if r.random() < 0.02 else 0), r.choice("abc"), round(ms, 3), r.randrange(1, 50)))
    return out


def recount(rows, s):
    """What is kept, by the rules, one event after the other."""
    win, base, flagged, slots = {}, {}, [], {}
    for seq, ts, key, ms, size in rows:
        b = base.setdefault(key, anomaly.Baseline(s.anomalies))
        unusual, z = b.see(ms)
        at = (60, ts // 60 * 60, key)
        if unusual and win.get(at, {"an": 0})["an"] < s.anomalies.keep:
            flagged.append((seq, None if z is None else round(z, 9)))
        for res in (10, 60, 3600):
            w = win.setdefault((res, ts // res * res, key), {"n": 0, "an": 0, "sum": 0.0, "sq": 0.0, "min": math.inf, "max": -math.inf, "first": (math.inf, None), "last": (-math.inf, None)})
            w["n"] += 1
            w["an"] += unusual
            w["sum"] += ms
            w["sq"] += ms * ms
            w["min"], w["max"] = min(w["min"], ms), max(w["max"], ms)
            if ts < w["first"][0]:
                w["first"] = (ts, ms)
            if ts >= w["last"][0]:
                w["last"] = (ts, ms)
        n = win[at]["n"]
        if n <= 3 or (n * 2654435761 + 97) % 4294967296 % n < 3:
            slots[(at[1], key, n - 1 if n <= 3 else (n * 1103515245 + 12345) % 2147483648 % 3)] = seq
    return win, base, flagged, slots


def check(rows, win, base, kept, sampled, s):
    want_win, want_base, want_flagged, want_slots = recount(rows, s)
    got = {(r.res, r.w, r.endpoint): (r.n, r.an, round(r.ms_sum, 6), round(r.ms_sumsq, 4), r.ms_min, r.ms_max, r.first_ts, r.ms_first, r.last_ts, r.ms_last) for r in win.collect()}
    assert got == {k: (w["n"], w["an"], round(w["sum"], 6), round(w["sq"], 4), w["min"], w["max"], *w["first"], *w["last"]) for k, w in want_win.items()}
    assert sorted((r.seq, None if r.z is None else round(r.z, 9)) for r in kept.collect()) == sorted(want_flagged)
    assert {r.endpoint: (r.n, round(r.m, 9), round(r["var"], 9)) for r in base.collect()} == {k: (b.n, round(b.m, 9), round(b.var, 9)) for k, b in want_base.items()}
    assert {(r.w, r.endpoint, r.slot): r.seq for r in sampled.collect()} == want_slots


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, ts long, endpoint string, ms double, size long")


@pytest.fixture(scope="module")
def policy():
    return parse(POLICY)


def test_operators_equal_the_recount(spark, policy):
    s, rows = policy.streams[0], made(1)
    good, bad = events.prepare(frame(spark, rows), s)
    assert bad.count() == 0
    judged, base = anomaly.judge(good, s)
    judged = judged.cache()
    win = rollup.windows(judged, s, F.col("unusual").cast("int"))
    check(rows, win, base, anomaly.kept_whole(judged, s), samples.samples(good, s), s)
    day = rollup.coarser(win.filter("res = 60"), 86400, [], s.numbers).first()
    assert day.n == len(rows) and abs(day.ms_sum - sum(r[3] for r in rows)) < 1e-6
    sd = win.filter("res = 3600").select("n", "ms_sum", "ms_sumsq", rollup.deviation("ms").alias("sd")).first()
    assert abs(sd.sd - math.sqrt(sd.ms_sumsq / sd.n - (sd.ms_sum / sd.n) ** 2)) < 1e-9
    judged.unpersist()


def test_sketch_is_within_its_accuracy(spark, policy):
    s, rows = policy.streams[0], made(2)
    good, _ = events.prepare(frame(spark, rows), s)
    sk = sketch.windows(good, s, "ms").filter("res = 3600")
    for q in (0.5, 0.9, 0.99):
        got = {r.endpoint: r.value for r in sketch.quantile(sketch.merge(sk, ["endpoint"]), ["endpoint"], q, s.accuracy).collect()}
        for key in "abc":
            xs = sorted(r[3] for r in rows if r[2] == key)
            exact_value = xs[math.ceil(q * len(xs)) - 1]
            assert abs(got[key] - exact_value) <= 0.0100001 * exact_value
    assert sketch.quantile(sk.filter("n < 0"), [], 0.5, 0.01).collect()[0][0] is None


@pytest.mark.parametrize("cuts", [[700], [1, 650, 660]])
def test_any_cut_into_batches_gives_the_same_state(spark, policy, tmp_path, cuts):
    s, rows = policy.streams[0], made(3, 900)
    store = Store(spark, f"file://{tmp_path}/state")
    store.create(POLICY)
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        ingest.ingest(store, {"latency": frame(spark, rows[a:b])}, batch=k)
        ingest.ingest(store, {"latency": frame(spark, rows[a:b])}, batch=k)  # a batch handed over twice
    m = store.read()
    check(rows, *(store.table(m, f"latency_{t}") for t in ("win", "base", "anomaly", "sample")), s)
    whole = answers.answers({"latency": events.prepare(frame(spark, rows), s)[0]}, policy)
    for p in policy.precomputes:
        kept = answers.answer(store.table(m, answers.state_name(p)), policy, p)
        plain = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.collect())
        assert plain(kept) == plain(whole[p.name]), p.name
    before = store.table(m, "latency_win").count()
    left = store.table(ingest.distill(store, m.now + 86400 * 2), "latency_win")
    assert left.filter("res = 10").count() == 0 and 0 < left.count() < before
    assert store.table(store.read(), "latency_raw").count() == 0
    assert store.sizes(store.read()).filter("name = 'latency_win' AND bytes > 0").count() == 1


def test_stream_of_files_equals_one_batch(spark, policy, tmp_path):
    s, rows = policy.streams[0], made(4, 300)
    source = f"{tmp_path}/in"
    for a in range(0, 300, 100):
        frame(spark, rows[a : a + 100]).coalesce(1).write.mode("append").parquet(source)
    store = Store(spark, f"file://{tmp_path}/state")
    store.create(POLICY)
    stream = spark.readStream.schema(frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 2).parquet(source)
    query = ingest.stream_into(store, stream, lambda df: {"latency": df}, f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    m = store.read()
    assert m.batch == 1 and store.table(m, "latency_win").filter("res = 3600").agg(F.sum("n")).first()[0] == 300


def test_bad_rows_are_refused_whole(spark, policy):
    df = spark.createDataFrame([(1, 10, "a", 1.0, 2.0), (2, None, "a", 1.0, 2.0), (3, 10, "a", float("nan"), 2.0), (4, 10, "a", 1.0, 2.5), (5, 10, None, 1.0, 1.0), (6, 10, "a", 1.0, 0.0), (7, 10, "a", 1.0, 2.0**60)], "seq long, ts long, endpoint string, ms double, size double")
    good, bad = events.prepare(df, policy.streams[0])
    assert [r.seq for r in good.collect()] == [1] and sorted(r.seq for r in bad.collect()) == [2, 3, 4, 5, 6, 7]
    assert good.first().rate == 0.5 and good.first().twice == 3


def test_senders_numbers_count_once(spark):
    rows = [("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("a", 1, 4), ("b", 7, 5), (None, None, 6), ("a", 3, 7)]
    df = spark.createDataFrame(rows, "source string, sent long, seq long")
    assert sorted(r.seq for r in events.unsent(df).collect()) == [1, 2, 5, 6, 7]
    done = spark.createDataFrame([("a", 2)], "source string, sent long")
    assert sorted(r.seq for r in events.unsent(df, done).collect()) == [5, 6, 7]


EXACT = """
stream usage exact {
  id request_id refuse repeats 7d
  key customer text
  value tokens integer
  late 48h
  ahead 10m
  period %s close 2h
  raw until closed + 1d
  rollup 1h keep 400d
}
precompute spent = sum(usage.tokens) by customer per %s
quota budget = spent
"""


def ends(ts, per):
    t = datetime.fromtimestamp(ts, timezone.utc)
    if per == "month":
        return int(datetime(t.year + t.month // 12, t.month % 12 + 1, 1, tzinfo=timezone.utc).timestamp())
    step = timedelta(hours=1) if per == "hour" else timedelta(days=1)
    floor = t.replace(minute=0, second=0) if per == "hour" else t.replace(hour=0, minute=0, second=0)
    return int((floor + step).timestamp())


def sequential(rows, s, wall):
    newest, seen, out = None, set(), {}
    for seq, ts, rid, _, _ in rows:
        why = None
        if ts > wall + s.ahead:
            why = "ahead"
        elif newest is not None and ts < newest - s.late:
            why = "late"
        elif newest is not None and newest >= ends(ts, s.period) + s.close:
            why = "closed"
        elif rid in seen:
            why = "repeat"
        if why is None:
            newest = ts if newest is None else max(newest, ts)
            seen.add(rid)
        out[seq] = why
    return out


@pytest.mark.parametrize("per,seed", [("day", 1), ("month", 2), ("hour", 3)])
def test_refusals_equal_the_sequential_rule(spark, per, seed):
    policy = parse(EXACT % (per, per))
    s, r = policy.streams[0], random.Random(seed)
    rows, wall = [], START + 400 * 900
    for k in range(400):
        ts = START + k * 900 - (r.randrange(200000) if r.random() < 0.2 else 0) + (10**7 if r.random() < 0.01 else 0)
        rid = f"r{k}" if r.random() < 0.85 else f"r{r.randrange(max(1, k))}"
        rows.append((k, ts, rid, r.choice("xy"), r.randrange(100)))
    df = spark.createDataFrame(rows, "seq long, ts long, request_id string, customer string, tokens long")
    labelled = exact.label(df, s, wall=wall)
    want = sequential(rows, s, wall)
    assert {x.seq: x.label for x in labelled.collect()} == want
    assert {"ahead", "late", "repeat"} <= {w for w in want.values() if w} or per == "hour"
    counted = defaultdict(int)
    for seq, _, _, customer, _ in rows:
        if want[seq]:
            counted[(want[seq], customer)] += 1
    assert {(x.reason, x.customer): x.n for x in exact.refused(labelled, s).collect()} == counted
    used = answers.answers({"usage": exact.accepted(labelled)}, policy)["spent"]
    limits = spark.createDataFrame([("x", 500.0), ("z", 1.0)], "customer string, lim double")
    got = answers.quota(limits, used, policy, policy.quotas[0]).collect()
    assert got and all(x.customer == "x" and x.remaining == x.lim - x.used and x.reached == (x.used >= x.lim) for x in got)


def test_exact_state_across_batches(spark, tmp_path):
    text = EXACT % ("day", "day")
    rows = [(0, START, "a", "x", 1), (1, START + 5, "b", "x", 2), (2, START + 6, "a", "x", 3), (3, START + 7, "c", "y", 4), (4, START - 10**6, "d", "x", 5)]
    store = Store(spark, f"file://{tmp_path}/exact")
    store.create(text)
    df = spark.createDataFrame(rows, "seq long, ts long, request_id string, customer string, tokens long")
    ingest.ingest(store, {"usage": df.filter("seq < 2")})
    m = ingest.ingest(store, {"usage": df.filter("seq >= 2")})
    assert {(r.reason, r.customer, r.n) for r in store.table(m, "usage_refused").collect()} == {("repeat", "x", 1), ("late", "x", 1)}
    assert m.clocks["usage"] == START + 7 and m.now == START + 7


def test_a_commit_of_many_weeks_is_as_many_jobs_as_one_of_few(spark, tmp_path):
    """Windows of all weeks are written by one job, and events are read once for what is new of them."""
    text = "stream s { key endpoint text value ms real rollup 1d keep forever quantiles ms }"
    asked, jobs = 0, []
    for weeks in (1, 30):
        store = Store(spark, f"file://{tmp_path}/{weeks}")
        store.create(text)
        rows = [(k, START + k % weeks * 7 * 86400, "a" if k % 3 else "b", 1.0 + k) for k in range(90)]
        df = spark.createDataFrame(rows, "seq long, ts long, endpoint string, ms double")
        spark.sparkContext.setJobGroup(f"weeks {weeks}", "")
        for part in (df.filter("seq < 45"), df.filter("seq >= 45")):
            ingest.ingest(store, {"s": part})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"weeks {weeks}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        manifest = store.read()
        asked += len(manifest.tables["s_win"]["parts"])
        win = store.table(manifest, "s_win").collect()
        want = Counter((ts // 86400 * 86400, endpoint) for _, ts, endpoint, _ in rows)
        assert len(win) == len(want) and {(x.w, x.endpoint): x.n for x in win} == want
        assert store.table(manifest, "s_ms_sk").agg(F.sum("n")).first()[0] == 90
    assert asked == 31 and jobs[1] <= jobs[0] + 10
