"""Files, log lines, templates, OTLP and traces against plain recounts."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.redact import redact
from tidemark.operators import dejavu, traces
from tidemark.operators.templates import WILD, Miner
from tidemark.policy import parse
from tidemark.sources import files, loglines, otlp

STREAM = parse("stream s { key k value v integer value r real }").streams[0]


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq long, value string")


def test_comma_separated(spark):
    got, bad = files.csv(lines(spark, ["10, a ,1,2.5", "", "# note", "11,b,x,1", "12,c,1"]), STREAM)
    assert [tuple(r) for r in got.collect()] == [(0, "10", "a", "1", "2.5"), (3, "11", "b", "x", "1")] and [r.seq for r in bad.collect()] == [4]
    got, _ = files.csv(lines(spark, ["7,10,a,1,2.5"]), STREAM, numbered=True)
    assert got.first().sent == "7"


def test_json_lines(spark):
    got, bad = files.json_lines(lines(spark, ['{"ts": 1, "k": "a", "v": 2, "r": 0.5, "seq": 9}', '{"stream": "t", "ts": 1}', "nonsense", '{"stream": "s", "ts": 2, "k": "b", "v": 2.5}']), STREAM)
    assert [(r.seq, r.sent, r.ts, r.k, r.v, r.r) for r in got.collect()] == [(0, 9, 1, "a", 2, 0.5), (3, None, 2, "b", 2.5, None)] and [r.seq for r in bad.collect()] == [2]


POLICY = """
logs { format "<timestamp> <level> <service> <message>" mask "[0-9a-f]{8}" }
stream web from logs where service = "web" { key route text value ms real rollup 1m keep 1d }
"""


def test_lines_pairs_and_routing(spark):
    p = parse(POLICY)
    texts = ["2026-09-28T01:02:03Z INFO web GET route=/a ms=1.5 route=/b level=x", '1790586000.9 WARN  web hello ms="2" note="a b" id 0badcafe', "2026-09-28T01:02:03,250 INFO db route=/c ms=3", "no time at all here", "short"]
    parsed, unread = loglines.parse(lines(spark, texts), p.logs)
    rows = {r.seq: r for r in parsed.collect()}
    assert rows[0].ts == rows[2].ts == 1790557323 and rows[1].ts == 1790586000 and sorted(r.seq for r in unread.collect()) == [3, 4]
    assert rows[0].level == "INFO" and rows[0].masked == "GET route=<*> ms=<*> route=<*> level=<*>" and rows[1].masked == "hello ms=<*> note=<*> id <*>"
    assert [(r.seq, r.route, r.ms) for r in loglines.route(parsed, p.streams[0]).collect()] == [(0, "/a", 1.5)]


def plain_drain(messages, similarity, layers):
    """Templates by comparing with all earlier ones of equal length and first tokens; no limit of branches is met."""
    made, out = [], []
    for m in messages:
        t = m.split()
        lead = lambda x: [WILD if any(c.isdigit() for c in w) else w for w in x[:layers]]
        best = None
        for k, (initial, now) in enumerate(made):
            if len(initial) == len(t) > layers and lead(initial) == lead(t):
                s = (sum(a == b != WILD for a, b in zip(now, t)) / len(t), now.count(WILD))
                if best is None or s > best[0]:
                    best = (s, k)
        if best and best[0][0] >= similarity:
            made[best[1]] = (made[best[1]][0], [a if a == b else WILD for a, b in zip(made[best[1]][1], t)])
            out.append(best[1])
        else:
            made.append((t, t))
            out.append(len(made) - 1)
    return out, [" ".join(x[1]) for x in made]


def test_templates(spark):
    messages = [f"user {w} logged {x} from host{k % 3}" for k, (w, x) in enumerate(zip("abcabcddd", ["in", "in", "out"] * 3))] + ["7 items", "8 items", "one", "one", "disk full now", "disk slow now"]
    miner = Miner(0.5, 4)
    assert ([miner.add(m.split()).number for m in messages], [" ".join(t.tokens) for t in miner.templates]) == plain_drain(messages, 0.5, 1)
    again = Miner(0.5, 4)
    for t in miner.templates:
        again.restore(t.initial, t.tokens, t.n)
    assert again.add("disk gone now".split()).number == miner.add("disk gone now".split()).number
    df = spark.createDataFrame([(k, k, "s", "INFO" if k % 2 else "WARN", m, m) for k, m in enumerate(messages)], "seq long, ts long, service string, level string, masked string, line string")
    from tidemark.operators.templates import mine

    rows, found = mine(df)
    numbers = {r.seq: r.template for r in rows.collect()}
    for side in (0, 1):
        part = [k for k in range(len(messages)) if k % 2 == side]
        want, texts = plain_drain([messages[k] for k in part], 0.5, 1)
        groups = {}
        for k, w in zip(part, want):
            groups.setdefault(w, set()).add(numbers[k])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(texts)
    firsts = [r.first_ts for r in found.orderBy("template").collect()]
    assert firsts == sorted(firsts) and found.agg(F.sum("n")).first()[0] == len(messages)


def test_equal_messages_pass_the_fold_once_a_block(spark, monkeypatch):
    """Templates that change between equal messages, over many blocks and two batches, against a line at a time."""
    import random

    from tidemark.operators import templates

    monkeypatch.setattr(templates, "BLOCK", 50)
    rng = random.Random(4)
    words = ["a", "b", "c", "<*>", "7", "e9"]
    messages = ["", "   "] + [" ".join(rng.choice(words[: 2 + k // 150]) for _ in range(rng.randint(1, 5))) for k in range(600)]
    rows = [(k * 3, 1000 + k * 7 % 91, "s" if k % 5 else None, "INFO", m, f"line {k}") for k, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "seq long, ts long, service string, level string, masked string, line string").repartition(3)
    miners, want, kept = {}, {}, {}
    for seq, ts, service, _, m, line in rows:
        t = miners.setdefault(service, Miner()).add(m.split())
        want[seq] = (service, t.number)
        one = kept.setdefault((service, t.number), {"template": len(kept) + 1, "service": service, "level": "INFO", "initial": m, "n": 0, "first_ts": ts, "last_ts": ts, "example": line})
        one |= {"n": one["n"] + 1, "first_ts": min(ts, one["first_ts"]), "last_ts": max(ts, one["last_ts"]), "text": " ".join(t.tokens)}
    want = {seq: kept[x]["template"] for seq, x in want.items()}
    got, found = templates.mine(df)
    assert {x.seq: x.template for x in got.collect()} == want
    assert sorted((x.asDict() for x in found.collect()), key=lambda x: x["template"]) == [{c: x[c] for c in templates.KEPT} for x in kept.values()]
    first, early = templates.mine(df.filter("seq <= 777"))
    second, both = templates.mine(df.filter("seq > 777"), known=early)
    assert {x.seq: x.template for x in first.union(second).collect()} == want
    assert sorted((x.asDict() for x in both.collect()), key=lambda x: x["template"]) == [{c: x[c] for c in templates.KEPT} for x in kept.values()]
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "collect_list" not in plan  # lines do not pass the fold, what it gave is read


def attr(key, **value):
    return {"key": key, "value": value}


def test_otlp_records(spark):
    body = {"resourceLogs": [{"resource": {"attributes": [attr("service.name", stringValue="shop"), attr("zone", stringValue="r")]}, "scopeLogs": [{"scope": {"attributes": [attr("zone", stringValue="s")]}, "logRecords": [
        {"timeUnixNano": "1790586000999999999", "severityNumber": 17, "body": {"stringValue": "paid total=3"}, "attributes": [attr("http.route", stringValue="/pay")]},
        {"timeUnixNano": "0", "observedTimeUnixNano": "1790586001000000000", "severityText": "Note", "body": {"intValue": "5"}, "attributes": [attr("zone", stringValue="x")]}, {"body": {"stringValue": "no time"}}]}]}]}
    df = lines(spark, [json.dumps(body), "broken"]).withColumnRenamed("value", "body")
    got, bad = otlp.log_records(df)
    a, b = got.orderBy("seq").collect()
    assert (a.ts, a.service, a.level, a.message, a.fields["http_route"], a.fields["zone"]) == (1790586000, "shop", "ERROR", "paid total=3", "/pay", "s")
    assert (b.ts, b.level, b.message, b.fields["zone"]) == (1790586001, "Note", "5", "x")
    assert {r.reason: r.n for r in bad.collect()} == {"no time": 1, "not readable": 1}
    again = spark.createDataFrame([(1, "x", 0), (2, "x", 3000), (3, "y", 3000), (4, "x", 9000)], "seq long, body string, received long")
    assert sorted(r.seq for r in otlp.new_requests(again, "logs").collect()) == [1, 3, 4]
    # A refused copy does not renew the memory.
    third = spark.createDataFrame([(1, "x", 0), (2, "x", 3000), (3, "x", 6000), (4, "x", 9000)], "seq long, body string, received long")
    assert sorted(r.seq for r in otlp.new_requests(third, "logs").collect()) == [1, 3]
    known = otlp.new_requests(third, "logs").filter("seq = 3").select("digest", "received")
    assert sorted(r.seq for r in otlp.new_requests(third.filter("seq = 4"), "logs", known).collect()) == []


def test_times_of_lines(spark):
    from tidemark.sources import loglines

    given = ["2026-01-02T03:04:05,123Z", "2026-01-02T03:04:05.123Z", "2026-01-02 03:04:05,5", "2026-01-02T03:04:05+01:00", "1767323045", "nothing"]
    got = [x.s for x in spark.createDataFrame(list(enumerate(given)), "k int, t string").orderBy("k").select(loglines.seconds(F.col("t")).alias("s")).collect()]
    t = 1767323045
    assert got == [t, t, t if got[2] is not None else None, t - 3600, t, None]


def test_lines_are_numbered_over_blocks_of_files(spark, tmp_path):
    from tidemark.sources import files

    (tmp_path / "a.txt").write_text("".join(f"a{k}\n" for k in range(5000)))
    (tmp_path / "b.txt").write_text("b0\n\nb2")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = sorted(map(tuple, files.numbered_lines(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate([*(f"a{k}" for k in range(5000)), "b0", "", "b2"]))


def point(series, t, start, total):
    p = {"timeUnixNano": str(t * 10**9), "startTimeUnixNano": str(start * 10**9), "asInt": str(total), "attributes": [attr("q", stringValue=series)]}
    return json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "hits", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [p]}}]}]}]})


def test_otlp_deltas(spark):
    day = 86400
    given = [("a", 100, 50, 7), ("a", 110, 50, 9), ("a", 105, 50, 8), ("a", 120, 50, 4), ("a", 130, 125, 6), ("b", 100, 90, 3), ("b", 110, 90, 3), ("a", 130 + 8 * day, 125, 20), ("a", 140 + 8 * day, 125, 21)]
    df = lines(spark, [point(*g) for g in given]).withColumnRenamed("value", "body")
    s = parse('stream hits_in from metrics "hits" { key q text value hits real }').streams[0]
    pts, _ = otlp.points(df)
    got, bad = otlp.metric_events(otlp.deltas(pts, 60), s)
    assert [(r.q, r.ts, r.hits) for r in got.orderBy("seq").collect()] == [("a", 110, 2.0), ("a", 120, 4.0), ("a", 130, 6.0), ("b", 100, 3.0), ("b", 110, 0.0), ("a", 130 + 8 * day, 20.0), ("a", 140 + 8 * day, 1.0)]
    assert bad.count() == 0


def test_redaction(spark):
    body = "x AKIA" + "A1" * 8 + " aws_SECRET_access_key = '" + "k" * 40 + "' ghp_" + "z" * 36 + " sk-proj-" + "q" * 40 + " xoxb-" + "1" * 12 + " AUTHORIZATION: bearer " + "t" * 20 + " clean sk-short"
    masked, n = redact(F.col("t"))
    row = spark.createDataFrame([(body,), ("nothing",), (None,)], "t string").select(masked.alias("m"), n.alias("n")).collect()
    assert row[0].n == 6 and row[0].m == "x [redacted aws-key-id] aws_SECRET_access_key = '[redacted aws-secret]' [redacted github-token] [redacted api-key] [redacted slack-token] AUTHORIZATION: bearer [redacted bearer-token] clean sk-short"
    assert row[1].n == 0 and row[1].m == "nothing" and row[2].m is None


def test_incidents_of_a_minute_are_judged_once(spark):
    """As many fingerprints are computed as there are minutes, and joined without a broadcast."""
    import contextlib
    import io

    rows = [(w, "web", "INFO", 1, 1 + 40 * (w // 3600 % 3 == 0)) for w in range(0, 40000, 60) if w % 420]
    df = spark.createDataFrame(rows, "w long, service string, level string, template long, n long")
    incidents = spark.createDataFrame([(k, k * 7) for k in range(6000)], "id long, started long")
    prints = dejavu.incident_fingerprints(df, incidents)
    n, want = {w: x for w, *_, x in rows}, {}
    for k in range(6000):
        since = k * 7 // 60 * 60
        now = (n.get(since, 0) + n.get(since + 60, 0)) / 2
        hour = sorted((n.get(w, 0) for w in range(since - 3600, since, 60)), reverse=True)
        usual = (hour[29] + hour[30]) / 2
        if abs(now - usual) >= 6 and max((now + 2) / (usual + 2), (usual + 2) / (now + 2)) >= 3:
            want[k] = (now, usual)
    assert len(want) > 500 and {x.incident: (x.now_rate, x.usual_rate) for x in prints.collect()} == want
    with contextlib.redirect_stdout(io.StringIO()) as out:
        prints.explain()
    joins = [x for x in out.getvalue().splitlines() if "Join [since" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_runs(spark):
    def m(role, source, tokens, at, raw):
        return (raw, role, source, tokens, at)

    runs = [("r1", "repo", "m", 1000, "[T]", 5, [m("system", "system", 10, 0, "S"), m("user", "task", 3, 1, "U"), m("assistant", "assistant", 4, 20, "A1"), m("tool", "tool:ls", 8, 30, "O"), m("assistant", "assistant", 2, 50, "A2"), m("user", "task", 1, 900, "U"), m("assistant", "assistant", 6, 910, "A3")])]
    df = spark.createDataFrame(runs, traces.RUN)
    c = traces.calls(df).orderBy("call").collect()
    assert [(x.call_id, x.ts, x.input_tokens, x.cached_tokens, x.output_tokens) for x in c] == [("r1#1", 1020, 18, 0, 4), ("r1#2", 1050, 30, 18, 2), ("r1#3", 1910, 33, 0, 6)]
    parts = {x.part_id: (x.tokens, x.cached_tokens, x.output_tokens) for x in traces.context(df).collect()}
    assert parts["r1#2/system"] == (10, 10, 0) and parts["r1#2/assistant"] == (4, 0, 0) and parts["r1#2/tools"] == (5, 5, 0) and parts["r1#3/task"] == (4, 0, 0) and parts["r1#1/output"] == (0, 0, 4)
    assert "r1#1/tool:ls" not in parts
    kept, _ = traces.pieces(df)
    assert kept.count() == 7 and kept.filter("body = 'U'").first().uses == 2
    got = {x.call_id: x.request for x in traces.rebuild(traces.call_rows(df), kept).collect()}
    assert got["r1#1"] == '{"model":"m","messages":[S,U],"tools":[T]}' and got["r1#3"] == '{"model":"m","messages":[S,U,A1,O,A2,U],"tools":[T]}'


def test_fingerprints(spark):
    now = 36000
    rows = [(w, "web", "ERROR", 1, 2) for w in range(now - 4200, now - 120, 60)] + [(now - 60, "web", "ERROR", 1, 80), (now, "web", "ERROR", 1, 2)] + [(w, "db", "INFO", 2, 40) for w in range(now - 4200, now - 180, 60)] + [(now - 60, "x", "DEBUG", 3, 900)]
    df = spark.createDataFrame(rows, "w long, service string, level string, template long, n long")
    prints = {x.service: x for x in dejavu.fingerprint(df, now + 59).collect()}
    assert set(prints) == {"web", "db"} and prints["web"].score > 0 > prints["db"].score
    incidents = spark.createDataFrame([(7, now - 55, None)], "id long, started long, ended long")
    seen = spark.createDataFrame([("web", "ERROR", 1, now - 30, 1, "late"), ("web", "ERROR", 1, now - 30, 2, "latest"), ("web", "ERROR", 1, now + 9999, 3, "after")], "service string, level string, template long, ts long, seq long, line string")
    saved = dejavu.save(dejavu.incident_fingerprints(df, incidents), incidents, seen)
    assert {x.service: x.example for x in saved.collect()} == {"web": "latest", "db": None}
    again = dejavu.deja_vu(dejavu.fingerprint(df, now + 59), saved).first()
    assert again.incident == 7 and again.similarity > 0.9 and again.shared == 2
