import json

import pytest
from pyspark.sql import functions as F

from tidemark import dashboards, migrate
from tidemark.policy import parse
from tidemark.read import tools
from tidemark.state import Store
from tidemark.streaming import ingest
from tests.test_streams import POLICY, START, frame, made


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('state')}/s")
    s.create(POLICY)
    ingest.ingest(s, {"latency": frame(spark, made(5, 900))})
    return s


def test_windows_pick_a_rollup_and_merge_it(store):
    a, b = START // 60 * 60, START // 60 * 60 + 600
    rows, more = tools.get_windows(store, "latency", a, b, every=120, by=[], percentiles={"ms": [0.5, 0.99]}).take()
    events = [r for r in made(5, 900) if a <= r[1] < b]
    assert sum(r.n for r in rows) == len(events) and not more and all(r.w % 120 == 0 for r in rows)
    assert all(r.ms_min <= r.ms_p50 * 1.02 and r.ms_p99 <= r.ms_max * 1.02 for r in rows)
    answer = tools.get_windows(store, "latency", a + 5, b, every=60)
    assert any("whole windows" in n for n in answer.notes)
    s = parse(POLICY).streams[0]
    assert tools.choose(s, 0, 600, None, 600)[0].res == 10 and tools.choose(s, 0, 7200, None, 7200)[1] <= 7200
    assert tools.choose(s, 0, 7200, 3600, 7200, "ms")[0].res == 3600
    with pytest.raises(ValueError):
        tools.choose(s, 0, 7200, 15, 7200)


def test_answers_kept_and_text(store):
    text = tools.csv_text(tools.get_answer(store, "requests"))
    assert text.splitlines()[0] == "endpoint,value" and len(text.splitlines()) == 4
    one = tools.get_answer(store, "requests", where={"endpoint": "a"})
    assert one.rows.columns == ["value"] and len(one.take()[0]) == 1
    day = tools.get_answer(store, "day_open", period="2026")
    assert day.rows.columns == ["endpoint", "period", "value"]
    assert tools.get_kept(store, "latency", "anomalies").rows.count() >= 0
    assert tools.get_kept(store, "latency", "samples", where={"endpoint": ["a", "b"]}).rows.filter("endpoint = 'c'").count() == 0
    assert "stream latency" in tools.describe(store) and len(tools.catalogue(parse(POLICY))) == 12
    assert tools.number_text(1234567890123.5) == "1234567890000" and tools.number_text(1e-7) == "0.0000001" and tools.number_text(0.1 + 0.2) == "0.3"
    with pytest.raises(ValueError):
        tools.get_answer(store, "nothing")
    with pytest.raises(ValueError):
        tools.get_answer(store, "requests", where={"nothing": 1})


def test_one_query_and_nothing_else(store):
    got, _ = tools.query(store, "SELECT endpoint, sum(n) AS n FROM latency_win WHERE res = 3600 GROUP BY 1 -- ; note").take()
    assert sum(r.n for r in got) == 900
    for bad in ("DROP TABLE latency_win", "SELECT 1; SELECT 2", "CREATE TABLE t AS SELECT 1", "INSERT INTO t VALUES (1)", "SET a = b"):
        with pytest.raises(Exception):
            tools.query(store, bad)


def test_migration(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/m")
    s.create(POLICY)
    ingest.ingest(s, {"latency": frame(spark, made(6, 200))})
    new = POLICY.replace("rollup 1h keep forever", "rollup 5m keep 1d\n  rollup 1h keep forever").replace("raw keep 1h", "raw keep 2h") + "\nprecompute worst = max(latency.ms) per day\nprecompute requests_too = count(latency) by endpoint\n"
    plan, m = migrate.migrate(s, new, dry_run=True)
    assert len(plan.added) == 3 and plan.changed == ["stream latency: raw keep"] and len(plan.notes) == 1 and s.read().policy == POLICY
    migrate.migrate(s, new)
    m = ingest.ingest(s, {"latency": frame(spark, [(k + 200, *r[1:]) for k, r in enumerate(made(7, 100))])})
    assert s.table(m, "latency_win").filter("res = 300").agg(F.sum("n")).first()[0] == 100
    assert s.table(m, "latency_win").filter("res = 3600").agg(F.sum("n")).first()[0] == 300
    for bad in (POLICY.replace("key endpoint text", "key endpoint integer"), POLICY.replace("  rollup 10s keep 1d\n", ""), POLICY.replace("anomalies ms log", "anomalies ms"), POLICY.replace("precompute avg_ms = avg(latency.ms) by endpoint\n", "")):
        with pytest.raises(ValueError):
            migrate.migrate(s, bad)
    assert len(s.read().migrations) == 1


def test_dashboard():
    board = {"title": "Shop", "panels": [{"title": "p95", "measure": "P95", "field": "ms", "by": ["route"], "where": {"service": "web"}}, {"title": "avg", "measure": "avg", "field": "ms", "by": ["route"], "where": {"service": "web"}}, {"title": "errors", "type": "toplist", "measure": "count", "by": ["template"], "where": {"level": "ERROR"}}]}
    text, plans = dashboards.import_dashboard(json.dumps(board))
    p = parse(text)
    assert [s.name for s in p.streams] == ["lines", "errors", "web_ms_by_route", "error_by_template"]
    assert [x[1] for x in plans] == ["web_ms_by_route", "web_ms_by_route", "error_by_template"]
    assert p.streams[2].rollups[0].quantiles == ["ms"] and p.streams[2].anomalies.z == 4 and p.streams[3].keys[0].type == "integer"
    for bad in ({}, {"panels": [{"measure": "median"}]}, {"panels": [{"measure": "count", "field": "x"}]}, {"panels": [{"measure": "sum"}]}, {"panels": [{"measure": "count", "by": ["A"]}]}):
        with pytest.raises(dashboards.DashboardError):
            dashboards.import_dashboard(json.dumps(bad))
