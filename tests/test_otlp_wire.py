import json
import struct

import pytest

from tidemark.sources import otlp, otlp_wire


def varint(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def put(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 1) + struct.pack("<d", value)
    return varint(number << 3) + varint(value)


def fixed(number, value):
    return varint(number << 3 | 1) + struct.pack("<Q", value)


def pair(key, value):
    return put(1, key) + put(2, value)


RECORD = fixed(1, 1790586000_500000000) + put(2, 13) + put(5, put(1, b"paid")) + put(6, pair(b"http.route", put(1, b"/pay"))) + put(6, pair(b"n", put(3, 2**64 - 5))) + put(99, b"skipped")
LOGS = put(1, put(1, put(1, pair(b"service.name", put(1, b"shop")))) + put(2, put(2, RECORD)))
POINT = fixed(2, 10**9) + fixed(3, 2 * 10**9) + put(4, 2.5) + put(7, pair(b"q", put(1, b"a")))
METRICS = put(1, put(2, put(2, put(1, b"depth") + put(5, put(1, POINT)))))


def test_requests_read_as_their_json(spark):
    got = json.loads(otlp_wire.to_json(LOGS, "logs"))
    record = got["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]
    assert record["timeUnixNano"] == "1790586000500000000" and record["attributes"][1]["value"] == {"intValue": "-5"}
    df = spark.createDataFrame([(0, LOGS), (1, b"\xff\xff"), (2, LOGS[:-3])], "seq long, body binary")
    rows, bad = otlp.log_records(otlp_wire.decode(df, "logs"))
    one = rows.first()
    assert rows.count() == 1 and (one.ts, one.service, one.level, one.message, one.fields["http_route"], one.fields["n"]) == (1790586000, "shop", "WARN", "paid", "/pay", "-5")
    assert bad.first().n == 2
    pts, _ = otlp.points(otlp_wire.decode(spark.createDataFrame([(0, METRICS)], "seq long, body binary"), "metrics"))
    p = pts.first()
    assert (p.metric, p.kind, p.ts, p.value, p.fields["q"]) == ("depth", "gauge", 2, 2.5, "a")


def test_damage_is_an_error():
    for cut in range(1, len(LOGS)):
        with pytest.raises(ValueError):
            otlp_wire.to_json(LOGS[:cut], "logs")
    deep = b""
    for _ in range(40):
        deep = put(5, put(1, deep))
    with pytest.raises(ValueError):
        otlp_wire.to_json(put(1, put(2, put(2, put(5, deep)))), "logs")


def test_nested_values_are_json(spark):
    given = {"values": [{"stringValue": "a"}, {"intValue": "5"}, {"boolValue": True}]}
    pairs = {"values": [{"key": "k", "value": {"stringValue": "v"}}, {"key": "n", "value": {"intValue": "1"}}]}
    df = spark.createDataFrame([(json.dumps(given, separators=(",", ":")),), (json.dumps(pairs, separators=(",", ":")),)], "t string")
    assert [r.p for r in df.select(otlp.plain(df.t).alias("p")).collect()] == ['["a",5,true]', '{"k":"v","n":1}']
