"""OTLP requests in protobuf, as the JSON that the same request would have.

The wire format says only field numbers, so a table names the few that are read; all else is skipped.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Messages in a request and their depth; beyond these a request is refused as unreadable.
MESSAGES, DEPTH = 400_000, 16

# The fields of each message by number, as (name in JSON, kind). A kind that is a message is a
# list of them where it ends in *.
FIELDS = {
    "logs": {1: ("resourceLogs", "ResourceLogs*")},
    "ResourceLogs": {1: ("resource", "Resource"), 2: ("scopeLogs", "ScopeLogs*")},
    "ScopeLogs": {1: ("scope", "Scope"), 2: ("logRecords", "LogRecord*")},
    "LogRecord": {1: ("timeUnixNano", "fixed"), 2: ("severityNumber", "int"), 3: ("severityText", "string"), 5: ("body", "Any"), 6: ("attributes", "Pair*"), 11: ("observedTimeUnixNano", "fixed")},
    "metrics": {1: ("resourceMetrics", "ResourceMetrics*")},
    "ResourceMetrics": {1: ("resource", "Resource"), 2: ("scopeMetrics", "ScopeMetrics*")},
    "ScopeMetrics": {1: ("scope", "Scope"), 2: ("metrics", "Metric*")},
    "Metric": {1: ("name", "string"), 5: ("gauge", "Data"), 7: ("sum", "Data"), 9: ("histogram", "HistogramData"), 10: ("exponentialHistogram", "Other"), 11: ("summary", "Other")},
    "Data": {1: ("dataPoints", "Number*"), 2: ("aggregationTemporality", "int"), 3: ("isMonotonic", "bool")},
    "HistogramData": {1: ("dataPoints", "Histogram*"), 2: ("aggregationTemporality", "int")},
    "Other": {1: ("dataPoints", "Empty*")},
    "Empty": {},
    "Number": {2: ("startTimeUnixNano", "fixed"), 3: ("timeUnixNano", "fixed"), 4: ("asDouble", "double"), 6: ("asInt", "sfixed"), 7: ("attributes", "Pair*")},
    "Histogram": {2: ("startTimeUnixNano", "fixed"), 3: ("timeUnixNano", "fixed"), 4: ("count", "fixed"), 5: ("sum", "double"), 9: ("attributes", "Pair*"), 11: ("min", "double"), 12: ("max", "double")},
    "Resource": {1: ("attributes", "Pair*")},
    "Scope": {1: ("name", "string"), 3: ("attributes", "Pair*")},
    "Pair": {1: ("key", "string"), 2: ("value", "Any")},
    "Any": {1: ("stringValue", "string"), 2: ("boolValue", "bool"), 3: ("intValue", "signed"), 4: ("doubleValue", "double"), 5: ("arrayValue", "List"), 6: ("kvlistValue", "Pairs"), 7: ("bytesValue", "bytes")},
    "List": {1: ("values", "Any*")},
    "Pairs": {1: ("values", "Pair*")},
}


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value & (2**64 - 1), at
        if shift > 63:
            raise ValueError("a number is too long")


class _Reader:
    def __init__(self):
        self.left = MESSAGES

    def message(self, data: memoryview, kind: str, depth: int = 0) -> dict:
        self.left -= 1
        if depth > DEPTH or self.left < 0:
            raise ValueError("too deep or too large")
        out, at = {}, 0
        while at < len(data):
            tag, at = _varint(data, at)
            wire = tag & 7
            if wire == 0:
                raw, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
                raw, at = bytes(data[at : at + size]), at + size
            elif wire == 2:
                size, at = _varint(data, at)
                raw, at = data[at : at + size], at + size
                if len(raw) != size:
                    raise ValueError("cut short")
            else:
                raise ValueError("unknown wire type")
            if at > len(data):
                raise ValueError("cut short")
            name, of = FIELDS[kind].get(tag >> 3, (None, None))
            if name is None:
                continue
            if of[0].isupper():
                value = self.message(raw, of.rstrip("*"), depth + 1)
            elif of == "string":
                value = bytes(raw).decode()
            elif of == "bytes":
                value = base64.b64encode(bytes(raw)).decode()
            elif of == "double":
                (value,) = struct.unpack("<d", raw)
            elif of in ("fixed", "sfixed"):
                value = str(struct.unpack("<Q" if of == "fixed" else "<q", raw)[0])
            elif of == "signed":
                value = str(raw - 2**64 if raw >= 2**63 else raw)
            else:
                value = bool(raw) if of == "bool" else raw
            if of.endswith("*"):
                out.setdefault(name, []).append(value)
            else:
                out[name] = value
        return out


def to_json(data: bytes, signal: str) -> str:
    """signal is logs or metrics. ValueError where data is no such request."""
    try:
        return json.dumps(_Reader().message(memoryview(data), signal))
    except (IndexError, TypeError, struct.error, UnicodeDecodeError) as e:
        raise ValueError(f"not readable: {e}") from None


def decode(requests: DataFrame, signal: str) -> DataFrame:
    """(seq, body) in JSON of requests (seq, body) in protobuf; what cannot be read has a null body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    out.append(None if data is None else to_json(data, signal))
                except ValueError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["seq", "body"])

    return requests.select("seq", "body").mapInArrow(run, "seq long, body string")
