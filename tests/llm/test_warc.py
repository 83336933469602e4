import hashlib
import io
import struct
import zipfile

import pytest

from tidemark.llm import warc


def reader(data):
    return lambda start, length: data[max(0, start) : max(0, start) + length]


def zip64(name, body):
    """An archive that needs its ZIP64 directory, as a very large one would."""
    local = warc.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, warc.NO32, warc.NO32, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    at = len(local) + len(body)
    central = warc.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, warc.NO32, warc.NO32, len(name), 28, 0, 0, 0, 0, warc.NO32) + name + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, at + len(central), 1)
    return local + body + central + end64 + locator + warc.END + struct.pack("<HHHHIIH", 0, 0, warc.NO16, warc.NO16, warc.NO32, warc.NO32, 0)


def test_directories():
    data = zip64(b"archive/data.warc.gz", b"payload")
    (m,) = warc.directory(reader(data), len(data))
    at = warc.begins(reader(data), m)
    assert (m.name, m.size, data[at : at + m.size]) == ("archive/data.warc.gz", 7, b"payload")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 in a comment"
        z.writestr("a", b"1" * 10)
        z.writestr("ü", b"2" * 20, zipfile.ZIP_DEFLATED)
    data = out.getvalue()
    a, u = warc.directory(reader(data), len(data))
    assert (a.name, a.size, u.name) == ("a", 10, "ü") and data[warc.begins(reader(data), a) :][:10] == b"1" * 10
    with pytest.raises(ValueError):
        warc.begins(reader(data), u)
    with pytest.raises(ValueError):
        warc.directory(reader(b"not a zip"), 9)


def test_archive_round_trip():
    records = [(str(k), warc.record([("WARC-Type", "response")], bytes([k]) * k * 1000)) for k in range(5)]
    data = warc.archive(records)
    with zipfile.ZipFile(io.BytesIO(data)) as z:  # any ZIP reader can open it
        assert [warc.parse(x)[1] for x in warc.records_of(z.read(warc.DATA))] == [bytes([k]) * k * 1000 for k in range(5)]


def test_pages(spark, tmp_path):
    long, short = "<p>é</p>" * 100, "short"
    rows = [(5, "u5", long, "x"), (3, "u3\nx", long, "x"), (3, None, long, "x"), (9, "u9", short, "x"), (8, "u8", short, "x"), (7, "u7", None, "x"), (None, "n", long, "x"), (-1, "m", "", "x"), (11, "v", "y" * 200_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    written = warc.write_archives(pages, f"file://{tmp_path}/a", roll=1).cache()
    assert sum(x.records for x in written.collect()) == len(rows)
    got = {(x.record_id, x.record_type, x.payload_bytes, x.payload_digest, x.refers_to) for x in warc.read_archives(written, fetch=10).collect()}
    want = set()
    for i, _, html, _ in rows:
        data = (html or "").encode()
        seen = html == long and i != 3
        want.add((f"urn:page:{'null' if i is None else i}", "revisit" if seen else "response", len(data), hashlib.sha256(data).hexdigest(), "urn:page:3" if seen else None))
    assert got == want
    written.unpersist()
    assert warc.read_archives(warc.write_archives(pages.filter("page_id = 99"), f"file://{tmp_path}/b").select("path")).count() == 0


def test_archive_without_index(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/other.warc.gz", b"".join(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<r{k}>")], b"x" * k) for k in range(3)))
    (tmp_path / "c.wacz").write_bytes(out.getvalue())
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/c.wacz",), (None,)], "path string")).collect()
    assert sorted((x.record_id, x.payload_bytes) for x in got) == [("r0", 0), ("r1", 1), ("r2", 2)]
