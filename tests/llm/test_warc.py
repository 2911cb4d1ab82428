import base64
import hashlib
import io
import struct
import zipfile

import pytest

from scoreforge.llm import warc as W

from .conftest import SF001


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def check(rows, pages):
    least = {}
    for i, html in pages:
        if i is not None:
            d = digest(html)
            least[d] = min(least.get(d, i), i)
    assert len(rows) == len(pages)
    want = []
    for i, html in pages:
        d = digest(html)
        revisit = d in least and (i is None or i > least[d])
        want.append((i, len((html or "").encode()), d, "revisit" if revisit else "response", least[d] if revisit else None))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def round_trip(pages, **options):
    return W.read_packages(W.write_packages(pages, W.packages_folder(pages), **options)).collect()


def test_round_trip_of_the_table(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    check(round_trip(pages, package_bytes=50_000), [(r["page_id"], r["html"]) for r in pages.collect()])


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nWARC-Type: x", "<p>x</p>"), (3, "u", "<p>x</p>"), (9, "u", "<p>x</p>"),
            (None, "u", "<p>x</p>"), (None, "u", "only here"), (5, "u", "é\U0001F600" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' least", "1 digest")
    check(round_trip(pages), [(i, h) for i, _, h in rows])
    assert round_trip(pages.limit(0)) == []
    small = round_trip(pages, least_bytes=100)
    assert all(r["record_type"] == "response" for r in small)


def test_packages_are_plain_zips_and_records_have_their_fields(tmp_path):
    path = str(tmp_path / "p" / "one.zip")
    writer = W.PackageWriter(path, 6)
    for i, text in enumerate(("first", "second")):
        writer.add(W.record(i, f"http://x/{i}", text.encode(), None)[0])
    writer.add(W.record(2, None, b"first", 0)[0])
    writer.close()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert {m.filename: m.compress_type for m in z.infolist()} == {W.DATA: 0, W.INDEX: 0}
    reader = W.PackageReader(path)
    records = [reader.record(*place) for place in reader.records(read=7)]
    assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"first" in records[0] and b"first" not in records[2]
    assert W.parsed(records[2]) == {"page_id": 2, "payload_bytes": 5, "payload_digest": digest("first"),
                                    "record_type": "revisit", "refers_to": 0}


def test_zip64_directories_and_damage(tmp_path):
    """A directory whose counts, sizes and offsets all stand in ZIP64 fields."""
    body = b"0123456789"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, W._FULL32, W._FULL32, 1, 20) + b"m" + struct.pack(
        "<HHQQ", 1, 16, 10, 10)
    extra = struct.pack("<HHQQQ", 1, 24, 10, 10, 5)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, W._FULL32, W._FULL32, 1, len(extra), 0, 0, 0,
                        0, W._FULL32) + b"m" + extra
    head = b"junk!" + local + body
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(head))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(head) + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, W._FULL16, W._FULL16, W._FULL32, W._FULL32, 4) + b"note"
    path = tmp_path / "wide.zip"
    path.write_bytes(head + entry + end64 + locator + end)
    reader = W.PackageReader(str(path))
    start, length = reader.members["m"]
    assert reader._range(start, length) == body
    path.write_bytes(b"nothing here")
    with pytest.raises(ValueError):
        W.PackageReader(str(path))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", "a" * 100)
    path.write_bytes(packed.getvalue())
    with pytest.raises(ValueError, match="not stored"):
        W.PackageReader(str(path))
