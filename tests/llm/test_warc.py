import glob
import hashlib
import re
import zlib

import pytest

from vitrine.llm import warc


def pages(spark):
    long = "<p>" + "é" * 200
    rows = [(5, "http://a/1", long), (3, "http://a/ 2\n3", long), (9, None, long), (1, "http://b", None), (2, "", ""), (4, "http://c", "x" * 99), (6, "http://c", "x" * 99), (7, "u", "x" * 100), (8, "u", "x" * 100), (8, "u", "x" * 100), (None, "u", "x" * 100), (None, "z", "only without an id" * 9), (None, "z", "only without an id" * 9), (10, "http://x", "WARC/1.0\r\n\r\nfiledesc://\n\n1 2 3 4 5\n"), (11, "http://x", "big " * 300_000)]
    return rows, spark.createDataFrame([(*r, "t", "d") for r in rows], "page_id long, url string, html string, record_type string, digest string").repartition(3)


@pytest.mark.parametrize(("version", "roll", "marks"), [(1, warc.ROLL, warc.MARKS), (2, 1500, 2)])
def test_round_trip(spark, monkeypatch, version, roll, marks):
    """Also with a file for every 1,500 bytes, and revisits broadcast two at a time."""
    monkeypatch.setattr(warc, "MARKS", marks)
    rows, df = pages(spark)
    found = warc.archive(df, version, roll=roll).collect()
    first = {}
    for key, _, html in rows:
        if key is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, key), key)
    expected = []
    for key, _, html in rows:
        data = (html or "").encode()
        it = first.get(html)
        again = it is not None and key != it
        expected.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", it if again else None))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(expected, key=str)
    assert all(r["date"] == warc.warc_date(warc.page_date(r["page_id"])) for r in found) and len({r["date"] for r in found}) > 10
    record = {r["page_id"]: r["record_id"] for r in found}
    assert all(r["refers_to_record"] == (record[r["refers_to"]] if r["record_type"] == "revisit" else None) for r in found)
    assert {r["uri"] for r in found} >= {"http://a/%202%0A3", "urn:none"}
    assert len({r["record_id"] for r in found if r["page_id"] and r["page_id"] != 8}) == 10


def test_empty(spark):
    _, df = pages(spark)
    assert warc.archive(df.limit(0)).count() == 0


def members(data):
    """What each gzip member holds."""
    found = []
    while data:
        one = zlib.decompressobj(31)
        found.append(one.decompress(data))
        assert one.eof
        data = one.unused_data
    return found


def test_archives_are_well_formed(spark, tmp_path):
    _, df = pages(spark)
    big = spark.createDataFrame([(77, "http://big", "y" * (17 << 20))], "page_id long, url string, html string")  # its length's highest byte isn't 0
    warc.write_arc(df.select("page_id", "url", "html").unionByName(big), f"file://{tmp_path}/arc", roll=3000)
    warc.convert_arc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc", roll=3000)
    n, files = 0, glob.glob(f"{tmp_path}/arc/roll=*/part-*")
    for f in files:
        parts = [m for m in members(open(f, "rb").read()) if m]
        assert parts[0].startswith(b"filedesc://pages-") and all(len(list(warc.parse_arc(parts[0] + m))) == 1 for m in parts[1:])
        assert len(parts) == 2 or sum(map(len, parts[1:])) <= 3000
        n += len(parts) - 1
    assert n == 16 and len(files) > 3
    n = 0
    for f in glob.glob(f"{tmp_path}/warc/pass-0/roll=*/part-*"):
        parts = [m for m in members(open(f, "rb").read()) if m]
        for i, m in enumerate(parts):
            ((fields, block),) = warc.parse_warc(m)
            assert m.startswith(b"WARC/1.1\r\n") and m.endswith(warc.END) and fields["warc-record-id"].startswith("<urn:uuid:") and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"])
            assert (fields["warc-type"] == "warcinfo") == (i == 0) and int(fields["content-length"]) == len(block)
            if fields["warc-type"] == "revisit":
                assert {"warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date", "warc-profile"} <= fields.keys() and block.endswith(warc.END)
        n += len(parts) - 1
    assert n == 16


def test_parser():
    def arc(version, *records):
        return warc.arc_start(version, "x", "19960101000000") + b"\n" + b"".join(warc.arc_header(version, u, "1.2.3.4", "199601", "text/html", len(b)) + b + b"\n" for u, b in records)

    for version in (1, 2):
        found = list(warc.parse_arc(arc(version, ("http://a b c", b"\xff\x00\n\n"), ("http://d", b""))))
        assert [(r.url, r.ip, r.date, r.block) for r in found] == [("http://a b c", "1.2.3.4", "199601", b"\xff\x00\n\n"), ("http://d", "1.2.3.4", "199601", b"")]
        assert found[0].http == (b"", b"\xff\x00\n\n") and found[0].page_id is None
        assert b"WARC-Type: resource" in warc.warc_record(found[0], None) and b"WARC-Date: 1996-01-01T00:00:00Z" in warc.warc_record(found[0], None)
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(arc(1, ("u", b"abc"))[:-3]))
    with pytest.raises(ValueError, match="fields"):
        list(warc.parse_arc(arc(2) + b"http://a 1.2.3.4 1996 text/html 3\nabc\n"))
    with pytest.raises(ValueError, match="version"):
        list(warc.parse_arc(b"filedesc://x 0.0.0.0 1996 text/plain 9\n7 0 what\n\n"))
    assert list(warc.parse_arc(b"")) == []


def test_damage_is_noticed(spark, tmp_path):
    (tmp_path / "w").mkdir()
    record = warc.warc_record(warc.ArcRecord("u", "i", "20000101000000", "t", b"HTTP/1.0 200 OK\r\n\r\nbody"), None)
    (tmp_path / "w" / "part-0").write_bytes(record.replace(b"body", b"bodx") + warc.END)
    with pytest.raises(Exception, match="differ"):
        warc.read_warc(spark, f"file://{tmp_path}/w").collect()
