import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from flowgauge.llm import warc
from tests.llm.helpers import prose

LONG = "<html>" + prose(2, 30_000) + "</html>"
ROWS = [(5, "http://a/1", "x" * 100), (3, "http://a/2", "x" * 100), (9, "http://a/3", "x" * 100), (1, "http://a/4", "short"),
        (2, "http://a/5", "short"), (4, None, None), (6, "http://a b/\n7", ""), (7, "u", LONG), (8, "u", LONG), (10, "é", "é" * 50),
        (11, "v", "WARC/1.0\r\n\r\n\r\nURL 1 2 3 4\n" * 9), (12, "v", "\r\n\n" * 40), (13, "w", "é" * 50), (14, "w", "é" * 49)] + [
    (1000 + i, "hot", "h" * 200) for i in range(300)]


def pages(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    for name in ("id", "place", "payload", "head", "text", "number", "record_type", "first", "copies"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def expected(rows):
    first = {}
    for i, _, html in rows:
        h = html or ""
        first[h] = min(first.get(h, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first[html or ""] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out)


@pytest.mark.parametrize("records", [1000, 2])
def test_pages_go_through_both_formats(spark, monkeypatch, records):
    monkeypatch.setattr(warc, "FILE_RECORDS", records)
    rows = ROWS if records == 1000 else ROWS[:14]
    got = warc.archived(pages(spark, rows))
    found = got.select("place", "payload_bytes", "payload_digest", "record_type", "refers_to_place").collect()
    assert sorted(tuple(r) for r in found) == expected(rows)
    if records == 2:
        payloads = {r.place: r.payload for r in got.collect()}
        first = {i: (h or "").encode() for i, _, h in rows}
        assert all(p is None or p == first[i] for i, p in payloads.items())


def test_pages_without_id_and_rows_that_repeat(spark):
    rows = [(None, "u", "z" * 120), (7, "u", "z" * 120), (8, "q", "r" * 150), (8, "q", "r" * 150), (None, None, None)]
    got = [(r.place, r.payload_bytes, r.record_type, r.refers_to_place) for r in warc.archived(pages(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 120, "revisit", 7), (7, 120, "response", None), (8, 150, "response", None),
                                           (8, 150, "response", None), (None, 0, "response", None)], key=str)


def test_nothing_in_nothing_out(spark):
    assert warc.archived(pages(spark, ROWS).limit(0)).count() == 0


V1 = (b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n"
      b"\x00\x00\x00\n\n" b"http://one/ 1.2.3.4 19970102030405 text/html 5\nab\ncd\n" b"dns:one 1.2.3.4 199702 text/dns 3\n\xff\xfe\x00\n")
V2_BODY = b"2 0 Archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
MESSAGE = b"HTTP/1.0 404 Not Found\r\nX-Archive-Place: 12\r\nA: b\r\n\r\n\xe9 body\r\n\r\nend"
V2 = (b"filedesc://new.arc 0.0.0.0 20000101 text/plain 200 - - 0 new.arc %d\n" % len(V2_BODY) + V2_BODY
      + b"\nhttp://two/ 9.9.9.9 20010203040506 text/html 404 abc - 77 new.arc %d\n" % len(MESSAGE) + MESSAGE + b"\n")


def v1():
    body = b"1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n"
    return V1.replace(b"plain 76\n", b"plain %d\n" % (len(body) + 5))


def test_both_versions_are_read_by_declared_lengths():
    one = list(warc.read_arc(v1()))
    assert [(r.url, r.date, r.kind, r.status, r.block) for r in one] == [
        ("http://one/", "19970102030405", "text/html", None, b"ab\ncd"), ("dns:one", "199702", "text/dns", None, b"\xff\xfe\x00")]
    two = list(warc.read_arc(V2))
    assert [(r.url, r.ip, r.status, r.block) for r in two] == [("http://two/", "9.9.9.9", "404", MESSAGE)]


@pytest.mark.parametrize("bad", [v1()[:-4], b"http://no/ 1 2 3 0\n", v1().replace(b"\n1 0 Arch", b"\n3 0 Arch"), V2.replace(b" abc - 77", b" abc 77")])
def test_broken_archives_are_refused(bad):
    with pytest.raises(ValueError):
        list(warc.read_arc(bad))


def test_legacy_bytes_arrive_unchanged_in_warc(spark, tmp_path):
    (tmp_path / "a.arc.gz").write_bytes(gzip.compress(v1()))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(V2))
    out = warc.converted_to_warc(spark, str(tmp_path))
    rows = {r.url: r for r in warc.read_warc(spark, out).collect()}
    assert rows["dns:one"].payload == b"\xff\xfe\x00" and rows["http://one/"].payload == b"ab\ncd"
    assert rows["http://two/"].payload == b"\xe9 body\r\n\r\nend" and rows["http://two/"].place == 12
    assert rows["dns:one"].date == "1997-02-01T00:00:00Z" and rows["http://two/"].date == "2001-02-03T04:05:06Z"
    files = spark.read.format("binaryFile").load(f"{out}/*.gz").collect()
    records = [x for f in files for x in warc.read_warc_records(gzip.decompress(f.content))]
    kinds = {f["warc-target-uri"]: f["content-type"] for f, _ in records}
    assert kinds == {"dns:one": "text/dns", "http://one/": "text/html", "http://two/": "application/http; msgtype=response"}
    assert len({f["warc-record-id"] for f, _ in records}) == 3
    assert {f["warc-record-id"] for f, _ in records} == {r.id for r in warc.converted(spark, str(tmp_path)).select(F.col("id")).collect()}
