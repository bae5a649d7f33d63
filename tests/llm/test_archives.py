"""Legacy archives, their conversion, and the WARC files read back."""

import gzip
import hashlib

import pytest

from assaykit.llm import warc

DATE = "20200101000000"


def arc(version, blocks, name="f.arc"):
    return warc.arc_head(version, name, DATE) + b"".join(
        warc.arc_record(version, f"http://x.org/{i}", "1.2.3.4", DATE, b, name, 0) for i, b in enumerate(blocks))


TRICKY = [b"", b"\n", b"http://y.org/ 1.2.3.4 20200101000000 text/html 5\nabcde\n", b"\x00\xff\r\n\r\nWARC/1.1\r\n", b"x" * 70_000]


@pytest.mark.parametrize("version", [1, 2])
def test_declared_lengths_rule(version):
    data = arc(version, TRICKY)
    for raw in (data, gzip.compress(data), b"\x00".join([gzip.compress(data[:0]), gzip.compress(data)])):
        found = list(warc.parse_arc(raw))
        assert [r["block"] for r in found] == TRICKY
        assert [r["url"] for r in found] == [f"http://x.org/{i}" for i in range(len(TRICKY))]
    fields = set(warc.ARC_FIELDS[version])
    assert fields <= set(found[0])


def test_broken_archives_are_refused():
    data = arc(1, [b"abc"])
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(arc(1, [b"abc"]) + b"http://z 1.1.1.1 20200101000000 text/html 200 - - 0 f 1\nx\n"))
    with pytest.raises(ValueError):
        list(warc.split_members(gzip.compress(b"x" * 1000)[:-20]))


def test_pages_with_a_filedesc_url_are_kept(spark):
    rows = [(1, "filedesc://x", "a" * 120), (2, "filedesc:", "b"), (3, "http://x.org/", "a" * 120)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted(tuple(r) for r in warc.report(pages).collect()) == sorted(expected([(i, h) for i, _, h in rows]), key=str)


def test_members_round_trip():
    parts = [b"", b"a", b"b" * 200_000, bytes(range(256)) * 50]
    assert list(warc.split_members(b"\x00".join(map(warc.member, parts)) + b"\x00\x00", step=100)) == parts


def test_identities():
    digest, record = warc.response("http://x.org/", "1.2.3.4", "20200102030405", "7", warc.http_block(7, "<p>"))
    (fields, block), = warc.parse_warc(record)
    assert digest == hashlib.sha256(b"<p>").hexdigest() and fields["warc-payload-digest"] == f"sha256:{digest}"
    assert fields["warc-date"] == "2020-01-02T03:04:05Z" and fields["warc-type"] == "response"
    assert fields["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    assert fields["warc-record-id"].startswith("<urn:uuid:") and warc.response("http://x.org/", "1.2.3.4", "20200102030405", "7", warc.http_block(7, "<p>"))[1] == record
    assert warc.warc_date("2020") == "2020-01-01T00:00:00Z"


def expected(rows, least=100):
    first = {}
    for i, h in rows:
        raw = (h or "").encode()
        if len(raw) >= least:
            first[raw] = min(first.get(raw, float("inf")), float("inf") if i is None else i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        to = first.get(raw)
        again = to is not None and to != float("inf") and to != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_pages_come_back(spark):
    long, other = "é<p>" * 60, "WARC/1.1\r\n\r\n" * 20
    rows = [(i, long) for i in (9, 4, 7, 11)] + [(1, other), (2, other), (3, "short"), (5, "short"), (6, None), (8, ""), (10, "\x00\x1f\n"), (None, long), (None, other + "!"), (12, other + "!"), (4, long), (13, "z" * 99), (14, "z" * 99), (15, "z" * 100), (16, "z" * 100)]
    urls = ["http://a b/ü", None, "  ", "https://x.org/?q=1"]
    pages = spark.createDataFrame([(i, urls[n % 4], h, "x", "y") for n, (i, h) in enumerate(rows)], "page_id bigint, url string, html string, digest string, record string").repartition(3)
    assert sorted([tuple(r) for r in warc.report(pages).collect()], key=str) == expected(rows)
    assert warc.report(pages.limit(0)).collect() == []


def test_files_are_plain_concatenations_of_members(spark, tmp_path):
    import os
    import subprocess

    contents = [b"first", b"", b"\x00\xff" * 999, os.urandom(1000), b"x" * ((1 << 24) + 5), b"last"]
    rows = spark.createDataFrame([(bytearray(warc.member(c)),) for c in contents], "value binary").coalesce(1)
    warc._write_members(rows, str(tmp_path / "members"))
    (path,) = (tmp_path / "members").glob("part-*")
    assert subprocess.run(["gzip", "-dc"], stdin=path.open("rb"), capture_output=True, check=True).stdout == b"".join(contents)
    expected = [x for c in contents for x in ([c, b""] if len(c) >= 1 << 24 else [c])]
    assert path.read_bytes() == b"".join(map(warc.member, expected))
    assert list(warc.split_members(path.read_bytes())) == expected
