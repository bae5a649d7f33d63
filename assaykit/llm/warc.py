"""Legacy archives to WARC: ARC 1 and 2 records are parsed and given WARC identities.

``write_arc`` puts pages into ARC files (the legacy form, version 1 or 2 by partition), ``parse_arc``
reads them by the version's header fields and the declared lengths, ``convert`` writes WARC/1.1 files
with synthesised record ids, dates, types and digests, and ``read_warc`` reads those back. WARC files
hold one gzip member per record, ARC files one for many records; files are plain concatenations of
members, and zero bytes between members are passed over when reading. An ARC record's offset counts uncompressed bytes.

Defined cases: null html is an empty payload; a null or blank url becomes ``about:blank``, and blanks
inside one are percent-encoded; repeated page rows are records each; of equal payloads the smallest
page_id is the response, and rows with that same page_id and payload are responses too; a null
page_id is larger than any other and is never referred to unless all are null; an archive without
records holds its description record alone; extra columns of the input are not stored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

#: Bytes from which equal payloads are stored once.
MIN_REVISIT = 100
#: Bytes of ARC records that are compressed together.
MEMBER_BYTES = 1 << 20
#: Fields of a URL record line, by version of the archive (fixed by the ARC format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
SOFTWARE = "assaykit"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:assaykit:warc")
PAD = "\x00"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member of its own, the same bytes at every run."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        z = zlib.decompressobj(31)
        yield z.decompress(view[at:])
        if not z.eof:
            raise ValueError(f"the archive ends inside a record at byte {at}")
        at = len(data) - len(z.unused_data)


def split_members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """``members``, fed in steps, so that what follows a member is not copied over and over."""
    at, end, view = 0, len(data), memoryview(data)
    while at < end:
        if data[at] == 0:
            at += 1
            continue
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= end:
                raise ValueError("the archive ends inside a record")
            parts.append(z.decompress(view[at : at + step]))
            at = min(at + step, end) - len(z.unused_data)
        yield b"".join(parts)


def _safe_url(url: str | None) -> str:
    url = (url or "").strip()
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "about:blank"


def http_block(page_id: int | None, html: str | None) -> bytes:
    body = (html or "").encode()
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode() + body


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that begins an ARC file."""
    titles = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 {SOFTWARE}\n{titles[version]}\n".encode()
    url = f"filedesc://{name}"
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"{url} 0.0.0.0 {date} text/plain {middle}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, block: bytes, name: str, offset: int) -> bytes:
    if version == 1:
        line = f"{url} {ip} {date} text/html {len(block)}\n"
    else:
        line = f"{url} {ip} {date} text/html 200 {hashlib.md5(block).hexdigest()} - {offset} {name} {len(block)}\n"
    return line.encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """URL records of an ARC archive (uncompressed members joined or one member per record).

    The first record tells the version, which tells the fields of every header line; a block ends
    where its declared length says, whatever it holds.
    """
    version = None
    for chunk in split_members(data) if data[:2] == b"\x1f\x8b" else [data]:
        at = 0
        while at < len(chunk):
            if chunk[at : at + 1] == b"\n":
                at += 1
                continue
            end = chunk.index(b"\n", at)
            values = chunk[at:end].decode().split(" ")
            begins = version is None
            if begins:
                length = int(values[-1])
                version = int(chunk[end + 1 : end + 1 + length].split(None, 1)[0])
            fields = ARC_FIELDS[version]
            if len(values) != len(fields):
                raise ValueError(f"{len(values)} fields in a header line of version {version}")
            record = dict(zip(fields, values, strict=True))
            block = chunk[end + 1 : end + 1 + int(record["length"])]
            if len(block) != int(record["length"]):
                raise ValueError("a block is shorter than declared")
            at = end + 1 + len(block)
            # the version block is the first record; a later URL may be anything
            if not begins:
                yield record | {"block": block}


def headers_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and what follows the empty line."""
    head, _, rest = block.partition(b"\r\n\r\n")
    pairs = (x.split(":", 1) for x in head.decode().split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}, rest


def warc_date(date: str) -> str:
    """ISO 8601 of a 14-digit archive date."""
    d = (date + "00000101000000"[len(date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page: str, digest: str) -> str:
    """The same urn for the same record at every run."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url}|{date}|{page}|{digest}')}>"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    body = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
    return warc_record({
        "WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, "", "", ""), "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Filename": name, "Content-Type": "application/warc-fields",
    }, body)


def response(url: str, ip: str, date: str, page: str, block: bytes) -> tuple[str, bytes]:
    """(payload digest, WARC response record) of an archived HTTP response."""
    digest = hashlib.sha256(headers_of(block)[1]).hexdigest()
    return digest, warc_record({
        "WARC-Type": "response", "WARC-Record-ID": record_id(url, date, page, digest), "WARC-Date": warc_date(date),
        "WARC-Target-URI": url, "WARC-IP-Address": ip, "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type": "application/http; msgtype=response",
    }, block)


def revisit(url: str, ip: str, date: str, page: str, digest: str, head: bytes, first: dict) -> bytes:
    """A record that refers to the response holding the same payload; its block is the HTTP header."""
    return warc_record({
        "WARC-Type": "revisit", "WARC-Record-ID": record_id(url, date, page, digest), "WARC-Date": warc_date(date),
        "WARC-Target-URI": url, "WARC-IP-Address": ip, "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(head).hexdigest()}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Refers-To": record_id(first["url"], first["date"], first["page"], digest),
        "WARC-Refers-To-Target-URI": first["url"], "WARC-Refers-To-Date": warc_date(first["date"]),
        "X-Refers-To-Page-Id": first["page"], "Content-Type": "application/http; msgtype=response",
    }, head)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, by declared lengths."""
    for chunk in split_members(data) if data[:2] == b"\x1f\x8b" else [data]:
        at = 0
        while at < len(chunk):
            end = chunk.index(b"\r\n\r\n", at) + 4
            fields, _ = headers_of(chunk[at:end])
            stop = end + int(fields["content-length"])
            if chunk[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            yield fields, chunk[end:stop]
            at = stop + 4


def _write_members(rows: DataFrame, path: str) -> None:
    """Gzip members (column ``value``, binary) to files, one for each partition: the files are the plain
    concatenation of their members.

    A member ends with the size of its content, lowest byte first, so that its last byte is zero below
    16 MiB: the text writer gets members without this byte and puts it back as the line separator. A
    larger member is followed by an empty one, which ends with zero.
    """
    whole = F.when(F.substring("value", -1, 1) == F.lit(b"\x00"), F.col("value")).otherwise(F.concat("value", F.lit(member(b""))))
    cut = F.substring(whole, F.lit(1), F.octet_length(whole) - 1)
    rows.select(cut.cast("string").alias("value")).write.option("lineSep", PAD).text(path)


def _read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, date: str = "20200101000000") -> None:
    """Pages as ARC files below ``path``; even partitions are version 1, odd ones version 2."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        version, name = 1 + at % 2, f"pages-{at:05d}.arc.gz"
        head = arc_head(version, name, date)
        held, size, offset, begun = [head], len(head), len(head), False
        for part in parts:
            out = []
            begun = True
            for page, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                record = arc_record(version, _safe_url(url), "0.0.0.0", date, http_block(page, html), name, offset)
                held.append(record)
                size, offset = size + len(record), offset + len(record)
                if size >= MEMBER_BYTES:
                    out.append(member(b"".join(held)))
                    held, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
        if begun and held:
            yield pa.RecordBatch.from_pydict({"value": pa.array([member(b"".join(held))], pa.binary())})

    _write_members(pages.select("page_id", "url", "html").mapInArrow(write, "value binary"), path)


ARC_ROW = "file string, at bigint, page string, url string, ip string, date string, digest string, bytes bigint, head binary, record binary"


def arc_rows(files: DataFrame, with_records: bool = True) -> DataFrame:
    """Parsed ARC records: identity, payload digest, and (if asked for) the WARC response, compressed."""

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                out: list[dict] = []
                size = 0
                for n, r in enumerate(parse_arc(content.as_py())):
                    fields, body = headers_of(r["block"])
                    page = fields.get("x-page-id", "")
                    row = {"file": path, "at": n, "page": page, "url": r["url"], "ip": r["ip"], "date": r["date"], "bytes": len(body)}
                    if with_records:
                        digest, record = response(r["url"], r["ip"], r["date"], page, r["block"])
                        row |= {"digest": digest, "head": r["block"][: len(r["block"]) - len(body)], "record": member(record)}
                    else:
                        row |= {"digest": hashlib.sha256(body).hexdigest(), "head": None, "record": None}
                    out.append(row)
                    size += len(row["record"] or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    text, number, raw = pa.string(), pa.int64(), pa.binary()
    schema = pa.schema([("file", text), ("at", number), ("page", text), ("url", text), ("ip", text), ("date", text), ("digest", text), ("bytes", number), ("head", raw), ("record", raw)])
    return files.mapInArrow(parse, ARC_ROW)


def convert(files: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """ARC files (path, content) to WARC files below ``path``; equal payloads are stored once.

    What is compared is narrow (digest, page); the decisions go back to the records by their place
    in the archives, which no two records share, so a payload that most pages hold is no hot key.
    """
    narrow = cut_lineage(arc_rows(files, with_records=False).drop("head", "record"))
    long_enough = narrow.where(F.col("bytes") >= min_revisit)
    order = F.struct((F.col("page") == "").alias("none"), F.col("page").try_cast("bigint").alias("number"))
    firsts = long_enough.groupBy("digest").agg(
        F.min(F.struct(order.alias("o"), "page", "url", "date")).alias("first"), F.count("*").alias("n")
    ).where("n > 1").select("digest", F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"))
    again = long_enough.join(firsts, "digest").where("page <> first_page").select("file", "at", "first_page", "first_url", "first_date")
    rows = arc_rows(files).join(again, ["file", "at"], "left")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, begun = f"pages-{TaskContext.get().partitionId():05d}.warc.gz", False
        for part in parts:
            out = [] if begun else [member(warc_info(name))]
            begun = True
            for r in part.to_pylist():
                if r["first_url"] is None:
                    out.append(r["record"])
                else:
                    first = {"url": r["first_url"], "date": r["first_date"], "page": r["first_page"]}
                    out.append(member(revisit(r["url"], r["ip"], r["date"], r["page"], r["digest"], r["head"], first)))
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    slim = rows.select(
        "page", "url", "ip", "date", "digest", "first_page", "first_url", "first_date",
        F.when(F.col("first_url").isNotNull(), F.col("head")).alias("head"), F.when(F.col("first_url").isNull(), F.col("record")).alias("record"),
    )
    _write_members(slim.mapInArrow(write, "value binary"), path)


def read_warc(files: DataFrame) -> DataFrame:
    """Records of WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id.

    A response's payload is digested again and must match its stored digest.
    """

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(1):
                out = []
                for fields, block in parse_warc(content.as_py()):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, body = headers_of(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"digest mismatch in {fields['warc-record-id']}")
                    page, first = http.get("x-page-id"), fields.get("x-refers-to-page-id")
                    out.append({
                        "page_id": int(page) if page else None, "payload_bytes": int(http["content-length"]), "payload_digest": digest,
                        "record_type": kind, "refers_to": int(first) if first else None, "record_id": fields["warc-record-id"][1:-1],
                        "target_uri": fields["warc-target-uri"], "date": fields["warc-date"],
                    })
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string())])
    return files.mapInArrow(parse, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, target_uri string, date string")


def report(pages: DataFrame) -> DataFrame:
    """Pages through ARC and WARC archives in the shared folder and back: one row per page."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    convert(_read_files(spark, arc), warc)
    return read_warc(_read_files(spark, warc)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
