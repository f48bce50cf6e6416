"""Web archives: the legacy ARC format converted to WARC.

An ARC file is a version block and records of one header line and as many bytes as the line declares.
Version 1 lines have five fields, version 2 lines ten. The converter splits a file by the declared lengths,
and synthesises for each record the WARC identifier (a name-based UUID), date, type and digests. Records
whose payload equals one with a smaller key become ``revisit`` records without a payload.

Archives are rows with the file's name and its bytes (one gzip member per record, so a member can be read
on its own), in the shared folder: they are written and read by Spark on any file system.

Defined cases: a null html is an empty payload; a null url is ``about:blank``; of repeated rows with the
smallest page_id all are responses, as nothing tells them apart; rows without page_id follow all others, and
are responses where no row of the payload has one. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import kept, table

#: Field names of the two versions of a record's header line; fixed by the format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
#: Bytes of payload after which a new archive is begun.
ARCHIVE_BYTES = 4 << 20
#: Payloads from this many bytes on are looked up for revisits.
LEAST_BYTES = 0


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1, as the payload digest of a record."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str | None, absent: str = "-") -> str:
    return "%20".join((value or "").split()) or absent


def arc_head(version: int, name: str, date: str) -> bytes:
    """Version block that opens an ARC file."""
    block = f"{version} 0 none\n{' '.join(FIELDS[version])}\n\n".encode()
    return arc_record(version, {"URL": f"filedesc://{_field(name)}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name}, block)


def arc_record(version: int, fields: dict[str, str], block: bytes) -> bytes:
    """One ARC record: the header line of the version, the block, and a line end."""
    line = " ".join(str(len(block)) if f == "Archive-length" else _field(fields.get(f)) for f in FIELDS[version])
    return line.encode() + b"\n" + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an ARC file with the fields of their version's header line. The version is read from
    the file's first record. A record that ends early or has a broken line raises an error."""
    at, version = 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        parts = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split(" ")
        if end < 0 or len(parts) not in (5, 10) or not parts[-1].isdigit():
            raise ValueError(f"broken record line at byte {at}")
        size = int(parts[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(block)} are left")
        if not version:
            head = block.split(b" ", 1)[0]
            if not parts[0].startswith("filedesc://") or head not in (b"1", b"2"):
                raise ValueError("not an ARC file")
            version = int(head)
            names = FIELDS[2] if len(parts) == 10 else FIELDS[1]
        else:
            names = FIELDS[version]
        if len(parts) != len(names):
            raise ValueError(f"record line of another version at byte {at}")
        yield dict(zip(names, parts)), block
        at = end + 1 + size
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1


def warc_date(date: str) -> str:
    """ISO date of a 14-digit ARC date; 12 or 8 digits are filled up, anything else is the epoch."""
    d = (date if date.isdigit() else "") + "0" * 14
    d = d[:14] if len(date) in (8, 12, 14) and date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_payload(block: bytes) -> tuple[bytes, bytes]:
    """Header and body of an HTTP response; a block without a header is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for gap in (b"\r\n\r\n", b"\n\n"):
        i = block.find(gap)
        if i >= 0:
            return block[: i + len(gap)], block[i + len(gap) :]
    return block, b""


def record_id(key: str, payload_digest: str) -> str:
    """Name-based identifier; a revisit can tell that of the record it repeats."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:sha1:{payload_digest}#{key}')}>"


def convert(fields: dict[str, str], block: bytes, key: str, original: str | None = None, opens: bool = False) -> bytes:
    """The WARC record of an ARC record. ``original`` is the key of the record with an equal payload that it
    repeats; ``opens`` marks the version block, which no other record is, whatever its URL."""
    url, date = fields["URL"], warc_date(fields["Archive-date"])
    head, body = http_payload(block)
    lines = [("WARC-Record-ID", record_id(key, digest(body))), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", fields["IP-address"])]
    if opens:
        kind, mime, content = "warcinfo", "application/warc-fields", b"software: ARC conversion\r\nformat: WARC File Format 1.1\r\n"
        lines = [x for x in lines if x[0] not in ("WARC-Target-URI", "WARC-IP-Address")] + [("WARC-Filename", url.removeprefix("filedesc://"))]
    else:
        kind, mime, content = ("response", "application/http; msgtype=response", block) if head else ("resource", fields["Content-type"], block)
        lines += [("WARC-Payload-Digest", f"sha1:{digest(body)}"), ("X-Page-Key", key), ("X-Payload-Length", str(len(body)))]
        if original is not None:
            kind, content = "revisit", head
            lines += [("WARC-Refers-To", record_id(original, digest(body))), ("X-Refers-To-Key", original), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = [("WARC-Type", kind), *lines, ("WARC-Block-Digest", f"sha1:{digest(content)}"), ("Content-Type", mime), ("Content-Length", str(len(content)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + content + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of a WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("record is cut off")
        yield head, block
        at = end + 4 + size + 4


def first_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(digest, original): per payload the smallest page_id. Equal digests are taken for equal payloads."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select("page_id", F.sha1(payload).alias("digest")).filter(F.octet_length(payload) >= least_bytes)
    return slim.groupBy("digest").agg(F.min("page_id").alias("original"))


def write_arc(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, data, keys, originals): the pages as ARC files, versions 1 and 2 in turn, with each record's
    page_id and, for payloads seen before, the page_id it repeats."""
    first = first_pages(pages)
    slim = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"))
    repeats = (F.col("page_id").isNull() & F.col("original").isNotNull()) | (F.col("page_id") > F.col("original"))
    joined = slim.join(first, "digest", "left").select("page_id", "url", "html", F.when(repeats, F.col("original")).alias("original"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, size = TaskContext.get().partitionId(), 0, 0
        out, keys, originals = [], [], []

        def done() -> pd.DataFrame:
            return pd.DataFrame({"name": [f"part-{part:05d}-{k:05d}.arc"], "data": [b"".join(out)], "keys": [list(keys)], "originals": [list(originals)]})

        for pdf in batches:
            for page, url, html, original in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["original"]):
                version = 1 + k % 2
                if not out:
                    out.append(arc_head(version, f"part-{part:05d}-{k:05d}.arc", "20000101000000"))
                block = HTTP_HEAD + (html or "").encode("utf-8", "replace")
                fields = {"URL": _field(url, "about:blank"), "IP-address": "0.0.0.0", "Archive-date": "20000101000000", "Content-type": "text/html", "Result-code": "200", "Filename": f"part-{part:05d}-{k:05d}.arc"}
                out.append(arc_record(version, fields, block))
                keys.append("" if pd.isna(page) else str(page))
                originals.append(None if pd.isna(original) else str(original))
                size += len(block)
                if size >= archive_bytes:
                    yield done()
                    k, size, out, keys, originals = k + 1, 0, [], [], []
        if out:
            yield done()

    text = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("original").cast("string").alias("original"))
    return text.mapInPandas(run, "name string, data binary, keys array<string>, originals array<string>")


def convert_archives(arcs: DataFrame) -> DataFrame:
    """(name, data): every ARC file of ``arcs`` (name, data, keys, originals) as a WARC file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data, keys, originals in zip(pdf["name"], pdf["data"], pdf["keys"], pdf["originals"]):
                records = parse_arc(data)
                members = [gzip.compress(convert(*next(records), name, opens=True), 6, mtime=0)]
                named = iter(zip(keys, originals, strict=True))
                for fields, block in records:
                    try:
                        key, original = next(named)
                    except StopIteration:
                        raise ValueError(f"{name}: more records than keys") from None
                    members.append(gzip.compress(convert(fields, block, key, original), 6, mtime=0))
                if next(named, None) is not None:
                    raise ValueError(f"{name}: more keys than records")
                yield pd.DataFrame({"name": [name.removesuffix(".arc") + ".warc.gz"], "data": [b"".join(members)]})

    return arcs.mapInPandas(run, "name string, data binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, warc_date, record_id) of the page
    records. The digest of the stored bytes is computed again and must agree with the record's."""
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date", "record_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["name"], pdf["data"]):
                rows = []
                for head, block in parse_warc(gzip.decompress(data)):
                    if head["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"{name}: a block differs from its digest")
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] != "revisit":
                        body = http_payload(block)[1]
                        if digest(body) != said or len(body) != int(head["X-Payload-Length"]):
                            raise ValueError(f"{name}: a payload differs from its digest")
                    rows.append((head["X-Page-Key"] or None, int(head["X-Payload-Length"]), said, head["WARC-Type"], head.get("X-Refers-To-Key"), head["WARC-Date"], head["WARC-Record-ID"]))
                if rows:
                    yield pd.DataFrame(rows, columns=cols)

    return archives.mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, warc_date string, record_id string")


def page_archives(pages: DataFrame) -> DataFrame:
    """The pages written as ARC, converted, and kept as WARC archives (name, data) in the shared folder."""
    return kept(convert_archives(write_arc(pages)), "warc")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType
    back = read_archives(page_archives(pages))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, min(page_id) AS original FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN NULL ELSE original END AS refers_to
FROM p JOIN o USING (h)
"""
