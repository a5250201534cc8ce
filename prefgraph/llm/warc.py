"""WARC archives of web pages: written with revisit records, read back by byte ranges.

Writing. Payloads are the pages' html in UTF-8. Of pages with equal payloads of at least ``least`` bytes the one with the
largest id is written whole (response), the others refer to it (revisit, no payload); smaller payloads are always written.
The choice is made on digests alone, so a payload that a third of the pages share costs a row each of a few bytes. Every
record is one gzip member; each task writes one file into the shared folder.

Reading. Files are cut into byte ranges. A task scans its range for the gzip magic, takes a candidate only if it inflates to
a WARC header, and owns the records that start in its range, read to their end wherever that is. After a record the next
one is expected right behind it; if it isn't there the scan goes on, so damaged stretches cost only their own records.

Edge cases: a null or empty html is an empty payload; rows with a null id take part as the smallest id and refers_to is
null where the chosen page has none; rows that repeat the chosen id are all written whole; a null or odd url is
escaped; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.llm.common import attempt_file, new_path, open_input, open_output, ship_package, staged

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-page:(-?\d*)>")


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One gzip member."""
    name = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    block = http if kind == "revisit" else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, size, count, out = attempt_file(folder, ".warc.gz"), 0, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                out = open_output(path) if out is None else out
                data = record(row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "replace"), row["digest"], row["record_type"], row["refers_to"])
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "records": [count]})

    return run


def write_archives(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", least: int = 1000, folder: str | None = None) -> DataFrame:
    """Archives of all pages; returns their manifest (path, size, records)."""
    spark = pages.sparkSession
    ship_package(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    slim = staged(rows.where(F.octet_length("html") >= least).select("page_id", "digest"), "warc-digests")
    shared = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    revisits = slim.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to", F.lit("revisit").alias("_kind")).distinct()
    typed = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["_id"]) & (rows["digest"] == revisits["_digest"]), "left")
    typed = typed.select("page_id", "url", "html", "digest", F.coalesce("_kind", F.lit("response")).alias("record_type"), "refers_to")
    folder = folder or new_path(spark, "warc")
    return staged(typed.mapInArrow(_writer(folder), "path string, size long, records long"), "warc-manifest")


def _inflate(data, at: int):
    """The member that starts at a place of the file: (whole content, place behind it), or None if there is none."""
    data.seek(at)
    z, parts, read = zlib.decompressobj(31), [], 0
    try:
        while not z.eof:
            chunk = data.read(BLOCK if read else 1 << 15)
            if not chunk:
                return None
            read += len(chunk)
            parts.append(z.decompress(chunk))
            if len(parts) == 1 and not parts[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return b"".join(parts), at + read - len(z.unused_data)


def members(data, size: int, start: int, stop: int) -> Iterator[bytes]:
    """Contents of the members that start in [start, stop)."""
    at = start
    while at < stop:
        data.seek(at)
        window = data.read(min(BLOCK, size - at))
        found = window.find(MAGIC)
        if found < 0:
            if at + len(window) >= min(size, stop + 2):
                return
            at += max(1, len(window) - 2)
            continue
        at += found
        if at >= stop:
            return
        if (got := _inflate(data, at)) is None:
            at += 1
            continue
        content, at = got
        yield content
        while at < stop and (got := _inflate(data, at)) is not None:
            content, at = got
            yield content


def parse(content: bytes) -> dict:
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    number = lambda x: int(m[1]) if (m := _ID.fullmatch(x or "")) and m[1] else None
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, length):
            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload_digest": digest, "payload_bytes": length, "payload": payload}


FIELDS = [("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload", pa.binary(), "binary")]


def _reader(payloads: bool):
    fields = FIELDS if payloads else FIELDS[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t, _ in fields], [n for n, _, _ in fields])
        for batch in batches:
            for split in batch.to_pylist():
                rows, held = [], 0
                with open_input(split["path"]) as data:
                    for content in members(data, split["size"], split["start"], split["stop"]):
                        rows.append(parse(content))
                        held += len(content)
                        if held > 8 * BLOCK:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return run


def read_archives(manifest: DataFrame, *, split_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """Records of the archives that a manifest (path, size) lists, a task for each ``split_bytes`` of them."""
    ship_package(manifest.sparkSession)
    cuts = manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = cuts.withColumn("stop", F.least(F.col("start") + split_bytes, "size"))
    # a number of its own, so that adaptive execution doesn't join splits, whose rows are small, into one task
    spread = splits.repartitionByRange(max(1, splits.count()), "path", "start")
    fields = FIELDS if payloads else FIELDS[:-1]
    return spread.mapInArrow(_reader(payloads), ", ".join(f"{n} {s}" for n, _, s in fields))
