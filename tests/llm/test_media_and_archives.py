"""JPEG media and WARC archives: exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest

from prefgraph.llm import jpeg_media, warc


def test_any_bytes_survive():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 15, 16, 17, 33, 300)] + [bytes(320), b"\x80" * 2560, (b"\x80" * 63 + b"z") * 33, b"\xff" * 6400, b"abc " * 640]
    files = jpeg_media.encode_group(payloads)
    for p, f, (image, found) in zip(payloads, files, jpeg_media.decode_group(files), strict=True):
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" and jpeg_media.payload_of(image, found[0]) == p
        thumb = jpeg_media.thumbnail(image, found[0])
        assert thumb.shape == (image.height // 8, image.width // 8) and thumb.reshape(-1)[0] == p[0]


def test_not_a_jpeg():
    with pytest.raises(ValueError):
        jpeg_media.parse(b"GIF89a")


def colour_file():
    """16 x 16 pixels, three components, luminance 2 x 2: DC differences only, by the tables of the writer."""
    codes, bits = jpeg_media._DC_CODES, jpeg_media._DC_BITS
    end = format(int(jpeg_media._AC_CODES[0]), f"0{jpeg_media._AC_BITS[0]}b")
    out = ""
    for v in (10, -3, 0, 5, 7, -9):  # four of luminance, then one of each colour
        s = abs(v).bit_length()
        out += format(int(codes[s]), f"0{bits[s]}b") + (format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else "") + end
    out += "1" * (-len(out) % 8)
    scan = int(out, 2).to_bytes(len(out) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = jpeg_media._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\x08" * 64) + seg(0xC4, b"\x00" + jpeg_media._DC_TABLE) + seg(0xC4, b"\x10" + jpeg_media._AC_TABLE)
    return head + seg(0xC0, b"\x08\0\x10\0\x10\x03\x01\x22\0\x02\x11\0\x03\x11\0") + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + scan + b"\xff\xd9"


def test_colour_with_sampling_and_without_restarts():
    (image, found), = jpeg_media.decode_group([colour_file()])
    assert found[0][:, :, 0].tolist() == [[10, 7], [7, 12]] and found[1][0, 0, 0] == 7 and found[2][0, 0, 0] == -9
    assert jpeg_media.thumbnail(image, found[0]).tolist() == [[138, 135], [135, 140]]


def test_media_query_columns(spark, sf):
    odd = [(10_000, None), (10_001, ""), (10_002, "x" * 64), (10_003, "é" * 50_000), (None, "x"), (10_004, "x" * 64)]
    docs = spark.createDataFrame([(d, t, "q") for d, t in odd], "doc_id long, text string, media string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    stored = {}
    for r in jpeg_media.media_features(jpeg_media.store_media(docs)).collect():
        stored[r["doc_id"]] = r
    for d, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        raw = (text or "").encode()
        raw_padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = stored[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(raw_padded), hashlib.sha256(raw_padded).hexdigest(), zlib.crc32(raw_padded[-64:]))
    assert stored[10_002]["media_sha256"] == stored[10_004]["media_sha256"] and stored[10_002]["feature"] == stored[10_004]["feature"]
    assert jpeg_media.media_features(jpeg_media.store_media(docs.limit(0))).count() == 0


def test_ranges_own_each_record_once(tmp_path):
    big = b"<html>" + bytes(range(32, 127)) * 3000
    payloads = [b"p%d" % k * 50 for k in range(60)] + [big]
    data = b"".join(warc.record(k, f"http://x/{k}\n", p, hashlib.sha1(p).hexdigest(), "response", None) for k, p in enumerate(payloads))
    (tmp_path / "a.warc.gz").write_bytes(data)
    with warc.open_input(f"file://{tmp_path}/a.warc.gz") as f:
        for step in (100, 997, 10**6):
            found = [warc.parse(c) for a in range(0, len(data), step) for c in warc.members(f, len(data), a, min(a + step, len(data)))]
            assert [(r["page_id"], r["payload"]) for r in found] == list(enumerate(payloads))


def test_archives_with_copies_and_nulls(spark):
    body = "<p>" + "x" * 2000
    rows = [(1, "u", body), (2, "u", body), (3, None, body), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", body), (3, "u", body), (7, "a b\r\nc", "é" * 600)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, refers_to int")
    got = warc.read_archives(warc.write_archives(pages), split_bytes=300)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got.collect())
    assert kinds == sorted([("1", "revisit", 3, 2003), ("2", "revisit", 3, 2003), ("3", "response", None, 2003), ("3", "response", None, 2003), ("4", "response", None, 5), ("5", "response", None, 5), ("6", "response", None, 0), ("None", "revisit", 3, 2003), ("7", "response", None, 1200)])
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_splits_are_read_by_as_many_tasks(spark):
    pages = spark.range(400).selectExpr("id as page_id", "'u' as url", "concat(repeat(sha2(string(id), 256), 20), id) as html").repartition(3)
    manifest = warc.write_archives(pages)
    splits = sum(-(-r["size"] // 20_000) for r in manifest.collect())
    read = warc.read_archives(manifest, split_bytes=20_000, payloads=False)
    assert read.rdd.getNumPartitions() == splits > 6 and read.selectExpr("spark_partition_id() as p").distinct().count() > splits // 2
    assert sorted(r["page_id"] for r in read.collect()) == list(range(400))
