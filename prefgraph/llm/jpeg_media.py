"""Media columns: payloads as baseline JPEG, read back by parsing markers and decoding the Huffman scans in numpy.

Writing. 64 payload bytes are the 64 quantised coefficients of a block, in zigzag order and less 128 (the format's unit;
samples would be rounded by the transform). A comment segment holds the payload's length, blocks after it are zero. The
luminance quantiser of the DC coefficient is 8, so a block's DC-only sample is its first byte. Restart markers every
``INTERVAL`` blocks make intervals independent.

Reading. Any baseline JPEG (one or more components, any sampling, restarts or none, one or more scans) is parsed marker
by marker; the intervals of all images of a batch that share tables and layout are decoded in step, a lane each. From
the DC coefficients of the first component comes the thumbnail, an eighth of the size; its hashes and the dimensions are the
feature.

Edge cases: a null or empty text is a payload of 64 zero bytes; equal texts have equal media and features; repeated rows and
null ids give a row each; an empty table gives an empty result; other columns are ignored. A stream that isn't baseline JPEG
raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.llm.common import ship_package, staged, utf8

BLOCK, INTERVAL, GROUP = 64, 16, 1 << 20
#: Code lengths of the writer's tables. DC: 4 bits for each category. AC by (zero run, size): short for runs of 0.
_DC = {s: 4 for s in range(12)}
_AC = {0x05: 2, 0x07: 2, 0x04: 3, 0x06: 4, 0x03: 5, 0x08: 5, 0x02: 6, 0x01: 7, 0x00: 8, 0xF0: 9} | {r << 4 | s: 11 for r in range(1, 16) for s in range(1, 11)} | {0x09: 11, 0x0A: 11}
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Canonical codes and lengths by symbol, and the table's segment."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, before, codes, bits = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s], bits[s] = code, before
        code += 1
    return codes, bits, bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(order)


def _segment(marker: int, data: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(data) + 2).to_bytes(2, "big") + data


_DC_CODES, _DC_BITS, _DC_TABLE = _codes(_DC)
_AC_CODES, _AC_BITS, _AC_TABLE = _codes(_AC)
_FIXED = (
    b"\xff\xd8"
    + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    + _segment(0xDB, b"\0\x08" + b"\x01" * 63)
    + _segment(0xC4, b"\x00" + _DC_TABLE)
    + _segment(0xC4, b"\x10" + _AC_TABLE)
    + _segment(0xDD, INTERVAL.to_bytes(2, "big"))
)
_SCAN_HEAD = _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _category(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _tail(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a size: v, or for negative v its ones' complement."""
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def _scan(coefficients: np.ndarray, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all intervals (not stuffed) and their lengths. interval: number of each block's interval, from 0 on."""
    n = len(coefficients)
    fresh = np.concatenate(([True], interval[1:] != interval[:-1]))
    dc = coefficients[:, 0].astype(np.int64)
    diff = dc - np.where(fresh, 0, np.concatenate(([0], dc[:-1])))
    value, bits = np.zeros((n, 65), np.uint64), np.zeros((n, 65), np.int64)
    size = _category(diff)
    value[:, 0] = _DC_CODES[size] << size.astype(np.uint64) | _tail(diff, size)
    bits[:, 0] = _DC_BITS[size] + size
    ac = coefficients[:, 1:]
    row, col = np.nonzero(ac)
    v = ac[row, col].astype(np.int64)
    before = np.concatenate(([-1], col[:-1]))
    before[np.concatenate(([True], row[1:] != row[:-1]))[: len(row)]] = -1
    run = col - before - 1 if len(col) else col
    size = _category(v)
    symbol = (run & 15) << 4 | size
    value[row, col + 1] = _AC_CODES[symbol] << size.astype(np.uint64) | _tail(v, size)
    bits[row, col + 1] = _AC_BITS[symbol] + size
    open_end = ac[:, 62] == 0
    value[open_end, 64], bits[open_end, 64] = _AC_CODES[0], _AC_BITS[0]
    there = bits.reshape(-1) > 0
    owner = np.repeat(interval, there.reshape(n, 65).sum(axis=1))
    value, bits = value.reshape(-1)[there], bits.reshape(-1)[there]
    if len(run) and run.max() > 15:  # runs of 16 zeros have a symbol of their own
        place = np.cumsum(there) - 1
        long = run > 15
        at = place[row[long] * 65 + col[long] + 1]
        at = np.repeat(at, run[long] >> 4)
        owner = np.insert(owner, at, owner[at])
        value, bits = np.insert(value, at, _AC_CODES[0xF0]), np.insert(bits, at, _AC_BITS[0xF0])
    count = int(interval[-1]) + 1
    total = np.bincount(owner, weights=bits, minlength=count).astype(np.int64)
    length = (total + 7) >> 3
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    ends = np.cumsum(bits)
    at = ends - bits + (start * 8 - (np.cumsum(total) - total))[owner]
    pad = length * 8 - total  # with ones
    value = np.concatenate([value, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)])
    at, bits = np.concatenate([at, start * 8 + total]), np.concatenate([bits, pad])
    word, words = at >> 5, (int(length.sum()) >> 2) + 3
    shifted = np.where(bits > 0, value << ((64 - (at & 31) - bits) & 63).astype(np.uint64), np.uint64(0))
    out = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=words)
    out[1:] += np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)[: words - 1]
    return out.astype(np.uint64).astype(">u4").view(np.uint8)[: int(length.sum())], length


def _layout(blocks: int) -> tuple[int, int]:
    wide = int(np.ceil(np.sqrt(blocks)))
    return wide, -(-blocks // wide)


def encode_group(payloads: list[bytes]) -> list[bytes]:
    """JPEG files of payloads, whose lengths are positive multiples of 64."""
    heads, parts, intervals, base = [], [], [], 0
    for p in payloads:
        wide, high = _layout(len(p) // BLOCK)
        if high * 8 > 65535:
            raise ValueError("payload too large for one JPEG")
        heads.append(_FIXED + _segment(0xFE, f"payload {len(p)}".encode()) + _segment(0xC0, b"\x08" + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00") + _SCAN_HEAD)
        blocks = np.zeros((wide * high, BLOCK), np.int16)
        blocks[: len(p) // BLOCK] = np.frombuffer(p, np.uint8).reshape(-1, BLOCK).astype(np.int16) - 128
        own = np.arange(len(blocks)) // INTERVAL
        parts.append(blocks)
        intervals.append(own + base)
        base += int(own[-1]) + 1
    counts = [-(-len(b) // INTERVAL) for b in parts]
    data, length = [], []
    # long payloads go through in stretches of whole intervals
    flat, owner = np.concatenate(parts), np.concatenate(intervals)
    step = GROUP // BLOCK
    cuts = [0]
    while cuts[-1] < len(flat):
        stop = min(len(flat), cuts[-1] + step)
        if stop < len(flat):
            stop = int(np.searchsorted(owner, owner[stop]))
            stop = stop if stop > cuts[-1] else int(np.searchsorted(owner, owner[cuts[-1]] + 1))
        cuts.append(stop)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        d, n = _scan(flat[a:b], owner[a:b] - owner[a])
        data.append(d)
        length.append(n)
    data, length = np.concatenate(data), np.concatenate(length)
    # stuffing and restart markers
    ff = (data == 255).astype(np.int64)
    interval = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(data)) + np.cumsum(ff) - ff + 2 * interval
    out = np.zeros(len(data) + int(ff.sum()) + 2 * len(length), np.uint8)
    out[place] = data
    ends = np.cumsum(length)
    stuffed = np.concatenate(([0], np.cumsum(ff)))[ends]
    after = ends + stuffed + 2 * np.arange(len(length))
    number = np.concatenate([np.arange(c) for c in counts])
    out[after], out[after + 1] = 0xFF, 0xD0 + (number & 7)
    last = np.cumsum(counts) - 1
    out[after[last] + 1] = 0xD9
    raw, files, at = out.tobytes(), [], 0
    for head, k in zip(heads, last.tolist(), strict=True):
        stop = int(after[k]) + 2
        files.append(head + raw[at:stop])
        at = stop
    return files


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    restart: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantiser)
    quantisers: dict = field(default_factory=dict)
    scans: list = field(default_factory=list)  # (components with their tables, intervals of bytes)


def parse(data: bytes) -> Image:
    """Markers of a baseline JPEG; entropy-coded data stays as it is, cut at its end."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, at, tables = Image(), 2, {}
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            return image
        size = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + size]
        at += size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            image.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xC0:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not baseline")
        elif marker == 0xDA:
            chosen = [(body[1 + 2 * i], tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0])]
            end = _MARKER.search(data, at)
            if not end:
                raise ValueError("a scan has no end")
            image.scans.append((chosen, data[at : end.start()]))
            at = end.start()


_tables: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """From the next 16 bits to length | run << 5 | size << 9; length 0 where no code starts so."""
    if table not in _tables:
        out, code, symbols = np.zeros(1 << 16, np.int64), 0, iter(table[16:])
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                s = next(symbols)
                out[code << (16 - length) : (code + 1) << (16 - length)] = length | (s >> 4) << 5 | (s & 15) << 9
                code += 1
            code <<= 1
        if len(_tables) > 64:
            _tables.clear()
        _tables[table] = out
    return _tables[table]


def _decode_lanes(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, pattern: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Coefficients (lane, block, 64) of intervals that start at bytes; pattern: (component, DC, AC table) of each block of a unit."""
    window = np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))
    order = np.argsort(-blocks, kind="stable")
    at, left = starts[order] * 8, blocks[order]
    out = np.zeros((len(at), int(left[0]) if len(left) else 0, 64), np.int16)
    previous = np.zeros((len(at), max(c for c, _, _ in pattern) + 1), np.int64)
    last = len(window) - 1
    one = np.uint64(1)

    def take(at, table):
        bits = window[np.minimum(at >> 3, last)].astype(np.uint64) << (at & 7).astype(np.uint64)
        entry = table[(bits >> np.uint64(48)).astype(np.int64)]
        length, size = entry & 31, entry >> 9
        raw = ((bits << length.astype(np.uint64)) >> one >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(raw < (1 << size) >> 1, raw - (1 << size) + 1, raw)
        if length.min(initial=1) == 0:
            raise ValueError("no such code")
        return value, entry >> 5 & 15, size, at + length + size

    for b in range(out.shape[1]):
        n = int(np.searchsorted(-left, -b, side="left"))  # lanes with more than b blocks
        component, dc, ac = pattern[b % len(pattern)]
        value, _, _, at[:n] = take(at[:n], dc)
        previous[:n, component] += value
        out[:n, b, 0] = previous[:n, component]
        lanes, k = np.arange(n), np.ones(n, np.int64)
        here = at[:n].copy()
        while len(lanes):
            value, run, size, here = take(here, ac)
            k += run
            if (size == 0).any():
                skip = (size == 0) & (run == 15)
                ends = (size == 0) & (run != 15)
                some = size > 0
                out[lanes[some], b, k[some]] = value[some]
                k = np.where(ends, 64, k + 1)
                del skip
            else:
                out[lanes, b, k] = value
                k += 1
            if k.max() >= 64:
                done = k >= 64
                at[lanes[done]] = here[done]
                lanes, k, here = lanes[~done], k[~done], here[~done]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


def decode_group(files: list[bytes]) -> list[tuple[Image, list[np.ndarray]]]:
    """Each image and the coefficients (rows, columns, 64) of its components, in zigzag order."""
    images = [parse(f) for f in files]
    results: list[dict] = [{} for _ in images]
    groups: dict[tuple, list] = {}
    for i, image in enumerate(images):
        most = [max(c[k] for c in image.components) for k in (1, 2)]
        by_id = {c[0]: (j, c) for j, c in enumerate(image.components)}
        for chosen, scan in image.scans:
            single = len(chosen) == 1
            pattern, shape = [], []
            for cid, dc, ac in chosen:
                j, (_, h, v, _) = by_id[cid]
                h, v = (1, 1) if single else (h, v)
                pattern += [(j, dc, ac)] * (h * v)
            if single:
                j, (_, h, v, _) = by_id[chosen[0][0]]
                shape = [-(-image.width * h // (8 * most[0])), -(-image.height * v // (8 * most[1]))]
            else:
                shape = [-(-image.width // (8 * most[0])), -(-image.height // (8 * most[1]))]
            groups.setdefault((tuple(pattern),), []).append((i, scan, shape[0] * shape[1], image.restart or shape[0] * shape[1], shape))
    for (pattern,), items in groups.items():
        joined = np.frombuffer(b"".join(scan + b"\xff\xd0" for _, scan, _, _, _ in items), np.uint8)
        ff = np.flatnonzero(joined == 255)
        follow = joined[ff + 1]
        restart = ff[(follow >= 0xD0) & (follow <= 0xD7)]
        drop = np.zeros(len(joined), bool)
        drop[ff[follow == 0] + 1] = True
        drop[restart], drop[restart + 1] = True, True
        kept = np.cumsum(~drop)
        data = np.concatenate([joined[~drop], np.zeros(16, np.uint8)])
        ends = kept[restart]
        starts = np.concatenate(([0], ends[:-1]))
        units = [np.minimum(r, n - r * np.arange(-(-n // r))) for _, _, n, r, _ in items]
        if len(starts) != sum(map(len, units)):
            raise ValueError("restart markers don't fit the image")
        units_of = np.concatenate(units)
        tabled = [(j, _lookup(dc), _lookup(ac)) for j, dc, ac in pattern]
        found = _decode_lanes(data, starts, units_of * len(pattern), tabled)
        lane = 0
        for (i, _, n, _, shape), u in zip(items, units, strict=True):
            rows = found[lane : lane + len(u)]
            flat = np.concatenate([rows[x, : c * len(pattern)] for x, c in enumerate(u.tolist())]) if len(u) > 1 else rows[0, : n * len(pattern)]
            lane += len(u)
            flat = flat.reshape(n, len(pattern), 64)
            for j in dict.fromkeys(j for j, _, _ in pattern):
                own = [k for k, (x, _, _) in enumerate(pattern) if x == j]
                _, h, v, _ = images[i].components[j]
                h, v = (h, v) if len(own) > 1 else (1, 1)
                part = flat[:, own].reshape(shape[1], shape[0], v, h, 64).transpose(0, 2, 1, 3, 4)
                results[i][j] = part.reshape(shape[1] * v, shape[0] * h, 64)
    return [(image, [r[j] for j in sorted(r)]) for image, r in zip(images, results, strict=True)]


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """DC-only samples of the first component: an eighth of its width and height."""
    dc = coefficients[:, :, 0].astype(np.int64) * int(image.quantisers[image.components[0][3]][0])
    return np.clip((dc + 1024) >> 3, 0, 255).astype(np.uint8)


def feature(image: Image, thumb: np.ndarray) -> str:
    """Dimensions, difference hash (8 x 8 bits) and SHA-1 prefix of the thumbnail."""
    rows, cols = np.arange(8) * thumb.shape[0] // 8, np.arange(9) * thumb.shape[1] // 9
    grid = thumb[np.ix_(rows, cols)].astype(np.int64)
    bits = np.packbits((grid[:, 1:] > grid[:, :-1]).reshape(-1)).tobytes().hex()
    return f"{image.width}x{image.height} dhash={bits} sha1={hashlib.sha1(thumb.tobytes()).hexdigest()[:16]}"


def payload_of(image: Image, coefficients: np.ndarray) -> bytes:
    """The payload that encode_group stored."""
    n = int(image.comment.removeprefix(b"payload "))
    return (coefficients.reshape(-1)[:n] + 128).astype(np.uint8).tobytes()


def _groups(items: list[bytes]) -> Iterator[slice]:
    start, size = 0, 0
    for k, x in enumerate(items):
        size += len(x)
        if size >= GROUP:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(items):
        yield slice(start, len(items))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [utf8(t) for t in batch.column("text").to_pylist()]
        for g in _groups(texts):
            media = encode_group([t + b"\0" * (-len(t) % BLOCK if t else BLOCK) for t in texts[g]])
            own = batch.slice(g.start, g.stop - g.start)
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(map(len, texts[g]), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        files = batch.column("media").to_pylist()
        for g in _groups(files):
            rows = []
            for data, (image, found) in zip(files[g], decode_group(files[g]), strict=True):
                payload = payload_of(image, found[0])
                rows.append((len(payload), sha(payload), zlib.crc32(payload[-BLOCK:]), len(data), sha(data), feature(image, thumbnail(image, found[0])), image.width, image.height))
            own = batch.slice(g.start, g.stop - g.start)
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n_bytes"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", "n_bytes", *names])


def store_media(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_bytes, media): the texts' payloads as JPEG files in a binary column, written to the shared folder."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(_store, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """Payload digests, dimensions and thumbnail hashes of a media column that store_media made."""
    ship_package(media.sparkSession)
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _load, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    )
