"""Token-id files: canonical length-limited Huffman code from global counts, independent blocks, bit-offset checkpoints.

A corpus is encoded once (ids of every text and an end id, kept as Parquet), counted, range-partitioned by id, and each
range becomes one file: the code lengths of all ids, then blocks of at most ``BLOCK`` ids, then the blocks' places. A block
holds the documents that start in it, the bit offset of every ``STRIDE``-th id, and the packed codes; it decodes without
any other block, all strides in step by one lookup table. Files are in ascending order of doc_id, nulls first.

Code lengths are limited by package-merge to ``LIMIT`` bits (more for vocabularies that need it), so that a table lookup
decodes an id. Counts are over all ids of the corpus; they and the lengths are as long as the vocabulary, whatever the
corpus.

Edge cases: a null or empty text is the end id alone; repeated ids keep their rows next to each other, in the order of
their texts' hashes; an empty table writes no files and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.llm.byte_bpe import encoder
from prefgraph.llm.common import attempt_file, new_path, open_input, open_output, ship_package, staged

MAGIC = b"PGTF0001"
BLOCK, STRIDE, LIMIT = 1 << 18, 128, 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    level, packed = coins, [np.zeros(len(coins), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, packages])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        packed.append(rank >= len(coins))
    take = 2 * len(coins) - 2
    for is_package in reversed(packed):
        n = int(is_package[:take].sum())
        lengths[order[: take - n]] += 1
        take = 2 * n
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == length)
        code <<= length - before
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code, before = code + len(ids), length
    return codes


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Table from the next ``width`` bits to id * 32 + length."""
    width = int(lengths.max(initial=1))
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    entry = (ids.astype(np.uint32) << np.uint32(5)) | lengths[ids].astype(np.uint32)
    table = np.repeat(entry, 1 << (width - lengths[ids].astype(np.int64)))
    return np.concatenate([table, np.full((1 << width) - len(table), 1, np.uint32)]), width


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids in a row, and the bit offset of every ``STRIDE``-th."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word = at >> 5
    shifted = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    n = (int(ends[-1]) >> 5) + 2 if len(ids) else 1
    # codes don't overlap, so sums of them are unions of bits, exact below 2**53
    high = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n)
    high[1:] += np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[: n - 1]
    return high.astype(np.uint64).astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8 if len(ids) else 0], at[::STRIDE].astype("<u4")


def unpack(data: bytes, n: int, places: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """n ids, all strides decoded in step."""
    padded = data + b"\0" * 8
    window = np.ndarray((len(padded) - 3,), ">u4", buffer=padded, strides=(1,))
    at = places.astype(np.int64)
    out = np.empty((STRIDE, len(at)), np.uint32)
    last = len(padded) - 4
    for k in range(STRIDE):
        bits = window[np.minimum(at >> 3, last)].astype(np.uint32)
        entry = table[((bits << (at & 7).astype(np.uint32)) >> np.uint32(32 - width))]
        out[k] = entry >> np.uint32(5)
        at += entry & np.uint32(31)
    return out.T.reshape(-1)[:n]


class FileWriter:
    def __init__(self, uri: str, lengths: np.ndarray):
        self.out, self.lengths, self.codes = open_output(uri), lengths, canonical(lengths)
        table = zlib.compress(lengths.tobytes())
        self.at, self.places, self.tokens = 0, [], 0
        self._write(MAGIC + struct.pack("<II", len(lengths), len(table)) + table)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def block(self, ids: np.ndarray, docs: list[tuple[int | None, int]]) -> None:
        data, places = pack(ids, self.codes, self.lengths)
        self.places.append(self.at)
        self.tokens += len(ids)
        names = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + bytes(d is None for d, _ in docs) + np.array([n for _, n in docs], "<u8").tobytes()
        self._write(struct.pack("<IIII", len(ids), len(docs), len(places), len(data)) + names + places.tobytes() + data)

    def close(self) -> None:
        self._write(np.array(self.places, "<u8").tobytes() + struct.pack("<QQ", len(self.places), self.tokens) + MAGIC)
        self.out.close()


def read_blocks(uri: str) -> Iterator[tuple[np.ndarray, list[tuple[int | None, int]]]]:
    """(ids, documents that start there as (doc_id, number of ids)) of each block of a file."""
    with open_input(uri) as data:
        if data.read(8) != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        n, size = struct.unpack("<II", data.read(8))
        table, width = lookup(np.frombuffer(zlib.decompress(data.read(size)), np.uint8, n))
        data.seek(data.size() - 24)
        blocks, _ = struct.unpack("<QQ", data.read(16))
        data.seek(data.size() - 24 - 8 * blocks)
        for place in np.frombuffer(data.read(8 * blocks), "<u8").tolist():
            data.seek(place)
            tokens, docs, strides, size = struct.unpack("<IIII", data.read(16))
            ids, null, lens = (np.frombuffer(data.read(w * docs), t) for w, t in ((8, "<i8"), (1, np.uint8), (8, "<u8")))
            places = np.frombuffer(data.read(4 * strides), "<u4")
            named = [(None if z else d, k) for d, z, k in zip(ids.tolist(), null.tolist(), lens.tolist(), strict=True)]
            yield unpack(data.read(size), tokens, places, table, width), named


def id_type(vocabulary: int, end: int) -> str:
    """How ids of a vocabulary are kept."""
    return "<u2" if max(vocabulary, end + 1) <= 1 << 16 else "<u4"


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        kind = id_type(len(coder.spaced), end)
        for batch in batches:
            flat, counts = coder.encode(batch.column("text"))
            ends = np.cumsum(counts + 1)
            ids = np.full(int(ends[-1]) if len(ends) else 0, end, kind)
            body = np.ones(len(ids), bool)
            body[ends - 1] = False
            ids[body] = flat
            places = pa.py_buffer(np.append(0, ends * ids.itemsize).astype(np.int32))
            kept = pa.Array.from_buffers(pa.binary(), len(counts), [None, places, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), kept], ["doc_id", "tie", "ids"])

    return run


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            column = batch.column("ids")
            if not len(column):
                continue
            _, places, data = column.buffers()
            at = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1]
            seen = np.bincount(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind))
            if len(seen) > len(total):
                total, seen = seen.astype(np.int64), total
            total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return run


def _write(folder: str, packed_lengths: bytes, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uri, writer, held, docs, size = attempt_file(folder, ".ids"), None, [], [], 0
        for batch in batches:
            for doc_id, kept in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                writer = writer or FileWriter(uri, np.frombuffer(zlib.decompress(packed_lengths), np.uint8))
                ids = np.frombuffer(kept, kind)
                docs.append((doc_id, len(ids)))
                held.append(ids)
                size += len(ids)
                while size >= BLOCK:
                    flat = np.concatenate(held)
                    writer.block(flat[:BLOCK], docs)
                    held, docs, size = [flat[BLOCK:]], [], size - BLOCK
        if writer:
            if size or docs:
                writer.block(np.concatenate(held), docs)
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [uri], "tokens": pa.array([writer.tokens], pa.int64())})

    return run


def write_token_files(docs: DataFrame, vocabulary: str, *, end_id: int = 2, id_col="doc_id", text_col="text", folder: str | None = None) -> DataFrame:
    """Token files of all texts; returns their manifest (part, path, tokens, first: ids in the files before)."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    encoded = staged(rows.mapInArrow(_encode(vocabulary, end_id), "doc_id long, tie long, ids binary"), "token-ids")
    # one row per id of the vocabulary at most
    kind = id_type(len(encoder(vocabulary).spaced), end_id)
    counted = encoded.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    folder = folder or new_path(spark, "token-files")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = encoded.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    written = staged(ordered.drop("tie").mapInArrow(_write(folder, zlib.compress(code_lengths(counts).tobytes()), kind), "part long, path string, tokens long"), "token-manifest")
    # one row per file
    first, files = 0, []
    for r in sorted(written.collect()):
        files.append((r["part"], r["path"], r["tokens"], first))
        first += r["tokens"]
    return spark.createDataFrame(files, "part long, path string, tokens long, first long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for file in batch.to_pylist():
            waiting: list[list] = []  # documents that haven't ended: [doc_id, start, ids, ids to come, crc]
            start = file["first"]
            for ids, docs in read_blocks(file["path"]):
                data, at, done = ids.astype("<u4").tobytes(), 0, []
                for doc_id, n in docs:
                    waiting.append([doc_id, start, n, n, 0])
                    start += n
                for k, doc in enumerate(waiting):
                    n = min(doc[3], len(ids) - at)
                    doc[4] = zlib.crc32(data[4 * at : 4 * (at + n)], doc[4])
                    doc[3] -= n
                    at += n
                    if doc[3]:
                        waiting = waiting[k:]
                        break
                    done.append(doc)
                else:
                    waiting = []
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in (0, 1, 2, 4)], names)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest, a task for each file."""
    ship_package(manifest.sparkSession)
    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.repartition(parts, "part").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
