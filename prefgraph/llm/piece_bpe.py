"""SentencePiece BPE by vectorised merge rounds, and back to text.

Texts are cut into words (a run of the white-space sign, then other characters); no piece of the model spans two words, so
words are merged apart. The distinct words of a batch that a worker doesn't remember form one flat array of symbols. In each
round every word finds its least pair rank by a segmented minimum; the pairs of that rank are merged at once, leftmost first
where they overlap, and merged symbols are compacted away; words without a pair leave. A merge that could make a pair of
the same or a lower rank (known from the vocabulary) is done one at a time, the leftmost first, as the library's queue does.

The model must be BPE with identity normalisation and without user-defined symbols; characters without a piece become
their UTF-8 bytes' pieces, or the unknown id if the model has no byte pieces.

Rounds are at most as many as the longest word has characters, so words of more than ``QUEUED`` are merged from a queue of pairs instead.

Edge cases: a null or empty text has no ids and decodes to the empty text; texts of one endless word take time in proportion
to their length and its logarithm; repeated rows and null ids give a row each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.llm.common import ship_package, tidy

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words that a worker remembers, in Arrow arrays.
MEMORY = 400_000
#: Words of more characters are merged from a queue, since rounds can be as many as a word has characters.
QUEUED = 512
NONE = np.int32(2**31 - 1)
_FOREIGN = 1 << 21  # symbols from here on are characters that no merge takes, by code point

_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process and file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


class _Pairs:
    """Rank and result of a pair of symbols, by open addressing."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, results: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        size = 1 << self.bits
        self.keys, self.ranks, self.results = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot[left]] < 0)
            _, first = np.unique(slot[left[free]], return_index=True)
            placed = left[free[first]]
            self.keys[slot[placed]], self.ranks[slot[placed]], self.results[slot[placed]] = keys[placed], ranks[placed], results[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, slot, -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (there >= 0)]
        return out


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = proto.SentencePiece.Type
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("only BPE models with identity normalisation are handled")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = [next((i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE and p.piece == f"<0x{b:02X}>"), None) for b in range(256)] if train.byte_fallback else None
        self.unknown = self.library.unk_id()
        self.size = len(proto.pieces)
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal)
        symbols = dict(normal)
        for piece in normal:  # characters that only occur within pieces
            for c in piece:
                symbols.setdefault(c, len(proto.pieces) + len(symbols))
        self.char = np.arange(_FOREIGN, _FOREIGN + 0x110000, dtype=np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.extra = {i: s for s, i in symbols.items() if s not in normal}
        scores = {proto.pieces[i].score for i in normal.values()}
        rank_of = {s: k for k, s in enumerate(sorted(scores, reverse=True))}
        times: dict[float, int] = {}
        for i in normal.values():
            times[proto.pieces[i].score] = times.get(proto.pieces[i].score, 0) + 1
        shared = {s for s, n in times.items() if n > 1}
        keys, ranks, results, least = [], [], [], {}
        for piece, i in normal.items():
            rank = rank_of[proto.pieces[i].score]
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank)
                    results.append(i)
                    for part in (a, b):
                        least[part] = min(least.get(part, rank), rank)
        self.pairs = _Pairs(np.array(keys, np.int64), np.array(ranks, np.int32), np.array(results, np.int32))
        self.singly = np.zeros(len(rank_of) + 1, bool)
        for i in normal.values():
            score = proto.pieces[i].score
            if score in shared or least.get(i, NONE) <= rank_of[score]:
                self.singly[rank_of[score]] = True
        self.text = [str(i) for i in range(self.size)]
        self.queue_pairs: dict[int, tuple[int, int]] | None = None
        self._forget()

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids (32-bit bytes) of each word."""
        ends = [self._merge_long(w) if len(w) > QUEUED else None for w in words]
        short = iter(self._merge_rounds([w for w, ids in zip(words, ends, strict=True) if ids is None]))
        return [self._final(next(short) if ids is None else ids) for ids in ends]

    def _merge_long(self, word: str) -> bytes:
        """The same merges from a queue of pairs by rank and place, whose time grows with the length's logarithm only."""
        if self.queue_pairs is None:
            used = np.flatnonzero(self.pairs.keys >= 0)
            self.queue_pairs = dict(zip(self.pairs.keys[used].tolist(), zip(self.pairs.ranks[used].tolist(), self.pairs.results[used].tolist(), strict=True), strict=True))
        sym = self.char[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        n, find = len(sym), self.queue_pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(pair[0], i, sym[i], sym[i + 1], pair[1]) for i in range(n - 1) if (pair := find(sym[i] << 32 | sym[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, result = heapq.heappop(queue)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # one of the two has been merged since
            sym[i], sym[j] = result, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if pair := find(result << 32 | sym[k]):
                    heapq.heappush(queue, (pair[0], i, result, sym[k], pair[1]))
            h = before[i]
            if h >= 0 and (pair := find(sym[h] << 32 | result)):
                heapq.heappush(queue, (pair[0], h, sym[h], result, pair[1]))
        return np.array([x for x in sym if x >= 0], np.int32).tobytes()

    def _merge_rounds(self, words: list[str]) -> list[bytes]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), lens)
        out: list = [None] * len(words)
        rank = np.full(len(sym), NONE, np.int32)
        into = np.full(len(sym), -1, np.int32)
        check = np.arange(len(sym))
        while len(sym):
            at = check[check < len(sym) - 1]
            at = at[word[at] == word[at + 1]]
            rank[check], slots = NONE, self.pairs.find(sym[at], sym[at + 1])
            hit = slots >= 0
            rank[at[hit]], into[at[hit]] = self.pairs.ranks[slots[hit]], self.pairs.results[slots[hit]]
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            done = least == NONE
            if done.any():
                leaving = np.repeat(done, sizes)
                ids, ends = sym[leaving].tobytes(), np.cumsum(sizes[done]) * 4
                for w, a, b in zip(word[starts[done]].tolist(), (ends - sizes[done] * 4).tolist(), ends.tolist(), strict=True):
                    out[w] = ids[a:b]
                stay = ~leaving
                sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
                least, sizes = least[~done], sizes[~done]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == np.repeat(least, sizes))
            first = np.concatenate(([True], word[pick[1:]] != word[pick[:-1]]))
            # of pairs that overlap every other one, from the left
            new_run = np.concatenate(([True], pick[1:] != pick[:-1] + 1)) | first
            place = np.arange(len(pick)) - np.maximum.accumulate(np.where(new_run, np.arange(len(pick)), 0))
            chosen = np.where(self.singly[rank[pick]], first, place % 2 == 0)
            pick = pick[chosen]
            sym[pick] = into[pick]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
            here = moved[pick]
            check = np.unique(np.concatenate([here, here[here > 0] - 1]))
        return out

    def _final(self, ids: bytes) -> bytes:
        a = np.frombuffer(ids, np.int32)
        if len(a) and a.max() >= self.size:
            flat = []
            for i in a.tolist():
                if i < self.size:
                    flat.append(i)
                    continue
                c = self.extra.get(i) or chr(i - _FOREIGN)
                flat += [self.byte_ids[b] for b in c.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]
            return np.array(flat, np.int32).tobytes()
        return ids

    def _learned(self, words: pa.Array) -> np.ndarray:
        """Where the worker remembers each of some distinct words, after merging those that it doesn't."""
        if len(self.known) > MEMORY:
            self._forget()
        at = pc.index_in(words, value_set=self.known)
        fresh = words.filter(pc.is_null(at))
        out = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            ids = self.merge([SPACE + w for w in fresh.to_pylist()])
            out[out < 0] = len(self.known) + np.arange(len(ids))
            self.known = pa.concat_arrays([self.known, fresh])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), np.int32)])
            self.lens = np.concatenate([self.lens, np.fromiter(map(len, ids), np.int64, len(ids)) // 4])
        return out

    def _forget(self) -> None:
        self.known, self.ids, self.lens = pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.int64)

    def _odd(self, text: str) -> np.ndarray:
        """Ids of a text that isn't words with one space between them."""
        marked = (self.prefix + text).replace(" ", SPACE) if text else ""
        words = [marked] if self.whole and marked else WORD.findall(marked)
        return np.frombuffer(b"".join(self.merge(words)), np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts of words with one space between them are split by Arrow, and each distinct word is merged once while the
        worker remembers it."""
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, f"^$|^ | $|  |{SPACE}").to_numpy(zero_copy_only=False)
        if self.whole or not self.prefix:
            odd[:] = True
        cut = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        coded = cut.flatten().dictionary_encode()
        place = self._learned(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
        own, starts = self.lens[place], (np.cumsum(self.lens) - self.lens)[place]
        flat = self.ids[np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        ends = np.append(0, np.cumsum(own))[cut.offsets.to_numpy()]
        even = iter(np.split(flat, ends[1:-1]) if len(cut) else [])
        return [self._odd(t) if o else next(even) for t, o in zip(texts, odd.tolist(), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


def _coder(path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids = [x.tolist() for x in m.encode([t or "" for t in batch.column("text").to_pylist()])]
                decoded = m.decode(ids)
                if full:
                    columns = {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
                else:
                    text = m.text.__getitem__
                    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                    columns = {"n_tokens": pa.array(map(len, ids), pa.int64()), "ids_sha256": pa.array(sha(",".join(map(text, x))) for x in ids), "decoded_sha256": pa.array(map(sha, decoded))}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    return run


def _apply(docs: DataFrame, path: str, id_col: str, text_col: str, full: bool, fields: str) -> DataFrame:
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_coder(path, full)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {fields}")


def encode_pieces(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids, decoded) for each row."""
    return _apply(docs, path, id_col, text_col, True, "ids array<int>, decoded string")


def piece_digests(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, made where the ids are, so that these aren't moved."""
    return _apply(docs, path, id_col, text_col, False, "n_tokens long, ids_sha256 string, decoded_sha256 string")
