"""Token ids, counts, pieces and token files against the libraries."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from prefgraph.llm import byte_bpe, piece_bpe, token_counts, token_files
from prefgraph.llm.byte_bpe import encoder

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "a", "B", "the", "é", "ß", "'s", "'ll", "1", "²", "<|endoftext|>", "$$", "🙂", "é", "中", "​", ".", "x" * 5, "\r\n", "▁", "<s>", "<0x41>", "tion", "ing", "aaa"]
ODD = ["", None, " ", "\n\n", "a", "x" * 3000, "word " * 3000, " lead", "trail ", "a\nb"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = spark.createDataFrame([(10_000 + k, t, 7) for k, t in enumerate(ODD)] + [(None, "no id", 7), (10_000, "twice", 7)], "doc_id long, text string, n_tokens int")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd, allowMissingColumns=True)


def test_piecewise_ids_are_the_library_s(monkeypatch):
    library, sample = Tokenizer.from_file(BPE), texts(1500, 1)
    sample += ["<|endoftext|>", "a <|endoftext|> b", "<s> </s> <unk>", "a<|endoftext|>b c", "\u3000\u5168 x", "x \xa0y", "a\tb\n c", ""]
    want = [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]
    for memory in (byte_bpe.MEMORY, 50):
        monkeypatch.setattr(byte_bpe, "MEMORY", memory)
        monkeypatch.setattr(byte_bpe, "GROUP", 4 * memory)
        coder = byte_bpe.BatchEncoder(BPE)
        for part in (sample, sample[::-1]):
            ids, counts = coder.encode(pa.array(part, pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == (want if part is sample else want[::-1])
            assert coder.count(pa.array(part, pa.string())).tolist() == counts.tolist()
    assert coder.encode(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0] and not len(coder.count(pa.array([], pa.string())))


@pytest.mark.parametrize("window, overlap", [(40, 4), (64, 16), (200, 1)])
def test_windows_splice_to_the_whole(window, overlap):
    library, coder = Tokenizer.from_file(BPE), encoder(BPE)
    for text in [*texts(150, 2), "x" * 500, "ab cd " * 100, "中" * 300, "$$$ %%% " * 50]:
        assert token_counts.count_in_windows(coder, text, window, overlap) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts(spark, docs):
    library = Tokenizer.from_file(BPE)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 1024) for r in docs.collect())
    got = token_counts.token_counts(docs, BPE, window=2000, overlap=64).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert token_counts.token_counts(docs.limit(0), BPE).count() == 0


def test_pieces_are_the_library_s():
    library, sample = sentencepiece.SentencePieceProcessor(model_file=PIECES), [*texts(2000, 3), "x" * 2000, " " * 300, "ab" * 500]
    assert [g.tolist() for g in piece_bpe.model(PIECES).encode(sample)] == library.encode(sample)


def test_piece_digests(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(r["doc_id"]), len(ids := library.encode(r["text"] or "")), sha(",".join(map(str, ids))), sha(library.decode(ids))) for r in docs.collect())
    got = piece_bpe.piece_digests(docs, PIECES).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert piece_bpe.encode_pieces(docs.limit(0), PIECES).count() == 0


def test_token_files(spark, docs):
    library = Tokenizer.from_file(BPE)
    rows = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.where("doc_id is null or text is null or text <> 'twice'").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for doc_id, ids in rows:
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.read_token_files(token_files.write_token_files(docs.where("doc_id is null or text is null or text <> 'twice'"), BPE)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), BPE)).count() == 0


def test_documents_longer_than_a_block(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 300, 5000).astype(np.uint32)
    lengths = token_files.code_lengths(np.bincount(ids))
    writer = token_files.FileWriter(f"file://{tmp_path}/x.ids", lengths)
    writer.block(ids[:3000], [(5, 4500), (None, 500)])
    writer.block(ids[3000:], [])
    writer.close()
    blocks = list(token_files.read_blocks(f"file://{tmp_path}/x.ids"))
    assert np.array_equal(np.concatenate([b for b, _ in blocks]), ids) and blocks[0][1] == [(5, 4500), (None, 500)]


@pytest.mark.parametrize("counts", [[5], [1, 0, 1], list(range(1, 400)), [2**k for k in range(40)]])
def test_lengths_are_a_code_within_the_limit(counts):
    lengths = token_files.code_lengths(np.array(counts), 12)
    used = lengths[np.array(counts) > 0]
    assert (used > 0).all() and used.max() <= 12 and sum(2.0 ** -int(x) for x in used) <= 1
    codes = token_files.canonical(lengths)
    words = sorted(format(int(c), f"0{n}b") for c, n in zip(codes, lengths, strict=True) if n)
    assert all(not b.startswith(a) for a, b in zip(words, words[1:]))


def test_long_words_end_and_equal_the_library():
    library, m, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_bpe.model(PIECES), random.Random(9)
    for text in ["x" * 5000, " " * 3001, "ab" * 2000, "".join(rng.choices("etaoin shrdlu", k=4000)).replace(" ", ""), "é中🙂" * 700, "a" + " " * 2000 + "b"]:
        assert m.encode([text])[0].tolist() == library.encode(text)
    for text in (" " * 1_000_000, "".join(rng.choices("etaoinshrdlu", k=100_000))):
        began = time.time()
        ids = m.encode([text])[0].tolist()
        assert time.time() - began < 60 and ids == library.encode(text)


def test_queue_and_rounds_agree():
    m, rng = piece_bpe.model(PIECES), random.Random(10)
    words = ["▁" + "".join(rng.choices("▁▁etaoinshrdlu.,0", k=rng.randint(1, 60))) for _ in range(600)]
    assert [m._merge_long(w) for w in words] == m._merge_rounds(words)
