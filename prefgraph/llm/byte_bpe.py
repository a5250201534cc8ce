"""Token ids of whole texts by the tokenizers library, by distinct pieces.

In the byte-level vocabulary's pattern no token holds a non-white character followed by a white one: letters, digits and
other signs are matched with at most one space in front, white space only with white space, and the special tokens hold
none. A place after a non-white and before a white character is so a token boundary whatever stands around it, and what
lies between two such places is encoded alike alone and in the text. The texts of a batch are cut at their spaces by Arrow if
each space is such a place, and the library encodes each distinct piece once: thousands of them joined by spaces in one call, of
which every token that starts with a space starts a piece. Texts with other white space beside a space are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space property (fixed values of the standard), as a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CLASS = re.sub(r"\\[xu]([0-9a-f]+)", r"\\x{\1}", WHITE)
#: A space beside other white space, or at an end: such texts are encoded whole.
UNEVEN = f" [{_CLASS}]|[{_CLASS}] |^ | $"
#: Pieces joined for one call of the library, bytes of the texts whose pieces are collected at a time, and pieces that a worker
#: remembers.
JOINED, GROUP, MEMORY = 2000, 1 << 25, 1_000_000

_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]


def _after(lens: np.ndarray) -> np.ndarray:
    """Where each of some neighbours of these lengths starts."""
    return np.cumsum(lens) - lens


class BatchEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        words = self.library.get_vocab(with_added_tokens=True)
        # the byte-level alphabet writes a space as this letter
        self.spaced = np.zeros(max(words.values(), default=0) + 1, bool)
        self.spaced[[i for w, i in words.items() if w.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.lens = pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and their number."""
        ids = [code.ids for code in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for own in ids for i in own), np.uint32, int(lens.sum())), lens

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces with a space before each, and their number; no piece starts or ends with white space."""
        edges = np.append(np.arange(0, len(pieces), JOINED), len(pieces)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), pieces), " ").to_pylist()
        flat, lens = [], []
        for k, code in enumerate(self.library.encode_batch_fast([" " + j for j in joined], add_special_tokens=False)):
            ids = np.array(code.ids, np.uint32)
            starts = np.flatnonzero(self.spaced[ids])
            n = int(edges[k + 1] - edges[k])
            if len(starts) == n and starts[0] == 0:
                flat.append(ids)
                lens.append(np.diff(np.append(starts, len(ids))))
            else:  # a special token that takes the space before it
                ids, own = self._whole([" " + p for p in pieces[edges[k] : edges[k + 1]].to_pylist()])
                flat.append(ids)
                lens.append(own)
        return np.concatenate(flat), np.concatenate(lens)

    def _learned(self, pieces: pa.Array) -> np.ndarray:
        """Where the worker remembers each of some distinct pieces, after encoding those that it doesn't."""
        if len(self.known) > MEMORY:
            self._forget()
        at = pc.index_in(pieces, value_set=self.known)
        fresh = pieces.filter(pc.is_null(at))
        out = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            out[out < 0] = len(self.known) + np.arange(len(fresh))
            ids, lens = self._pieces(fresh)
            self.known, self.ids, self.lens = pa.concat_arrays([self.known, fresh]), np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])
        return out

    def _group(self, texts: pa.Array, full: bool) -> tuple[np.ndarray | None, np.ndarray]:
        uneven = pc.match_substring_regex(texts, UNEVEN)
        cut = pc.split_pattern(pc.if_else(uneven, "", texts), " ")
        first, words = cut.offsets.to_numpy()[:-1].astype(np.int64), cut.flatten()
        inner = np.ones(len(words), bool)
        inner[first] = False
        # heads have no space before them; a text that isn't even is its own head
        heads, head_lens = self._whole(pc.if_else(uneven, texts, words.take(pa.array(first))).to_pylist())
        coded = words.filter(pa.array(inner)).dictionary_encode()
        learned = self._learned(coded.dictionary)
        place = np.empty(len(words), np.int64)
        place[inner] = learned[coded.indices.to_numpy()]
        place[first] = len(self.lens) + np.arange(len(texts))
        lens = np.concatenate([self.lens, head_lens])
        own = lens[place]
        counts = np.add.reduceat(own, first)
        if not full:
            return None, counts
        return np.concatenate([self.ids, heads])[np.repeat(_after(lens)[place] - _after(own), own) + np.arange(int(own.sum()))], counts

    def _run(self, texts: pa.Array, full: bool) -> tuple[list, np.ndarray]:
        """By groups of about ``GROUP`` bytes; a null text is empty."""
        texts = pc.fill_null(texts, "")
        group = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // GROUP
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        done = [self._group(texts.slice(a, b - a), full) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        return [ids for ids, _ in done], np.concatenate([np.empty(0, np.int64), *[n for _, n in done]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another as the library gives them without added special tokens, and the number of each."""
        flat, counts = self._run(texts, True)
        return np.concatenate([np.empty(0, np.uint32), *flat]), counts

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        return self._run(texts, False)[1]
