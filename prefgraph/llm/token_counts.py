"""Token counts of whole texts; huge ones by overlapping windows that are spliced where both encodings agree.

A text of more than ``WINDOW`` characters is encoded in windows that overlap by ``OVERLAP``, with the library's offsets.
Two neighbours are spliced at a place in their overlap where both have a token boundary and where a letter, digit or
sign precedes white space: no token of the byte-level pattern spans such a place (see byte_bpe), so the tokens
on either side are those of the whole text. If the overlap has no such place, the left window is widened, by twice as much
each time, up to the end of the text. Shorter texts are encoded whole.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a text without white space is encoded in one piece, whatever
its length; repeated rows and null ids give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.llm.byte_bpe import WHITE, BatchEncoder, encoder
from prefgraph.llm.common import ship_package

WINDOW, OVERLAP = 32_768, 512
_SEAM = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


def _window(library, text: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in the text, of the tokens of a window."""
    at = np.array(library.encode(text[start:stop], add_special_tokens=False).offsets, np.int64).reshape(-1, 2) + start
    return at[:, 0], at[:, 1]


def _before(window, place: int) -> int | None:
    """Tokens of the window before a place, or None if a token spans it."""
    starts, ends = window
    n = int(np.searchsorted(starts, place))
    return n if n == 0 or ends[:n].max() <= place else None


def count_in_windows(coder: BatchEncoder, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> int:
    library, total = coder.library, 0
    start, stop = 0, min(window, len(text))
    left, counted = _window(library, text, start, stop), 0  # counted: the left window's tokens before the last seam
    while stop < len(text):
        widened = overlap
        while True:
            begin, end = max(start + 1, stop - widened), min(len(text), stop - widened + window)
            right, seam = _window(library, text, begin, end), None
            for m in _SEAM.finditer(text, begin + 1, stop):
                if begin < m.start() < stop and (a := _before(left, m.start())) is not None and (b := _before(right, m.start())) is not None and a >= counted:
                    seam = (a, b)
                    break
            if seam:
                break
            # no proven boundary in the overlap: the left window grows
            widened *= 2
            stop = min(len(text), stop + widened)
            left = _window(library, text, start, stop)
            if stop == len(text):
                return total + len(left[0]) - counted
        total += seam[0] - counted
        start, stop, left, counted = begin, end, right, seam[1]
    return total + len(left[0]) - counted


def _counter(path: str, window: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            long = pc.greater(pc.utf8_length(texts), window)
            counts = np.zeros(len(texts), np.int64)
            counts[~long.to_numpy(zero_copy_only=False)] = coder.count(texts.filter(pc.invert(long)))
            for k in np.flatnonzero(long).tolist():
                counts[k] = count_in_windows(coder, texts[k].as_py(), window, overlap)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text", limit: int = 1024, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; ``vocabulary`` is the path of a tokenizers file."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(_counter(vocabulary, window, overlap), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
