"""Words, word hashes and row keys shared by the operators.

Words are runs of bytes outside space and tab..carriage return, which is what
``bytes.split()`` yields, so texts stay UTF-8 bytes and are never decoded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_CACHED_WORDS = 400_000  # word hashes one task keeps; beyond it words are hashed again
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word to 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < _CACHED_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` consecutive word hashes (empty if there are fewer)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= _MULTIPLIER
        out += h[j : j + n]
    return mixed(out)


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole word sequence, its length included."""
    return xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))


def signed(value: int) -> int:
    """A 64-bit hash as Spark's bigint."""
    return value - (1 << 64) if value >= 1 << 63 else value


def utf8(column: pa.Array) -> Iterator[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty; one object at a time."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that one batch's derived arrays stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_key(text: Column) -> Column:
    """Key of a text's content; with doc_id it tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is not in ``dropped`` (doc_id, text_key)."""
    gone = dropped.select(F.col("doc_id").alias("_nq_id"), F.col("text_key").alias("_nq_key")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_nq_id"]) & (text_key(docs["text"]) == gone["_nq_key"])
    return docs.join(gone, same, "left_anti")
