"""Byte-pair encoding and decoding of whole texts with a public byte-level tokenizer file.

A text is cut at special tokens and then by the tokenizer's pattern into words. A
word is merged over two contiguous arrays: its parts between the boundaries that
are left, and the rank of every pair of neighbours. The smallest rank is found by
scanning, its boundary is deleted and the two ranks beside it are refreshed, until
no pair has a rank. Words beyond ``SHORT`` bytes, for which scanning is quadratic, take the
same merges from a heap of ranks instead.

Encoding and decoding are two row-wise passes without a shuffle; each
Python worker remembers the ids of a bounded number of words.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.text import pieces

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHORT = 256  # bytes of a word whose ranks are scanned
_CACHED_WORDS = 300_000
_CACHED_BYTES = 64  # longer words are merged again each time
_CHUNK = 100_000  # words of a long text looked up at once
_NONE = 1 << 62
# Fixed value: white space of the split pattern, the Unicode White_Space property.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the split pattern of byte-level BPE.
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others 256 and up in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in letters)
    letters |= {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Bpe:
    """Ranks, ids and special tokens of one tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, split, special = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not spec["normalizer"]
        odd = model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
        if not plain or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        vocab, letters = model["vocab"], byte_letters()
        # A pair of neighbouring parts (by id) has a rank; the rank names the part they merge to.
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged_id = [vocab[a + b] for a, b in pairs]
        self.byte_id = [vocab[letter] for letter in letters]
        self.special = {t["content"]: t["id"] for t in special}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if special else None
        self.words = regex.compile(_SPLIT)
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.pieces = {i: bytes(map(byte_of.__getitem__, token)) for token, i in vocab.items()} | {i: token.encode() for token, i in self.special.items()}

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word."""
        return self._scanned(word) if len(word) <= SHORT else self._queued(word)

    def _scanned(self, word: bytes) -> list[int]:
        """Parts and the ranks between them as two contiguous arrays: delete the boundary of the smallest (leftmost) rank."""
        rank_of = self.ranks.get
        parts = [self.byte_id[b] for b in word]
        ranks = [rank_of(pair, _NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            part = parts[i] = self.merged_id[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], part), _NONE)
            if i < len(ranks):
                ranks[i] = rank_of((part, parts[i + 1]), _NONE)
        return parts

    def _queued(self, word: bytes) -> list[int]:
        """The same merges for a long word: parts are linked by their starts, a heap holds (rank, start, both parts)."""
        n, rank_of = len(word), self.ranks.get
        part = [self.byte_id[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                rank = rank_of((part[left], part[right]))
                if rank is not None:
                    heapq.heappush(heap, (rank, left, part[left], part[right]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, left, a, b = heapq.heappop(heap)
            right = after[left]
            if part[left] != a or right >= n or part[right] != b:
                continue  # one of its parts has been merged since
            part[left], part[right], after[left] = self.merged_id[rank], -1, after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(left)
            if left:
                offer(before[left])
        return [p for p in part if p >= 0]


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit integers; remembers a bounded number of short words."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = _packed(self.bpe.merged(raw))
        if len(self) < _CACHED_WORDS and len(raw) <= _CACHED_BYTES:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        bpe = self.bpe
        if not bpe.cut:
            return self._plain(text)
        parts = bpe.cut.split(text)
        return b"".join(_packed([bpe.special[p]]) if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        found = (m.group() for m in self.bpe.words.finditer(text)) if len(text) > _CHUNK else iter(self.bpe.words.findall(text))
        out = []
        while chunk := b"".join(map(self.__getitem__, islice(found, _CHUNK))):
            out.append(chunk)
        return b"".join(out)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One file's tokenizer, kept by a Python worker from task to task."""
    return WordIds(Bpe(path))


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _encoder(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in pieces(batches, 500):
            ids = [words.of(text.as_py() or "") for text in batch.column("text")]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def _decoder(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = word_ids(path).bpe.pieces.__getitem__
        for batch in pieces(batches, 500):
            texts = [b"".join(map(piece, array("I", ids.as_py() or b""))).decode("utf-8", "replace") for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), batch.column("ids"), pa.array(texts, pa.string())],
                                             ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per row: doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit integers) of the whole text.

    No special tokens are added; a special token's string in a text is that token.
    Null and empty texts have no ids. Rows are encoded one by one, so repeated rows
    and null ids stay as they are, and a text of any length, or a word of any
    length, is encoded whole. Other columns are not read; an empty table gives an
    empty result. ``path`` must be readable on every executor.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoder(path), "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Adds the text that ids (of ``encode``) stand for, special tokens included, as ``decoded``.

    Null or empty ids give an empty text; bytes that are no UTF-8, as cut sequences
    may have, become replacement characters.
    """
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoder(path), "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and lowercase hex digests of ids and decoded text."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
