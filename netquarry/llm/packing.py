"""Packing of token sequences by non-negative least squares over shallow length combinations.

A document's ids give full windows, a head of whole units (64 ids) and a tail
under one unit. Combinations of at most four heads that fill a window exactly
are enumerated; non-negative least squares matches their repeat counts to the
histogram of heads; counts are rounded down, and heads left over are packed
greedily, largest first, into further exact fillings. What fits no window, and
the tails, run on as one stream cut at the window. So only the stream's last
sequence is padded.

The plan needs the histogram alone (under 130 numbers at any input size). A
document finds its place from its class and its rank in it: ranks are counted
inside each task while tokenizing and lifted by running totals over tasks, so
no class is gathered or sorted, however common.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netquarry.functions.storage import materialize
from netquarry.llm.text import pieces, utf8

WINDOW = 4096
UNIT = 64
DEPTH = 4
UNITS = WINDOW // UNIT  # classes 1..63 are heads of so many units, 64..126 are tails of 1..63 ids
CLASSES = UNITS + UNIT - 1
END_ID = 2
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
_CACHED_WORDS = 600_000
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids (16-bit little-endian) of a chunk between ASCII white space.

    The tokenizer drops white space and never joins across it, so ids of a text
    are those of its chunks. Plain words, with sentence marks behind them, go
    straight to the tokenizer's BPE model; every other chunk is encoded by the
    tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            spelled = part.encode().decode("latin-1").translate(self.letters)
            ids = array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(self.parts) < _CACHED_WORDS:
                self.parts[part] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        if plain:
            word, marks = plain.groups()
            ids = self._part(word.lower())
            if marks:
                ids += self._part(marks)
        else:
            ids = array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < _CACHED_WORDS:
            self[chunk] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def _tokenized(path: str):
    end = array("H", [END_ID]).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = WordIds(path), TaskContext.get().partitionId()
        counts, full = np.zeros(CLASSES, np.int64), 0
        names = ["part", "doc_id", "ids", "full_before", "head_rank", "tail_rank", "counts", "full"]
        for batch in pieces(batches, 1000):
            ids = [words.of(text) + end for text in utf8(batch.column("text"))]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            before = full + np.concatenate(([0], np.cumsum(n // WINDOW)[:-1]))
            full += int((n // WINDOW).sum())
            ranks = []
            for classes in (n % WINDOW // UNIT, np.where(n % UNIT > 0, UNITS - 1 + n % UNIT, 0)):
                order = np.argsort(classes, kind="stable")
                firsts = np.searchsorted(classes[order], classes[order])
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(n)) - firsts
                ranks.append(rank + counts[classes])
                counts += np.bincount(classes, minlength=CLASSES)
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, part)), batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(before), pa.array(ranks[0]),
                 pa.array(ranks[1]), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.int64())], names
            )
        nothing = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), nothing, pa.nulls(1, pa.binary()), nothing, nothing, nothing,
             pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([full])], names
        )

    return run


def combinations(units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``depth`` head sizes that fill a window."""
    found: list[tuple[int, ...]] = []

    def extend(sofar: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.append(sofar)
        elif len(sofar) < depth:
            for size in range(min(left, most), 0, -1):
                extend((*sofar, size), left - size, size)

    extend((), units, units - 1)
    return found


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * n):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        if gradient.max(initial=-np.inf) <= tolerance:
            break
        active[int(gradient.argmax())] = True
        while True:
            z = np.zeros(n)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (z <= 1e-12)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x += step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
        x = z
    return x


@dataclass
class Plan:
    """Where the rank-th head or tail of a class goes."""

    # Per head class: rank at which a run of equal fillings starts, its first sequence,
    # heads of the class per filling, and their first place in it.
    starts: list[list[int]] = field(default_factory=lambda: [[] for _ in range(UNITS)])
    runs: list[list[tuple[int, int, int]]] = field(default_factory=lambda: [[] for _ in range(UNITS)])
    used: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.int64))
    stream: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.int64))
    first_stream_sequence: int = 0

    def add(self, combination: tuple[int, ...], repeats: int, sequence: int) -> None:
        place = 0
        for size in dict.fromkeys(combination):
            each = combination.count(size)
            self.starts[size].append(int(self.used[size]))
            self.runs[size].append((sequence, each, place))
            self.used[size] += each * repeats
            place += each * size * UNIT

    def pieces(self, kind: int, rank: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start within the part, length, sequence, offset) of one head or tail."""
        if rank < self.used[kind]:
            run = int(np.searchsorted(self.starts[kind], rank, "right")) - 1
            sequence, each, place = self.runs[kind][run]
            turn, copy = divmod(rank - self.starts[kind][run], each)
            return [(0, length, sequence + turn, place + copy * length)]
        at, out, done = int(self.stream[kind]) + (rank - int(self.used[kind])) * length, [], 0
        while done < length:
            sequence, offset = divmod(at + done, WINDOW)
            take = min(length - done, WINDOW - offset)
            out.append((done, take, self.first_stream_sequence + sequence, offset))
            done += take
        return out


def plan_windows(counts: np.ndarray, first_sequence: int) -> Plan:
    """Fillings for a histogram of heads and tails (index 0 is ignored)."""
    plan, left, sequence = Plan(), counts.astype(np.int64).copy(), first_sequence
    heads = [c for c in range(1, UNITS) if left[c]]
    columns = [c for c in combinations() if all(left[size] for size in c)]

    def fill(combination: tuple[int, ...], repeats: int) -> None:
        nonlocal sequence
        repeats = min(repeats, *(int(left[s]) // combination.count(s) for s in set(combination)))
        if repeats > 0:
            plan.add(combination, repeats, sequence)
            sequence += repeats
            for size in combination:
                left[size] -= repeats

    if columns:
        a = np.zeros((UNITS, len(columns)))
        for j, combination in enumerate(columns):
            for size in combination:
                a[size, j] += 1
        target = counts[:UNITS].astype(float)
        target[0] = 0
        repeats = nonnegative_least_squares(a[heads], target[heads])
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] >= 1:
                fill(columns[j], int(repeats[j]))
    for largest in sorted(heads, reverse=True):  # greedy: each round uses up a class or leaves it to the stream
        while left[largest]:
            spare, chosen, room = left.copy(), [largest], UNITS - largest
            spare[largest] -= 1
            while room and (fits := [c for c in range(min(room, largest), 0, -1) if spare[c]]):
                chosen.append(fits[0])
                spare[fits[0]] -= 1
                room -= fits[0]
            if room:
                break
            fill(tuple(chosen), int(left[largest]))
    plan.first_stream_sequence = sequence
    sizes = np.array([0, *(UNIT * c for c in range(1, UNITS)), *range(1, UNIT)], np.int64)
    rest = np.where(np.arange(CLASSES) < UNITS, left, counts) * sizes
    rest[0] = 0
    plan.stream = np.concatenate(([0], np.cumsum(rest)[:-1]))
    return plan


def _placed(plan: Plan):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7
        for batch in pieces(batches, 500):
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "full_before", "head_rank", "tail_rank", "chunk_base")]
            for i, (doc_id, before, head, tail, base) in enumerate(zip(*columns)):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), "<u2")
                offsets = batch.column("bases")[i].values
                n, raw = len(ids), ids.astype("<u4")
                full, units, rest = n // WINDOW, n % WINDOW // UNIT, n % UNIT
                found = [(k * WINDOW, WINDOW, base + before + k, 0) for k in range(full)]
                at = full * WINDOW
                if units:
                    length = units * UNIT
                    found += [(at + s, *p) for s, *p in plan.pieces(units, head + offsets[units].as_py(), length)]
                    at += length
                if rest:
                    kind = UNITS - 1 + rest
                    found += [(at + s, *p) for s, *p in plan.pieces(kind, tail + offsets[kind].as_py(), rest)]
                rows += [(doc_id, s, length, zlib.crc32(raw[s : s + length].tobytes()), n, q, o) for s, length, q, o in found]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and the end id; each id lies in one piece, and
    pieces fill sequences of 4096 ids from offset 0 without gaps. ``start`` counts
    the document's ids before the piece, ``doc_tokens`` all of them, ids_crc32 is
    over the piece's ids as little-endian 32-bit numbers. Only the last sequence
    can be short.

    Null and empty texts are the end id alone. Each repeated row is a document of
    its own; doc_id may be null; other columns are not read; an empty table gives
    an empty result. ``tokenizer`` names a file every executor can read.
    """
    schema = ("part bigint, doc_id bigint, ids binary, full_before bigint, head_rank bigint, tail_rank bigint, "
              "counts array<bigint>, full bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    written = materialize(rows.mapInArrow(_tokenized(tokenizer), schema), "packing-ids")
    tasks = written.filter("ids IS NULL").select("part", "counts", "full")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # The number of full windows is one more class, so all running totals are one window.
    listed = tasks.select("part", F.posexplode(F.concat("counts", F.array("full"))).alias("class", "n"))
    lifted = listed.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = lifted.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("class", "base"))).alias("all"))
    bases = materialize(
        bases.select("part", F.col("all.base").alias("bases"), F.element_at("all.base", -1).alias("chunk_base")), "packing-bases"
    )
    totals = {r["class"]: r["n"] for r in listed.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # CLASSES + 1 rows
    counts = np.array([totals.get(c, 0) for c in range(CLASSES)], np.int64)
    plan = plan_windows(counts, totals.get(CLASSES, 0))
    out = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    with_ids = written.filter("ids IS NOT NULL").select("part", "doc_id", "ids", "full_before", "head_rank", "tail_rank")
    return with_ids.join(bases, "part").mapInArrow(_placed(plan), out)

