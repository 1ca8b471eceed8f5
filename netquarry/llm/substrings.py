"""Exact removal of long repeated word spans over a compacted De Bruijn graph.

Nodes are the 19-word sequences of the corpus, edges the 20-word windows. Edges
are partitioned by their anchor, the eight-word part with the smallest hash.
Consecutive windows of a document with one anchor form a path of up to 13 edges,
written as one row. One exchange brings the rows of an anchor together, and windows
over it tell three cases apart:

- the anchor occurs once: none of its edges repeats, the rows go;
- it always occurs inside the same path: the path is nonbranching and repeated
  as a whole, so its occurrences compare as one unit;
- paths differ around the anchor: the graph branches there, and one occurrence
  of each distinct path (its earliest) is unfolded into single edges.

Equal words therefore always meet at one anchor, wherever documents begin or end,
and only about a seventh of all windows is ever a row. Rows carry source
coordinates (document, start), whose smallest is the occurrence that stays. A
path or edge is identified by its anchor's and its own hash, 128 bits together.

A task first folds the equal paths among up to ``FOLD`` rows: only the earliest
goes to its anchor, the others are known to repeat and are spread by their place,
so a passage in a third of all documents is one row per fold there. No row is
written before it is known to repeat; joins then bring branching paths, and what
goes, back to the documents they come from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.storage import materialize
from netquarry.llm.text import WordHashes, mixed, pieces, text_key, utf8, window_hashes

WINDOW = 20
ANCHOR = 8
_ODD = np.uint64(0xD6E8FEB86659FD93)
FOLD = 1 << 20  # rows a task holds to fold equal ones
# Within a document a coordinate is one bigint: the word position above 8 bits of path
# length. Its order is the order of occurrence.
_START, _LENGTH = 8, 0xFF
# A document is its id, null last; text_key is 0 unless several texts share the id.
_DOCUMENT = ["unnamed", "id", "text_key"]
_PLACED = "unnamed bigint, id bigint, text_key bigint, at bigint, anchor bigint, content bigint"


def paths(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content, start and number of windows of each path of one document."""
    edges = window_hashes(h, WINDOW)
    if not len(edges):
        none = np.empty(0, np.uint64)
        return none, none, none, none
    parts = window_hashes(h, ANCHOR)
    at = np.lib.stride_tricks.sliding_window_view(parts, WINDOW - ANCHOR + 1).argmin(axis=1) + np.arange(len(edges))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(edges)) - 1
    length = (last - first + 1).astype(np.uint64)
    # A path has at most 32 words, so its first and last window cover all of them.
    content = mixed(edges[first] * _ODD + edges[last] + length)
    return parts[at[first]], content, first.astype(np.uint64), length


def _folded(held: list[tuple]) -> pa.RecordBatch:
    """Earliest row of each (anchor, content); the later ones spread by place, without content."""
    unnamed, ids, keys = (np.concatenate([docs.column(c).to_numpy() for docs, *_ in held]) for c in _DOCUMENT)
    rows, at, anchor, content = (np.concatenate([h[j] for h in held]) for j in range(1, 5))
    order = np.lexsort((keys, ids, unnamed))
    new = np.zeros(len(order), np.int64)
    new[1:] = (np.diff(unnamed[order]) != 0) | (np.diff(ids[order]) != 0) | (np.diff(keys[order]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)

    order = np.lexsort((at, rank[rows], content, anchor))
    rows, at, anchor, content = rows[order], at[order], anchor[order], content[order]
    later = np.zeros(len(order), bool)
    later[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
    # A repeated row gives the same place again.
    twin = np.zeros(len(order), bool)
    twin[1:] = later[1:] & (rank[rows[1:]] == rank[rows[:-1]]) & (at[1:] == at[:-1])
    rows, at, anchor, content, later = (x[~twin] for x in (rows, at, anchor, content, later))
    # Twins of the earliest are gone, so what is left of a group after its head stands later.
    spread = mixed(anchor * _ODD + mixed(ids[rows].view(np.uint64) * _ODD + at.view(np.uint64)))
    anchor = np.where(later, spread, anchor).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x[rows]) for x in (unnamed, ids, keys)), pa.array(at), pa.array(anchor), pa.array(content.view(np.int64), mask=later)],
        [*_DOCUMENT, "at", "anchor", "content"],
    )


def _folds(parts: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Parts are (documents, row, at, anchor, content); rows count within their documents."""
    held, size, base = [], 0, 0
    for docs, rows, *found in parts:
        held.append((docs, rows + base, *found))
        size, base = size + len(rows), base + docs.num_rows
        if size >= FOLD:
            yield _folded(held)
            held, size, base = [], 0, 0
    if size:
        yield _folded(held)


def _joined(found: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([f[j] for f in found]) for j in range(4))


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()

    def parts():
        for batch in pieces(batches, 1000):
            found = []
            for i, text in enumerate(utf8(batch.column("text"))):
                anchor, content, start, length = paths(words.of(text.split()))
                found.append((np.full(len(anchor), i), ((start << np.uint64(_START)) | length).view(np.int64), anchor, content))
            if found:
                yield batch.select(_DOCUMENT), *_joined(found)

    return _folds(parts())


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single edges of the named paths."""
    words = WordHashes()

    def parts():
        for batch in pieces(batches, 500):
            found = []
            for i, (text, branching) in enumerate(zip(utf8(batch.column("text")), batch.column("branching"))):
                edges = window_hashes(words.of(text.split()), WINDOW)
                coordinate = branching.values.field("at").to_numpy()
                length = coordinate & _LENGTH
                # Positions of all windows of all paths: each path counts on from its first.
                total = int(length.sum())
                at = np.arange(total) + np.repeat((coordinate >> _START) - np.concatenate(([0], np.cumsum(length)[:-1])), length)
                anchor = np.repeat(branching.values.field("anchor").to_numpy(), length).view(np.uint64)
                found.append((np.full(total, i), (at << _START) | 1, anchor, edges[at]))
            if found:
                yield batch.select(_DOCUMENT), *_joined(found)

    return _folds(parts())


def _repeated(occurrences: DataFrame) -> DataFrame:
    """Rows that stand later than an equal one, and the earliest of each path where paths branch.

    Columns of a place, and the anchor of branching rows (null for later ones). One
    exchange by anchor serves both windows.
    """
    place = F.struct(*_DOCUMENT, "at")
    path, node = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
    met = occurrences.repartition("anchor").withColumn("later", F.col("content").isNull() | (place != F.min(place).over(path)))
    met = met.withColumn("branches", F.min("content").over(node) != F.max("content").over(node)).filter("later OR branches")
    return met.select(*_DOCUMENT, "at", F.when(~F.col("later"), F.col("anchor")).alias("anchor"))


def _rows(docs: DataFrame) -> DataFrame:
    """Texts by document; a text key is carried only where several texts share an id."""
    number = F.col("doc_id").cast("bigint")
    named = docs.select(number.isNull().cast("bigint").alias("unnamed"), F.coalesce(number, F.lit(0)).alias("id"), text_key(F.col("text")).alias("text_key"), "text")
    low, high = F.min("text_key").alias("low"), F.max("text_key").alias("high")
    shared = named.groupBy("unnamed", "id").agg(low, high).filter("low < high").select("unnamed", "id", F.lit(True).alias("shared"))
    named = named.join(materialize(shared, "substring-ids"), ["unnamed", "id"], "left")
    return named.select("unnamed", "id", F.when(F.col("shared"), F.col("text_key")).otherwise(F.lit(0)).alias("text_key"), "text")


def _texts(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts of the documents that ``lists`` names, with its columns; the key table alone thins the texts first."""
    return rows.join(lists.select(*_DOCUMENT), _DOCUMENT, "left_semi").join(lists, _DOCUMENT)


def repeats(rows: DataFrame) -> DataFrame:
    """Per document that loses words: the coordinates ``gone`` of what also starts earlier."""
    found = materialize(_repeated(rows.mapInArrow(_paths, _PLACED)), "substring-repeats")
    branching = found.filter("anchor IS NOT NULL").groupBy(*_DOCUMENT).agg(F.collect_list(F.struct("anchor", "at")).alias("branching"))
    texts = _texts(rows, materialize(branching, "substring-branching"))
    edges = _repeated(texts.mapInArrow(_edges, _PLACED))
    later = found.unionByName(edges).filter("anchor IS NULL")
    return materialize(later.groupBy(*_DOCUMENT).agg(F.collect_list("at").alias("gone")), "substring-gone")


def _stripped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1000):
        totals, removed, digests, left = [], [], [], []
        for text, found in zip(utf8(batch.column("text")), batch.column("gone")):
            split = text.split()
            gone = np.zeros(len(split) + 1, np.int64)
            if found.is_valid:
                at = found.values.to_numpy()
                start = at >> _START
                np.add.at(gone, start, 1)
                np.add.at(gone, start + (at & _LENGTH) + (WINDOW - 1), -1)
            keep = np.cumsum(gone)[:-1] == 0
            rest = b" ".join([w for w, k in zip(split, keep.tolist()) if k])
            totals.append(len(split))
            removed.append(len(split) - int(keep.sum()))
            digests.append(hashlib.sha256(rest).hexdigest())
            left.append(rest)
        ids = pa.array(batch.column("id").to_numpy(), mask=batch.column("unnamed").to_numpy() == 1)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(left, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Words are runs outside space and tab..carriage return. A word goes if a window
    of 20 consecutive words covering it also starts earlier: in a smaller doc_id,
    or earlier in the same document. Windows are judged on the input. kept_sha256
    digests the remaining words joined by single spaces.

    Null, empty and blank texts have no words; texts under 20 words keep all.
    Repeated rows with one doc_id and text count as one document, keep one row
    each, and agree; other texts of one doc_id are documents of their own, in an
    order of their hash. A null doc_id comes after all others. Other columns are not
    read; an empty table gives an empty result.
    """
    rows = _rows(docs)
    gone = repeats(rows)
    whole = rows.join(gone.select(*_DOCUMENT), _DOCUMENT, "left_anti").withColumn("gone", F.lit(None).cast("array<bigint>"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    parts = [part.select(*_DOCUMENT, "text", "gone").mapInArrow(_stripped, schema).select(columns) for part in (_texts(rows, gone), whole)]
    return parts[0].unionByName(parts[1])
