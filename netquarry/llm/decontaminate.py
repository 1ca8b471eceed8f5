"""Benchmark passages in documents, by latent semantic retrieval and word checks.

Features are the benchmark's own words (bounded by the benchmark, not by the
corpus), weighted by inverse document frequency over all documents. The latent
space is the SVD of a block's TF-IDF rows together with the leading directions of
the documents' TF-IDF passages, which a randomised SVD finds in Spark over all
passages of all documents; it holds every item whole. Words are looked up once, in
a written table of feature numbers. Every passage of every document is searched. A passage is 32
words, one every 16, with as many words around it as the item has. Documents, then
their passages, are compared with the items by cosine in the space: a candidate
has at least the cosine that the confirmation implies, so nothing it would accept
is passed over, however many documents there are. Candidates are confirmed on the
words around the passage: longest common subsequence with the item, and the same
for the item's answer, its last sentence. Among the confirmed passages of a pair
the cosine decides after these shares. A benchmark is searched in blocks of items;
all work on a document happens where it is read, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.storage import materialize
from netquarry.llm.text import pieces, text_key, utf8

STRIDE, SPAN = 16, 2  # a passage is SPAN strides long
BLOCK_ITEMS = 1000  # benchmark items searched in one pass
MIN_COMMON = 0.6  # share of the item's words in order around the passage
MIN_ANSWER = 0.5  # the same for the item's answer
_MARKS = b".,;:!?\"'()[]"
_EPS = 1e-12
_RANK_FLOOR = 1e-12  # smaller shares of the largest eigenvalue are rounding, of repeated items
_SLACK = 1e-4  # rounding of a cosine in the space, which is kept in single precision
DIRECTIONS = 48  # leading directions of the documents' passages
_CHUNK = 16_000  # words whose passages are multiplied at once


def plain_words(raw: bytes) -> list[bytes]:
    """Words in lower case without sentence marks."""
    return raw.lower().translate(None, _MARKS).split()


def features_of(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Feature number per word, 0 for words no item has."""
    return np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words))


@dataclass
class Items:
    """A block of benchmark items, ready to ship to tasks."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int]


def items_of(rows: list) -> Items:
    """Items of (item_id, text) rows; those without words are left out."""
    ids, words, answers, vocabulary = [], [], [], {}
    for item_id, text in rows:
        raw = (text or "").encode()
        found = plain_words(raw)
        if not found:
            continue
        sentence = plain_words(re.split(rb"(?<=[.!?])\s+", raw.strip())[-1])
        ids.append(item_id)
        words.append(found)
        answers.append(sentence if len(sentence) >= 4 else found[-8:])
        for word in found:
            vocabulary.setdefault(word, len(vocabulary) + 1)
    return Items(ids, words, answers, vocabulary)


def coded(docs: DataFrame, items: Items) -> DataFrame:
    """``docs`` with ``ids``, the feature numbers of all words as bytes, in place of ``text``."""
    if "ids" in docs.columns:
        return docs
    kind, kept = _id_type(items), [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1000):
            found = [features_of(plain_words(text), items.vocabulary).astype(kind).tobytes() for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.binary())], [*kept, "ids"])

    return docs.mapInArrow(run, docs.select(*kept).schema.add("ids", "binary"))


def _id_type(items: Items) -> type:
    return np.uint16 if len(items.vocabulary) < 1 << 16 else np.uint32


def _ids(batch: pa.RecordBatch, items: Items) -> Iterator[np.ndarray]:
    """Feature numbers of each row's words."""
    for value in batch.column("ids"):
        yield np.frombuffer(value.as_py(), _id_type(items))


def _frequencies(items: Items):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(items.vocabulary) + 1, np.int64), 0
        for batch in batches:
            for ids in _ids(batch, items):
                df[np.unique(ids)] += 1
                n += 1
        df[0] = n  # feature 0, every other word, carries the number of documents
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["feature", "df"])

    return run


def inverse_frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """Weight per feature over all documents, given by text or coded; the vector's length is the benchmark's vocabulary."""
    rows = coded(docs, items).select("ids").mapInArrow(_frequencies(items), "feature bigint, df bigint")
    df = np.zeros(len(items.vocabulary) + 1)
    for row in rows.groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[row["feature"]] = row["df"]
    n = df[0]
    df[0] = 0
    return np.log((n + 1) / (df + 1)) + 0.01


def _chunks(texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of whole texts in rows of a stride each, blank at the end, and the row each text starts with, the last one's end included."""
    held: list[np.ndarray] = []
    n = 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([-(-len(ids) // STRIDE) for ids in held])
        starts = np.concatenate([[0], ends])
        rows = np.zeros(starts[-1] * STRIDE, held[0].dtype)
        for ids, start in zip(held, starts):
            rows[start * STRIDE : start * STRIDE + len(ids)] = ids
        return rows.reshape(-1, STRIDE), starts

    for ids in texts:
        held.append(ids)
        n += len(ids)
        if n >= _CHUNK:
            yield made()
            held, n = [], 0
    if held:
        yield made()


def _add_products(rows: np.ndarray, starts: np.ndarray, scaled: np.ndarray, weight2: np.ndarray, total: np.ndarray) -> None:
    """Adds A'A times the directions, without the features' last weight, over one chunk's passages to ``total``."""
    along, size, part = np.zeros((len(rows), scaled.shape[1])), np.zeros(len(rows)), np.empty((len(rows), scaled.shape[1]))
    for words in rows.T.astype(np.intp, order="C"):
        scaled.take(words, axis=0, out=part, mode="clip")
        along += part
        size += weight2.take(words)
    # A passage is a stride and the next of its text, or a text's only stride.
    first, last = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    first[starts[:-1]] = last[starts[1:] - 1] = True
    goes_on = np.flatnonzero(~last)
    passage, lengths = along.copy(), size.copy()
    passage[goes_on] += along[goes_on + 1]
    lengths[goes_on] += size[goes_on + 1]
    passage /= lengths[:, None] + _EPS
    passage[last & ~first] = 0.0
    # A word lies in the passage its stride starts and in the one before.
    own = passage.copy()
    own[goes_on + 1] += passage[goes_on]
    known = np.flatnonzero(rows)
    order = known[np.argsort(rows.ravel()[known], kind="stable")]
    ids = rows.ravel()[order]
    fresh = np.append(True, ids[1:] != ids[:-1])
    place, row = np.cumsum(fresh) - 1, order // STRIDE
    total[ids[fresh]] += np.array([np.bincount(place, column.take(row)) for column in np.ascontiguousarray(own.T)]).T


def _passage_products(items: Items, idf: np.ndarray, directions: np.ndarray):
    """Task body: A'A times ``directions`` (features x columns) over the unit TF-IDF rows A of this task's passages."""
    scaled, weight2 = directions * idf[:, None], idf**2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(scaled)
        for rows, starts in _chunks(ids for batch in batches for ids in _ids(batch, items) if ids.any()):
            _add_products(rows, starts, scaled, weight2, total)
        total *= idf[:, None]
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c) for c in total[used].T)], ["feature", *(f"c{j}" for j in range(scaled.shape[1]))])

    return run


def passage_directions(docs: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF rows of all passages of ``docs`` times their share of the largest singular value, as rows.

    ``docs`` are given by text or coded. A randomised SVD: a Gaussian start, then two
    products with the rows, each summed over tasks, and the small eigenproblem on
    what they span.
    """
    own = idf.copy()
    own[0] = 0.0
    names = [f"c{j}" for j in range(min(DIRECTIONS, len(items.vocabulary)))]
    schema = "feature bigint, " + ", ".join(f"{n} double" for n in names)
    rows = coded(docs, items).select("ids")

    def product(directions: np.ndarray) -> np.ndarray:
        found = np.zeros_like(directions)
        sums = rows.mapInArrow(_passage_products(items, own, directions), schema).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
        for row in sums.collect():
            found[row["feature"]] = [row[n] for n in names]
        return found

    basis = np.linalg.qr(product(np.random.default_rng(1).standard_normal((len(idf), len(names)))))[0]
    values, vectors = np.linalg.eigh(basis.T @ product(basis))
    kept = values > _RANK_FLOOR * max(values[-1], _EPS)
    return (np.sqrt(values[kept] / max(values[-1], _EPS)) * (basis @ vectors[:, kept])).T


def latent_space(items: Items, idf: np.ndarray, directions: np.ndarray | None = None) -> np.ndarray:
    """Right singular vectors (features x rank) of the items' TF-IDF rows and the passages' directions, as many as their rank, so that every item lies in the space."""
    rows = np.zeros((len(items.words), len(idf)))
    for row, words in zip(rows, items.words):
        ids = np.array([items.vocabulary[w] for w in words])
        np.add.at(row, ids, idf[ids])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True) + _EPS
    if directions is not None:
        rows = np.vstack([rows, directions])
    values, vectors = np.linalg.eigh(rows @ rows.T)
    held = values > _RANK_FLOOR * values[-1]
    return np.ascontiguousarray((rows.T @ (vectors[:, held] / np.sqrt(values[held]))).astype(np.float32))


def _places(words: list) -> dict:
    """Bits of the places of each word."""
    where: dict = {}
    for i, word in enumerate(words):
        where[word] = where.get(word, 0) | 1 << i
    return where


def _in_order(where: dict, length: int, words: list) -> int:
    """Length of the longest common subsequence of ``words``, all of which have places, and the text of so many words that has them."""
    full = (1 << length) - 1
    row = full
    for word in words:
        hit = row & where[word]
        row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence of words or their numbers, bit-parallel over ``a``."""
    where = _places(a)
    return _in_order(where, len(a), [word for word in b if word in where])


def needed(length: int) -> int:
    """Least number of an item's words that is MIN_COMMON of them."""
    return max(1, math.ceil(MIN_COMMON * length - 1e-9))


class Search:
    """Looks one text up in a block of items; made once per task.

    A text, and then the words around a passage, is the sum of the latent vectors of
    its distinct benchmark words. Of an item's words, at least m must be found in
    order. So its product with the item's row is no less than the weight of the
    item's m lightest words, and its cosine no less than that over both lengths;
    what has a smaller one is passed over. The threshold is compared before the
    division by the lengths, which both sides share.
    """

    def __init__(self, items: Items, idf: np.ndarray, space: np.ndarray) -> None:
        self.items = items
        self.where, self.answers = [], []
        self.weight2 = idf**2
        self.weight2[0] = 0.0
        self.words = space * idf[:, None].astype(np.float32)
        self.words[0] = 0
        queries, least, lengths = [], [], []
        for words in items.words:
            ids = np.array([items.vocabulary[w] for w in words])
            self.where.append(_places(ids.tolist()))
            queries.append(self.words[ids].sum(axis=0))
            lengths.append(np.linalg.norm(queries[-1]) + _EPS)
            least.append(np.sort(self.weight2[ids])[: needed(len(ids))].sum())
        for words in items.answers:
            self.answers.append([items.vocabulary[w] for w in words])
        lengths = np.array(lengths)
        self.queries = np.ascontiguousarray((np.array(queries) / lengths[:, None]).astype(np.float32).T)
        self.least = np.array(least) / lengths
        self.place = np.zeros(len(idf), np.int64)

    def _around(self, weights: np.ndarray, at: np.ndarray, before: np.ndarray, length: int, passages: int) -> np.ndarray:
        """Per passage, the weights of the distinct words within ``length`` words of it.

        A word counts for a passage if the passage reaches its place ``at`` but not
        the place of the same word ``before`` (-1 if none), so for one run of passages.
        """
        first = np.maximum((at - SPAN * STRIDE - length) // STRIDE + 1, 0)
        first = np.where(before >= 0, np.maximum(first, (before + length) // STRIDE + 1), first)
        first, after = np.minimum(first, passages), np.minimum((at + length) // STRIDE + 1, passages)
        counts = first < after
        ends = np.bincount(first[counts], weights[counts], passages + 1) - np.bincount(after[counts], weights[counts], passages + 1)
        return ends.cumsum()[:passages]

    def found(self, text: bytes) -> dict[int, tuple[float, float, float, int]]:
        """Per item number: share in order, share of the answer, cosine, passage start (of the best passage)."""
        return self.found_in(features_of(plain_words(text), self.items.vocabulary))

    def found_in(self, ids: np.ndarray) -> dict[int, tuple[float, float, float, int]]:
        """The same for the feature numbers of a text's words."""
        items = self.items
        seen: dict[int, tuple] = {}
        at = np.flatnonzero(ids)
        if not len(at):
            return seen
        own = ids[at]
        present = np.flatnonzero(np.bincount(own))
        vectors = self.words[present]
        slack = _SLACK * np.sqrt(self.weight2[present].sum())
        near = np.flatnonzero(vectors.sum(axis=0) @ self.queries >= self.least - slack)
        if not len(near):
            return seen
        self.place[present] = np.arange(len(present))
        weights = (vectors @ self.queries[:, near]).astype(float)[self.place[own]]
        order = np.argsort(own, kind="stable")
        before = np.full(len(at), -1)
        same = own[order[1:]] == own[order[:-1]]
        before[order[1:][same]] = at[order[:-1][same]]
        passages = max(1, -(-(len(ids) - STRIDE) // STRIDE))
        for q, weight in zip(near.tolist(), weights.T):
            length = len(items.words[q])
            must = needed(length)
            some = np.flatnonzero(weight > slack / len(present))  # all words left out weigh no more than the slack
            for k in np.flatnonzero(self._around(weight[some], at[some], before[some], length, passages) >= self.least[q] - 2 * slack).tolist():
                left, right = max(k * STRIDE - length, 0), (k + SPAN) * STRIDE + length
                around = [word for word in ids[left:right].tolist() if word in self.where[q]]
                if len(around) < must:
                    continue
                common = _in_order(self.where[q], length, around) / length
                if common < MIN_COMMON:
                    continue
                answer = common_subsequence(self.answers[q], around) / len(self.answers[q])
                if answer >= MIN_ANSWER:
                    vector = self.words[ids[k * STRIDE : (k + SPAN) * STRIDE]].sum(axis=0)
                    hit = (common, answer, float(vector @ self.queries[:, q] / (np.linalg.norm(vector) + _EPS)), -k * STRIDE)
                    seen[q] = max(seen.get(q, hit), hit)
        return {q: (*hit[:3], -hit[3]) for q, hit in seen.items()}


def _pairs(items: Items, idf: np.ndarray, space: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, idf, space)
        for batch in pieces(batches, 1000):
            out = [(i, items.ids[q], *hit) for i, ids in enumerate(_ids(batch, items)) for q, hit in search.found_in(ids).items()]
            rows = pa.array([o[0] for o in out], pa.int64())
            columns = [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array([o[1] for o in out], pa.int64())]
            columns += [pa.array([o[j] for o in out], pa.float64()) for j in (2, 3, 4)] + [pa.array([o[5] for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "item_id", "common", "answer", "cosine", "passage_start"])

    return run


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[DataFrame, tuple[Items, np.ndarray, np.ndarray]]]:
    """Blocks of benchmark items: ``docs`` coded by the block's words, and the items with their weights and latent space over all of ``docs``."""

    def ready(block: list) -> Iterator[tuple[DataFrame, tuple[Items, np.ndarray, np.ndarray]]]:
        items = items_of(block)
        if items.ids:
            rows = materialize(coded(docs, items), "benchmark-words")
            idf = inverse_frequencies(rows, items)
            yield rows, (items, idf, latent_space(items, idf, passage_directions(rows, items, idf)))

    block: list = []
    for row in benchmark.select(F.col("item_id").cast("bigint"), "text").orderBy("item_id", "text").toLocalIterator():
        block.append(tuple(row))
        if len(block) == BLOCK_ITEMS:
            yield from ready(block)
            block = []
    yield from ready(block)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item it holds, also reworded.

    Columns: doc_id, text_key, item_id, common (share of the item's words found in
    order), answer (the same for its answer), cosine (latent, of the best passage),
    passage_start (in words). Null, empty and blank texts and items match nothing.
    Repeated documents yield a pair each, repeated items too. Other columns are
    not read. With an empty table on either side the result is empty.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    schema = "doc_id bigint, text_key bigint, item_id bigint, common double, answer double, cosine double, passage_start bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for words, block in _blocks(rows, benchmark):
        found = found.unionByName(words.mapInArrow(_pairs(*block), schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; columns unchanged. Rows are dropped where they are read."""
    left = docs
    for _, block in _blocks(docs.select("text"), benchmark):
        def clean(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            search = Search(*block)
            for batch in pieces(batches, 1000):
                yield batch.filter(pa.array([not search.found(text) for text in utf8(batch.column("text"))], pa.bool_()))

        left = left.mapInArrow(clean, docs.schema)
    return left
