"""Document quality: word rules, and Viterbi line labels of a linear-chain random field.

Lines of a document form a chain with the labels content and boilerplate. Line
features are shares of marks, capitals, separators and digits, lengths and
repetition. The field is fitted by maximum likelihood on the lines of a bounded
sample of labelled documents (a document's quality stands for its lines), and a
document is kept if at least half of its words are in lines labelled content.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.text import WordHashes, pieces, text_key, utf8, window_hashes

SAMPLE_DOCS = 2000  # labelled documents the field is fitted on
SAMPLE_LINES = 60  # lines of a chain in fitting; longer documents count as several chains
MIN_CONTENT = 0.5
FEATURES = 11
_STEPS = 150

_BYTES = np.arange(256)
_CLASSES = {
    "space": np.isin(_BYTES, [9, 10, 11, 12, 13, 32]),
    "lead": (_BYTES & 0xC0) != 0x80,
    "symbol": np.isin(_BYTES, [ord(c) for c in "#*$%&|<>"]),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "letter": ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 0xC0),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "pipe": _BYTES == ord("|"),
    "bang": _BYTES == ord("!"),
}


@dataclass
class Lines:
    """Counts of the lines of one text; lines without a word are left out."""

    features: np.ndarray
    words: np.ndarray
    word_chars: int
    n_symbols: int
    n_dup_lines: int


def read_lines(text: bytes) -> Lines:
    """Features (lines x 11) and base counts of a text."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return Lines(np.empty((0, FEATURES), np.float32), np.empty(0, np.int64), 0, 0, 0)
    is_ = {name: table[raw] for name, table in _CLASSES.items()}
    starts = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
    starts = starts[starts < len(raw)]

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64)

    begins = ~is_["space"]
    begins[1:] &= is_["space"][:-1]
    words = per_line(begins)
    filled = np.flatnonzero(words)
    seen: set[bytes] = set()
    ends = np.append(starts[1:] - 1, len(raw) if raw[-1] != 10 else len(raw) - 1)
    again = np.zeros(len(starts), bool)
    marked = np.zeros(len(starts), bool)
    for k in filled.tolist():
        line = text[starts[k] : ends[k]]
        again[k] = line in seen
        seen.add(line)
        marked[k] = line.rstrip()[-1:] in b".!?:"
    word_chars = per_line(is_["lead"] & ~is_["space"])
    n = np.maximum(words, 1).astype(np.float32)
    letters = np.maximum(per_line(is_["letter"]), 1)
    table = np.stack([
        np.ones(len(n)), np.minimum(per_line(is_["symbol"]) / n, 3), per_line(is_["upper"]) / letters, np.minimum(per_line(is_["pipe"]) / n, 1),
        np.minimum(per_line(is_["bang"]) / n, 2), per_line(is_["digit"]) / np.maximum(word_chars, 1), words < 3, np.log1p(words) / 5,
        np.minimum(word_chars / n, 30) / 10, again, marked,
    ], axis=1).astype(np.float32)
    return Lines(table[filled], words[filled], int(word_chars.sum()), int(is_["symbol"].sum()), int(again.sum()))


def repeated_words(h: np.ndarray) -> int:
    """Words in three-word windows that occur at least twice in the text."""
    windows = window_hashes(h, 3)
    if not len(windows):
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(h), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


@dataclass
class LineField:
    """Linear-chain field: weights (2 x features) and transitions (2 x 2); label 1 is content."""

    weights: np.ndarray
    moves: np.ndarray

    def labels(self, features: np.ndarray) -> np.ndarray:
        """Viterbi labels of one chain; content wins a tie."""
        if not len(features):
            return np.empty(0, np.int64)
        scores = (features @ self.weights.T).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1 = scores[0]
        came0, came1 = [], []
        for e0, e1 in scores[1:]:
            a, b = s0 + m00, s1 + m10
            c, d = s0 + m01, s1 + m11
            came0.append(b >= a)
            came1.append(d >= c)
            s0, s1 = (b if b >= a else a) + e0, (d if d >= c else c) + e1
        label = int(s1 >= s0)
        path = [label]
        for zero, one in zip(reversed(came0), reversed(came1)):
            label = int(one if label else zero)
            path.append(label)
        return np.array(path[::-1])


def fit_field(chains: list[tuple[np.ndarray, int]]) -> LineField:
    """Maximum likelihood (with a small penalty) by Adam over padded chains; every line has its document's label."""
    if len({label for _, label in chains}) < 2:
        return LineField(np.zeros((2, FEATURES)), np.zeros((2, 2)))
    parts = [(f[s : s + SAMPLE_LINES], y) for f, y in chains for s in range(0, len(f), SAMPLE_LINES)]
    n, longest = len(parts), max(len(f) for f, _ in parts)
    x, mask = np.zeros((n, longest, FEATURES)), np.zeros((n, longest), bool)
    y = np.array([label for _, label in parts])
    for i, (f, _) in enumerate(parts):
        x[i, : len(f)], mask[i, : len(f)] = f, True
    # Both labels weigh the same, whatever their share in the sample.
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    onehot = np.eye(2)[y]
    theta = np.zeros(2 * FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    steps = np.maximum(mask.sum(axis=1) - 1, 0)
    for t in range(1, _STEPS + 1):
        weights, moves = theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES :].reshape(2, 2)
        e = x @ weights.T
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = e[:, 0]
        for k in range(1, longest):
            step = np.logaddexp(forward[:, k - 1, :1] + moves[0], forward[:, k - 1, 1:] + moves[1]) + e[:, k]
            forward[:, k] = np.where(mask[:, k, None], step, forward[:, k - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for k in range(longest - 2, -1, -1):
            ahead = e[:, k + 1] + backward[:, k + 1]
            step = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
            backward[:, k] = np.where(mask[:, k + 1, None], step, 0)
        p = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        grad_w = np.einsum("n,nlk,nlf->kf", share, mask[..., None] * onehot[:, None] - p, x)
        pair = forward[:, :-1, :, None] + moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :]
        pair = np.exp(pair - total[:, None, None, None]) * mask[:, 1:, None, None]
        wanted = np.zeros((n, 2, 2))
        wanted[np.arange(n), y, y] = steps
        grad_m = np.einsum("n,nij->ij", share, wanted - pair.sum(axis=1))
        gradient = np.concatenate([grad_w.ravel(), grad_m.ravel()]) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return LineField(theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES :].reshape(2, 2))


def _sample_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 500):
        found = [read_lines(text).features for text in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("order"), batch.column("quality"), pa.array([f.tobytes() for f in found], pa.binary())], ["order", "quality", "features"]
        )


def train(docs: DataFrame, labels: DataFrame) -> LineField:
    """Field fitted on at most SAMPLE_DOCS labelled documents, chosen by a hash of their id."""
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("_id"), (F.col("quality") > 0).cast("int").alias("quality"), F.xxhash64(F.col("doc_id").cast("bigint")).alias("order")
    )
    # Half of the sample for each label, so that the rare one is seen often enough.
    half = [chosen.filter(F.col("quality") == q).orderBy("order").limit(SAMPLE_DOCS // 2) for q in (0, 1)]
    sample = F.broadcast(half[0].unionByName(half[1]))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(sample, F.col("doc_id") == F.col("_id"))
    found = rows.select("order", "quality", "text").mapInArrow(_sample_features, "order bigint, quality int, features binary")
    # Repeated rows of a labelled document are cut to the sample's size as well.
    found = found.orderBy("order", "features").limit(SAMPLE_DOCS).collect()
    chains = [(np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES), r["quality"]) for r in found if r["features"]]
    return fit_field(chains)


def _verdict(text: bytes, field: LineField, hashes: WordHashes) -> tuple:
    """Base counts, base_failed, content share and kept of one text."""
    lines = read_lines(text)
    h = hashes.of(text.split())
    repeats = repeated_words(h)
    failed = len(h) < 50 or 100 * repeats > 50 * len(h)
    content = int(lines.words[field.labels(lines.features) == 1].sum())
    share = content / len(h) if len(h) else 0.0
    return len(h), lines.word_chars, lines.n_symbols, lines.n_dup_lines, repeats, failed, share, not failed and share >= MIN_CONTENT


def _judged(field: LineField):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, 1000):
            rows = [_verdict(text, field, hashes) for text in utf8(batch.column("text"))]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), *columns],
                ["doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
            )

    return run


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, base counts, base_failed, content_share, kept.

    n_words, word_chars (code points in words), n_symbols (of # * $ % & | < >),
    n_dup_lines (lines with a word that equal an earlier line), n_repeat_words
    (words in three-word windows found twice or more). base_failed: under 50 words,
    or more than half of them repeated. kept: not failed, and at least half of the
    words in lines the field labels content.

    Null, empty and blank texts have zero counts and fail. Repeated rows agree.
    Null ids are kept as they are. Labels with nulls are passed over; without
    labels of both kinds every line counts as content. Other columns are not read;
    an empty table gives an empty result.
    """
    field = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    schema = ("doc_id bigint, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
              "n_repeat_words bigint, base_failed boolean, content_share double, kept boolean")
    return rows.mapInArrow(_judged(field), schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept; columns unchanged. Rows are dropped where they are read, without a join."""
    field = train(docs, labels)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, 1000):
            yield batch.filter(pa.array([_verdict(text, field, hashes)[-1] for text in utf8(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
