"""Personal data in texts: fixed patterns, and a semi-Markov random field over whole spans.

The patterns give the base spans. The field scores whole candidate segments (up
to 14 tokens: runs of letters or digits, or single marks) by features of the
entire span and its surroundings, and a segment-level Viterbi pass chooses
boundaries and kinds together. A segment can only be personal data if it holds a
digit or an at sign, so the pass needs just the stretches of text around those;
it gives what it would give over the whole text. Spans of the field that touch no
base span are added, among them secrets such as quoted tokens, which no pattern
covers. The field is fitted by maximum likelihood on stretches of a bounded
sample of documents, labelled by the patterns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.text import pieces, text_key, utf8

KINDS = ["email", "ip", "card", "phone", "secret"]
SAMPLE_DOCS = 400  # documents with digits whose stretches the field is fitted on
SAMPLE_STRETCHES = 3  # stretches of each
LONGEST = 14  # tokens of a segment
CONTEXT = 4  # tokens kept on either side of a stretch
_STEPS = 60

# ---- base patterns ----------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            last = domain.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all pattern matches that pass their test, by kind and start."""
    found = [(0, s, e) for s, e in _emails(text)]
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(int(p) <= 255 if len(p) < 9 else int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m.group().split(".")):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                found.append((3, *m.span()))
    return found


# ---- semi-Markov field ------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_CARRIER = re.compile(r"[0-9@]")
_SECRET = re.compile(r"(?:token|key|secret|password)\s*[=:]\s*[\"']([^\"'\s]{16,})[\"']", re.I)
_CUES = {"token", "key", "secret", "password", "passwd", "apikey"}
_NEAR = 200  # characters on either side of a carrier within which its stretch is looked for
FEATURES = 19


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans around digits and at signs: every segment that holds one, with context."""
    reach, last, spans = LONGEST + CONTEXT, -1, []
    at = _CARRIER.search(text)
    while at:
        # Carriers whose surroundings overlap share a stretch.
        start = max(0, at.start() - _NEAR)
        end = at.end()
        after = _CARRIER.search(text, end)
        while after and after.start() - end <= _NEAR:
            end = after.end()
            after = _CARRIER.search(text, end)
        start = max(start, last, 0)
        while start > max(last, 0) and text[start].isalnum() and text[start - 1].isalnum():
            start -= 1
        stop = min(len(text), end + _NEAR)
        while stop < len(text) and text[stop].isalnum() and text[stop - 1].isalnum():
            stop += 1
        spans = [m.span() for m in _TOKEN.finditer(text, start, stop)]
        carriers = [i for i, (s, e) in enumerate(spans) if _CARRIER.search(text, s, e)]
        group: list[int] = []
        for i in carriers:
            if group and i - group[-1] > 2 * reach:
                yield spans[max(0, group[0] - reach) : group[-1] + reach + 1]
                group = []
            group.append(i)
        if group:
            yield spans[max(0, group[0] - reach) : group[-1] + reach + 1]
        last = stop
        at = _CARRIER.search(text, stop)


def _features(text: str, spans: list[tuple[int, int]], i: int, j: int) -> np.ndarray | None:
    """Features of the segment of tokens i..j-1; None where it can't be personal data."""
    start, end = spans[i][0], spans[j - 1][1]
    span = text[start:end]
    n_digits = sum("0" <= c <= "9" for c in span)
    ats = span.count("@")
    if not (n_digits or ats) or "\n" in span or "  " in span:
        return None
    before, after = text[start - 1 : start], text[end : end + 1]
    letters = any(c.isalpha() for c in span)
    digits = _digits(span)
    parts = span.split(".")
    ip = len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) <= 255 for p in parts)
    local, _, domain = span.partition("@")
    address = ats == 1 and bool(local) and "." in domain and not domain.startswith(".") and " " not in span and span[0] in _LOCAL_CHARS
    plain = not letters and not ats
    cue = any(text[s:e].lower() in _CUES for s, e in spans[max(0, i - 4) : i])
    quoted = before in "\"'" and before != "" and after == before
    hexes = len(span) >= 16 and all(c in "0123456789abcdefABCDEF" for c in span)
    return np.array([
        1, (j - i) / LONGEST, plain and 16 <= n_digits <= 19, plain and 16 <= n_digits <= 19 and luhn(digits), plain and 8 <= n_digits <= 15,
        n_digits < 8, n_digits > 19, span[0] == "+" and span[1:2].isdigit(), ip, address, letters, " " in span, before != "" and before in _LOCAL_CHARS,
        after != "" and after in _LOCAL_CHARS and after != ".", cue, quoted, hexes and letters, not span[-1].isalnum(), not (span[0].isalnum() or span[0] == "+"),
    ], np.float64)


@dataclass
class SpanField:
    weights: np.ndarray  # kinds x features; tokens outside spans score 0

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        for tokens in stretches(text):
            found += self._decoded(text, tokens)
        return found

    def _decoded(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        n = len(tokens)
        best, came = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i in range(max(0, j - LONGEST), j):
                f = _features(text, tokens, i, j)
                if f is None:
                    continue
                scores = self.weights @ f
                kind = int(scores.argmax())
                if best[i] + scores[kind] > best[j]:
                    best[j], came[j] = best[i] + float(scores[kind]), (i, kind)
        found, j = [], n
        while j:
            if came[j] is None:
                j -= 1
            else:
                i, kind = came[j]
                found.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
        return found[::-1]


def fit_field(examples: list[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]]) -> SpanField:
    """Maximum likelihood over all segmentations of each stretch, by Adam."""
    data = []
    for text, tokens, gold in examples:
        n = len(tokens)
        segments = [(i, j, f) for j in range(1, n + 1) for i in range(max(0, j - LONGEST), j) if (f := _features(text, tokens, i, j)) is not None]
        if not segments:
            continue
        starts = {s: i for i, (s, _) in enumerate(tokens)}
        ends = {e: i + 1 for i, (_, e) in enumerate(tokens)}
        marked = {(starts[s], ends[e]): k for k, s, e in gold if s in starts and e in ends}
        table = np.array([f for _, _, f in segments])
        wanted = np.zeros((len(KINDS), FEATURES))
        for (i, j, f) in segments:
            if (i, j) in marked:
                wanted[marked[i, j]] += f
        by_end = [[] for _ in range(n + 1)]
        by_start = [[] for _ in range(n + 1)]
        for s, (i, j, _) in enumerate(segments):
            by_end[j].append(s)
            by_start[i].append(s)
        data.append((n, table, np.array([i for i, _, _ in segments]), np.array([j for _, j, _ in segments]), by_end, by_start, wanted))
    weights = np.zeros((len(KINDS), FEATURES))
    weights[:, 0] = -2
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, _STEPS + 1):
        gradient = -1e-3 * weights
        for n, table, at, to, by_end, by_start, wanted in data:
            scores = table @ weights.T
            high = scores.max(axis=1)
            whole = high + np.log(np.exp(scores - high[:, None]).sum(axis=1))
            alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
            for j in range(1, n + 1):
                alpha[j] = alpha[j - 1]
                if by_end[j]:
                    alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[at[by_end[j]]] + whole[by_end[j]])])
            for i in range(n - 1, -1, -1):
                beta[i] = beta[i + 1]
                if by_start[i]:
                    beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[to[by_start[i]]] + whole[by_start[i]])])
            p = np.exp(alpha[at][:, None] + scores + beta[to][:, None] - alpha[n])
            gradient += (wanted - p.T @ table) / len(data)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        weights = weights + 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return SpanField(weights)


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to SAMPLE_STRETCHES stretches per text, as text of their own."""
    for batch in pieces(batches, 500):
        out = []
        for key, raw in zip(batch.column("order").to_pylist(), utf8(batch.column("text"))):
            text = raw.decode("utf-8", "replace")
            for k, tokens in zip(range(SAMPLE_STRETCHES), stretches(text)):
                out.append((key, k, text[max(0, tokens[0][0] - 1) : tokens[-1][1] + 1]))
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["order", "k", "stretch"]
        )


def train(docs: DataFrame) -> SpanField:
    """Field fitted on stretches of at most SAMPLE_DOCS documents, chosen by a hash of id and text."""
    keyed = docs.filter(F.col("text").rlike("[0-9@]")).select(
        F.xxhash64(F.col("doc_id").cast("bigint"), text_key(F.col("text"))).alias("order"), "text"
    )
    chosen = F.broadcast(keyed.select("order").distinct().orderBy("order").limit(SAMPLE_DOCS).withColumnRenamed("order", "_order"))
    sample = keyed.join(chosen, F.col("order") == F.col("_order"), "left_semi").select("order", "text")
    rows = sample.mapInArrow(_examples, "order bigint, k bigint, stretch string").distinct().orderBy("order", "k", "stretch")
    examples = []
    for row in rows.limit(SAMPLE_DOCS * SAMPLE_STRETCHES).collect():
        text = row["stretch"]
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        gold = base_spans(text) + [(4, *m.span(1)) for m in _SECRET.finditer(text)]
        examples.append((text, tokens, gold))
    return fit_field(examples)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """Disjoint stretches covered by the spans."""
    out: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _free(taken: list[list[int]], start: int, end: int) -> bool:
    k = bisect_left(taken, [start + 1])
    return not (k and taken[k - 1][1] > start) and not (k < len(taken) and taken[k][0] < end)


def _found(field: SpanField):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1000):
            rows = []
            for raw in utf8(batch.column("text")):
                if not _CARRIER_BYTES.search(raw):
                    rows.append((0, 0, 0, 0, _NOTHING, ""))
                    continue
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
                taken = _merged(base)
                added = [x for x in field.spans(text) if _free(taken, x[1], x[2])]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


_CARRIER_BYTES = re.compile(rb"[0-9@]")
_NOTHING = hashlib.sha256(b"").hexdigest()


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, sorted by kind (email,
    ip, card, phone, secret) and start, comma-joined. The counts and base_sha256
    are of the pattern matches; ``spans`` also has those the field adds.

    Null, empty and blank texts have no spans. Repeated rows agree. Null ids are
    kept. Other columns are not read; an empty table gives an empty result, and a
    table without digits and at signs an unfitted field, which is never asked.
    """
    field = train(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return rows.mapInArrow(_found(field), schema)
