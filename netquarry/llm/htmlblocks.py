"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks. Each block is read as the hashed
tokens of its tag path (element names, class and id words, roles), the mean of
its hashed words, and a few shares; a bidirectional LSTM in numpy labels every
block with the whole page in view. It is fitted on a bounded sample of pages:
blocks inside the article element, where there is one, are main text, and the same blocks dressed in
other usual page layouts teach what menus, sidebars, notices, forms, adverts and
comments look like elsewhere. Pages of a batch run together, padded by length.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.text import pieces

SAMPLE_PAGES = 150  # pages the labeller is fitted on
SAMPLE_CHARS = 1 << 20  # longest page that may be one of them
LAYOUTS = 3  # other layouts each of them is dressed in
HIDDEN = 12
PATHS, WORDS, SHARES = 256, 64, 6
_EPOCHS, _BATCH, _LONGEST = 10, 32, 80  # _LONGEST: blocks of a page in fitting, taken from both its ends

# ---- pages to blocks --------------------------------------------------------

_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:script|style|template|noscript|textarea|svg|iframe|title)\b[^>]*>.*?(?:</(?:script|style|template|noscript|textarea|svg|iframe|title)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr option br".split())
_NAME_PARTS = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with character references decoded and white space joined."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links, path, in_head = 0, 0, (), False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append(Block(path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    for m in _TOKENS.finditer(page):
        if (text := m.group("text")) is not None:
            if not in_head:
                parts.append(text)
                linked += len(text) * (links > 0)
            continue
        if (name := m.group("name")) is None:
            continue
        name = name.lower()
        if name == "a":
            links = max(0, links + (-1 if m.group("close") else 1))
        if name in _INLINE:
            continue
        flush()
        if name == "head":
            in_head = not m.group("close")
        elif name == "body":
            in_head = False
        if m.group("close"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in _VOID and not m.group("rest").endswith("/"):
            if name in _LEAF:  # an open leaf of the same kind ends where the next begins
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] not in _LEAF:
                        break
            names = [f"<{name}"]
            for kind, *values in _ATTRIBUTES.findall(m.group("rest")):
                value = next(filter(None, values), "")
                names += [w.lower() for w in _NAME_PARTS.findall(value)] if kind.lower() != "role" else [f"role={value.lower()}"]
            stack.append((name, tuple(names)))
        path = tuple(t for _, names in stack for t in names)
    flush()
    return out


# ---- features ---------------------------------------------------------------


class Buckets(dict):
    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, key: str) -> int:
        value = zlib.crc32(key.encode()) % self.size
        if len(self) < 200_000:
            self[key] = value
        return value


def encode(page: list[Block], paths: Buckets, words: Buckets) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    shares = np.zeros((len(page), SHARES), np.float32)
    path_ids, word_ids = [], []
    for k, block in enumerate(page):
        split = block.text.lower().split(" ")
        path_ids.append(np.fromiter(map(paths.__getitem__, block.path), np.int64, len(block.path)))
        word_ids.append(np.fromiter(map(words.__getitem__, split), np.int64, len(split)))
        n = len(block.text)
        shares[k] = (np.log1p(len(split)) / 4, block.linked / n, block.text[-1] in ".!?:;\"", k / len(page), min(1, len(split) / 5), "." in block.text[:-1])
    return path_ids, word_ids, shares


def _inputs(pages: list, length: int) -> tuple:
    """Flat ids with their (step, page) cell, for one padded batch."""
    p_cell, p_id, w_cell, w_id, w_weight = [], [], [], [], []
    shares, mask = np.zeros((length, len(pages), SHARES), np.float32), np.zeros((length, len(pages)), bool)
    for j, (path_ids, word_ids, share) in enumerate(pages):
        for t in range(len(share)):
            cell = t * len(pages) + j
            p_id.append(path_ids[t])
            p_cell.append(np.full(len(path_ids[t]), cell))
            w_id.append(word_ids[t])
            w_cell.append(np.full(len(word_ids[t]), cell))
            w_weight.append(np.full(len(word_ids[t]), 1 / len(word_ids[t]), np.float32))
        shares[: len(share), j], mask[: len(share), j] = share, True
    flat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    return flat(p_cell, int), flat(p_id, int), flat(w_cell, int), flat(w_id, int), flat(w_weight, np.float32), shares, mask


def _dense(batch: tuple) -> np.ndarray:
    """Input vectors (step, page, feature) of one padded batch."""
    p_cell, p_id, w_cell, w_id, w_weight, shares, mask = batch
    x = np.zeros((mask.size, PATHS + WORDS + SHARES), np.float32)
    x[p_cell, p_id] = 1
    x[:, PATHS : PATHS + WORDS] = np.bincount(w_cell * WORDS + w_id, w_weight, mask.size * WORDS).reshape(-1, WORDS)
    x = x.reshape(*mask.shape, -1)
    x[..., PATHS + WORDS :] = shares
    return x


# ---- the labeller -----------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM; positive scores are main text."""

    def __init__(self, seed: int = 3) -> None:
        draw = np.random.default_rng(seed)
        size, gates = PATHS + WORDS + SHARES, 4 * HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = (draw.standard_normal((size, gates)) * 0.1).astype(np.float32)
            self.p[f"U{d}"] = (draw.standard_normal((HIDDEN, gates)) * 0.2).astype(np.float32)
            self.p[f"b{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # the forget gate starts open
        self.p["v"] = (draw.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        steps, n, _ = x.shape
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        drive = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in order:
            z = drive[t] + h @ self.p[f"U{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            alive = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh_c, alive))
            h, c = np.where(alive, o * tanh_c, h), np.where(alive, c_new, c)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._direction(x, mask, d, None) for d in "fb"], axis=2)
        return h @ self.p["v"] + self.p["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._direction(x, mask, d, kept[d]) for d in "fb"], axis=2)
        d_score = (_sigmoid(h @ self.p["v"] + self.p["c"]) - y) * mask / mask.sum()
        grad = {k: np.zeros_like(w) for k, w in self.p.items()}
        grad["v"] = np.einsum("tn,tnh->h", d_score, h)
        grad["c"] = d_score.sum(keepdims=True).reshape(1)
        for d, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            d_out = d_score[..., None] * self.p["v"][half]
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            d_drive = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            for t, h0, c0, i, f, o, g, tanh_c, alive in reversed(kept[d]):
                dh = dh + d_out[t]
                dh_in, dc_in = np.where(alive, dh, 0), np.where(alive, dc, 0)
                do = dh_in * tanh_c
                dct = dc_in + dh_in * o * (1 - tanh_c**2)
                dz = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), do * o * (1 - o), dct * i * (1 - g**2)], axis=1)
                d_drive[t] = dz
                grad[f"U{d}"] += h0.T @ dz
                dh = np.where(alive, dz @ self.p[f"U{d}"].T, dh)
                dc = np.where(alive, dct * f, dc)
            grad[f"W{d}"] = np.einsum("tnf,tng->fg", x, d_drive, optimize=True)
            grad[f"b{d}"] = d_drive.sum(axis=(0, 1))
        return grad


_MAIN = [("<main",), ("<article",), ("<div", "content"), ("<div", "main", "content"), ("<div", "post", "body"), ("<section", "article", "body"),
         ("<div", "entry", "content"), ("<div", "story"), ("<main", "role=main"), ("<div", "text"), ("<article", "post"), ("<div", "article")]
_ASIDE = [("<nav",), ("<header",), ("<footer",), ("<aside",), ("<form",), ("<div", "nav"), ("<div", "menu"), ("<div", "sidebar"), ("<div", "ad"),
          ("<div", "advert"), ("<div", "ads", "banner"), ("<div", "promo"), ("<div", "sponsored"), ("<div", "cookie", "notice"), ("<div", "notice"),
          ("<div", "consent"), ("<div", "comments"), ("<section", "comments"), ("<div", "comment"), ("<ol", "comment", "list"), ("<div", "footer"),
          ("<div", "header"), ("<div", "breadcrumb"), ("<div", "related"), ("<div", "share"), ("<div", "social"), ("<div", "newsletter"),
          ("<div", "subscribe"), ("<div", "login"), ("<ul", "menu"), ("<div", "widget"), ("<div", "popup"), ("<div", "banner"), ("<div", "copyright")]
_INSIDE = [("<aside",), ("<form",), ("<div", "ad"), ("<div", "related"), ("<div", "share"), ("<section", "comments"), ("<div", "comments"), ("<nav",)]


def _dressed(page: list[Block], main: list[bool], draw: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """The page's text in another layout: main text in one container, other text and borrowed sentences around it."""
    root = ("<html", "<body") + ((), ("<div", "wrapper"), ("<div", "page", "container"))[draw.integers(3)]
    inner = root + _MAIN[draw.integers(len(_MAIN))]
    texts = [b.text for b, m in zip(page, main) if m]
    if not texts:
        return [], []

    def leaf(tag: str) -> tuple[str, ...]:
        return (tag,)

    def aside(at: tuple[str, ...], kinds: list) -> list[Block]:
        kind, out = kinds[draw.integers(len(kinds))], []
        listed = kind[0] in ("<nav", "<ul") or "menu" in kind
        for _ in range(draw.integers(1, 7)):
            words = texts[draw.integers(len(texts))].split(" ")
            start = draw.integers(len(words))
            text = " ".join(words[start : start + (draw.integers(1, 4) if listed else draw.integers(2, 40))])
            tail = leaf("<li") if listed else ((), leaf("<p"), leaf("<h3"), ("<div",))[draw.integers(4)]
            out.append(Block(at + kind + tail, text, len(text) if listed else 0))
        return out

    out: list[Block] = []
    labels: list[bool] = []

    def put(found: list[Block], label: bool) -> None:
        out.extend(found)
        labels.extend([label] * len(found))

    for _ in range(draw.integers(1, 4)):
        put(aside(root, _ASIDE), False)
    put([Block(inner + leaf("<h1"), texts[0], 0)], True)
    for text in texts[1:]:
        tail = leaf("<p") if draw.random() < 0.8 else (("<ul", "<li"), ("<blockquote",), ("<h2",), ("<div",), ("<table", "<tr", "<td"))[draw.integers(5)]
        put([Block(inner + tail, text, 0)], True)
        if draw.random() < 0.08:
            put(aside(inner, _INSIDE), False)
    if draw.random() < 0.3:
        put(aside(inner, _INSIDE), False)
    for _ in range(draw.integers(1, 4)):
        put(aside(root, _ASIDE), False)
    return out, labels


def _in_article(block: Block) -> bool:
    """Label of a sampled page's block: in its article or main element, and in nothing set apart there."""
    kinds = set(block.path)
    return bool(kinds & {"<article", "<main"}) and not kinds & {"<nav", "<aside", "<footer", "<form", "<header", "comments", "comment", "ad"}


_APART = {t for kind in (*_ASIDE, *_INSIDE) for t in kind} - {"<div", "<section", "<ol", "<ul"}


def fit(pages: list[str], seed: int = 11) -> Labeller:
    """Labeller fitted on pages; one without article or main element teaches by its running text in other layouts only.

    What is main there is not known, but text outside menus and the like is text, and
    its layouts are made here. Without any text the labeller finds no main text.
    """
    draw = np.random.default_rng(seed)
    paths, words, examples = Buckets(PATHS), Buckets(WORDS), []
    for page in pages:
        found = blocks(page)
        main = [_in_article(b) for b in found]
        known = any(main)
        if not known:
            main = [not _APART & set(b.path) and not b.linked for b in found]
        for k in range(LAYOUTS + 1):
            some, labels = (found, main) if known and not k else _dressed(found, main, draw)
            if len(some) > _LONGEST:
                some, labels = some[: _LONGEST // 2] + some[-_LONGEST // 2 :], labels[: _LONGEST // 2] + labels[-_LONGEST // 2 :]
            if some:
                examples.append((encode(some, paths, words), np.array(labels, np.float32)))
    model = Labeller()
    m = {k: np.zeros_like(w) for k, w in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    t = 0
    if not examples:
        model.p["v"][:] = 0
    for _ in range(_EPOCHS if examples else 0):
        order = draw.permutation(len(examples))
        # Pages of like length share a batch; batches come in random order.
        order = sorted(order, key=lambda k: len(examples[k][1]))
        batches = [order[s : s + _BATCH] for s in range(0, len(order), _BATCH)]
        for b in draw.permutation(len(batches)):
            chosen = [examples[k] for k in batches[b]]
            length = max(len(y) for _, y in chosen)
            batch = _inputs([e for e, _ in chosen], length)
            y = np.zeros((length, len(chosen)), np.float32)
            for j, (_, labels) in enumerate(chosen):
                y[: len(labels), j] = labels
            t += 1
            for k, g in model.gradients(_dense(batch), batch[-1], y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] = (model.p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def label(pages: list[list[Block]], model: Labeller, paths: Buckets, words: Buckets) -> list[np.ndarray]:
    """Main-text flags of each page's blocks; batches hold a bounded number of padded cells."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * len(pages[order[stop]]) <= 6000:
            stop += 1
        some = order[start:stop]
        length = len(pages[some[-1]])
        batch = _inputs([encode(pages[k], paths, words) for k in some], length)
        scores = model.scores(_dense(batch), batch[-1])
        for j, k in enumerate(some):
            out[k] = scores[: len(pages[k]), j] > 0
        start = stop
    return out


def _extracted(model: Labeller):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, words = Buckets(PATHS), Buckets(WORDS)
        for batch in pieces(batches, 200):
            found = [blocks(x.as_py() or "") for x in batch.column("html")]
            texts = [" ".join(b.text for b, m in zip(page, main) if m) for page, main in zip(found, label(found, model, paths, words))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(b) for b in found], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"]
            )

    return run


def train(pages: DataFrame) -> Labeller:
    """Labeller fitted on at most SAMPLE_PAGES pages of up to SAMPLE_CHARS characters, chosen by a hash.

    Pages with an article or main element come first; where they are too few, other
    pages fill the sample.
    """
    teaches = F.col("html").rlike("(?i)<(article|main)[ >]")
    short = pages.filter(F.length("html") <= SAMPLE_CHARS)
    usable = short.select("html", F.struct((~teaches).alias("other"), F.xxhash64("page_id", "html").alias("hash")).alias("order"))
    chosen = F.broadcast(usable.select("order").distinct().orderBy("order").limit(SAMPLE_PAGES).withColumnRenamed("order", "_order"))
    rows = usable.join(chosen, F.col("order") == F.col("_order"), "left_semi").dropDuplicates(["order"]).orderBy("order").limit(SAMPLE_PAGES)
    return fit([r["html"] for r in rows.select("html").toLocalIterator()])


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Per page: page_id, url, text (main text, blocks joined by a space), n_chars, n_blocks.

    Null, empty and blank pages, and pages without main text, have an empty text.
    Unclosed and stray tags are read as they come. Repeated rows agree; null ids
    and urls are kept. Other columns are not read; an empty table gives an empty
    result. A table without any article or main element is learnt from as ``fit``
    says. ``model`` reuses a fitted labeller.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html"))
    model = model or train(rows)
    return rows.mapInArrow(_extracted(model), "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint")
