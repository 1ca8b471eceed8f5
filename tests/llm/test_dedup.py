"""Near copies, repeated spans and repeated lines against brute force."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netquarry.llm import linededup, minhash, substrings
from netquarry.llm.text import WordHashes, text_key


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = {k: shingles(r[1]) for k, r in enumerate(rows)}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[find(k)].append(r[0])
    named = [min(ids[find(k)]) if ids[find(k)] else None for k in sets]
    return sorted(((r[0], len(sets[k]), named[k], r[0] == named[k]) for k, r in enumerate(rows)), key=repr)


def near(df):
    return sorted((tuple(r) for r in minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("block", [500, 3])
def test_near_duplicates(crowd, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # large bands in many small blocks give the same
    assert near(crowd[0]) == components(crowd[1])


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows, no_docs):
    assert near(odd_docs) == components(odd_rows)
    assert near(no_docs) == []
    left = minhash.keep_one_per_group(odd_docs)
    assert left.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in left.collect()), key=repr)
    assert ids == sorted([1, 1, 4, 5, 6, 7, 9, 11, 12, 13, None], key=repr)


def test_estimate_follows_similarity(spark):
    h = WordHashes().of([f"w{i}".encode() for i in range(400)])
    draw = np.random.default_rng(1)
    a, b = (draw.integers(0, 1 << 32, minhash.HASHES, np.uint32) | np.uint32(1) for _ in range(2))
    x, y = minhash._minima(np.unique(h[:300]), a, b), minhash._minima(np.unique(h[100:]), a, b)
    assert abs((x == y).mean() - 0.5) < 0.15


def strip_repeats(rows, words_of=lambda text: text):
    seen, out = set(), []
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    digests = {}
    for unnamed, i, text in order:
        w = words_of(text).encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                keep[k : k + 20] = [False] * 20
            seen.add(window)
        rest = [x for x, y in zip(w, keep) if y]
        digests[unnamed, i, text] = (len(w), len(w) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest())
    for r in rows:
        out.append((r[0], *digests[r[0] is None, r[0] or 0, r[1] or ""]))
    return sorted(out, key=repr)


def test_repeated_spans(crowd, no_docs):
    got = sorted((tuple(r) for r in substrings.without_repeats(crowd[0]).collect()), key=repr)
    assert got == strip_repeats(crowd[1]) and sum(r[2] for r in got) > 500
    assert substrings.without_repeats(no_docs).count() == 0


def test_repeated_spans_of_odd_rows(odd_docs, odd_rows):
    # Two texts without an id come in the order of their hash; only one of them has words here.
    got = sorted((tuple(r) for r in substrings.without_repeats(odd_docs).collect()), key=repr)
    assert got == strip_repeats(odd_rows)
    texts = {r["doc_id"]: r["kept_text"] for r in substrings.without_repeats(odd_docs, with_text=True).collect()}
    assert texts[7] == "one two" and texts[2] == "" and texts[10].endswith("tail")


def test_repeated_spans_of_rows_that_share_an_id(spark):
    """Texts of one id, or of none, are documents of their own, ordered by their hash."""
    draw = random.Random(12)

    def words(n):
        return ["".join(draw.choice(("ba", "de", "ki", "lo", "mu")) for _ in range(draw.randint(2, 4))) for _ in range(n)]

    base = words(400)
    texts = set()
    while len(texts) < 330:
        at = draw.randrange(380)
        texts.add(" ".join([*words(draw.randint(0, 30)), *base[at : at + draw.randint(18, 45)], *words(draw.randint(0, 30))]))
    texts = sorted(texts)
    rows = [(None, t) for t in texts[:300]] + [(7, t) for t in texts[300:]] + [(8, texts[0]), (None, texts[5])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    keys = {r["text"]: r["k"] for r in df.select("text", text_key(F.col("text")).alias("k")).collect()}
    place = {t: i for i, t in enumerate(sorted(texts, key=keys.get))}
    # The brute force orders documents of one id by their text, so it is given names in the order of the hashes.
    numbered = [(d, f"{place[t]:04d}|{t}") for d, t in rows]
    want = sorted(((r[0], *r[1:]) for r in strip_repeats(numbered, lambda t: t.partition("|")[2])), key=repr)
    got = sorted(map(tuple, substrings.without_repeats(df).collect()), key=repr)
    assert got == want and sum(r[2] for r in got) > 3000


def test_paths_cover_every_window_once():
    h = np.random.default_rng(3).integers(0, 1 << 63, 500, np.uint64)
    _, _, start, length = substrings.paths(h)
    covered = [k for s, n in zip(start.tolist(), length.tolist()) for k in range(s, s + n)]
    assert covered == list(range(481)) and length.max() <= 13


def test_equal_paths_fold_within_a_task():
    """The earliest of equal rows keeps its content, later ones lose it, repeated rows leave one."""
    def part(ids, rows, at, anchor, content):
        docs = pa.RecordBatch.from_pydict({"unnamed": [int(i is None) for i in ids], "id": [i or 0 for i in ids], "text_key": [0] * len(ids)})
        return docs, np.array(rows), np.array(at), np.array(anchor, np.uint64), np.array(content, np.uint64)

    # Anchor 5 holds path 7 in documents null, 9 (twice, a repeated row) and 2, and path 8 in document 9.
    parts = [part([None, 9, 9], [0, 1, 2, 1], [256, 512, 512, 1024], [5, 5, 5, 5], [7, 7, 7, 8]), part([2], [0, 0], [512, 256], [5, 6], [7, 7])]
    out = pa.Table.from_batches(substrings._folds(iter(parts))).to_pylist()
    place = {(r["unnamed"], r["id"], r["at"]): (r["anchor"], r["content"]) for r in out}
    assert len(out) == len(place) == 5
    assert place[0, 2, 512] == (5, 7) and place[0, 2, 256] == (6, 7) and place[0, 9, 1024] == (5, 8)
    later = [place[1, 0, 256], place[0, 9, 512]]
    assert all(content is None for _, content in later) and len({5, *(anchor for anchor, _ in later)}) == 3


def near_line(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def drop_lines(rows):
    lines = []
    for key in sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows}):
        lines += [(key, k, line) for k, line in enumerate(key[2].split("\n")) if line.encode().split()]
    gone = defaultdict(list)
    for k, (key, no, line) in enumerate(lines):
        w = line.encode().split()
        first = next(j for j, x in enumerate(lines) if x[2] == line)
        # The line's first place decides whether a near one stands earlier.
        if first < k or len(w) >= 10 and any(len(o.encode().split()) >= 10 and near_line(w, o.encode().split()) for _, _, o in lines[:first]):
            gone[key].append(no)
    return {key: ",".join(map(str, sorted(v))) for key, v in gone.items()}


def test_repeated_lines(spark, crowd, odd_docs, odd_rows, no_docs):
    for df, rows in ((crowd[0], crowd[1]), (odd_docs, [r for r in odd_rows])):
        rows = [r for r in rows if not r[1] or len(r[1]) < 10_000]
        df = df.filter("text IS NULL OR length(text) < 10000")
        want = drop_lines(rows)
        got = sorted(((r["doc_id"], r["removed_lines"]) for r in linededup.line_report(df).collect()), key=repr)
        assert got == sorted(((r[0], want.get((r[0] is None, r[0] or 0, r[1] or ""), "")) for r in rows), key=repr)
    assert linededup.line_report(no_docs).count() == 0
    left = {r["doc_id"]: r for r in linededup.drop_repeated_lines(odd_docs).collect()}
    assert 2 not in left and 8 not in left and left[5]["text"] == "" and left[4]["text"] is None and left[1]["n_chars"] == 3
    assert linededup.drop_repeated_lines(odd_docs).columns == odd_docs.columns


def test_one_word_edits_of_a_template_line(spark):
    head, tail = "this is the usual opening of".split(), "and this is how it ends".split()
    rows = [(k, " ".join([*head, f"n{k}", *tail])) for k in range(40)]  # the last below is two edits from all others
    rows += [(90, " ".join([*head, *tail])), (91, " ".join([*head, "p", "q", *tail]))]
    got = {r["doc_id"]: r["n_removed"] for r in linededup.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == 0 and all(got[k] == 1 for k in range(1, 40)) and got[90] == 1 and got[91] == 0
