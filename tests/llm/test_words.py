"""Byte-pair coding and spelling variants against the tokenizer library and brute force."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import pytest
from tokenizers import Tokenizer

from netquarry.llm import bpe, spelling


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.TOKENIZER)


def coded(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_as_the_library(library):
    words = bpe.WordIds(bpe.Bpe(bpe.TOKENIZER))
    draw = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "‍", "　", "a", "the", "Zoë", "1", "²", "Ⅷ", "'s", "'LL", "'ll", "!", "...", "漢字", "😀", "<|endoftext|>", "<|endof"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        assert list(array("I", words.of(text))) == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("word", ["a" * 3000, "ab" * 1500, "é" * 900, " " * 2000, "!?" * 700, "qwertyuiop" * 300])
def test_long_words(library, word):
    words = bpe.WordIds(bpe.Bpe(bpe.TOKENIZER))
    assert list(array("I", words.of(word))) == library.encode(word, add_special_tokens=False).ids
    short = word.encode()[: bpe.SHORT]
    assert words.bpe._scanned(short) == words.bpe._queued(short)


def test_long_text_in_chunks(library, monkeypatch):
    monkeypatch.setattr(bpe, "_CHUNK", 7)
    text = "some words, and  more\n\n words " * 20
    assert list(array("I", bpe.WordIds(bpe.Bpe(bpe.TOKENIZER)).of(text))) == library.encode(text, add_special_tokens=False).ids


def test_refuses_other_files():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_coding_of_odd_tables(library, odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, bpe.digests(bpe.decode(bpe.encode(odd_docs))).collect()), key=repr)
    assert got == sorted(((r[0], *coded(library, r[1] or "")) for r in odd_rows), key=repr)
    assert bpe.digests(bpe.decode(bpe.encode(no_docs))).count() == 0


def test_decoding_of_cut_sequences(spark, library):
    ids = library.encode("漢字 <|endoftext|>", add_special_tokens=False).ids
    rows = [(i, i, bytearray(array("I", ids[:i]).tobytes())) for i in range(len(ids) + 1)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, ids binary")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df).collect()}
    assert got == {i: library.decode(ids[:i], skip_special_tokens=False) for i in range(len(ids) + 1)} | {None: ""}


# --- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def spelled(rows):
    """Brute force over (doc_id, text)."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def found(df, **bounds):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in spelling.variants(df, **bounds).collect())


def edited(draw, word):
    i = draw.randrange(len(word))
    return draw.choice((word[:i] + draw.choice("aeioué") + word[i:], word[:i] + word[i + 1 :], word[:i] + draw.choice("xyzß") + word[i + 1 :]))


@pytest.fixture(scope="module")
def typos():
    draw = random.Random(7)
    rows = []
    for k in range(60):
        base = "".join(draw.choice(("ba", "de", "ki", "lo", "mü", "ra", "se", "Ti")) for _ in range(draw.randint(3, 7)))
        family = [base, *(edited(draw, base) for _ in range(4))]
        family += [edited(draw, w) for w in family[1:3]]
        for w in family:
            rows.append((len(rows), " ".join([w] * draw.choice((1, 2, 3, 21, 210)))))
    # A crowd that differs in its last letters only, words of one letter, and very long ones.
    crowd = ["common" * 2 + a + b for a in "abcdefgh" for b in "abcdefgh"]
    rows += [(len(rows) + i, f"{w}, {w}; {w}") for i, w in enumerate(crowd)]
    long = "".join(draw.choice("abcde") for _ in range(400))
    ends = [long, long[:200], long[:199], long[:201], "x" + long, long[1:], long[:150] + "q" + long[151:], long[:-1] + "q", "a" * 7, "a" * 8, "a" * 300, "a" * 301]
    rows += [(len(rows) + i, f"{w}\n{w}") for i, w in enumerate(ends)]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"rare": 2, "merged": 4}, {"rare": 1, "merged": 0}, {"rare": 10_000, "merged": 10_000}])
def test_variants_against_brute_force(spark, typos, bounds):
    df = spark.createDataFrame(typos, "doc_id bigint, text string").repartition(3)
    want = spelled(typos)
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 5 for w in want)
    assert found(df, **bounds) == want


def test_variants_of_odd_tables(odd_docs, odd_rows, no_docs):
    assert found(odd_docs) == spelled([r[:2] for r in odd_rows])
    assert found(no_docs) == []
