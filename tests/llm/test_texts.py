"""Quality, personal data, pages, benchmark search, packing, totals and licences."""

import collections
import random
import re
import textwrap
import zlib
from array import array

import numpy as np
import pytest

from netquarry.llm import decontaminate, htmlblocks, licenses, packing, pii, quality, rollups

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(draw: random.Random, n: int) -> list[str]:
    return ["".join(draw.choice(("ba", "de", "ki", "lo", "mu", "ra", "se", "ti")) for _ in range(draw.randint(1, 4))) for _ in range(n)]


# ---- quality ----------------------------------------------------------------


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = [False] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered[i : i + 3] = [True] * 3
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, sum(covered), len(w) < 50 or 100 * sum(covered) > 50 * len(w)


def labelled(spark):
    """Documents of clean and of junk lines, two kinds of junk, with labels."""
    draw, rows, labels = random.Random(4), [], []
    for k in range(80):
        good = k % 2 == 0
        lines = []
        for _ in range(6):
            w = words(draw, 14)
            lines.append(" ".join(w).capitalize() + "." if good else " | ".join(w) if k % 4 == 1 else " ".join(f"{x}###" for x in w))
        rows.append((k, "\n".join(lines), "en", "s", 0))
        labels.append((k, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality(spark, odd_docs, odd_rows, no_docs):
    docs, rows, labels = labelled(spark)
    train, held = labels.filter("doc_id < 40"), {r[0] for r in rows if r[0] >= 40}
    got = {r["doc_id"]: r for r in quality.judge(docs, train).collect()}
    assert all(got[k]["kept"] == (k % 2 == 0) for k in held)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert all(tuple(got[r[0]][c] for c in names) == base_counts(r[1]) for r in rows)
    odd = quality.judge(odd_docs, labels.limit(0)).collect()
    assert sorted((tuple(r[c] for c in names) for r in odd)) == sorted(base_counts(r[1]) for r in odd_rows)
    assert quality.judge(no_docs, labels.limit(0)).count() == 0
    assert quality.keep_good(docs, labels).count() == 40
    left = quality.keep_good(odd_docs, labels)
    assert left.schema == odd_docs.schema and left.count() == sum(r["kept"] for r in quality.judge(odd_docs, labels).collect())


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(2)
    field = quality.LineField(draw.normal(size=(2, quality.FEATURES)), draw.normal(size=(2, 2)))
    x = draw.normal(size=(7, quality.FEATURES))
    scores = x @ field.weights.T

    def value(path):
        return sum(scores[t, y] for t, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

    best = max((tuple(int(c) for c in f"{k:07b}") for k in range(128)), key=value)
    assert tuple(field.labels(x)) == best


# ---- personal data ----------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            tests = [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15]
            if tests[k]:
                out.append((k, *m.span()))
    return out


def test_base_patterns_equal_the_plain_ones():
    draw = random.Random(8)
    pieces = ["a@b.c", "@", ".", "x.y@z-1.co.uk", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4539578763621486", "4539 5787-6362 1486", "+1 (301) 555-0346", "+4",
              " ", "-", "%", "é", "007", "+", "12.34.56.78@host.org", "\n", "abc", "a@b@c.d", "9" * 25]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 9)))
        assert pii.base_spans(text) == slow_spans(text), text


def test_personal_data(spark, odd_docs, no_docs):
    draw, rows = random.Random(3), []
    for k in range(60):
        w = words(draw, 60)
        w[10], w[25], w[40] = f"{w[0]}.{k}@mail{k}.example.com", f"10.0.{k}.7", f"+1 (301) 555-{k:04d}"
        w[50] = f'token = "{draw.getrandbits(160):040x}"'
        rows.append((k, " ".join(w), "en", "s", 0))
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, text, *_ in rows:
        r, spans = got[k], got[k]["spans"].split(",")
        assert (r["n_email"], r["n_ip"], r["n_phone"]) == (1, 1, 1)
        secret = re.search('"([0-9a-f]{40})"', text).span(1)
        assert f"secret:{secret[0]}:{secret[1]}" in spans and {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in slow_spans(text)} <= set(spans)
    assert {r["spans"] for r in pii.personal_data(odd_docs).collect()} == {""}
    assert pii.personal_data(no_docs).count() == 0


# ---- pages ------------------------------------------------------------------


def page(draw, k, main, side):
    body = "".join(f"<p>{' '.join(words(draw, 25)).capitalize()} &amp; more.</p>" for _ in range(4))
    return (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"
            f"<!-- ad --><script>var t='</p>';</script><{main}><h1>Title {k}</h1>{body}</{main.split()[0]}>{side}<footer>&copy; someone</footer></body></html>")


def test_main_text(spark, no_docs):
    draw = random.Random(6)
    rows = [(k, f"http://x/{k}", page(draw, k, "article", "<div class='ad'>Buy this now</div>")) for k in range(40)]
    others = [(100 + k, None, page(draw, k, "div class='post-content'", "<div class='sidebar'><p>Read these other things too</p></div><form><label>Your name</label></form>"
               "<section id='comments'><p>I did not like this at all.</p></section>")) for k in range(10)]
    odd = [(200, "u", None), (201, "u", ""), (202, "u", "<"), (203, None, "<p>unclosed <b>text"), (0, "http://x/0", rows[0][2]), (None, None, "<div>")]
    df = spark.createDataFrame([*rows, *others, *odd], "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "'x' AS n_chars")
    got = htmlblocks.main_text(df).collect()
    assert len(got) == 56
    texts = {r["page_id"]: r["text"] for r in got}
    for k, _, html in [*rows, *others]:
        inner = re.search(r"<h1>.*?(?=</article>|</div>)", html).group()
        assert texts[k] == " ".join(re.sub("<[^>]+>", " ", inner).replace("&amp;", "&").split())
    assert texts[200] == texts[201] == texts[None] == "" and all(r["n_chars"] == len(r["text"]) for r in got)
    assert htmlblocks.main_text(df.limit(0)).count() == 0


def test_main_text_of_a_table_without_articles(spark):
    draw = random.Random(9)
    side = ("<div class='sidebar'><p>Read these other things too</p></div><form><label>Your name</label></form>"
            "<div class='comments'><p>I did not like this at all.</p></div>")
    rows = [(k, "u", page(draw, k, "div class='post-content'", side)) for k in range(40)]
    got = htmlblocks.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    right = 0
    for r in got:
        inner = re.search(r"<h1>.*?(?=</div>)", rows[r["page_id"]][2]).group()
        right += r["text"] == " ".join(re.sub("<[^>]+>", " ", inner).replace("&amp;", "&").split())
    assert len(got) == 40 and right >= 36


def test_main_text_without_any_text_to_learn_from(spark):
    rows = [(1, "u", "<nav><ul><li><a href='/'>Home</a></li></ul></nav>"), (2, "u", None)]
    got = htmlblocks.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert [r["text"] for r in got] == ["", ""]


def test_blocks():
    got = htmlblocks.blocks("<div class=a>one<b>two</b> three<p>x &lt; y<p>z<br>w</div><textarea><p>no</textarea>end")
    assert [b.text for b in got] == ["onetwo three", "x < y", "z", "w", "end"]
    assert got[0].path == ("<div", "a") and got[2].path == ("<div", "a", "<p") and got[4].path == ()


def test_gradients_of_the_labeller():
    draw, model = np.random.default_rng(1), htmlblocks.Labeller()
    x = draw.normal(size=(4, 2, htmlblocks.PATHS + htmlblocks.WORDS + htmlblocks.SHARES)).astype(np.float32) * 0.1
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = draw.integers(0, 2, (4, 2)).astype(np.float32)
    grad = model.gradients(x, mask, y)

    def loss():
        s = model.scores(x, mask).astype(np.float64)
        return ((np.logaddexp(0, s) - y * s) * mask).sum() / mask.sum()

    for name, at in (("Wf", (3, 5)), ("Ub", (2, 20)), ("bf", (13,)), ("v", (4,))):
        keep = model.p[name][at]
        model.p[name][at] = keep + 1e-2
        up = loss()
        model.p[name][at] = keep - 1e-2
        down = loss()
        model.p[name][at] = keep
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-4)


# ---- benchmark --------------------------------------------------------------


def test_contamination(spark, odd_docs, no_docs):
    draw = random.Random(12)
    items = [(k, " ".join(words(draw, 30)).capitalize() + ". " + " ".join(words(draw, 6)) + ".") for k in range(12)]
    rows, want = [], set()
    for k in range(80):
        w = words(draw, draw.randint(0, 150))
        if k % 4 == 0:
            item = items[(k // 4) % 12]
            copy = item[1].split()
            for _ in range(k // 4 % 5):  # reworded: up to four words changed
                copy[draw.randrange(len(copy) - 7)] = words(draw, 1)[0]
            at = draw.randint(0, len(w))
            w[at:at] = copy
            want.add((k, item[0]))
        rows.append((k, " ".join(w), "en", "s", 0))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "  ")], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == want
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.count() == 60 and left.columns == docs.columns
    assert decontaminate.contaminated(odd_docs, bench).count() == 0
    assert decontaminate.drop_contaminated(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.contaminated(no_docs, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_space_holds_every_item(spark):
    """More items than a fixed small rank could hold, and texts of the same words that are no items."""
    draw, known = random.Random(21), words(random.Random(22), 900)
    items = [(k, " ".join(draw.choices(known, k=34)).capitalize() + ".") for k in range(300)]
    rows = [(k, " ".join(draw.choices(known, k=40) + (items[k][1].split() if k < 300 else []) + draw.choices(known, k=40)), "en", "s", 0) for k in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    block = decontaminate.items_of(items)
    idf = decontaminate.inverse_frequencies(docs, block)
    space = decontaminate.latent_space(block, idf)
    for found in block.words:
        row = np.bincount([block.vocabulary[w] for w in found], minlength=len(idf)) * idf
        assert np.linalg.norm(row @ space) == pytest.approx(np.linalg.norm(row), rel=1e-3)
    bench = spark.createDataFrame([*items, (300, items[0][1])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(k, k) for k in range(300)} | {(0, 300)}


def test_search_equals_brute_force_at_any_number_of_documents():
    """Short and long, verbatim and reworded items among foreign words, weights as of few and of many documents."""
    draw, common = random.Random(31), words(random.Random(32), 60)
    items = decontaminate.items_of([(k, " ".join(draw.choices(common, k=n // 2) + words(draw, n - n // 2)) + ".") for k, n in enumerate([5, 8, 9, 12, 15, 18, 25, 40, 70, 120] * 3)])
    texts = []
    for k in range(150):
        w = [f"foreign{draw.randrange(10**6)}" if draw.random() < 0.7 else draw.choice(common) for _ in range(draw.randint(0, 200))]
        copy = [x.decode() for x in items.words[k % 30]]
        for _ in range(0 if k < 60 else draw.randrange(len(copy) // 2 + 1)):
            copy[draw.randrange(len(copy))] = "other"
        w[(at := draw.randint(0, len(w))) : at] = copy
        texts.append(" ".join(w).encode())
    want = []
    for text in texts:
        w, hits = decontaminate.plain_words(text), set()
        for q, (item, answer) in enumerate(zip(items.words, items.answers)):
            for start in range(0, max(1, len(w) - 16), 16):
                around = w[max(0, start - len(item)) : start + 32 + len(item)]
                if decontaminate.common_subsequence(item, around) >= 0.6 * len(item) and decontaminate.common_subsequence(answer, around) >= 0.5 * len(answer):
                    hits.add(q)
        want.append(hits)
    assert all(k % 30 in hits for k, hits in enumerate(want[:60]))
    df = np.zeros(len(items.vocabulary) + 1)
    for text in texts:
        df[np.unique(decontaminate.features_of(decontaminate.plain_words(text), items.vocabulary))] += 1
    df[0] = 0
    for more in (1, 10**6):
        idf = np.log((len(texts) * more + 1) / (df * more + 1)) + 0.01
        search = decontaminate.Search(items, idf, decontaminate.latent_space(items, idf))
        assert [set(search.found(text)) for text in texts] == want


def test_candidates_come_from_the_space(spark):
    """An item the space does not hold is not met; the passages' directions are those of all their TF-IDF rows."""
    draw, known = random.Random(41), words(random.Random(42), 30)
    items = decontaminate.items_of([(k, " ".join(draw.choices(known, k=20)) + ".") for k in range(4)])
    rows = [(k, " ".join(draw.choices(known + ["foreign"], k=draw.choice([0, 5, 16, 32, 33, 70, 200])) + ([x.decode() for x in items.words[k % 4]] if k % 2 else [])), "en", "s", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    idf = decontaminate.inverse_frequencies(docs, items)
    passages = []
    for row in rows:
        ids = decontaminate.features_of(decontaminate.plain_words(row[1].encode()), items.vocabulary)
        for start in range(0, max(1, len(ids) - 16), 16) if len(ids) else ():
            v = np.bincount(ids[start : start + 32], minlength=len(idf)) * idf
            size = np.sqrt((idf[ids[start : start + 32]] ** 2 * (ids[start : start + 32] > 0)).sum())
            v[0] = 0
            passages.append(v / size if size else v)
    a = np.array(passages)
    found = decontaminate.passage_directions(docs, items, idf)
    assert found.T @ found == pytest.approx(a.T @ a / np.linalg.norm(a, 2) ** 2, abs=1e-8)
    space = decontaminate.latent_space(items, idf, found)
    text = b"foreign " + b" ".join(items.words[1])
    assert 1 in decontaminate.Search(items, idf, space).found(text)
    assert not decontaminate.Search(items, idf, np.zeros_like(space)).found(text)


@pytest.mark.parametrize("run", [decontaminate.contaminated, decontaminate.drop_contaminated])
def test_space_is_shaped_by_all_documents(spark, monkeypatch, run):
    """Many documents, repeated rows among them: the directions are those of every document's passages."""
    draw, known = random.Random(51), words(random.Random(52), 20)
    rows = [(k, " ".join(draw.choices(known + ["foreign"], k=draw.choice([0, 3, 40]))), "en", "s", 0) for k in range(2100)]
    docs = spark.createDataFrame([*rows, *rows[:50]], SCHEMA)
    bench = spark.createDataFrame([(k, " ".join(draw.choices(known, k=12)) + ".") for k in range(3)], "item_id bigint, text string")
    directions, seen = decontaminate.passage_directions, []

    def passage_directions(read, items, idf):
        seen.append((read.count(), directions(read, items, idf), directions(docs, items, idf)))
        return seen[-1][1]

    monkeypatch.setattr(decontaminate, "passage_directions", passage_directions)
    run(docs, bench).count()
    (count, found, whole), = seen
    assert count == 2150
    assert found.T @ found == pytest.approx(whole.T @ whole, abs=1e-9)


def test_common_subsequence():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


# ---- packing ----------------------------------------------------------------


def test_word_ids_equal_the_tokenizer():
    ids = packing.WordIds(packing.TOKENIZER)
    texts = ["The CAT's hat, isn't it?! 12 3a <|endoftext|>x", "É déjà vu ß Ölfaß İstanbul ΣΑΣ", "a\x1cb   é ＡＢ", "naïve—dash… #### &&&%%", "", "日本語 テスト 🙂🙂", "don't 'S I'LL _x_ a_b"]
    for text in texts:
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(ids.of(text.encode()), "<u2")) == want, text


def test_packing(spark, crowd, odd_docs, odd_rows, no_docs):
    ids = packing.WordIds(packing.TOKENIZER)
    for df, rows in ((crowd[0], crowd[1]), (odd_docs, odd_rows)):
        got = packing.pack(df).collect()
        docs = collections.Counter((r[0], ids.of((r[1] or "").encode()) + b"\x02\x00") for r in rows)
        pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for (doc_id, raw), copies in docs.items():
            whole, n = np.frombuffer(raw, "<u2"), len(raw) // 2
            own = [p for p in pieces[doc_id, n] if zlib.crc32(array("I", whole[p[0] : p[0] + p[1]].tolist()).tobytes()) == p[2]]
            covered = np.zeros(n + 1, int)
            for start, length, _ in own:
                covered[start] += 1
                covered[start + length] -= 1
            assert (np.cumsum(covered)[:-1] == copies).all()
        fills = []
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            fills.append(at)
        assert sum(f < packing.WINDOW for f in fills) <= 1 and max(fills) <= packing.WINDOW
        assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(no_docs).count() == 0


def test_plan_uses_every_head_once():
    draw = np.random.default_rng(5)
    counts = np.concatenate((draw.integers(0, 60, packing.UNITS), draw.integers(0, 20, packing.UNIT - 1)))
    counts[0] = 0
    plan = packing.plan_windows(counts, 7)
    taken = collections.Counter()
    for kind in range(1, packing.CLASSES):
        length = kind * packing.UNIT if kind < packing.UNITS else kind - packing.UNITS + 1
        for rank in range(counts[kind]):
            for _, size, sequence, offset in plan.pieces(kind, rank, length):
                for unit in range(offset, offset + size):
                    taken[sequence, unit] += 1
    assert set(taken.values()) == {1} and min(s for s, _ in taken) == 7
    last = max(s for s, _ in taken)
    assert all((s, u) in taken for s in range(7, last) for u in range(0, packing.WINDOW, 61))


def test_least_squares():
    draw = np.random.default_rng(4)
    a, x = draw.random((12, 30)), np.where(draw.random(30) < 0.2, draw.random(30), 0)
    found = packing.nonnegative_least_squares(a, a @ x)
    assert (found >= 0).all() and np.abs(a @ found - a @ x).max() < 1e-6
    flat = packing.nonnegative_least_squares(np.eye(3), np.array([1.0, -2.0, 3.0]))
    assert flat == pytest.approx([1, 0, 3])


# ---- totals and licences ----------------------------------------------------


def test_rollup_is_idempotent_and_folds(spark, odd_docs, no_docs):
    def counted(rows, extra=""):
        return spark.createDataFrame(rows, "source string, lang string, tokenizer_version string, n_tokens bigint" + extra)

    roll = rollups.Rollup(spark)
    assert roll.totals().count() == 0
    a = counted([("a", "en", "1", 10), ("a", "en", "1", 5), (None, "en", "1", None)])
    roll.commit(0, rollups.inserted(a))
    roll.commit(1, rollups.revised(counted([("a", "en", "1", 7, 5)], ", old_n_tokens bigint")), rollups.deleted(counted([(None, "en", "1", 0)])))
    want = [("a", "en", "1", 2, 17)]
    for _ in range(2):
        roll.commit(1, rollups.revised(counted([("a", "en", "1", 7, 5)], ", old_n_tokens bigint")), rollups.deleted(counted([(None, "en", "1", 0)])))
        assert [tuple(r) for r in roll.totals().collect()] == want
    roll.fold(1)
    roll.fold(1)
    assert [tuple(r) for r in roll.totals().collect()] == want
    roll.commit(2, rollups.inserted(counted([("b", None, "2", 1)])))
    assert roll.totals().count() == 2
    with pytest.raises(ValueError):
        roll.commit(1, rollups.inserted(a))
    totals = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in rollups.document_totals(odd_docs).collect()}
    assert totals["b", "en", "words"][0] == 2 and totals["b", "en", "words"][1] == 2  # doc 5's text is that of the smaller doc 4
    assert rollups.document_totals(no_docs).count() == 0


def test_licences(spark, odd_docs, no_docs):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    body = [t for k, t in licenses.KNOWN if k == "MIT"][-1]
    rows = [(1, f"Some text\nreleased UNDER the MIT licence!\nmore"), (2, "Copyright (c) 2020 Someone\n\n" + body.upper()), (3, mit), (4, mit + " not really"),
            (5, None), (6, ""), (7, "(C) 1999 x\nAll rights reserved")]
    got = {tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, 1, "MIT"), (2, -1, "MIT"), (3, 0, "MIT"), (7, 1, "proprietary")}
    own = spark.createDataFrame([("own", "one two")], "license string, text string")
    assert {(r["doc_id"], r["unit"]) for r in licenses.scan(odd_docs, own).collect()} == {(7, 0), (8, 0)}
    assert licenses.scan(no_docs).count() == 0 and licenses.scan(odd_docs, own.limit(0)).count() == 0


def test_whole_licences_and_runs_of_lines(spark):
    full = licenses.full_texts()
    rows, want = [], set()
    for license in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
        body, titled = [t for k, t in full if k == license][:2]
        wrapped = "\n".join(textwrap.fill(p, 78) for p in body.split("\n"))
        narrow = textwrap.fill(body, 40)
        n = len(rows)
        # Alone, with title and copyright line, and inside a longer text.
        rows += [(n, narrow), (n + 1, titled.split("\n")[0] + "\n\nCopyright (c) 2020 Someone\n\n" + wrapped), (n + 2, "before it\n\n" + wrapped + "\nafter it")]
        want |= {(n, -1, license), (n + 1, -1, license), (n + 1, 4, license), (n + 2, 2, license)}
    for license in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"):
        text = next(t for k, t in full if k == license)
        rows.append((100 + len(rows), text))
        want.add((rows[-1][0], -1, license))
        rows.append((100 + len(rows), "before it\n" + text + "\nafter it"))
        want.add((rows[-1][0], 1 + next(i for i, line in enumerate(text.split("\n")) if line.strip()), license))
    notice = [(300, "x\nThis work is licensed under the\nGNU General Public\n\nLicense, version 3.\ny"), (301, "x\nThis work is licensed under the\nGNU General Public License, version 3. y"), (302, "All\nrights reserved.")]
    want |= {(300, 1, "GPL-3.0"), (302, -1, "proprietary")}
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(rows + notice, "doc_id bigint, text string")).collect()]
    assert want <= set(got) and len(got) == len(set(got))
    assert {r for r in got if r[0] < 100 or r[0] >= 300} == want - {r for r in want if 100 <= r[0] < 300}
    # Against brute force over every run of lines.
    draw = random.Random(41)
    known = [("a", "u v"), ("b", "u v w"), ("c", "v\nw u v"), ("d", "w"), ("e", "u u u u u")]
    docs = [(k, "".join(draw.choice(("u", "v", "w", "x", " ", " ", "\n", "\n")) for _ in range(draw.randint(0, 24)))) for k in range(300)]
    texts, want = {" ".join(t.split()): k for k, t in known}, set()
    for k, text in docs:
        filled = [(i, " ".join(line.split())) for i, line in enumerate(text.split("\n")) if line.strip()]
        for i in range(len(filled)):
            for j in range(i, len(filled)):
                run = " ".join(x for _, x in filled[i : j + 1])
                if run in texts:
                    want.add((k, -1 if j - i + 1 == len(filled) > 1 else filled[i][0], texts[run]))
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(known, "license string, text string")).collect()]
    assert sorted(got) == sorted(want)
