"""Spelling variants: words one edit apart, found through variable-length grams.

A word between two end marks has one gram at every place: the shortest piece of 2
to 7 letters from there that is rare in the vocabulary. So the gram dictionary
holds short grams where they select well and longer ones only under frequent
prefixes, and whether a piece is a gram depends on its own letters alone.

One edit changes only the grams over its place; the largest number of grams over
one place of a word is the word's bound. Two words one edit apart therefore keep
all but so many grams in common, and must share some of their rarest ones, as many
more than the bound as both list. The lists of these rare grams are merged by
counting shared grams for each pair, and what reaches the count is verified by edit
distance. A gram that stays frequent at full length (its list could be of any size)
is not merged: the words that need it meet by their own text without one letter
instead, where a group is no larger than the alphabet.

The vocabulary is counted with partial aggregates first, so a very frequent word is
one row per task. The dictionary comes out of the sorted order of all pieces, block
by block; the rest is joins and aggregates of built-in functions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.storage import materialize

LETTERS = r"A-Za-z\u00C0-\u00FF"
MIN_LENGTH = 7
MIN_COUNT = 2
GARBLE = 31  # runs whose hash this divides lose a letter
RATIO = 10  # a form is at least so much more frequent
SHORTEST, LONGEST = 2, 7  # letters of a gram; LONGEST may not exceed MIN_LENGTH
RARE = 32  # a gram found more often is made longer
MERGED = 256  # the longest list that is merged
SHARED = 2  # grams beyond its bound that a word lists
LONG_WORD = 200  # letters; longer words meet by halves, not by each left-out letter
BLOCK = 4096  # pieces of the sorted vocabulary counted together
_ENDS = pa.list_(pa.struct([("gram", pa.string()), ("found", pa.int64())]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FROM, _TO = "^", "$"  # end marks, outside the letters


def _without_letter(text: Column, at: Column) -> Column:
    """``text`` without its letter ``at`` (from 0)."""
    return F.concat(F.left(text, at), F.substr(text, at + 2))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the distinct words of all texts and their occurrences.

    A word is a maximal run of letters, A-Z in lower case; where the CRC-32 h of
    ``<doc_id>:<run>`` is a multiple of 31 it lacks its letter h % length.
    """
    # Shorter runs only yield shorter words.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = run.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    run = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % GARBLE == 0, _without_letter(F.col("run"), at)).otherwise(F.col("run"))
    counted = run.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _blocked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces in blocks, with their own counts of the prefixes of the first and the last piece."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            pieces, counts = part.column("piece").to_pylist(), part.column("n").to_numpy()
            ends = {}
            for piece in {pieces[0], pieces[-1]}:
                for q in range(SHORTEST, len(piece) + 1):
                    gram = piece[:q]
                    ends[gram] = int(counts[bisect_left(pieces, gram) : bisect_right(pieces, gram, key=lambda p: p[:q])].sum())
            yield pa.RecordBatch.from_arrays(
                [part.column("block").slice(0, 1), pa.array([pieces]), pa.array([counts], pa.list_(pa.int64())), pa.array([list(ends.items())], _ENDS)],
                ["block", "pieces", "counts", "ends"],
            )


def _chosen(rare: int):
    """Task body: the gram of each piece of a block, from prefix counts in the block or, at its ends, over all blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pieces, counts = batch.column("pieces")[i].as_py(), np.array(batch.column("counts")[i].as_py(), np.int64)
                ends = {e["gram"]: e["found"] for e in batch.column("ends")[i].as_py()}
                lengths = np.array([len(p) for p in pieces])
                letters, found = lengths.copy(), counts.copy()  # the whole piece, if no prefix of it is rare
                for q in range(LONGEST - 1, SHORTEST - 1, -1):
                    prefixes = np.array([p[:q] for p in pieces])
                    first = np.concatenate(([True], prefixes[1:] != prefixes[:-1]))
                    run_of = np.cumsum(first) - 1
                    total = np.bincount(run_of, counts).astype(np.int64)
                    starts = np.flatnonzero(first)
                    for k in {0, len(starts) - 1}:
                        total[k] = ends.get(prefixes[starts[k]].item(), total[k])
                    total = total[run_of]
                    takes = (lengths > q) & (total <= rare)
                    letters[takes], found[takes] = q, total[takes]
                yield pa.RecordBatch.from_arrays([pa.array(pieces), pa.array(letters, pa.int32()), pa.array(found)], ["piece", "letters", "found"])

    return run


def gram_dictionary(places: DataFrame, rare: int) -> DataFrame:
    """piece, letters, found: the gram that starts each piece (LONGEST letters or up to the word's end) and its frequency.

    A prefix of the piece that is found at most ``rare`` times is long enough, so
    the prefixes below it are pruned; the whole piece is taken if no prefix is rare.
    In sorted order a prefix is a run of pieces: blocks of the order count their own
    runs, and only the runs at their ends are added up across blocks.
    """
    pieces = places.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    ordered = pieces.repartitionByRange("piece").sortWithinPartitions("piece").withColumn("block", F.monotonically_increasing_id())
    schema = "block bigint, pieces array<string>, counts array<bigint>, ends array<struct<gram: string, found: bigint>>"
    blocks = materialize(ordered.mapInArrow(_blocked, schema), "spelling-blocks")
    ends = blocks.select("block", F.inline("ends"))
    totals = ends.groupBy("gram").agg(F.sum("found").alias("total"))
    summed = ends.join(totals, "gram").groupBy("block").agg(F.collect_list(F.struct("gram", F.col("total").alias("found"))).alias("ends"))
    whole = blocks.drop("ends").join(summed, "block")
    return whole.select("pieces", "counts", "ends").mapInArrow(_chosen(rare), "piece string, letters int, found bigint")


def _letter_set(word: Column) -> Column:
    """64-bit set of a word's letters; one edit changes at most two of its bits."""
    letters = F.array_distinct(F.split(word, ""))
    one = F.lit(1).cast("bigint")
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda found, c: found.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.ascii(c), F.lit(64)))))


def rare_grams(words: DataFrame, rare: int = RARE) -> DataFrame:
    """id, margin, gram, nth, found: for each word its bound + SHARED rarest grams.

    ``words``: id, word. ``margin`` is the number of listed grams beyond the bound.
    """
    marked = F.split(F.concat(F.lit(_FROM), "word", F.lit(_TO)), "")
    places = words.select("id", F.length("word").alias("size"), marked.alias("marked")).select(
        "id",
        F.posexplode(F.transform(F.sequence(F.lit(0), "size"), lambda p: F.array_join(F.slice("marked", p + 1, F.lit(LONGEST)), ""))).alias("place", "piece"),
    )
    grams = places.join(gram_dictionary(places, rare), "piece").select("id", F.struct("found", F.left("piece", F.col("letters")).alias("gram"), "place").alias("gram"))
    of_word = grams.groupBy("id").agg(F.array_sort(F.collect_list("gram")).alias("grams"))
    by_place = F.array_sort(F.transform("grams", lambda g: F.struct(g["place"], F.length(g["gram"]).alias("letters"))))
    of_word = of_word.withColumn("lengths", F.transform(by_place, lambda g: g["letters"]))
    over = lambda at: F.size(  # noqa: E731  grams over a place
        F.filter(F.sequence(F.greatest(at - (LONGEST - 1), F.lit(0)), at), lambda p: p + F.get("lengths", p) > at)
    )
    places_of = F.sequence(F.lit(1), F.size("lengths") - 1)
    bound = F.aggregate(places_of, F.lit(0), lambda most, at: F.greatest(most, over(at)))
    bounded = of_word.withColumn("bound", bound)
    listed = F.slice("grams", F.lit(1), F.col("bound") + SHARED)
    # Equal grams of a word stand side by side: the first, second ... of them.
    numbered = F.transform(
        "listed", lambda g, i: F.struct(g["gram"].alias("gram"), F.size(F.filter(F.slice("listed", F.lit(1), i), lambda e: e["gram"] == g["gram"])).alias("nth"),
                                        g["found"].alias("found"))
    )
    listed = bounded.withColumn("listed", listed).select("id", (F.size("listed") - F.col("bound")).alias("margin"), F.explode(numbered).alias("g"))
    return listed.select("id", "margin", "g.gram", "g.nth", "g.found")


def _merged(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) that share as many listed grams as both must."""
    # Size and margin (a few letters) travel as one number.
    listed = lists.select(F.xxhash64("gram", "nth").alias("key"), "id", (F.shiftleft(F.col("size").cast("bigint"), 8) + F.col("margin")).alias("facts"), "letters_set")
    left, right = (listed.select("key", *(F.col(c).alias(f"{c}_{side}") for c in listed.columns[1:])) for side in "ab")
    size, margin = ([f(F.col(f"facts_{side}")) for side in "ab"] for f in (lambda c: F.shiftright(c, 8), lambda c: c.bitwiseAND(F.lit(255))))
    close = (F.col("id_a") < F.col("id_b")) & (F.abs(size[0] - size[1]) <= 1)
    close &= F.bit_count(F.col("letters_set_a").bitwiseXOR(F.col("letters_set_b"))) <= 2
    met = left.join(right, "key").filter(close)
    pairs = met.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.min(F.least(*margin)).alias("needed")
    )
    return pairs.filter("shared >= needed").select("a", "b")


def _pairs(keyed: DataFrame) -> DataFrame:
    other = keyed.select("key", F.col("id").alias("b"))
    return keyed.select("key", F.col("id").alias("a")).join(other, "key").filter("a < b").select("a", "b")


def _by_text(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of words (id, word) that may be one edit apart, without grams.

    Words that differ in one letter are equal without it; the shorter of two words
    that differ by a letter is the longer one without it. For long words: one edit
    lies in one half, so the other half is equal.
    """
    short = words.filter(F.length("word") <= LONG_WORD).withColumn("at", F.explode(F.sequence(F.lit(0), F.length("word") - 1)))
    short = short.select("id", "at", _without_letter(F.col("word"), F.col("at")).alias("key"))
    replaced = _pairs(short.select("id", F.struct("at", "key").alias("key")))
    shorter = words.select(F.col("id").alias("b"), F.col("word").alias("key"))
    deleted = short.select(F.col("id").alias("a"), "key").join(shorter, "key").select("a", "b")
    size = F.length("word")
    # Halves of the shorter length: of the word itself and, as the longer partner, of one letter less.
    halves = words.filter(size >= LONG_WORD).withColumn("of", F.explode(F.array(size, size - 1))).withColumn("half", F.floor(F.col("of") / 2).cast("int"))
    left = F.struct(F.lit(True).alias("left"), "of", F.left("word", F.col("half")).alias("text"))
    right = F.struct(F.lit(False).alias("left"), "of", F.right("word", F.col("of") - F.col("half")).alias("text"))
    halved = _pairs(halves.select("id", F.explode(F.array(left, right)).alias("key")))
    return replaced.unionByName(deleted).unionByName(halved)


def near_words(words: DataFrame, rare: int = RARE, merged: int = MERGED) -> DataFrame:
    """a, b: every pair (once) of ``words`` (id, word of at least LONGEST letters, distinct) that is exactly one edit apart."""
    lists = rare_grams(words, rare).join(words.select("id", F.length("word").alias("size"), _letter_set(F.col("word")).alias("letters_set")), "id")
    lists = materialize(lists, "spelling-lists")
    crowded = words.join(lists.filter(F.col("found") > merged).select("id").distinct(), "id", "left_semi")
    pairs = _merged(lists.filter(F.col("found") <= merged)).unionByName(_by_text(crowded))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    text = words.select(F.col("id").alias("a"), F.col("word").alias("word_a"))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"))
    return pairs.join(text, "a").join(other, "b").filter(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last; a form is RATIO times as frequent, so few doublings suffice."""
    roots = forms.withColumnRenamed("form", "root")
    while True:
        step = roots.select(F.col("word").alias("via"), F.col("root").alias("last"))
        moved = roots.join(step, roots["root"] == step["via"], "left")
        moved = materialize(moved.select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")), "spelling-roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def variants(docs: DataFrame, rare: int = RARE, merged: int = MERGED) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n (see ``vocabulary`` for words and n).

    ``n_near`` counts the words exactly one inserted, deleted or replaced letter
    away. ``form`` is the most frequent of them (the smallest in code-point order on
    a tie) if it occurs at least ten times as often, ``form_n`` its n; else both are
    null. ``root`` follows forms to the last, and is the word itself without one.

    Null, empty and letterless texts have no words; a null doc_id counts as empty
    text in the hash. Repeated rows count each. Texts and words of any length are
    taken whole. Other columns are not read; an empty table gives an empty result.
    """
    words = materialize(vocabulary(docs).withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    pairs = materialize(near_words(words.select("id", "word"), rare, merged), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("other"))
    near = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    best_n = -F.col("best.less")
    known = words.join(near, "id", "left").withColumn("fits", best_n >= RATIO * F.col("n"))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("fits"), F.col("best.word")).alias("form"),
                         F.when(F.col("fits"), best_n).alias("form_n"))
    known = materialize(known, "spelling-known")
    roots = _roots(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _sql() -> str:
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), list_transform(range(8), lambda i: CAST(i AS UBIGINT))),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS v
    FROM range(256) r(b))
), run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z{chr(0xC0)}-{chr(0xFF)}]+')), '{_UPPER}', '{_LOWER}') AS run
  FROM documents
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)),
    CAST(4294967295 AS UBIGINT)) AS h
  FROM (
    SELECT run, count(*) AS n, flatten(list_transform(string_split(id || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS UBIGINT)] ELSE [CAST(195 AS UBIGINT), CAST(unicode(c) - 64 AS UBIGINT)] END)) AS bytes
    FROM run WHERE length(run) >= {MIN_LENGTH} GROUP BY id, run) x CROSS JOIN tab
), word AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % {GARBLE} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
      ELSE run END AS word FROM hashed) y
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), cut AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word) z
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN word w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN word w ON c.rest = w.word
), best AS (
  SELECT p.word, count(*) OVER (PARTITION BY p.word) AS n_near, p.other, o.n AS other_n
  FROM near p JOIN word o ON o.word = p.other
  QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) = 1
), known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form,
    CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n
  FROM word w LEFT JOIN best b ON b.word = w.word
), walk AS (
  SELECT word, word AS root, form AS ahead FROM known
  UNION ALL SELECT k.word, k.ahead, f.form FROM walk k JOIN known f ON f.word = k.ahead
)
SELECT k.word, k.form, w.root, k.n, k.n_near, k.form_n
FROM known k JOIN walk w ON w.word = k.word AND w.ahead IS NULL"""


SQL = _sql()
