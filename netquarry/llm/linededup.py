"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are the same if their strings are, or, from ten words on, if their
words differ by one inserted, deleted or replaced word. Equal lines fold first.
Lines within one edit have one half of their words in common, at the front or
at the end, so only distinct lines that share such a half with another go on.
These emit all their variants with one word of the other half deleted, and the
line itself, as hashed keys: running XORs of (word, position) hashes give every
variant in time linear in the line. Variants meet by key, a line is
compared with the earliest of its key only, and that pair's words are verified.
Aggregates combine map-side and no list of pairs is formed, so a template line
with thousands of fillings costs rows linear in its count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.storage import materialize
from netquarry.llm.text import text_key

NEAR_WORDS = 10
_SPACE_LIKE = "\t\n\x0b\f\r"


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, _SPACE_LIKE, " " * len(_SPACE_LIKE)), " "), "")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "line_no").alias("place")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")


def _front(c: Column) -> Column:
    """Words in the front half of a line of class ``c``; the back half has the other c - front."""
    return F.floor(c / 2).cast("int")


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that hold a word: place, digest (h0, h1), words n and, for near matches, half keys."""
    lines = _rows(docs).select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("words", _words(F.col("line"))).withColumn("n", F.size("words")).filter("n > 0")

    def halves(c: Column) -> list[Column]:
        back = c - _front(c)
        return [
            F.xxhash64(F.lit(0), c, F.slice("words", F.lit(1), _front(c))),
            F.xxhash64(F.lit(1), c, F.slice("words", F.col("n") - back + 1, back)),
        ]

    # As the shorter line of a pair (or of equal length) the class is n, as the longer n - 1.
    keys = F.when(F.col("n") >= NEAR_WORDS, F.array(*halves(F.col("n")), *halves(F.col("n") - 1)))
    return lines.select("doc_id", "text_key", "line_no", F.xxhash64("line").alias("h0"), F.xxhash64(F.lit(1), "line").alias("h1"), "n",
                        keys.alias("halves"))


def _near_candidates(distinct: DataFrame) -> DataFrame:
    """Distinct lines that share a half with another: h0, and per kind of edit where it may be.

    ``replace``, ``longer`` and ``shorter`` are sets over {0, 1}: 0 where the front
    half is shared, so that the edit is behind it, 1 where the back half is.
    """
    halves = distinct.filter("halves IS NOT NULL").select("h0", F.posexplode("halves").alias("role", "half"))
    own = F.when(F.col("role") < 2, F.col("h0"))
    groups = halves.groupBy("half").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.max(F.when(F.col("role") >= 2, 1)).alias("longer"))
    groups = groups.filter("low <> high OR (low IS NOT NULL AND longer = 1)")
    side = F.col("role") % 2

    def sides(wanted: Column) -> Column:
        return F.collect_set(F.when(wanted, side))

    return halves.join(groups, "half").groupBy("h0").agg(
        sides((F.col("role") < 2) & (F.col("low") != F.col("high"))).alias("replace"),
        sides((F.col("role") >= 2) & F.col("low").isNotNull()).alias("longer"),
        sides((F.col("role") < 2) & (F.col("longer") == 1)).alias("shorter"),
    )


def _near_later(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Distinct lines (h0, h1) within one word of an earlier one."""
    candidates = materialize(_near_candidates(distinct).join(distinct.select("h0", "h1", "place"), "h0"), "line-near")
    wanted = candidates.select("place.*").groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("wanted"))
    wanted = wanted.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    rows = _rows(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    texts = rows.select("doc_id", "text_key", F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("line_no"))
    texts = texts.select(_place(), _words(F.col("lines")[F.col("line_no")]).alias("words"))
    # Repeated rows yield the same line again; one of them is enough.
    lines = materialize(candidates.join(texts, "place").dropDuplicates(["h0", "h1"]), "line-candidates")

    word = lines.select("h0", "h1", F.size("words").alias("n"), "replace", "longer", "shorter", F.posexplode("words").alias("i", "word"))
    here, moved = F.xxhash64("i", "word"), F.xxhash64(F.col("i") - 1, F.col("word"))
    upto = Window.partitionBy("h0", "h1").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("h0", "h1").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.bit_xor(here).over(upto).bitwiseXOR(here).bitwiseXOR(F.bit_xor(moved).over(upto)).bitwiseXOR(F.bit_xor(moved).over(every))
    cut = word.select("*", left.alias("left"), F.bit_xor(here).over(every).alias("full"))

    def may_be(sides: str, c: Column) -> Column:
        behind = F.array_contains(sides, 0) & (F.col("i") >= _front(c))
        return behind | (F.array_contains(sides, 1) & (F.col("i") <= F.col("n") - (c - _front(c))))

    # Replaced word: equal variants at one position. Inserted word: a variant equals a whole line one word shorter.
    replaced = F.when(may_be("replace", F.col("n")), F.struct(F.lit(0).alias("kind"), F.xxhash64(F.lit(0), "n", "i", "left").alias("key"), "i"))
    inserted = F.when(may_be("longer", F.col("n") - 1),
                      F.struct(F.lit(1).alias("kind"), F.xxhash64(F.lit(1), F.col("n") - 1, "left").alias("key"), "i"))
    whole = F.when((F.col("i") == 0) & (F.size("shorter") > 0),
                   F.struct(F.lit(2).alias("kind"), F.xxhash64(F.lit(1), "n", "full").alias("key"), F.lit(-1).alias("i")))
    keys = cut.select("h0", "h1", F.explode(F.array_compact(F.array(replaced, inserted, whole))).alias("v")).select("h0", "h1", "v.*")
    keys = materialize(keys, "line-variants")
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    met = keys.join(several, "key").join(lines.select("h0", "h1", "place"), ["h0", "h1"])
    met = materialize(met, "line-met")

    def earliest(kind: int) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.struct("place", "i", "h0", "h1"))).alias(f"e{kind}")

    firsts = met.groupBy("key").agg(*map(earliest, (0, 1, 2)))
    rival = F.when(F.col("kind") == 0, F.col("e0")).when(F.col("kind") == 1, F.col("e2")).otherwise(F.col("e1"))
    pairs = (
        met.join(firsts, "key").select("h0", "h1", "place", "i", "kind", rival.alias("rival")).filter(F.col("rival.place") < F.col("place"))
        .select("h0", "h1", F.greatest("i", "rival.i").alias("i"), (F.col("kind") == 0).alias("replaced"),
                F.col("rival.h0").alias("g0"), F.col("rival.h1").alias("g1"))
        .distinct()
    )
    mine = lines.select("h0", "h1", F.col("words").alias("a"))
    theirs = lines.select(F.col("h0").alias("g0"), F.col("h1").alias("g1"), F.col("words").alias("b"))

    def cut_at(words: str) -> Column:
        w = F.col(words)
        return F.concat(F.slice(w, F.lit(1), F.col("i")), F.slice(w, F.col("i") + 2, F.size(w)))

    same = (
        F.when(F.col("replaced"), (F.size("a") == F.size("b")) & (cut_at("a") == cut_at("b")))
        .when(F.size("a") > F.size("b"), cut_at("a") == F.col("b")).otherwise(F.col("a") == cut_at("b"))
    )
    return pairs.join(mine, ["h0", "h1"]).join(theirs, ["g0", "g1"]).filter(same).select("h0", "h1").distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines to remove: doc_id, text_key, line_no (from 0).

    A line with words goes if an equal one, or from ten words on one within one
    word edit of it, stands earlier: in a smaller doc_id, or higher up in the same
    document. Which of the two is itself removed does not matter. Words are runs
    outside space and tab..carriage return; lines are split at \\n.

    Null, empty and blank texts have no such lines. Repeated rows with one doc_id
    and text are one document and lose the same lines. A null doc_id comes after
    all others. Other columns are not read.
    """
    lines = materialize(_lines(docs), "lines")
    distinct = materialize(
        lines.groupBy("h0", "h1").agg(F.min(_place()).alias("place"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("copies")),
        "line-distinct",
    )
    near = _near_later(docs, distinct).withColumn("near", F.lit(True))
    # A distinct line that is near an earlier one goes wherever it stands.
    verdict = distinct.select("h0", "h1", F.col("place").alias("first"), "copies").join(near, ["h0", "h1"], "left")
    verdict = verdict.filter("copies > 1 OR near").select("h0", "h1", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("h0", "h1", _place()).join(verdict, ["h0", "h1"]).filter(F.col("near") | (F.col("place") != F.col("first")))
    return gone.select("place.doc_id", "place.text_key", "place.line_no").distinct()


def _per_document(docs: DataFrame) -> DataFrame:
    gone = repeated_lines(docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("line_no")).alias("_gone"))
    return materialize(gone.select(F.col("doc_id").alias("_nq_id"), F.col("text_key").alias("_nq_key"), "_gone"), "line-gone")


def line_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, removed_lines (numbers from 0, comma-joined)."""
    gone = _per_document(docs)
    rows = _rows(docs).select("doc_id", "text_key", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    out = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_nq_id"]) & (rows["text_key"] == gone["_nq_key"]), "left")
    numbers = F.transform("_gone", lambda x: x.cast("string"))
    return out.select("doc_id", "n_lines", F.coalesce(F.array_size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"),
                      F.coalesce(F.array_join(numbers, ","), F.lit("")).alias("removed_lines"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines cut out of the text; columns stay.

    Documents none of whose lines with words is left go; documents that had none
    before stay as they are. n_chars, where present, follows the new text.
    """
    gone = _per_document(docs)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_nq_id")) & (text_key(F.col("text")) == F.col("_nq_key"))
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("_gone"), i))
    joined = docs.join(gone, same, "left").withColumn("_nq_text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    joined = joined.filter(F.col("_gone").isNull() | F.col("_nq_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("_nq_text")}
    if "n_chars" in docs.columns:
        length = F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.char_length("_nq_text"))
        changed["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return joined.select([changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])


SQL = r"""
WITH lines AS (
  SELECT doc_id, no - 1 AS line_no, string_split(text, chr(10))[no] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents)
), split AS (
  SELECT *, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM lines
), filled AS (SELECT *, len(words) AS n FROM split WHERE len(words) > 0),
firsts AS (SELECT line, any_value(words) AS words, any_value(n) AS n, min({'d': doc_id, 'l': line_no}) AS place FROM filled GROUP BY line),
variants AS (
  SELECT line, place, n, i, words[1 : i - 1] || words[i + 1 : n] AS left_words
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= 10)
), replaced AS (SELECT n, i, left_words, min(place) AS e FROM variants GROUP BY ALL),
shorter AS (SELECT left_words, min(place) AS e FROM variants GROUP BY ALL),
whole AS (SELECT words, min(place) AS e FROM firsts WHERE n >= 10 GROUP BY ALL),
near AS (
  SELECT line FROM variants v JOIN replaced r ON v.n = r.n AND v.i = r.i AND v.left_words = r.left_words WHERE r.e < v.place
  UNION SELECT line FROM variants v JOIN whole w ON v.left_words = w.words WHERE w.e < v.place
  UNION SELECT line FROM firsts f JOIN shorter s ON f.words = s.left_words WHERE f.n >= 10 AND s.e < f.place
), gone AS (
  SELECT f.doc_id, f.line_no FROM filled f JOIN firsts t ON f.line = t.line
  WHERE {'d': f.doc_id, 'l': f.line_no} <> t.place OR f.line IN (SELECT line FROM near)
), counts AS (SELECT doc_id, count(*) AS n_removed, string_agg(line_no, ',' ORDER BY line_no) AS removed_lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN counts USING (doc_id)
"""
