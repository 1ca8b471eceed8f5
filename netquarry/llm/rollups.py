"""Token totals kept by signed deltas, committed batch by batch.

A batch of changes (documents that come, go, or whose count is revised) becomes
additive deltas of documents and tokens by source, language and tokenizer
version, pre-aggregated before their one shuffle, and is written to a folder
named by the batch. Totals are the sum over committed batches. Committing a batch
again replaces its own folder, so replays and retries change nothing; folding
turns committed batches into one base, and folded batch ids are refused after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.storage import fresh_path

GROUP = ["source", "lang", "tokenizer_version"]
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"


def inserted(counted: DataFrame) -> DataFrame:
    """Changes for documents that come: source, lang, tokenizer_version, n_tokens."""
    return counted.select(*GROUP, F.lit(1).cast("bigint").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))


def deleted(counted: DataFrame) -> DataFrame:
    """Changes for documents that go, with the counts they came with."""
    return inserted(counted).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revised(counted: DataFrame) -> DataFrame:
    """Changes for new counts of documents that stay: also old_n_tokens."""
    change = F.coalesce("n_tokens", F.lit(0)) - F.coalesce("old_n_tokens", F.lit(0))
    return counted.select(*GROUP, F.lit(0).cast("bigint").alias("n_docs"), change.cast("bigint").alias("n_tokens")).filter("n_tokens <> 0")


class Rollup:
    """Totals under one folder of the shared storage."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or fresh_path(spark, "token-rollup")

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _folded(self) -> int:
        """Last batch id in the base, -1 without one."""
        if not self._exists(f"{self.path}/folded"):
            return -1
        done = self.spark.read.schema("upto bigint").parquet(f"{self.path}/folded").agg(F.max("upto").alias("upto")).first()["upto"]
        return -1 if done is None else done

    def commit(self, batch_id: int, *changes: DataFrame) -> None:
        """Commit one batch; the same id again replaces it."""
        if batch_id <= self._folded():
            raise ValueError(f"batch {batch_id} is folded already")
        every = changes[0]
        for more in changes[1:]:
            every = every.unionByName(more)
        sums = every.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.filter("n_docs <> 0 OR n_tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")

    def _deltas(self) -> DataFrame:
        base = self._folded()
        found = self.spark.createDataFrame([], _SCHEMA)
        if base >= 0:
            found = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/base-{base}")
        if self._exists(f"{self.path}/batches"):
            batches = self.spark.read.schema(f"{_SCHEMA}, batch_id bigint").parquet(f"{self.path}/batches")
            found = found.unionByName(batches.filter(F.col("batch_id") > base).drop("batch_id"))
        return found

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; groups without documents left are gone."""
        sums = self._deltas().groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")

    def fold(self, upto: int) -> None:
        """Make batches up to ``upto`` one base; nothing is lost if this stops half-way."""
        if upto <= self._folded():
            return
        base = self._folded()
        batches = self.spark.read.schema(f"{_SCHEMA}, batch_id bigint").parquet(f"{self.path}/batches").filter(F.col("batch_id").between(base + 1, upto))
        every = batches.drop("batch_id")
        if base >= 0:
            every = every.unionByName(self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/base-{base}"))
        sums = every.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/base-{upto}")
        # The one-row append is the commit: before it readers still use the old base and all batches.
        self.spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).coalesce(1).write.mode("append").parquet(f"{self.path}/folded")


_WORD = r"[^\x20\x09-\x0D]+"


def spaced(text: Column) -> Column:
    """Pieces between single spaces, empty ones too: a first, rough word count."""
    return F.coalesce(F.size(F.split(text, " ", -1)).cast("bigint"), F.lit(0))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("bigint"), F.lit(0))


def words_and_marks(text: Column) -> Column:
    return words(text) + F.coalesce(F.regexp_count(text, F.lit("[.,;:!?]")).cast("bigint"), F.lit(0))


def document_totals(docs: DataFrame) -> DataFrame:
    """Totals of ``docs`` after a history of four batches, the last of them replayed.

    Batch 0 adds all documents under ``words`` with a rough count, batch 1 revises
    it to the exact one, batch 2 adds all under ``words+marks``, batch 3 removes
    every document whose text a smaller doc_id has. Null sources and languages are
    groups of their own; a null or empty text has no tokens. Repeated rows with one
    doc_id stay. Other columns are not read; an empty table gives an empty result.
    """
    rollup = Rollup(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", text.alias("text"))
    rows = rows.select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("digest"),
                       F.when(F.col("text") == "", 0).otherwise(spaced(F.col("text"))).alias("rough"),
                       words(F.col("text")).alias("exact"), words_and_marks(F.col("text")).alias("marks"))

    def counted(df: DataFrame, version: str, now: str, old: str | None = None) -> DataFrame:
        more = [F.col(old).alias("old_n_tokens")] if old else []
        return df.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.col(now).alias("n_tokens"), *more)

    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    later = rows.join(first, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    rollup.commit(0, inserted(counted(rows, "words", "rough")))
    rollup.commit(1, revised(counted(rows, "words", "exact", "rough")))
    rollup.commit(2, inserted(counted(rows, "words+marks", "marks")))
    for _ in range(2):
        rollup.commit(3, deleted(counted(later, "words", "exact")), deleted(counted(later, "words+marks", "marks")))
    return rollup.totals()


SQL = r"""
WITH firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first_id FROM documents GROUP BY 1),
kept AS (
  SELECT source, lang, coalesce(text, '') AS text FROM documents d JOIN firsts f ON coalesce(d.text, '') = f.t
  WHERE d.doc_id IS NOT DISTINCT FROM f.first_id
), counted AS (
  SELECT source, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(text, '[.,;:!?]')) AS marks FROM kept
)
SELECT source, lang, 'words' AS tokenizer_version, count(*)::BIGINT AS n_docs, sum(words)::BIGINT AS n_tokens FROM counted GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words+marks', count(*)::BIGINT, sum(words + marks)::BIGINT FROM counted GROUP BY source, lang
"""
