"""Substring search over an index of letter grams instead of a scan of all texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.storage import fresh_path

_SIZES = (2, 3)


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    pieces = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


class GramIndex:
    """Postings (gram, text) of the distinct texts of a column, in folders by the gram's hash.

    A search reads the folders of its own grams only, keeps the texts that have all
    of them, and verifies those against the whole search text. A gram that many texts
    share is many rows of its folder, spread over files and tasks.
    """

    def __init__(self, spark: SparkSession, path: str, folders: int) -> None:
        self.spark, self.path, self.folders = spark, path, folders

    @classmethod
    def build(cls, rows: DataFrame, column: str, path: str | None = None, folders: int = 128) -> GramIndex:
        """Index the distinct values of a text column; null and one-character texts are not found by any search."""
        index = cls(rows.sparkSession, path or fresh_path(rows.sparkSession, "grams"), folders)
        texts = rows.select(F.col(column).cast("string").alias("text")).filter("length(text) >= 2").distinct()
        postings = texts.select("text", F.explode(F.concat(*[_grams(F.col("text"), n) for n in _SIZES])).alias("gram"))
        placed = postings.withColumn("folder", index._folder(F.col("gram")))
        placed.hint("rebalance", "folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(index.path)
        return index

    def _folder(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.folders)).cast("int")

    def search(self, text: str) -> DataFrame:
        """Indexed texts that hold ``text`` (as written); none for fewer than two characters."""
        postings = self.spark.read.schema("text string, gram string, folder int").parquet(self.path)
        if len(text) < min(_SIZES):
            return postings.limit(0).select("text")
        size = min(max(_SIZES), len(text))
        wanted = sorted({text[i : i + size] for i in range(len(text) - size + 1)})
        lookup = self.spark.createDataFrame([(g,) for g in wanted], "gram string")
        folders = [r[0] for r in lookup.select(self._folder(F.col("gram"))).distinct().collect()]
        hits = postings.filter(F.col("folder").isin(*folders) & F.col("gram").isin(*wanted))
        if len(wanted) > 1:
            hits = hits.groupBy("text").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") == len(wanted))
        return hits.filter(F.col("text").contains(text)).select("text")
