"""Uniform seeded samples of a fixed size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.config import DEFAULT
from netquarry.operators.ranking import top_n_per_group


def sample_key(key: Sequence[str], seed: int) -> Column:
    """Uniform text key of a row: the same rows are drawn on every run."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))


def reservoir(df: DataFrame, key: Sequence[str], limit: int = DEFAULT.sample_rows, seed: int = DEFAULT.seed) -> DataFrame:
    """Uniform sample of at most ``limit`` rows: those with the lowest keys.

    Key prefixes are counted first. The prefix at which the running count
    passes the limit bounds the candidates, so the final ordered cut reads
    about ``limit`` rows however large the input is.
    """
    keyed = df.withColumn("_key", sample_key(key, seed))
    prefix = F.substring("_key", 1, 5)
    sizes = keyed.groupBy(prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cut = sizes.select("_p", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before")).filter(
        F.col("_before") < limit
    ).agg(F.max("_p"))
    near = keyed.withColumn("_cut", cut.scalar()).filter(prefix <= F.col("_cut"))
    return near.orderBy("_key", *key).limit(limit).select(*df.columns)


def sample_per_group(
    df: DataFrame, keys: Sequence[str], row_key: Sequence[str], n: int, seed: int = DEFAULT.seed
) -> DataFrame:
    """Uniform seeded sample of at most n rows per group."""
    keyed = df.withColumn("_key", sample_key(row_key, seed))
    return top_n_per_group(keyed, list(keys), [F.asc("_key"), *[F.asc(c) for c in row_key]], n).drop("_key")
