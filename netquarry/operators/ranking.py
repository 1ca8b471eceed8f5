"""Top-n per group and global ranks that never put one group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this n Spark itself trims each group before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
_TRIMMED_BY_SPARK = 1000


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of every group by a total order.

    Small n: a plain row_number filter, which Spark trims map-side. Larger n:
    the same cut is taken first inside hash slices of each group, so a group
    holding most rows is spread over all shuffle partitions; the survivors
    (at most slices x n per group) then get the exact cut.
    """
    out = df
    if n > _TRIMMED_BY_SPARK:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices)))
        w = Window.partitionBy(*keys, "_slice").orderBy(*order)
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn", "_slice")
    w = Window.partitionBy(*keys).orderBy(*order)
    return out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def ranked_by_bucket(
    df: DataFrame, bucket: Column, order: Sequence[Column], name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Add a dense rank (from 0) for an order that refines ``bucket``.

    Rows are counted per bucket, only the bucket table gets a running total,
    and the rank inside a bucket is added to its offset. The one-task step sees
    buckets, never rows. With ``within`` the rank restarts per group.
    """
    rows = df.withColumn("_bucket", bucket)
    keys = [*within, "_bucket"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop("_bucket", "_rn", "_offset")
    )


def most_common(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Modal value per group, smallest value on a tie, in two combinable steps."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*keys, value).agg(n.alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))
