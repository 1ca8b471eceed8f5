"""Approximate distinct counts from mergeable sketches, written once per hour and reused by wider windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.network import window_start

LG_BUCKETS = 12


def relative_error(lg_buckets: int = LG_BUCKETS) -> float:
    """Four standard errors of an estimate."""
    return 4 * 1.04 / 2 ** (lg_buckets / 2)


def hourly_sketches(flows: DataFrame, columns: Sequence[str] = ("DstAddr", "Dport"), lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """One sketch per column, source address and hour; null values do not count."""
    rows = flows.select("SrcAddr", window_start("StartTime", "1 hour").alias("time_window"), *columns)
    return rows.groupBy("SrcAddr", "time_window").agg(*[F.hll_sketch_agg(c, lg_buckets).alias(c) for c in columns])


def distinct_counts(sketches: DataFrame, width: str, columns: Sequence[str] = ("DstAddr", "Dport")) -> DataFrame:
    """Estimated distinct values per source address and window of ``width`` (whole hours), from sketches alone."""
    wide = sketches.select("SrcAddr", window_start("time_window", width).alias("time_window"), *columns)
    merged = wide.groupBy("SrcAddr", "time_window").agg(*[F.hll_union_agg(c).alias(c) for c in columns])
    return merged.select("SrcAddr", "time_window", *[F.hll_sketch_estimate(c).alias(f"{c}_distinct") for c in columns])
