"""Nearest match in time of many probes to many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.network import micros_between
from netquarry.functions.storage import materialize


def asof_join(
    probes: DataFrame, rows: DataFrame, time: str, keys: Sequence[str] = (), direction: str = "nearest", match: str = "match"
) -> DataFrame:
    """Each probe with the row of its keys at or before, at or after, or closest to its time.

    ``direction`` is ``backward``, ``forward`` or ``nearest`` (the earlier row on a
    tie). The row comes as struct ``match``, null where there is none, also for
    probes without a time; rows without a time match nothing; null keys are equal.
    Of rows that share keys and time the one of the greatest hash is taken.

    Probes and rows are united and range partitioned by keys and time, probes of
    one time also by their hash, so a busy key or moment is spread. The written
    parts fix the ranges; the last and first row of every part are carried over
    the parts around it, a table of one row per key and part.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    probe_kind, row_kind = probes.schema, rows.schema
    as_probe, as_row = F.struct(*probes.columns), F.struct(*rows.columns)
    every = probes.select(
        *keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.xxhash64(*_plain(probes)).alias("_h"),
        as_probe.alias("_probe"), F.lit(None).cast(row_kind).alias("_row"),
    ).unionByName(
        rows.filter(F.col(time).isNotNull()).select(
            *keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.xxhash64(*_plain(rows)).alias("_h"),
            F.lit(None).cast(probe_kind).alias("_probe"), as_row.alias("_row"),
        )
    )
    # Rows come before the probes of their time, and only probes are told apart by hash.
    spread = F.when(F.col("_side") == 1, F.col("_h"))
    ranged = every.withColumn("_spread", spread).repartitionByRange(*keys, "_t", "_side", "_spread").drop("_spread")
    parts = materialize(ranged.withColumn("_part", F.spark_partition_id()), "asof")

    known = F.col("_side") == 0
    ends = parts.groupBy(*keys, "_part").agg(
        F.max_by("_row", F.when(known, F.struct("_t", "_h"))).alias("_last"),
        F.min_by("_row", F.when(known, F.struct("_t", F.bitwise_not("_h")))).alias("_first"),
    )
    by_part = Window.partitionBy(*keys).orderBy("_part")
    ends = ends.select(
        *keys, "_part",
        F.last("_last", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("_from_left"),
        F.first("_first", ignorenulls=True).over(by_part.rowsBetween(1, Window.unboundedFollowing)).alias("_from_right"),
    )
    inside = Window.partitionBy(*keys, "_part")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    upward = inside.orderBy("_t", "_side", "_h").rowsBetween(*so_far)
    downward = inside.orderBy(F.desc("_t"), "_side", "_h").rowsBetween(*so_far)
    seen = parts.withColumns(
        {"_before": F.last("_row", ignorenulls=True).over(upward), "_after": F.last("_row", ignorenulls=True).over(downward)}
    ).filter("_side = 1")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*keys, "_part"]]
    on = same[0]
    for more in same[1:]:
        on = on & more
    found = seen.alias("s").join(ends.alias("e"), on, "left").select(
        "s._probe", F.coalesce("s._before", "e._from_left").alias("_b"), F.coalesce("s._after", "e._from_right").alias("_a")
    )
    return found.select("_probe.*", _chosen(direction, time).alias(match))


def _plain(df: DataFrame) -> list[Column]:
    """Columns a hash can take; maps cannot be hashed and go as text."""
    return [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema]


def _chosen(direction: str, time: str) -> Column:
    t, before, after = F.col(f"_probe.{time}"), F.col("_b"), F.col("_a")
    if direction == "backward":
        pick = before
    elif direction == "forward":  # a row of the same time may end the part before
        pick = F.when(before[time] == t, before).otherwise(after)
    else:
        closer = micros_between(before[time], t) <= micros_between(t, after[time])
        pick = F.when(after.isNull() | closer, before).otherwise(after)
    return F.when(t.isNotNull(), pick)
