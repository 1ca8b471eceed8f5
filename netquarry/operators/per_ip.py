"""Per-address behaviour profile over the whole capture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.network import simple_label, window_start
from netquarry.functions.vectors import min_max
from netquarry.operators.grouped import GATHERED, gap_columns, gap_statistics, gathered, gathered_sums, large_keys, range_of, value_columns, value_statistics
from netquarry.schema import PER_IP_FEATURES

KEY = ["SrcAddr"]
VALUES = ["Proto", "DstAddr", "Sport", "State", "Dport"]


def busiest_share(rows: DataFrame) -> DataFrame:
    """Share of flows in an address's busiest tenth of active hours, at least one."""
    hours = rows.groupBy("SrcAddr", window_start("StartTime", "1 hour").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    per_ip = Window.partitionBy("SrcAddr")
    ranked = hours.withColumn("_rn", F.row_number().over(per_ip.orderBy(F.desc("_n"), F.asc("_h")))).withColumn(
        "_hours", F.count(F.lit(1)).over(per_ip)
    )
    top = F.col("_rn") <= F.greatest(F.lit(1), F.ceil(F.col("_hours") * 0.1))
    return ranked.groupBy("SrcAddr").agg((F.sum(F.when(top, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("burst_score"))


def top_labels(rows: DataFrame) -> DataFrame:
    """Most common simplified label; on a tie the one seen first.

    Raw labels are counted before they are simplified, so the pattern match
    runs once per address and label.
    """
    raw = rows.groupBy("SrcAddr", "Label").agg(F.count(F.lit(1)).alias("_n"), F.min("StartTime").alias("_first"))
    counts = raw.groupBy("SrcAddr", simple_label("Label").alias("label")).agg(
        F.sum("_n").alias("_n"), F.min("_first").alias("_first")
    )
    return counts.groupBy("SrcAddr").agg(
        F.min_by("label", F.struct(-F.col("_n"), F.col("_first"), F.col("label"))).alias("label")
    )


def _scalars() -> list[Column]:
    hour = F.hour("StartTime")
    return [
        F.count(F.lit(1)).alias("flow_count"),
        (F.avg("SrcBytes") / (F.avg("DstBytes") + 1)).alias("payload_asymmetry"),
        F.avg(((hour >= 22) | (hour < 6)).cast("int")).alias("night_ratio"),
        F.sum("TotPkts").alias("_pkts"),
        F.avg("Dur").alias("avg_duration"),
        F.avg("TotBytes").alias("avg_bytes"),
        F.avg("TotPkts").alias("avg_pkts"),
        F.avg((F.col("Proto") == "tcp").cast("int")).alias("tcp_ratio"),
        F.avg((F.col("Proto") == "udp").cast("int")).alias("udp_ratio"),
        F.avg(F.col("TotBytes") / F.col("TotPkts")).alias("bytes_per_pkt"),
    ]


def _spread_statistics(rows: DataFrame) -> DataFrame:
    """Statistics of addresses of any size: aggregates that combine before each exchange, and gaps over ranges of time."""
    values = value_statistics(rows, KEY, VALUES)
    return rows.groupBy(*KEY).agg(*_scalars()).join(values, KEY).join(gap_statistics(rows, KEY, spread=["DstAddr", "Dport"]), KEY)


def _gathered_statistics(rows: DataFrame, parts: int) -> DataFrame:
    """The same for addresses whose flows fit a task: one exchange brings them together, windows over it do the rest."""
    used = rows.select(*KEY, "StartTime", *VALUES, "Dur", "TotPkts", "TotBytes", "SrcBytes", "DstBytes")
    totals = gathered(used, KEY, parts, VALUES).groupBy(*KEY).agg(*_scalars(), *gathered_sums(VALUES))
    names = ["flow_count", "payload_asymmetry", "night_ratio", "_pkts", "avg_duration", "avg_bytes", "avg_pkts", "tcp_ratio", "udp_ratio", "bytes_per_pkt"]
    return totals.select(*KEY, *names, *[c for v in VALUES for c in value_columns(v, F.col("flow_count"))], *gap_columns())


def _statistics(rows: DataFrame) -> DataFrame:
    """Addresses of at most ``GATHERED`` flows by one exchange, the others spread over tasks.

    Counting all values of all addresses in one hash aggregate instead fills a
    task's memory, as most destinations and ports of an address differ.
    """
    large, parts = large_keys(rows, KEY, GATHERED)
    if large is None:
        return _gathered_statistics(rows, parts)
    few = _gathered_statistics(rows.join(large, KEY, "left_anti"), parts)
    return few.unionByName(_spread_statistics(rows.join(large, KEY, "left_semi")))


def profile_fingerprints(rows: DataFrame) -> DataFrame:
    """19 features and the label of every source address.

    ``rows`` comes from ``cleaning.per_ip_rows``. Parts that combine well are
    aggregates on the address, joined to the statistics of its flows.
    """
    joined = _statistics(rows).join(busiest_share(rows), KEY).join(top_labels(rows), KEY)
    cov = F.coalesce(F.try_divide(F.col("gap_std_pop"), F.nullif(F.col("gap_mean"), F.lit(0.0))), F.lit(0.0))
    pkts = F.when(F.col("_pkts") == 0, F.lit(1.0)).otherwise(F.col("_pkts"))
    out = joined.withColumns(
        {
            "proto_entropy": F.col("Proto_bits"),
            "scan_entropy": F.col("DstAddr_bits"),
            "avg_sport_entropy": F.col("Sport_bits"),
            "state_entropy": F.col("State_bits"),
            "unique_dst_ports": F.col("Dport_distinct"),
            "unique_dst_ips": F.col("DstAddr_distinct"),
            "c2_beacon_score": F.when(F.col("flow_count") < 2, F.lit(0.0)).otherwise(1 / (1 + cov)),
            "scan_score": F.least(F.lit(1.0), F.col("DstAddr_distinct") / pkts),
            "pkts_per_flow": F.col("avg_pkts"),
        }
    )
    return out.select("SrcAddr", "label", *PER_IP_FEATURES)


def normalized_profile(profile: DataFrame, columns: Sequence[str] = PER_IP_FEATURES) -> DataFrame:
    """Add ``norm_features``: every feature rescaled to [0, 1], constants to 0."""
    ranges = range_of(profile, columns)
    scaled = [min_max(F.col(c).cast("double"), F.col("_r")[f"lo_{c}"], F.col("_r")[f"hi_{c}"]) for c in columns]
    return profile.withColumn("_r", ranges).withColumn("norm_features", F.array(*scaled)).drop("_r")
