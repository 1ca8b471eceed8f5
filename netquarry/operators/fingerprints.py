"""Hourly behavioural fingerprints per source address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.config import DEFAULT
from netquarry.functions import rules
from netquarry.functions.network import window_start
from netquarry.functions.vectors import min_max
from netquarry.operators.grouped import (
    GATHERED, gap_columns, gap_statistics, gathered, gathered_sums, large_keys, range_of, value_columns, value_statistics,
)
from netquarry.schema import BASE_FEATURES, FEATURES

KEYS = ["SrcAddr", "time_window"]
VALUES = ["Proto", "DstAddr", "Dport"]


def _complete(flows: DataFrame) -> DataFrame:
    """Give optional columns their neutral value, so sparse sources work too."""
    defaults = {
        "Sport": F.lit(0), "Dport": F.lit(0), "Proto": F.lit(""), "Dur": F.lit(0.0), "SrcBytes": F.lit(0),
        "DstBytes": F.lit(0), "TotPkts": F.lit(0), "DatasetSource": F.lit("Mixed"),
    }
    out = flows.withColumns({c: v for c, v in defaults.items() if c not in flows.columns})
    extra: dict[str, Column] = {}
    if "TotBytes" not in flows.columns:
        extra["TotBytes"] = F.col("SrcBytes") + F.col("DstBytes")
    if "is_malicious" not in flows.columns:
        extra["is_malicious"] = F.col("Label").cast("int") if "Label" in flows.columns else F.lit(-1)
    return out.withColumns(extra) if extra else out


def _means(iot_ports: Sequence[int], has_dport: bool) -> dict[str, Column]:
    """What is averaged over a key's flows."""
    iot = F.col("Dport").isin(*iot_ports).cast("int") if has_dport else F.lit(0)
    return {
        "dur": F.col("Dur"), "total": F.col("TotBytes"), "pkts": F.col("TotPkts"), "src": F.col("SrcBytes"), "dst": F.col("DstBytes"),
        "night": (F.hour("StartTime") < 6).cast("int"), "iot": iot,
    }


def _sums(means: dict[str, Column]) -> list[Column]:
    return [
        *[c for name, value in means.items() for c in (F.sum(value).alias(f"_sum_{name}"), F.count(value).alias(f"_n_{name}"))],
        F.count_if(F.col("Sport") < 1024).alias("_low"),
        F.count_if(F.col("Sport") > 1024).alias("_high"),
    ]


def _features_of_sums() -> list[Column]:
    """Features of a key from the sums and counts over all its flows."""
    def mean(name: str) -> Column:
        return F.try_divide(F.col(f"_sum_{name}").cast("double"), F.nullif(F.col(f"_n_{name}"), F.lit(0)))

    low, high = F.col("_low"), F.col("_high")
    asymmetry = (
        F.when(mean("dst") > 1e-9, mean("src") / F.when(mean("dst") > 1e-9, mean("dst")))
        .when(mean("src") > 0, mean("src"))
        .otherwise(F.lit(1.0))
    )
    return [
        F.col("_n").alias("conn_count"),
        mean("dur").alias("avg_duration"),
        mean("total").alias("avg_bytes"),
        F.coalesce(F.try_divide(mean("total"), F.nullif(mean("pkts"), F.lit(0.0))), F.lit(0.0)).alias("bytes_per_packet"),
        mean("night").alias("night_ratio"),
        F.coalesce(F.try_divide(F.col("_sum_src"), F.when(F.col("_sum_total") > 0, F.col("_sum_total"))), F.lit(0.0)).alias("src_bytes_ratio"),
        F.coalesce(F.try_divide(low, F.nullif(low + high, F.lit(0))), F.lit(0.5)).alias("device_role_score"),
        mean("iot").alias("iot_port_affinity"),
        asymmetry.alias("payload_asymmetry"),
        F.when(F.col("_from") == F.col("_to"), F.col("_from")).otherwise(F.lit("Mixed")).alias("dataset_source"),
    ]


def _scalars(rows: DataFrame, means: dict[str, Column]) -> DataFrame:
    """Plain sums, means and counts per key, the most common label and the source.

    Flows fold first into one row per key, label and source, with fixed-width
    sums only, so the large aggregate is a hash aggregate. The few folded rows of
    a key then give its label (smallest on a tie) and its source, which is 'Mixed'
    where several occur.
    """
    folded = rows.groupBy(*KEYS, F.col("is_malicious").alias("_label"), F.col("DatasetSource").alias("_source")).agg(
        F.count(F.lit(1)).alias("_n"), *_sums(means)
    )
    # Sources of one label count together before the most common label is taken.
    per_label = folded.groupBy(*KEYS, "_label").agg(F.sum("_n").alias("_n")).groupBy(*KEYS).agg(
        F.min_by("_label", F.struct(-F.col("_n"), F.col("_label"))).alias("label")
    )
    added = ["_n", "_low", "_high", *[f"{p}_{name}" for name in means for p in ("_sum", "_n")]]
    totals = folded.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in added], F.min("_source").alias("_from"), F.max("_source").alias("_to"))
    return totals.select(*KEYS, *_features_of_sums()).join(per_label, list(KEYS))


def _spread_statistics(rows: DataFrame, means: dict[str, Column]) -> DataFrame:
    """Statistics of keys of any size: aggregates that combine before each exchange, and gaps over ranges of time."""
    values = value_statistics(rows, KEYS, VALUES)
    gaps = gap_statistics(rows, KEYS, spread=["DstAddr", "Sport", "Dport"])
    return _scalars(rows, means).join(values, KEYS).join(gaps, KEYS)


def _gathered_statistics(rows: DataFrame, means: dict[str, Column], parts: int) -> DataFrame:
    """The same statistics for keys whose flows fit a task: one exchange brings a key's flows together, windows over it do the rest."""
    used = rows.select(*KEYS, "StartTime", *VALUES, "Sport", "Dur", "TotBytes", "TotPkts", "SrcBytes", "DstBytes", "is_malicious", "DatasetSource")
    placed = gathered(used, KEYS, parts, [*VALUES, "is_malicious"])
    totals = placed.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_n"), *_sums(means),
        F.min("DatasetSource").alias("_from"), F.max("DatasetSource").alias("_to"),
        F.min_by("is_malicious", F.struct(-F.col("_is_malicious_rows"), F.col("is_malicious"))).alias("label"),
        *gathered_sums(VALUES),
    )
    stats = [c for v in VALUES for c in value_columns(v, F.col("_n"))]
    return totals.select(*KEYS, *_features_of_sums(), "label", *stats, *gap_columns())


def _statistics(rows: DataFrame, means: dict[str, Column]) -> DataFrame:
    """Keys of at most ``GATHERED`` flows by one exchange, the others spread over tasks."""
    large, parts = large_keys(rows, KEYS, GATHERED)
    if large is None:
        return _gathered_statistics(rows, means, parts)
    few = _gathered_statistics(rows.join(large, KEYS, "left_anti"), means, parts)
    return few.unionByName(_spread_statistics(rows.join(large, KEYS, "left_semi"), means))


def raw_fingerprints(
    flows: DataFrame, window: str = DEFAULT.fingerprint_window, iot_ports: Sequence[int] = DEFAULT.iot_ports,
) -> DataFrame:
    """Unrounded fingerprints."""
    rows = _complete(flows).withColumn("time_window", window_start("StartTime", window))
    out = _statistics(rows, _means(iot_ports, "Dport" in flows.columns))
    ports = F.col("Dport_distinct") if "Dport" in flows.columns else F.lit(0).cast("bigint")
    protos = F.col("Proto_distinct") if "Proto" in flows.columns else F.lit(0).cast("bigint")
    hosts = F.col("DstAddr_distinct")
    beacon = (
        F.when(F.col("conn_count") < 2, F.lit(1.0))
        .when(F.col("gap_mean") <= 1e-9, F.lit(0.0))
        .otherwise(F.try_divide(F.col("gap_std_pop"), F.col("gap_mean")))
    )
    return out.withColumns(
        {
            "unique_dst_ips": hosts,
            "unique_dst_ports": ports,
            "proto_entropy": F.col("Proto_nats"),
            "scan_entropy": F.col("DstAddr_bits"),
            "scan_score": hosts / F.col("conn_count"),
            "burst_score": F.when(F.col("conn_count") < 2, F.lit(0.0)).otherwise(F.col("gap_std_samp")),
            "c2_beacon_score": beacon,
            "protocol_diversity": protos,
            "horizontal_scan_flag": ((hosts > 50) & (ports < 3)).cast("int"),
            "vertical_scan_flag": ((ports > 20) & (hosts < 5)).cast("int"),
        }
    )


def with_attack_type(raw: DataFrame, vt_score: Column | None = None) -> DataFrame:
    """Classify unrounded fingerprints by the ordered attack rules."""
    return raw.withColumn(
        "attack_type",
        rules.attack_type(
            F.col("c2_beacon_score"), F.col("payload_asymmetry"), F.col("scan_entropy"),
            F.col("iot_port_affinity"), F.col("horizontal_scan_flag") == 1,
            F.col("vertical_scan_flag") == 1, vt_score,
        ),
    )


# Features reported as whole numbers; the rest are rounded to 4.
WHOLE = {
    "conn_count", "unique_dst_ips", "unique_dst_ports", "protocol_diversity",
    "horizontal_scan_flag", "vertical_scan_flag",
}


def fingerprints(
    flows: DataFrame,
    window: str = DEFAULT.fingerprint_window,
    iot_ports: Sequence[int] = DEFAULT.iot_ports,
) -> DataFrame:
    """One row per (SrcAddr, window): 19 features, label and attack type."""
    typed = with_attack_type(raw_fingerprints(flows, window, iot_ports))
    features = [F.col(c) if c in WHOLE else F.round(F.col(c), 4).alias(c) for c in FEATURES]
    return typed.select("SrcAddr", "time_window", "dataset_source", *features, "label", "attack_type")


def relabel_known_botnets(flows: DataFrame, intel: DataFrame, **kwargs) -> DataFrame:
    """Attack types re-evaluated with the intelligence count of each address."""
    raw = raw_fingerprints(flows, **kwargs)
    vt = intel.groupBy(F.col("ip").alias("SrcAddr")).agg(F.max("vt_malicious").alias("vt_score"))
    joined = raw.join(vt, "SrcAddr", "left")
    typed = with_attack_type(joined, F.coalesce(F.col("vt_score"), F.lit(0)))
    return typed.select(*KEYS, F.coalesce("vt_score", F.lit(0)).alias("vt_score"), "attack_type")


def normalize(fp: DataFrame, columns: Sequence[str] = BASE_FEATURES) -> DataFrame:
    """Min-max rescale the volume features over the whole table.

    The ranges arrive as one scalar subquery; a null burst stays null.
    """
    names = [c for c in columns if c in fp.columns]
    ranges = range_of(fp, names)
    scaled = {c: min_max(F.col(c).cast("double"), F.col("_r")[f"lo_{c}"], F.col("_r")[f"hi_{c}"]) for c in names}
    return fp.withColumn("_r", ranges).withColumns(scaled).drop("_r")


QUARTILES = (0.25, 0.5, 0.75)
# Rank error of the bracketing summary is 1 / _ACCURACY of all rows.
_ACCURACY = 10_000


def describe(fp: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Count, mean, deviation, extremes and exact interpolated quartiles per feature.

    Three wide passes over the rows. A mergeable summary brackets each quartile;
    the next pass counts the values below every bracket; the last keeps only values
    inside one (a few in ten thousand), which are ranked through 1024 value slices
    of the bracket, so no task orders more than a slice. Features without a value
    are left out.
    """
    slack = 3.0 / _ACCURACY
    probes = [p for q in QUARTILES for p in (q - slack, q + slack)]
    values = {c: F.col(c).cast("double") for c in columns}
    summary = fp.agg(*[
        F.struct(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
                 F.percentile_approx(v, probes, _ACCURACY).alias("e")).alias(f"f{k}")
        for k, v in enumerate(values.values())
    ]).first()
    # A few numbers per feature, whatever the number of rows.
    known = {c: summary[f"f{k}"] for k, c in enumerate(columns) if summary[f"f{k}"]["count"]}
    spark = fp.sparkSession
    schema = "feature string, q int, low double, high double, count bigint"
    brackets = spark.createDataFrame([(c, i, r["e"][2 * i], r["e"][2 * i + 1], r["count"]) for c, r in known.items() for i in range(len(QUARTILES))], schema)
    stats = spark.createDataFrame([(c, r["count"], r["mean"], r["std"], r["min"], r["max"]) for c, r in known.items()],
                                  "feature string, count bigint, mean double, std double, min double, max double")
    below = fp.agg(*[F.count_if(values[c] < r["e"][2 * i]).alias(f"{c}|{i}") for c, r in known.items() for i in range(len(QUARTILES))]) if known else fp.limit(0)
    below = below.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("q"), F.col(f"`{c}|{i}`").alias("below")) for c in known for i in range(len(QUARTILES))
    ])).alias("b")).select("b.*") if known else spark.createDataFrame([], "feature string, q int, below bigint")
    hits = [
        F.when(values[c].between(r["e"][2 * i], r["e"][2 * i + 1]), F.struct(F.lit(c).alias("feature"), F.lit(i).alias("q"), values[c].alias("v")))
        for c, r in known.items() for i in range(len(QUARTILES))
    ]
    near = fp.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.*") if hits else spark.createDataFrame([], "feature string, q int, v double")
    counts = near.groupBy("feature", "q", "v").agg(F.count(F.lit(1)).alias("n")).join(brackets, ["feature", "q"])
    width = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    counts = counts.withColumn("_slice", F.coalesce(F.floor((F.col("v") - F.col("low")) / width * 1023), F.lit(0)))
    slices = counts.groupBy("feature", "q", "_slice").agg(F.sum("n").alias("_rows"))
    ahead = Window.partitionBy("feature", "q").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("feature", "q", "_slice", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_base"))
    upto = F.sum("n").over(Window.partitionBy("feature", "q", "_slice").orderBy("v"))
    placed = counts.withColumn("_in", upto).join(slices, ["feature", "q", "_slice"]).join(below, ["feature", "q"])
    share = F.element_at(F.array(*[F.lit(p) for p in QUARTILES]), F.col("q") + 1)
    h = (F.col("count") - 1) * share
    last = F.col("below") + F.col("_base") + F.col("_in") - 1
    first = last - F.col("n") + 1

    def at_rank(r: Column) -> Column:
        return F.max(F.when((first <= r) & (r <= last), F.col("v")))

    cuts = placed.groupBy("feature", "q").agg(at_rank(F.floor(h)).alias("a"), at_rank(F.ceil(h)).alias("z"), F.max(h - F.floor(h)).alias("w"))
    # A rank outside its bracket would be an error of the summary; say so instead of giving a null.
    found = F.when(F.col("a").isNotNull() & F.col("z").isNotNull(), F.col("a") + (F.col("z") - F.col("a")) * F.col("w"))
    value = F.coalesce(found, F.raise_error(F.lit("quartile outside its bracket")).cast("double"))
    quartiles = cuts.groupBy("feature").agg(
        *[F.round(F.max(F.when(F.col("q") == i, value)), 4).alias(f"p{int(p * 100)}") for i, p in enumerate(QUARTILES)]
    )
    return stats.join(quartiles, "feature", "left").select(
        "feature", "count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "p25", "p50", "p75", "max"
    )
