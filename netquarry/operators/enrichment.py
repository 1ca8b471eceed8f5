"""Threat-intelligence joins on campaign addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import DEFAULT
from netquarry.functions import rules
from netquarry.operators.ranking import top_n_per_group

# Intelligence columns with their neutral and 'source missing' values.
COUNTS = ("vt_malicious", "vt_suspicious", "abuse_score")
TEXTS = ("asn", "country", "shodan_ports", "shodan_tags")


def prioritise_addresses(camps: DataFrame, n: int) -> DataFrame:
    """First n addresses per campaign: hostile label first, then busiest.

    An address ranks by its busiest window among those with its highest label
    (labels are two-valued), found with fixed-width aggregates only.
    """
    flat = camps.groupBy("campaign_id", "SrcAddr").agg(
        F.max("label").alias("label"),
        F.coalesce(F.max(F.when(F.col("label") > 0, F.col("conn_count"))), F.max("conn_count")).alias("conn_count"),
    )
    order = [F.desc("label"), F.desc("conn_count"), F.asc("SrcAddr")]
    return top_n_per_group(flat, ["campaign_id"], order, n)


def join_intel(addresses: DataFrame, intel: DataFrame, missing: str = "neutral", ip: str = "ip") -> DataFrame:
    """Left join on the address; unknown addresses read 0 / '' or the -1 sentinel."""
    count_default = F.lit(-1 if missing == "sentinel" else 0)
    have = intel.columns

    def pick(c: str, default: Column) -> Column:
        return F.coalesce(F.col(c), default).alias(c) if c in have else default.alias(c)

    keep = [c for c in addresses.columns]
    joined = addresses.join(intel, ip, "left")
    return joined.select(*keep, *[pick(c, count_default.cast("bigint")) for c in COUNTS], *[pick(c, F.lit("")) for c in TEXTS])


def with_threat_level(rows: DataFrame) -> DataFrame:
    level = rules.threat_level(F.col("vt_malicious"), F.col("vt_suspicious"), F.col("abuse_score"))
    return rows.withColumn("threat_level", level)


def with_technique(rows: DataFrame) -> DataFrame:
    """Technique columns of the row's campaign type, as a projection."""
    return rows.withColumn("_t", rules.technique(F.col("campaign_type"))).select(*rows.columns, "_t.*")


def enrich(
    camps: DataFrame, summary: DataFrame, intel: DataFrame,
    n: int | None = None, missing: str = "neutral",
) -> DataFrame:
    """One row per (campaign, address) with level and technique; with ``n`` only the first addresses of each."""
    chosen = camps.select("campaign_id", "SrcAddr").distinct() if n is None else prioritise_addresses(camps, n)
    chosen = chosen.select("campaign_id", F.col("SrcAddr").alias("ip"))
    typed = chosen.join(summary.select("campaign_id", "campaign_type"), "campaign_id").select(
        "campaign_id", "campaign_type", "ip"
    )
    return with_technique(with_threat_level(join_intel(typed, intel, missing)))


def indicator_matches(camps: DataFrame, indicators: DataFrame, first: int | None = None) -> DataFrame:
    """Indicator rows for source addresses, optionally the first n addresses."""
    ips = camps.select(F.col("SrcAddr").alias("ip")).distinct()
    if first is not None:
        ips = ips.orderBy("ip").limit(first)
    return ips.join(indicators, "ip").select("ip", "event", F.lit("").alias("threat_actor"), "tlp")


def matches_per_address(matches: DataFrame, first: int = 5) -> DataFrame:
    """First n 'event | TLP' lines per address, one line each."""
    line = F.concat(F.coalesce("event", F.lit("")), F.lit(" | TLP="), F.coalesce("tlp", F.lit("")))
    lines = top_n_per_group(matches.select("ip", line.alias("line")), ["ip"], [F.asc("line")], first)
    return lines.groupBy("ip").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("matches"))
