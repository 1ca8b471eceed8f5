"""Report and summary queries over the analysis tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import DEFAULT, EngineConfig
from netquarry.functions.network import (
    beacon_strength, confidence_band, malicious_profile, severity_tier, subnet24_lenient,
)
from netquarry.operators.enrichment import matches_per_address
from netquarry.operators.grams import GramIndex
from netquarry.operators.sampling import sample_per_group
from netquarry.schema import PER_IP_FEATURES


def kpis(camps: DataFrame, docs: DataFrame) -> DataFrame:
    """Headline numbers: one row."""
    d = docs.agg(
        F.struct(
            F.coalesce(F.round(F.avg("confidence_pct"), 4), F.lit(0.0)).alias("avg"),
            F.count_if("drift_detected").alias("drifting"),
            F.count_if(F.col("confidence_pct") >= 75).alias("high"),
        )
    ).scalar()
    return camps.agg(
        F.countDistinct("campaign_id").alias("campaigns"), F.count_if(F.col("label") > 0).alias("malicious_rows")
    ).withColumn("_d", d).select(
        "campaigns", "malicious_rows", F.col("_d.avg").alias("mean_confidence"), F.col("_d.drifting").alias("drifting"),
        F.col("_d.high").alias("high_confidence"),
    )


def campaign_table(camps: DataFrame, docs: DataFrame) -> DataFrame:
    n = camps.groupBy(F.col("campaign_id").alias("cluster_id")).agg(F.countDistinct("SrcAddr").alias("n_ips"))
    return docs.join(n, "cluster_id", "left").select(
        F.col("cluster_id").alias("campaign_id"), "label", "attack_type", F.coalesce("n_ips", F.lit(0)).alias("n_ips"),
        "confidence_pct", F.array_join("top_ttps", ", ").alias("top_ttp"), F.col("drift_detected").alias("drift"),
        "cross_dataset",
    )


def low_confidence(table: DataFrame, below: float = 60) -> DataFrame:
    return table.filter(F.col("confidence_pct") < below).withColumn("low_confidence", F.lit(True))


def factor_matrix(docs: DataFrame) -> DataFrame:
    return docs.select("cluster_id", "contributing_factors.*")


# Factor key -> description and weight name.
FACTOR_NAMES = {
    "B": ("Behavioral cohesion", "w1"),
    "I": ("Infrastructure overlap", "w2"),
    "T": ("Timing correlation", "w3"),
    "M": ("Threat-intel match", "w4"),
}


def contribution_lines(docs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row per campaign and factor: value, weight, contribution."""
    entries = [
        F.struct(
            F.lit(k).alias("factor"), F.lit(name).alias("description"),
            F.col(f"contributing_factors.{k}").alias("value"), F.lit(cfg.weights[w]).alias("weight"),
        )
        for k, (name, w) in FACTOR_NAMES.items()
    ]
    return docs.select("cluster_id", F.inline(F.array(*entries))).withColumn(
        "contribution", F.round(F.col("value") * F.col("weight"), 4)
    )


def profiler_points(camps: DataFrame, cap: int = DEFAULT.scatter_cap, seed: int = DEFAULT.seed) -> DataFrame:
    """Scatter points: all hostile rows, at most ``cap`` benign ones per campaign."""
    usable = camps.dropna(subset=["scan_entropy", "c2_beacon_score"]).select(
        "campaign_id", "SrcAddr", "time_window", "scan_entropy", "c2_beacon_score",
        (F.coalesce("label", F.lit(0)) > 0).alias("malicious"),
    )
    benign = sample_per_group(usable.filter(~F.col("malicious")), ["campaign_id"], ["SrcAddr", "time_window"], cap, seed)
    return benign.unionByName(usable.filter("malicious"))


# Enrichment columns a report may carry.
REPORT_INTEL = ["ip", "threat_level", "vt_malicious", "abuse_score", "asn", "country", "technique_id", "technique_name"]


def report_campaigns(
    camps: DataFrame, docs: DataFrame, enriched: DataFrame | None = None, drift: DataFrame | None = None,
    campaigns: Sequence[int] = (), min_confidence: float = 0.0, include: Sequence[str] = (),
) -> DataFrame:
    """Selected campaigns with optional nested indicators and drift windows.

    Nested lists are bounded: enrichment holds a fixed budget of rows per
    campaign, drift one row per window.
    """
    picked = docs.filter(F.col("confidence_pct") >= min_confidence)
    if campaigns:
        picked = picked.filter(F.col("cluster_id").isin(list(campaigns)))
    n = camps.groupBy(F.col("campaign_id").alias("cluster_id")).agg(F.countDistinct("SrcAddr").alias("ip_count"))
    out = picked.join(n, "cluster_id", "left").select(
        F.col("cluster_id").alias("campaign_id"), "attack_type", "confidence_pct",
        confidence_band("confidence_pct", mid="medium").alias("confidence_band"), "contributing_factors", "top_ttps",
        "drift_detected", "cross_dataset", "iot_family", F.coalesce("ip_count", F.lit(0)).alias("ip_count"),
    )
    if "ips" in include and enriched is not None:
        cols = [c for c in REPORT_INTEL if c in enriched.columns]
        lists = enriched.groupBy("campaign_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("enriched_ips"))
        out = out.join(lists, "campaign_id", "left")
    if "drift" in include and drift is not None:
        entry = F.struct("window_start", "window_next", "drift")
        lists = drift.groupBy("campaign_id").agg(F.sort_array(F.collect_list(entry)).alias("drift_windows"))
        out = out.join(lists, "campaign_id", "left")
    return out


def report_dataset(flows: DataFrame, camps: DataFrame, docs: DataFrame, enriched: DataFrame, selected: DataFrame) -> DataFrame:
    """Dataset counts that head a report: one row."""
    count = F.count(F.lit(1))
    return flows.agg(count.alias("total_flows"), F.countDistinct("SrcAddr").alias("unique_source_ips")).withColumns(
        {
            "fingerprints": camps.agg(count).scalar(),
            "campaigns_total": docs.agg(count).scalar(),
            "campaigns_selected": selected.agg(count).scalar(),
            "enriched_ips": enriched.agg(F.countDistinct("ip")).scalar(),
        }
    )


def run_summary(
    flows: DataFrame, camps: DataFrame, enriched: DataFrame, entries: DataFrame, nodes: DataFrame, edges: DataFrame
) -> DataFrame:
    """Counts per phase as (metric, value) rows."""
    skip = {"SrcAddr", "dataset_source", "time_window", "campaign_id", "label", "attack_type"}
    features = len([c for c in camps.columns if c not in skip])
    n = F.count(F.lit(1)).cast("bigint")

    def metric(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("metric"), "value")

    parts = [
        metric(flows, "flows", n),
        metric(camps, "fingerprints", n),
        metric(camps, "source_ips", F.countDistinct("SrcAddr")),
        metric(camps, "feature_columns", F.max(F.lit(features))),
        metric(camps, "clusters", F.countDistinct("campaign_id")),
        metric(enriched, "enriched_ips", F.countDistinct("ip")),
        metric(entries.filter("iot_family <> ''"), "iot_families", F.countDistinct("iot_family")),
        metric(nodes, "nodes", n),
        metric(edges, "edges", n),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def node_details(enriched: DataFrame, matches: DataFrame, camps: DataFrame, node: str | None = None) -> DataFrame:
    """Inspector rows: enrichment, indicator lines and the beacon strength of the address's campaign."""
    beacons = camps.groupBy("campaign_id").agg(F.avg(F.coalesce(F.col("c2_beacon_score").cast("double"), F.lit(0.0))).alias("_score"))
    rows = (enriched if node is None else enriched.filter(F.col("ip") == node)).join(beacons, "campaign_id", "left")
    lines = matches_per_address(matches if node is None else matches.filter(F.col("ip") == node))
    return rows.join(lines, "ip", "left").select(
        "ip", "campaign_id", "campaign_type", "threat_level", "vt_malicious", "abuse_score", "asn", "country",
        F.col("matches"), beacon_strength("_score").alias("beacon"),
    )


def malicious_addresses(assigned: DataFrame, limit: int = 200) -> DataFrame:
    """Hostile-labelled addresses, busiest first."""
    return assigned.filter(malicious_profile("label")).select(
        F.col("SrcAddr").alias("ip"), "label", subnet24_lenient("SrcAddr").alias("subnet"), "campaign_id", "flow_count",
        "payload_asymmetry",
    ).orderBy(F.desc("flow_count"), F.asc("ip")).limit(limit)


def top_subnets(assigned: DataFrame, limit: int = 10) -> DataFrame:
    return assigned.filter(malicious_profile("label")).groupBy(subnet24_lenient("SrcAddr").alias("subnet")).agg(
        F.count(F.lit(1)).alias("count")
    ).orderBy(F.desc("count"), F.asc("subnet")).limit(limit)


def top_label_counts(assigned: DataFrame, limit: int = 12, cut: int = 24) -> DataFrame:
    name = F.when(F.coalesce("label", F.lit("")) == "", F.lit("Unknown")).otherwise(F.col("label"))
    counts = assigned.groupBy(name.alias("full")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), F.asc("full")).limit(limit)
    short = F.when(F.length("full") > cut, F.concat(F.left("full", F.lit(cut)), F.lit("…"))).otherwise(F.col("full"))
    return top.select(short.alias("label"), "count")


def search_campaigns(
    campaigns: DataFrame, query: str = "", sort: str = "confidence", ascending: bool = False
) -> DataFrame:
    """Campaigns whose id, subnet or label holds the text, sorted by any column."""
    out = campaigns
    if query:
        q = query.lower()
        out = out.filter(
            F.col("campaign_id").cast("string").contains(q)
            | F.col("dominant_subnet").contains(q)
            | F.lower("top_label").contains(q)
        )
    key = F.lower(F.col(sort)) if dict(out.dtypes)[sort] == "string" else F.col(sort)
    return out.orderBy(key.asc() if ascending else key.desc(), F.asc("campaign_id"))


def search_addresses(assigned: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """First addresses holding the text; shorter than two characters finds none."""
    hit = F.col("SrcAddr").contains(query) if len(query) >= 2 else F.lit(False)
    return assigned.filter(hit).select("SrcAddr").orderBy("SrcAddr").limit(limit)


def search_indexed(index: GramIndex, query: str, limit: int = 12) -> DataFrame:
    """As ``search_addresses``, from an index of the addresses."""
    return index.search(query).select(F.col("text").alias("SrcAddr")).orderBy("SrcAddr").limit(limit)


def overview(campaigns: DataFrame) -> DataFrame:
    return campaigns.agg(
        F.coalesce(F.sum("ip_count"), F.lit(0)).alias("total_ips"), F.count(F.lit(1)).alias("campaigns"),
        F.count_if(F.col("confidence") >= 0.8).alias("high_confidence"),
    )


def campaign_tiers(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(
        F.concat(F.lit("C"), F.col("campaign_id").cast("string")).alias("name"),
        F.round(F.col("confidence") * 100, 1).alias("confidence"), severity_tier("confidence").alias("tier"),
    )


def address_features(assigned: DataFrame, ip: str) -> DataFrame:
    """One address's features, raw beside normalised."""
    entries = [
        F.struct(
            F.lit(c).alias("feature"), F.col(c).cast("double").alias("raw"), F.col("norm_features")[i].alias("normalised")
        )
        for i, c in enumerate(PER_IP_FEATURES)
    ]
    return assigned.filter(F.col("SrcAddr") == ip).select(F.inline(F.array(*entries)))


def campaign_members(assigned: DataFrame, campaign_id: int, limit: int = 100) -> DataFrame:
    return assigned.filter(F.col("campaign_id") == campaign_id).select("SrcAddr").orderBy("SrcAddr").limit(limit)
