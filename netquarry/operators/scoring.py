"""Attribution score C = w1*B + w2*I + w3*T + w4*M per campaign."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import DEFAULT, EngineConfig
from netquarry.functions.network import (
    asn_key, malicious_profile, simple_label, subnet24, subnet24_lenient, window_start,
)
from netquarry.operators.ranking import most_common
from netquarry.schema import FEATURES


def _cohesion_from(parts: list[Column], rows: DataFrame, by: str) -> DataFrame:
    """Mean pairwise cosine per group from unit-vector sums: no pair is formed."""
    length = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    unit = [F.coalesce(F.try_divide(p, F.nullif(F.col("_len"), F.lit(0.0))), F.lit(0.0)) for p in parts]
    sums = rows.withColumn("_len", length).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_len") > 0).alias("_nonzero"),
        *[F.sum(u).alias(f"_u{i}") for i, u in enumerate(unit)],
    )
    total = sum((F.col(f"_u{i}") * F.col(f"_u{i}") for i in range(1, len(parts))), F.col("_u0") * F.col("_u0"))
    pairs = F.col("n").cast("double") * (F.col("n") - 1)
    b = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.try_divide(total - F.col("_nonzero"), pairs))
    return sums.select(by, b.alias("B"))


def cohesion(camps: DataFrame, columns: Sequence[str] = FEATURES, by: str = "campaign_id") -> DataFrame:
    """B(k) over feature columns; rows without length contribute 0."""
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns if c in camps.columns]
    return _cohesion_from(parts, camps, by)


def cohesion_of_vectors(points: DataFrame, features: str, dims: int, by: str) -> DataFrame:
    """B(k) over an array column."""
    return _cohesion_from([F.col(features)[i].cast("double") for i in range(dims)], points, by)


def memberships(camps: DataFrame) -> DataFrame:
    """Distinct (campaign, address) pairs; an address may be in several campaigns."""
    return camps.select("campaign_id", "SrcAddr").distinct()


def infrastructure_overlap(members: DataFrame, asn_by_ip: DataFrame) -> DataFrame:
    """I(k): share of addresses in the campaign's modal ASN or modal /24.

    Addresses are folded to (campaign, ASN, /24) counts before any mode is
    taken, so later steps work on networks instead of addresses.
    """
    # Both sides grow with the addresses. Their files are far smaller than their rows, by which
    # Spark would take millions of addresses for a small table and send them through the driver.
    keyed = members.join(asn_by_ip.hint("merge"), F.col("SrcAddr") == F.col("ip"), "left").select(
        "campaign_id", asn_key("asn").alias("asn"), subnet24("SrcAddr").alias("net")
    )
    counts = keyed.groupBy("campaign_id", "asn", "net").agg(F.count(F.lit(1)).alias("n"))
    top_asn = most_common(counts.filter("asn <> ''"), ["campaign_id"], "asn", F.col("n")).withColumnRenamed("asn", "top_asn")
    top_net = most_common(counts.filter("net <> ''"), ["campaign_id"], "net", F.col("n")).withColumnRenamed("net", "top_net")
    hit = F.coalesce(F.col("asn") == F.col("top_asn"), F.lit(False)) | F.coalesce(
        F.col("net") == F.col("top_net"), F.lit(False)
    )
    return (
        counts.join(top_asn, "campaign_id", "left")
        .join(top_net, "campaign_id", "left")
        .groupBy("campaign_id")
        .agg((F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("I"))
    )


def subnet_share(members: DataFrame) -> DataFrame:
    """I(k) of the per-address profile: share of the largest /24."""
    counts = members.groupBy("campaign_id", subnet24_lenient("SrcAddr").alias("net")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("campaign_id").agg((F.max("n") / F.sum("n")).alias("I"))


def hourly_counts(flows: DataFrame) -> DataFrame:
    """Flows per address and hour: the one pass over flows that timing needs."""
    return flows.groupBy("SrcAddr", window_start("StartTime", "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def timing_correlation(hourly: DataFrame, members: DataFrame, min_rows: int = 0) -> DataFrame:
    """T(k): |Pearson| of a campaign's hourly counts against all flows.

    Works on per-address hourly counts, so a busy address is one row per hour.
    Hours a campaign lacks count as 0 and need no grid: with the overall series
    centred, they only enter through the number of hours.
    """
    overall = hourly.groupBy("hour").agg(F.sum("n").cast("double").alias("a"))
    stats = overall.agg(
        F.struct(
            F.count(F.lit(1)).alias("hours"), F.avg("a").alias("mean"), F.var_pop("a").alias("var"),
            F.min("a").alias("lo"), F.max("a").alias("hi"), F.sum("a").alias("total"),
        ).alias("s")
    ).scalar()
    own = (
        hourly.join(members, "SrcAddr").groupBy("campaign_id", "hour").agg(F.sum("n").cast("double").alias("b"))
    )
    lined = own.join(overall, "hour").withColumn("_s", stats)
    sums = lined.groupBy("campaign_id").agg(
        F.first("_s").alias("s"),
        F.count(F.lit(1)).alias("present"),
        F.sum("b").alias("sb"),
        F.min("b").alias("lo"),
        F.max("b").alias("hi"),
        F.avg("b").alias("mb"),
        F.var_pop("b").alias("vb"),
        F.sum((F.col("a") - F.col("_s.mean")) * F.col("b")).alias("cov"),
    )
    hours, absent = F.col("s.hours"), F.col("s.hours") - F.col("present")
    # Spread of the series padded with zeros, merged from the observed part.
    spread = F.col("present") * F.col("vb") + F.pow("mb", F.lit(2)) * F.col("present") * absent / hours
    flat = (F.col("s.lo") == F.col("s.hi")) | ((absent == 0) & (F.col("lo") == F.col("hi")))
    r = F.abs(F.try_divide(F.col("cov"), F.sqrt(F.col("s.var") * hours * spread)))
    guard = flat | (hours < 3) | (F.col("sb") < min_rows) | (F.col("s.total") < min_rows)
    t = F.when(guard, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0)))
    scored = sums.select("campaign_id", t.alias("T"))
    return members.select("campaign_id").distinct().join(scored, "campaign_id", "left").select(
        "campaign_id", F.coalesce("T", F.lit(0.0)).alias("T")
    )


def threat_match(enriched: DataFrame) -> DataFrame:
    """M(k): share of enriched rows with an intelligence hit or abuse above 25."""
    hit = (F.coalesce("vt_malicious", F.lit(0)) > 0) | (F.coalesce("abuse_score", F.lit(0)) > 25)
    return enriched.groupBy("campaign_id").agg(F.avg(hit.cast("int")).alias("M"))


def label_match(members: DataFrame, labels: DataFrame) -> DataFrame:
    """M(k) of the per-address profile: share of addresses with a hostile label."""
    hit = malicious_profile("label").cast("int")
    return members.join(labels.select("SrcAddr", "label"), "SrcAddr", "left").groupBy("campaign_id").agg(
        F.avg(F.coalesce(hit, F.lit(0))).alias("M")
    )


def confidence(b: Column, i: Column, t: Column, m: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return b * cfg.w1 + i * cfg.w2 + t * cfg.w3 + m * cfg.w4


def confidence_pct(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 100, 2)


def latest_campaign(camps: DataFrame) -> DataFrame:
    """Campaign (and attack type) of each address in its latest window."""
    cols = [c for c in ("campaign_id", "attack_type") if c in camps.columns]
    return camps.groupBy("SrcAddr").agg(*[F.max_by(c, "time_window").alias(c) for c in cols])


def asn_by_address(enriched: DataFrame) -> DataFrame:
    """ASN per enriched address; with several campaigns the highest id wins."""
    return enriched.groupBy("ip").agg(F.max_by("asn", "campaign_id").alias("asn"))


def factors(camps: DataFrame, enriched: DataFrame, hourly: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """B, I, T, M and C per campaign, unrounded."""
    members = memberships(camps)
    parts = (
        cohesion(camps)
        .join(infrastructure_overlap(members, asn_by_address(enriched)), "campaign_id", "left")
        .join(timing_correlation(hourly, members), "campaign_id", "left")
        .join(threat_match(enriched), "campaign_id", "left")
    ).fillna(0.0, ["B", "I", "T", "M"])
    return parts.withColumn("C", confidence(F.col("B"), F.col("I"), F.col("T"), F.col("M"), cfg))


def cluster_documents(
    camps: DataFrame, enriched: DataFrame, hourly: DataFrame, drift_flags: DataFrame, summary: DataFrame,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """One nested score document per campaign."""
    attack = most_common(camps, ["campaign_id"], "attack_type")
    label = most_common(camps, ["campaign_id"], "label")
    ttps = (
        enriched.filter("technique_id <> 'N/A'").groupBy("campaign_id")
        .agg(F.slice(F.sort_array(F.collect_set("technique_id")), 1, 5).alias("top_ttps"))
    )
    out = (
        factors(camps, enriched, hourly, cfg)
        .join(attack, "campaign_id").join(label, "campaign_id")
        .join(ttps, "campaign_id", "left")
        .join(drift_flags, "campaign_id", "left")
        .join(summary.select("campaign_id", "cross_dataset"), "campaign_id", "left")
    )
    return out.select(
        F.col("campaign_id").alias("cluster_id"),
        confidence_pct(F.col("C")).alias("confidence_pct"),
        F.col("label").cast("string").alias("label"),
        "attack_type",
        F.struct(*[F.round(c, 4).alias(c) for c in "BITM"]).alias("contributing_factors"),
        F.coalesce("top_ttps", F.array().cast("array<string>")).alias("top_ttps"),
        F.coalesce("drift_detected", F.lit(False)).alias("drift_detected"),
        F.coalesce("cross_dataset", F.lit(False)).alias("cross_dataset"),
        F.lit(None).cast("string").alias("iot_family"),
    )


def upsert_documents(existing: DataFrame, incoming: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Merge documents by key: incoming fields win, absent ones are kept."""
    old, new = existing.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    names = list(dict.fromkeys([*existing.columns, *incoming.columns]))

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        if c not in existing.columns:
            return F.col(f"n.{c}").alias(c)
        if c not in incoming.columns:
            return F.col(f"o.{c}").alias(c)
        return F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*[pick(c) for c in names])


def profile_campaigns(
    assigned: DataFrame, hourly: DataFrame, dims: int, features: str = "norm_features", cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Campaign rows of the per-address profile.

    ``assigned`` has one row per address: SrcAddr, label, campaign_id and its
    normalised feature array.
    """
    members = assigned.select("campaign_id", "SrcAddr")
    rows = members.join(assigned.select("SrcAddr", "label"), "SrcAddr")
    net = most_common(rows.withColumn("dominant_subnet", subnet24_lenient("SrcAddr")), ["campaign_id"], "dominant_subnet")
    named = rows.withColumn("top_label", F.when(F.coalesce("label", F.lit("")) == "", "Unknown").otherwise(F.col("label")))
    out = (
        assigned.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("ip_count"))
        .join(cohesion_of_vectors(assigned, features, dims, "campaign_id"), "campaign_id")
        .join(subnet_share(members), "campaign_id")
        .join(timing_correlation(hourly, members, min_rows=3), "campaign_id")
        .join(label_match(members, assigned), "campaign_id")
        .join(net, "campaign_id")
        .join(most_common(named, ["campaign_id"], "top_label"), "campaign_id")
    )
    c = confidence(F.col("B"), F.col("I"), F.col("T"), F.col("M"), cfg)
    return out.select(
        "campaign_id", "ip_count", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("confidence"),
        *[F.round(f, 4).alias(f) for f in "BITM"], "dominant_subnet", "top_label",
    )


def labelled_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("simple_label", simple_label("Label"))
