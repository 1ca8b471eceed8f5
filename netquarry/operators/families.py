"""Malware family labels of campaigns from flow sub-labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions import rules


def majority_sublabel(flows: DataFrame, members: DataFrame) -> DataFrame:
    """Most frequent non-blank sub-label of a campaign's IoT-sourced flows.

    On a tie the label seen first in time wins. Flows are folded to (address,
    sub-label) before the join, so neither a busy address nor a large campaign
    reaches one task row by row.
    """
    text = F.trim(F.col("SubLabel"))
    folded = (
        flows.filter(F.col("DatasetSource").contains("IoT") & (text != ""))
        .groupBy("SrcAddr", text.alias("sublabel"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("StartTime").alias("first"))
    )
    counts = (
        folded.join(members, "SrcAddr")
        .groupBy("campaign_id", "sublabel")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )
    top = counts.groupBy("campaign_id").agg(
        F.min_by("sublabel", F.struct(-F.col("n"), F.col("first"), F.col("sublabel"))).alias("majority_sublabel")
    )
    return members.select("campaign_id").distinct().join(top, "campaign_id", "left").select(
        "campaign_id", F.coalesce("majority_sublabel", F.lit("")).alias("majority_sublabel")
    )


def map_families(df: DataFrame, column: str = "majority_sublabel") -> DataFrame:
    """Add iot_family and ttps for a sub-label column."""
    return df.withColumn("_f", rules.family(F.col(column))).select(*df.columns, "_f.*")


def family_entries(flows: DataFrame, members: DataFrame) -> DataFrame:
    """Family document per campaign, ready to be merged by cluster id."""
    mapped = map_families(majority_sublabel(flows, members))
    return mapped.select(
        F.col("campaign_id").alias("cluster_id"), "campaign_id", "majority_sublabel", "iot_family", "ttps",
        F.col("ttps").alias("iot_tactics"),
    )
