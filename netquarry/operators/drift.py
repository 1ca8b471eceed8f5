"""Temporal drift of campaign centroids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.config import DEFAULT
from netquarry.functions.network import window_start
from netquarry.functions.vectors import cosine, norm
from netquarry.schema import FEATURES


def _series(centroids: DataFrame, threshold: float) -> DataFrame:
    """1 - cosine between each centroid and the campaign's next non-zero one."""
    usable = centroids.filter(norm("centroid") > 0)
    w = Window.partitionBy("campaign_id").orderBy("window_start")
    paired = usable.select(
        "campaign_id", "window_start", "centroid",
        F.lead("window_start").over(w).alias("window_next"), F.lead("centroid").over(w).alias("next"),
    ).filter(F.col("window_next").isNotNull())
    return paired.select(
        "campaign_id", "window_start", "window_next", (1 - cosine("centroid", "next")).alias("_d")
    ).select("campaign_id", "window_start", "window_next", F.round("_d", 4).alias("drift"), (F.col("_d") > threshold).alias("flagged"))


def drift_series(
    camps: DataFrame, columns: Sequence[str] = FEATURES,
    window: str = DEFAULT.drift_window, threshold: float = DEFAULT.drift_threshold,
) -> DataFrame:
    """Drift between adjacent windows of each campaign.

    One combining aggregate builds the centroids; the ordered step sees one row
    per campaign and window.
    """
    names = [c for c in columns if c in camps.columns]
    means = [F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in names]
    cents = (
        camps.filter(F.col("time_window").isNotNull())
        .groupBy("campaign_id", window_start("time_window", window).alias("window_start"))
        .agg(F.array(*means).alias("centroid"))
    )
    return _series(cents, threshold)


def drift_flags(series: DataFrame) -> DataFrame:
    return series.groupBy("campaign_id").agg(F.max("flagged").alias("drift_detected"))


def profile_drift(
    assigned: DataFrame, hourly: DataFrame, dims: int, features: str = "norm_features",
    window: str = DEFAULT.drift_window, threshold: float = DEFAULT.drift_threshold,
) -> DataFrame:
    """Drift of the per-address profile: mean vector of the addresses active in a window."""
    active = hourly.select("SrcAddr", window_start("hour", window).alias("window_start")).distinct()
    rows = active.join(assigned.select("SrcAddr", "campaign_id", features), "SrcAddr")
    cents = rows.groupBy("campaign_id", "window_start").agg(
        F.array(*[F.avg(F.col(features)[i]) for i in range(dims)]).alias("centroid")
    )
    return _series(cents, threshold)


def drift_matrix(series: DataFrame, campaigns: Sequence[int]) -> DataFrame:
    """Windows by the named campaigns; the series itself is the long form for any number of them."""
    wide = series.groupBy(F.col("window_start").alias("t")).pivot("campaign_id", list(campaigns)).agg(F.first("drift"))
    return wide.select("t", *[F.col(f"`{c}`").alias(f"c{c}") for c in wide.columns if c != "t"])


def drift_documents(series: DataFrame) -> DataFrame:
    """One row per campaign with its ordered window list (bounded by windows)."""
    entry = F.struct("window_start", "window_next", "drift")
    return series.groupBy("campaign_id").agg(F.sort_array(F.collect_list(entry)).alias("windows"))
