"""Phase tables of one session, written once to the shared folder.

The analysis is a chain of phases with a table between them. Queries that start
from a phase table share it within a session instead of deriving it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions import rules
from netquarry.functions.network import malicious_profile
from netquarry.functions.storage import materialize
from netquarry.operators import cleaning, clustering, enrichment, fingerprints, per_ip, scoring
from netquarry.plans import fixture

_TASK_FLOWS = 250_000  # flows that one task compares
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = materialize(build(), name)
    return _TABLES[key]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        raw = fixture.raw_flows(spark, sf_dir)
        parts = max(spark.sparkContext.defaultParallelism, -(-raw.count() // _TASK_FLOWS))
        return cleaning.clean(raw, parts=parts)

    return staged(spark, sf_dir, "flows", build)


def fingerprint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "fingerprints", lambda: fingerprints.fingerprints(flows(spark, sf_dir)))


def by_attack_type(fp: DataFrame) -> DataFrame:
    """Normalised fingerprints with a rule-made campaign: the attack type's code."""
    return fingerprints.normalize(fp).withColumn("campaign_id", rules.attack_code(F.col("attack_type")))


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "campaigns", lambda: by_attack_type(fingerprint_table(spark, sf_dir)))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "hourly", lambda: scoring.hourly_counts(flows(spark, sf_dir)))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        camps = campaigns(spark, sf_dir)
        return enrichment.enrich(camps, clustering.characterize(camps), fixture.intel_table(spark, sf_dir))

    return staged(spark, sf_dir, "enriched", build)


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-address profile with normalised vectors and a rule-made campaign."""
    def build() -> DataFrame:
        rows = cleaning.per_ip_rows(flows(spark, sf_dir))
        # Written before its ranges are taken, or the flows are profiled once for those and once more for the rows.
        out = per_ip.normalized_profile(materialize(per_ip.profile_fingerprints(rows), "profile-rows"))
        hostile = malicious_profile("label")
        code = (
            F.when(hostile & (F.col("payload_asymmetry") > 10), 0).when(hostile, 1)
            .when(F.col("flow_count") == 1, 2).otherwise(3)
        )
        return out.withColumn("campaign_id", code)

    return staged(spark, sf_dir, "profile", build)
