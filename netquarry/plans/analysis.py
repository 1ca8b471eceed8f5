"""The two end-to-end analyses: hourly campaigns and the per-address profile.

Each phase writes its table to the shared folder and the next one reads it, so
a phase is computed once, column pruning works between phases, and a lost
executor never costs more than the phase it was in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.config import DEFAULT, EngineConfig
from netquarry.functions.storage import materialize
from netquarry.operators import (
    cleaning, clustering, density, drift, enrichment, families, fingerprints, graph, kmeans, models, per_ip, reports,
    sampling, scoring,
)
from netquarry.schema import PER_IP_FEATURES
from netquarry.sources import writers

FINGERPRINT_KEY = ["SrcAddr", "time_window"]


@dataclass(frozen=True)
class Analysis:
    """Tables of one analysis; all are lazy or already written."""

    flows: DataFrame
    campaigns: DataFrame
    hourly: DataFrame
    drift: DataFrame
    documents: DataFrame
    nodes: DataFrame
    edges: DataFrame
    k_curve: DataFrame | None = None
    summary: DataFrame | None = None
    enriched: DataFrame | None = None
    matches: DataFrame | None = None
    cluster_table: DataFrame | None = None
    quality: DataFrame | None = None
    classifier_report: DataFrame | None = None
    importances: DataFrame | None = None
    projection: DataFrame | None = None
    run_summary: DataFrame | None = None

    def write(self, path: str) -> None:
        """Flows as partitioned Parquet, the campaign documents as JSON lines, every other table as Parquet."""
        writers.write_flows(self.flows, f"{path}/flows")
        writers.write_documents(self.documents, f"{path}/documents")
        for name, table in vars(self).items():
            if table is not None and name not in ("flows", "documents"):
                table.write.mode("overwrite").parquet(f"{path}/{name}")


def assign_campaigns(fp: DataFrame, cfg: EngineConfig = DEFAULT, k: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Normalised fingerprints with campaign_id, and the k curve when k was searched."""
    matrix, names = clustering.design_matrix(fp)
    points = materialize(clustering.standardize(matrix, names), "points")
    extra = [c for c in names if c.startswith("ds_")]
    curve = None
    if cfg.cluster_method == "density":
        found = density.density_clusters(
            points, FINGERPRINT_KEY, min_cluster_size=cfg.min_cluster_size, min_samples=cfg.min_samples
        )
    elif k is None:
        curve, k, fitted = clustering.sweep_k(points, cfg)
        model = fitted.get(k)
        if cfg.cluster_method == "kmeans" and model is not None:
            found = kmeans.assign(points, model)
        else:
            found = _fixed_k(points, k, cfg)
    else:
        found = _fixed_k(points, k, cfg)
    return found.drop("features", *extra), curve


def _fixed_k(points: DataFrame, k: int, cfg: EngineConfig) -> DataFrame:
    if cfg.cluster_method == "hierarchical":
        return clustering.hierarchical(points, k)
    return kmeans.assign(points, kmeans.fit(points, [k], cfg.n_init, cfg.seed)[k])


def analyse(
    raw: DataFrame, intel: DataFrame, indicators: DataFrame | None = None, cfg: EngineConfig = DEFAULT, k: int | None = None,
    known_botnets: bool = False,
) -> Analysis:
    """Raw unified flows and intelligence to scored, labelled, graphed campaigns.

    With ``known_botnets`` attack types take the intelligence count of an address
    into account. Classifier tables are absent where only one label occurs.
    """
    flows = materialize(cleaning.clean(raw), "flows")
    found = fingerprints.fingerprints(flows, cfg.fingerprint_window, cfg.iot_ports)
    if known_botnets:
        named = fingerprints.relabel_known_botnets(flows, intel, window=cfg.fingerprint_window, iot_ports=cfg.iot_ports)
        found = found.drop("attack_type").join(named.select(*FINGERPRINT_KEY, "attack_type"), FINGERPRINT_KEY).select(found.columns)
    fp = materialize(found, "fingerprints")
    assigned, curve = assign_campaigns(fingerprints.normalize(fp), cfg, k)
    camps = materialize(assigned, "campaigns")
    hourly = materialize(scoring.hourly_counts(flows), "hourly")
    summary = clustering.characterize(camps)
    enriched = materialize(enrichment.enrich(camps, summary, intel, cfg.enrich_per_campaign), "enriched")
    series = drift.drift_series(camps, window=cfg.drift_window, threshold=cfg.drift_threshold)
    scores = scoring.cluster_documents(
        camps, enriched, hourly, drift.drift_flags(series), clustering.cluster_summary(camps), cfg
    )
    members = scoring.memberships(camps)
    entries = families.family_entries(flows, members)
    documents = materialize(scoring.upsert_documents(scores, entries), "documents")
    listed = graph.with_families(enriched, entries)
    nodes = materialize(graph.build_nodes(members, listed), "nodes")
    edges = materialize(graph.build_edges(members, listed), "edges")
    between = graph.betweenness_centrality(nodes, edges)
    matrix, names = clustering.design_matrix(camps)
    points = materialize(clustering.standardize(matrix, names), "points")
    projected, _ = models.project_2d(points, dims=len(names))
    report = importances = None
    if models.has_two_labels(camps):
        train, test = models.stratified_split(matrix, "label", FINGERPRINT_KEY, seed=cfg.seed)
        forest = models.train_forest(train, names, seed=cfg.seed)
        report = models.classification_report(models.predict(forest, test, names))
        importances = models.feature_importances(forest, names, camps)
    return Analysis(
        cluster_table=clustering.cluster_summary(camps), quality=clustering.davies_bouldin(points, "campaign_id", "features", len(names)),
        classifier_report=report, importances=importances, projection=projected.select(*FINGERPRINT_KEY, "campaign_id", "pc1", "pc2"),
        run_summary=reports.run_summary(flows, camps, enriched, entries, nodes, edges), flows=flows, campaigns=camps, hourly=hourly, drift=series, documents=documents,
        nodes=graph.degree_centrality(nodes, edges).join(between, "id"), edges=edges, k_curve=curve, summary=summary,
        enriched=enriched, matches=enrichment.indicator_matches(camps, indicators) if indicators is not None else None,
    )


def analyse_profile(
    raw: DataFrame, sample_key: Sequence[str] | None = None, k_range: tuple[int, int] = (4, 6), cfg: EngineConfig = DEFAULT
) -> Analysis:
    """Per-address analysis of all rows, or of a uniform sample when a row key is given."""
    drawn = raw if sample_key is None else sampling.reservoir(raw, sample_key, cfg.sample_rows, cfg.seed)
    rows = materialize(cleaning.per_ip_rows(drawn), "rows")
    vectors = materialize(per_ip.normalized_profile(materialize(per_ip.profile_fingerprints(rows), "profile-rows")), "profile")
    curve, _, model = clustering.best_k_simplified(vectors, k_range, "norm_features", cfg.seed)
    camps = materialize(kmeans.assign(vectors, model, "norm_features"), "campaigns")
    hourly = materialize(scoring.hourly_counts(rows), "hourly")
    dims = len(PER_IP_FEATURES)
    series = drift.profile_drift(camps, hourly, dims, window=cfg.drift_window, threshold=cfg.drift_threshold)
    scored = scoring.profile_campaigns(camps, hourly, dims, cfg=cfg)
    flagged = drift.drift_flags(series)
    documents = scored.join(flagged, "campaign_id", "left").withColumn(
        "drift_detected", F.coalesce("drift_detected", F.lit(False))
    )
    nodes, edges = graph.profile_graph(camps, documents)
    return Analysis(rows, camps, hourly, series, documents, nodes, edges, curve)
