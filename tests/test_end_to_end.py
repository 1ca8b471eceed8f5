"""Whole analyses on the smallest given tables, and the query registry."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from netquarry.config import EngineConfig
from netquarry.plans import contract as queries
from netquarry.plans import fixture
from netquarry.plans.analysis import analyse, analyse_profile, assign_campaigns
from netquarry.sources import readers

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are absent")


@needs_tables
def test_standard_analysis(spark, tmp_path):
    cfg = EngineConfig(k_max=4, n_init=2)
    got = analyse(fixture.raw_flows(spark, SF), fixture.intel_table(spark, SF), fixture.indicator_table(spark, SF), cfg)
    docs = got.documents.collect()
    assert got.k_curve.count() == 3 and len(docs) == got.campaigns.select("campaign_id").distinct().count()
    assert all(0 <= d["confidence_pct"] <= 100 and d["iot_family"] for d in docs)
    n = got.nodes.agg(F.count("*"), F.min("degree_centrality"), F.max("betweenness_centrality")).first()
    assert n[0] == got.nodes.select("id").distinct().count() and n[1] > 0 and n[2] == 0.0
    assert got.enriched.count() == got.campaigns.select("campaign_id", "SrcAddr").distinct().count()
    assert got.matches.count() > 0
    got.write(str(tmp_path))
    back = {name: spark.read.parquet(f"{tmp_path}/{name}").count() for name in ("quality", "classifier_report", "importances", "projection", "run_summary", "cluster_table")}
    assert back["quality"] == 1 and back["classifier_report"] >= 2 and back["importances"] > 19 and back["run_summary"] == 9
    assert back["projection"] == got.campaigns.count() and back["cluster_table"] == len(docs)


@needs_tables
@pytest.mark.parametrize("method", ["hierarchical", "density"])
def test_other_methods_keep_every_fingerprint(spark, method):
    from netquarry.operators import cleaning, fingerprints

    fp = fingerprints.normalize(fingerprints.fingerprints(cleaning.clean(fixture.raw_flows(spark, SF))))
    camps, _ = assign_campaigns(fp, EngineConfig(cluster_method=method), k=3)
    assert camps.count() == fp.count() and camps.filter("campaign_id IS NULL").count() == 0
    assert camps.select("campaign_id").distinct().count() > 1


@needs_tables
def test_profile_analysis(spark):
    raw = fixture.raw_flows(spark, SF)
    key = ["SrcAddr", "DstAddr", "StartTime", "Sport", "Dport", "SrcBytes"]
    got = analyse_profile(raw, key, cfg=EngineConfig(sample_rows=3000))
    assert got.flows.count() == 3000
    docs = got.documents.collect()
    assert sum(d["ip_count"] for d in docs) == got.campaigns.count() and len(docs) >= 4
    assert got.nodes.filter("type = 'ip'").count() == min(300, got.campaigns.count())


def test_registry():
    queries, checks = contract.queries(), contract.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) > 100


@needs_tables
def test_entry_schema(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["SrcAddr", "time_window", "dataset_source"] and df.count() > 0


def test_mixed_log_is_written_by_many_tasks(spark, tmp_path):
    spark.range(40, numPartitions=4).selectExpr(
        "id AS l_suppkey", "id * 3 AS l_partkey", "id AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber", "'N' AS l_returnflag", "'O' AS l_linestatus"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40, numPartitions=4).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    path = queries._mixed_inputs(spark, str(tmp_path))[1]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    per_file = lines.groupBy("file").agg(F.count_if(F.col("value").startswith("#fields")).alias("heads")).collect()
    assert len(per_file) > 1 and all(r["heads"] == 1 for r in per_file)
    flows = fixture.raw_flows(spark, str(tmp_path)).filter("TotPkts % 4 = 1").count()
    assert lines.count() == flows + len(per_file) and readers.read_zeek(spark, path).count() == flows > 0
