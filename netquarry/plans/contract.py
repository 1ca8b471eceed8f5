"""Registered queries: one per operator group, each with its check SQL.

Keys start with the operator ids of the survey. Every query runs over whole
tables; limits appear only where the operator itself is a top-n or a sample.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.config import DEFAULT
from netquarry.functions import network as N
from netquarry.functions import rules
from netquarry.functions import vectors as V
from netquarry.functions.storage import fresh_path, materialize
from netquarry.operators import (
    asof, cleaning, clustering, density, drift, enrichment, families, fingerprints, grams, graph, grouped, kmeans, models, per_ip, ranking, reports,
    sampling, scoring, sketches, timeline, ward,
)
from netquarry.plans import fixture
from netquarry.plans import stages as S
from netquarry.plans.checks import FEATURE_SQL, HOSTILE, PROFILE_SQL, SCALED, SIMPLE_LABEL, chain
from netquarry.schema import FEATURES, PER_IP_FEATURES
from netquarry.sources import intel, readers, store, writers
from netquarry.streaming.fingerprints import FingerprintStream
from netquarry.streaming.sampler import StreamSampler

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

DIMS = 64  # length of the given embedding vectors


def query(name: str, sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            text = chain(sql, *needs)
            CHECKS[name] = text.replace("WITH", "WITH RECURSIVE", 1) if "USING KEY" in text or "_walk(" in text else text
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def members(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.memberships(S.campaigns(spark, sf))


# ---- sources and sinks ------------------------------------------------------

UNIFIED = (
    "StartTime, SrcAddr, Sport, DstAddr, Dport, Proto, Dur, SrcBytes, DstBytes, TotPkts, Label, SubLabel, DatasetSource"
)
UNIFIED_SQL = (
    "StartTime, SrcAddr, Sport::INT AS Sport, DstAddr, Dport::INT AS Dport, lower(trim(Proto)) AS Proto, Dur, "
    "SrcBytes::BIGINT AS SrcBytes, DstBytes::BIGINT AS DstBytes, TotPkts::BIGINT AS TotPkts"
)


def _write_binetflow(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "flows") + ".binetflow"
    raw = fixture.raw_flows(spark, sf)
    raw.selectExpr(
        "date_format(StartTime, 'yyyy/MM/dd HH:mm:ss.SSSSSS') AS StartTime", "Dur", "Proto", "SrcAddr", "Sport",
        "'->' AS Dir", "DstAddr", "Dport", "State", "0 AS sTos", "0 AS dTos", "TotPkts", "SrcBytes + DstBytes AS TotBytes",
        "SrcBytes", "Label",
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(
    "a1_binetflow_csv",
    f"SELECT DISTINCT {UNIFIED_SQL}, (SrcBytes + DstBytes)::BIGINT AS TotBytes, State, Label AS Label_raw, '' AS SubLabel, "
    "'CTU-13' AS DatasetSource, CASE WHEN regexp_matches(Label, 'Botnet|Attack|Malicious|PortScan|C&C|C2', 'i') THEN 1 ELSE 0 END "
    "AS Label FROM raw",
    "raw",
)
def a1(spark: SparkSession, sf: str) -> DataFrame:
    flows = cleaning.clean(readers.read_flows(spark, _write_binetflow(spark, sf)))
    return flows.select(*UNIFIED.split(", "), "TotBytes", "State", "Label_raw")


@query(
    "a3_zeek_log",
    f"SELECT {UNIFIED_SQL}, CASE WHEN SubLabel <> '' THEN 1 ELSE 0 END AS Label, SubLabel, 'IoT-23' AS DatasetSource FROM raw",
    "raw",
)
def a3(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly logs with two alternating layouts, the second without trailing cells."""
    rows = fixture.raw_flows(spark, sf).selectExpr(
        "CAST(timestampdiff(HOUR, TIMESTAMP_NTZ'2024-06-01', StartTime) AS INT) AS f",
        "format_string('%d.%06d', timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', StartTime) div 1000000,"
        " timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', StartTime) % 1000000) AS ts",
        "SrcAddr", "Sport", "DstAddr", "Dport", "Proto", "Dur", "SrcBytes", "DstBytes", "TotPkts",
        "IF(SubLabel <> '', 'Malicious', 'Benign') AS label", "SubLabel",
    )
    long = ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes",
            "orig_pkts", "label", "detailed-label"]
    short = ["proto", "id.orig_h", "id.orig_p", "ts", "id.resp_h", "id.resp_p", "orig_bytes", "resp_bytes", "duration",
             "orig_pkts", "label", "detailed-label"]
    as_long = F.concat_ws("\t", "ts", "SrcAddr", "Sport", "DstAddr", "Dport", "Proto", "Dur", "SrcBytes", "DstBytes",
                          "TotPkts", "label", "SubLabel")
    as_short = F.regexp_replace(
        F.concat_ws("\t", "Proto", "SrcAddr", "Sport", "ts", "DstAddr", "Dport", "SrcBytes", "DstBytes", "Dur", "TotPkts",
                    "label", "SubLabel"), r"\t+$", "")
    lines = rows.select("f", F.when(F.col("f") % 2 == 0, as_long).otherwise(as_short).alias("value"))
    heads = rows.select("f").distinct().select(
        "f",
        F.explode(F.array(
            F.when(F.col("f") % 2 == 0, F.lit("\t".join(["#fields", *long]))).otherwise(F.lit("\t".join(["#fields", *short]))),
            F.lit("#types\ttime"),
        )).alias("value"),
    )
    path = fresh_path(spark, "conn.log.labeled")
    heads.unionByName(lines).repartition("f").write.partitionBy("f").text(path)
    return readers.read_zeek(spark, f"{path}/f=*").select(*UNIFIED.split(", "))


@query(
    "a4_cic_csv",
    "SELECT StartTime, SrcAddr, Sport::INT AS Sport, DstAddr, Dport::INT AS Dport, lower(trim(Proto)) AS Proto, Dur, "
    "SrcBytes::BIGINT AS SrcBytes, DstBytes::BIGINT AS DstBytes, (TotPkts + 2)::BIGINT AS TotPkts, "
    "CASE WHEN regexp_matches(lower(Label), 'malicious|attack|bot') THEN 1 ELSE 0 END AS Label, SubLabel, "
    "'IoT-23' AS DatasetSource FROM raw",
    "raw",
)
def a4(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "cic")
    fixture.raw_flows(spark, sf).selectExpr(
        "date_format(StartTime, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS `Timestamp`", "SrcAddr AS `Source IP`", "Sport AS `Source Port`",
        "DstAddr AS `Destination IP`", "Dport AS `Destination Port`", "Proto AS `Protocol`", "Dur AS `Flow Duration`",
        "TotPkts AS `Total Fwd Packets`", "2 AS `Total Backward Packets`", "SrcBytes AS `Total Length of Fwd Packets`",
        "DstBytes AS `Total Length of Bwd Packets`", "Label AS `Label`", "SubLabel AS `Detailed.Label`",
        "SubLabel AS `Detailed Label`",
    ).write.option("header", True).csv(path)
    return readers.read_flows(spark, path).select(*UNIFIED.split(", "))


@query(
    "a6_generic_csv",
    f"SELECT {UNIFIED_SQL.replace('DstBytes::BIGINT', '0::BIGINT')}, CASE WHEN regexp_matches(Label, "
    "'Botnet|Attack|Malicious|PortScan|C&C|C2', 'i') THEN 1 ELSE 0 END AS Label, SubLabel, 'IoT-23' AS DatasetSource FROM raw",
    "raw",
)
def a6(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "generic")
    fixture.raw_flows(spark, sf).selectExpr(
        "date_format(StartTime, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS StartTime", "SrcAddr", "Sport", "DstAddr", "Dport",
        "Proto", "Dur", "SrcBytes", "TotPkts", "Label", "SubLabel",
    ).write.option("header", True).csv(path)
    return cleaning.clean(readers.read_flows(spark, path, "generic"), deduplicate=False).select(*UNIFIED.split(", "))


def _mixed_inputs(spark: SparkSession, sf: str) -> list[str]:
    """Four files, one per format, from rows dealt by packet count; with bad cells, bad times, empty keys and repeats."""
    rows = fixture.raw_flows(spark, sf).withColumn("f", F.expr("CAST(TotPkts % 4 AS INT)"))
    paths = [fresh_path(spark, name) + end for name, end in (("mixed", ".binetflow"), ("mixed-conn.log.labeled", ""), ("mixed-cic", ""), ("mixed-own", ""))]
    rows.filter("f = 0").selectExpr(
        "date_format(StartTime, 'yyyy/MM/dd HH:mm:ss.SSSSSS') AS StartTime", "Dur", "Proto", "SrcAddr", "Sport", "'->' AS Dir", "DstAddr",
        "IF(Sport = 53, '0x0303', CAST(Dport AS STRING)) AS Dport", "State", "0 AS sTos", "0 AS dTos", "TotPkts",
        "SrcBytes + DstBytes AS TotBytes", "SrcBytes", "Label",
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths[0])
    lines = rows.filter("f = 1").selectExpr(
        "concat_ws('\t', format_string('%d.%06d', timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', StartTime) div 1000000,"
        " timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', StartTime) % 1000000), SrcAddr, Sport, DstAddr, Dport, Proto, Dur, SrcBytes,"
        " DstBytes, TotPkts, IF(SubLabel <> '', 'Malicious', 'Benign'), SubLabel) AS value"
    )
    fields = ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "label", "detailed-label"]
    head = pa.array(["\t".join(["#fields", *fields])])

    def with_head(batches):
        """Every task writes a log of its own, so each starts with the header."""
        for column in itertools.chain([head], (b.column(0) for b in batches)):
            yield pa.RecordBatch.from_arrays([column.cast(pa.string())], ["value"])

    lines.mapInArrow(with_head, "value string").write.text(paths[1])
    rows.filter("f = 2").selectExpr(
        "date_format(StartTime, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS `Timestamp`", "SrcAddr AS `Source IP`", "Sport AS `Source Port`",
        "DstAddr AS `Destination IP`", "Dport AS `Destination Port`", "Proto AS `Protocol`", "Dur AS `Flow Duration`",
        "TotPkts AS `Total Fwd Packets`", "0 AS `Total Backward Packets`", "SrcBytes AS `Total Length of Fwd Packets`",
        "DstBytes AS `Total Length of Bwd Packets`", "Label", "SubLabel AS `Detailed Label`",
    ).write.option("header", True).csv(paths[2])
    own = rows.filter("f = 3").selectExpr(
        "IF(TotPkts % 16 = 7, 'some day', date_format(StartTime, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")) AS StartTime",
        "IF(TotPkts % 16 = 11, NULL, SrcAddr) AS SrcAddr", "Sport", "DstAddr", "Dport", "Proto", "Dur", "SrcBytes", "DstBytes", "TotPkts",
        "IF(Dport = 443, '1', '0') AS Label", "SubLabel", "'LAN' AS DatasetSource",
    )
    own.unionByName(own).write.option("header", True).csv(paths[3])
    return paths


_SHARED = "StartTime, SrcAddr, Sport::INT AS Sport, DstAddr, Dport::INT AS Dport, lower(trim(Proto)) AS Proto, Dur, SrcBytes::BIGINT AS SrcBytes"
_REST = "DstBytes::BIGINT AS DstBytes, TotPkts::BIGINT AS TotPkts"


@query("a8_expand_inputs", "SELECT l_linenumber % 3 AS part, count(*) AS lines FROM lineitem WHERE l_linenumber % 3 <> 1 GROUP BY 1")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    """Files of overlapping patterns, once each, without the excluded ones."""
    base = fresh_path(spark, "inputs")
    items = fixture.table(spark, sf, "lineitem")
    items.withColumn("part", F.col("l_linenumber") % 3).write.partitionBy("part").csv(base)
    skipped = readers.expand_inputs(spark, [f"{base}/part=1/*.csv"])
    files = readers.expand_inputs(spark, [f"{base}/**/*.csv", f"{base}/part=0/*.csv", f"{base}/none/*.csv"], skipped)
    lines = spark.read.text(files).select(F.regexp_extract(F.col("_metadata.file_path"), r"part=(\d)", 1).cast("int").alias("part"))
    return lines.groupBy("part").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "a9_union_sources",
    f"SELECT DISTINCT {_SHARED.replace('Dport::INT', 'CASE WHEN Sport = 53 THEN 0 ELSE Dport END::INT')}, {_REST}, "
    "CASE WHEN regexp_matches(Label, 'Botnet|Attack|Malicious|PortScan|C&C|C2', 'i') THEN 1 ELSE 0 END AS Label, '' AS SubLabel, "
    "'CTU-13' AS DatasetSource, Label AS Label_raw FROM raw WHERE TotPkts % 4 = 0 "
    f"UNION ALL SELECT DISTINCT {_SHARED}, {_REST}, CASE WHEN SubLabel <> '' THEN 1 ELSE 0 END, SubLabel, 'IoT-23', NULL FROM raw WHERE TotPkts % 4 = 1 "
    f"UNION ALL SELECT DISTINCT {_SHARED}, {_REST}, CASE WHEN regexp_matches(lower(Label), 'malicious|attack|bot') THEN 1 ELSE 0 END, SubLabel, "
    "'IoT-23', NULL FROM raw WHERE TotPkts % 4 = 2 "
    f"UNION ALL SELECT DISTINCT {_SHARED}, {_REST}, CASE WHEN Dport = 443 THEN 1 ELSE 0 END, SubLabel, 'LAN', "
    "CASE WHEN Dport = 443 THEN '1' ELSE '0' END FROM raw WHERE TotPkts % 4 = 3 AND TotPkts % 16 NOT IN (7, 11)",
    "raw",
)
def a9(spark: SparkSession, sf: str) -> DataFrame:
    both = readers.union_sources([readers.read_flows(spark, path) for path in _mixed_inputs(spark, sf)])
    return cleaning.clean(both).select(*UNIFIED.split(", "), "Label_raw")


@query(
    "a10_write_read_flows",
    "SELECT StartTime, SrcAddr, Sport, DstAddr, Dport, Proto, Dur, SrcBytes, DstBytes, TotPkts, is_malicious AS Label, SubLabel, "
    "DatasetSource, TotBytes, StartTime::DATE AS flow_date FROM flows",
    "flows",
)
def a10(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "unified")
    writers.write_flows(S.flows(spark, sf), path)
    return readers.read_stored(spark, path)


@query(
    "a11_csv_mirror",
    "SELECT DatasetSource, count(*) AS flows, sum(TotBytes)::BIGINT AS bytes, sum(is_malicious)::BIGINT AS malicious, "
    "min(StartTime) AS first_seen, max(StartTime) AS last_seen FROM flows GROUP BY 1",
    "flows",
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "mirror")
    writers.write_flows(S.flows(spark, sf), path, csv_path=path + ".csv")
    back = readers.read_stored(spark, path + ".csv", "csv")
    return back.groupBy("DatasetSource").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("TotBytes").alias("bytes"), F.sum("Label").cast("bigint").alias("malicious"),
        F.min("StartTime").alias("first_seen"), F.max("StartTime").alias("last_seen"),
    )


@query("a12_json_documents", "SELECT cluster_id, confidence_pct, label, attack_type, B, I, T, M, top_ttps, drift_detected FROM doc", "doc")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    path = fresh_path(spark, "documents")
    writers.write_documents(docs, path)
    back = spark.read.schema(docs.schema).json(path)
    return back.select(
        "cluster_id", "confidence_pct", "label", "attack_type", "contributing_factors.*",
        F.array_join("top_ttps", ", ").alias("top_ttps"), "drift_detected",
    )


@query("a13_intel_map", "SELECT ip, vt_malicious, vt_suspicious, abuse_score, asn, country, shodan_ports, shodan_tags FROM intel", "intel")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    table = fixture.intel_table(spark, sf)
    path = fresh_path(spark, "intel")
    entry = F.struct(*[c for c in table.columns if c != "ip"])
    table.select(F.to_json(F.create_map("ip", entry)).alias("value")).write.text(path)
    return intel.read_intel_map(spark, path, per_line=True)


# ---- cleaning and projections -----------------------------------------------

@query(
    "b_clean_flows",
    "SELECT *, CASE Proto WHEN 'tcp' THEN 0 WHEN 'udp' THEN 1 WHEN 'icmp' THEN 2 WHEN 'arp' THEN 3 ELSE 99 END AS ProtoCode, "
    "is_malicious AS Label FROM flows",
    "flows",
)
def b_clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean(fixture.raw_flows(spark, sf))


@query(
    "b8_deduplicate",
    "SELECT count(*) AS before, (SELECT count(*) FROM flows) AS after, count(*) - (SELECT count(*) FROM flows) AS removed FROM "
    "(SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE TotPkts > 10)",
    "raw", "flows",
)
def b8(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixture.raw_flows(spark, sf)
    doubled = cleaning.clean(raw.unionByName(raw.filter("TotPkts > 10")), deduplicate=False)
    n = F.count(F.lit(1))
    after = cleaning.clean(doubled.drop("is_malicious", "ProtoCode", "Label", "TotBytes").withColumnRenamed("Label_raw", "Label"))
    return doubled.agg(n.alias("before")).withColumn("after", after.agg(n).scalar()).withColumn(
        "removed", F.col("before") - F.col("after")
    )


@query(
    "b4_b5_b6_labels",
    "SELECT Label, SubLabel, CASE WHEN regexp_matches(Label, 'Botnet|Attack|Malicious|PortScan|C&C|C2', 'i') THEN 1 ELSE 0 END AS by_text, "
    "CASE WHEN lower(trim(' Malicious')) = lower(trim(SubLabel)) THEN 1 ELSE 0 END AS by_exact, "
    "CASE WHEN regexp_matches(lower(Label), 'malicious|attack|bot') THEN 1 ELSE 0 END AS by_cic, "
    "regexp_matches(lower(SubLabel), 'botnet|malicious|attack') AS by_profile, count(*) AS flows FROM raw GROUP BY ALL",
    "raw",
)
def b4(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixture.raw_flows(spark, sf)
    counts = raw.groupBy("Label", "SubLabel").agg(F.count(F.lit(1)).alias("flows"))
    return counts.select(
        "Label", "SubLabel", N.malicious_text("Label").alias("by_text"), N.malicious_exact("SubLabel").alias("by_exact"),
        N.malicious_cic("Label").alias("by_cic"), N.malicious_profile("SubLabel").alias("by_profile"), "flows",
    )


@query(
    "b10_profile",
    "SELECT count(*) AS total_flows, min(StartTime) AS first_seen, max(StartTime) AS last_seen, count(DISTINCT SrcAddr) AS unique_src, "
    "count(DISTINCT DstAddr) AS unique_dst, sum(is_malicious)::BIGINT AS malicious_flows, round(avg(is_malicious) * 100, 4) AS malicious_pct FROM flows",
    "flows",
)
def b10(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.dataset_profile(S.flows(spark, sf))


@query("b10_source_counts", "SELECT DatasetSource, count(*) AS flows FROM flows GROUP BY 1", "flows")
def b10s(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.source_counts(S.flows(spark, sf))


@query(
    "b11_windows",
    "SELECT date_trunc('hour', StartTime) AS hour, time_bucket(INTERVAL '6 hours', StartTime, TIMESTAMP '2024-06-01') AS six, "
    "count(*) AS flows FROM flows GROUP BY 1, 2",
    "flows",
)
def b11(spark: SparkSession, sf: str) -> DataFrame:
    hours = S.flows(spark, sf).groupBy(N.window_start("StartTime", "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("flows"))
    return hours.select("hour", N.window_start("hour", "6 hours").alias("six"), "flows")


@query(
    "b12_b14_addresses",
    "SELECT SrcAddr, regexp_extract(SrcAddr, '^(\\d+\\.\\d+\\.\\d+)(?:\\.|$)', 1) AS net, array_to_string(string_split(SrcAddr, '.')[1:3], '.') "
    "AS net_lenient, array_to_string(string_split(SrcAddr, '.')[3:4], '.') AS tail, count(*) AS flows FROM flows GROUP BY ALL",
    "flows",
)
def b12(spark: SparkSession, sf: str) -> DataFrame:
    counts = S.flows(spark, sf).groupBy("SrcAddr").agg(F.count(F.lit(1)).alias("flows"))
    return counts.select(
        "SrcAddr", N.subnet24("SrcAddr").alias("net"), N.subnet24_lenient("SrcAddr").alias("net_lenient"),
        N.last_octets("SrcAddr").alias("tail"), "flows",
    )


@query("b13_asn_key", "SELECT split_part(upper(asn), ' ', 1) AS asn_key, count(*) AS addresses FROM intel GROUP BY 1", "intel")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.intel_table(spark, sf).groupBy(N.asn_key("asn").alias("asn_key")).agg(F.count(F.lit(1)).alias("addresses"))


@query(
    "b15_b16_label_text",
    f"SELECT l AS raw_label, {SIMPLE_LABEL} AS label, regexp_matches(lower(l), 'botnet|malicious|attack') AS hostile, count(*) AS flows "
    "FROM prow GROUP BY ALL",
    "prow",
)
def b15(spark: SparkSession, sf: str) -> DataFrame:
    counts = S.flows(spark, sf).groupBy(F.col("Label_raw").alias("raw_label")).agg(F.count(F.lit(1)).alias("flows"))
    return counts.select(
        "raw_label", N.simple_label("raw_label").alias("label"), N.malicious_profile("raw_label").alias("hostile"), "flows"
    )


@query(
    "b17_profile_rows",
    "SELECT SrcAddr, Sport::VARCHAR AS Sport, Dport::VARCHAR AS Dport, State, Proto, l AS Label, Dur, TotPkts::DOUBLE AS TotPkts, "
    "TotBytes::DOUBLE AS TotBytes, DstBytes::DOUBLE AS DstBytes FROM prow",
    "prow",
)
def b17(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.per_ip_rows(S.flows(spark, sf)).select(
        "SrcAddr", "Sport", "Dport", "State", "Proto", "Label", "Dur", "TotPkts", "TotBytes", "DstBytes"
    )


@query(
    "b18_attack_category",
    "SELECT attack_type, CASE WHEN a LIKE '%mirai%' OR a LIKE '%bot%' THEN 'bot' WHEN a LIKE '%c2%' OR a LIKE '%beacon%' THEN 'c2' "
    "WHEN a LIKE '%scan%' THEN 'scan' ELSE 'other' END AS category, count(*) AS fingerprints FROM (SELECT attack_type, lower(attack_type) AS a FROM fp) GROUP BY ALL",
    "fp",
)
def b18(spark: SparkSession, sf: str) -> DataFrame:
    fp = S.fingerprint_table(spark, sf)
    return fp.groupBy("attack_type", N.attack_category("attack_type").alias("category")).agg(F.count(F.lit(1)).alias("fingerprints"))


# ---- fingerprints -----------------------------------------------------------

FP_SQL = "SrcAddr, time_window, dataset_source, " + ", ".join(FEATURE_SQL) + ", label, attack_type"


@query("c21_fingerprints", f"SELECT {FP_SQL} FROM fp", "fp")
def c21(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(S.flows(spark, sf))


@query(
    "c21_stream_fingerprints",
    f"SELECT {FP_SQL} FROM fp WHERE time_window + INTERVAL 1 HOUR <= (SELECT max(StartTime) - INTERVAL 6 HOURS FROM flows)",
    "fp", "flows",
)
def c21_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of a stream that arrives in six-hour pieces, unordered inside; windows the horizon has passed."""
    flows = S.flows(spark, sf)
    folder = fresh_path(spark, "arriving")
    pieces = [r[0] for r in flows.select(N.window_start("StartTime", "6 hours").alias("t")).distinct().sort("t").collect()]
    for start in pieces:
        flows.filter(N.window_start("StartTime", "6 hours") == F.lit(start)).write.mode("append").parquet(folder)
    stream = FingerprintStream(delay="6 hours")
    stream.start(spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 24).parquet(folder)).awaitTermination()
    return stream.result(flows)


@query("c20_attack_types", "SELECT attack_type, dataset_source, label, count(*) AS fingerprints FROM fp GROUP BY ALL", "fp")
def c20(spark: SparkSession, sf: str) -> DataFrame:
    return S.fingerprint_table(spark, sf).groupBy("attack_type", "dataset_source", "label").agg(
        F.count(F.lit(1)).alias("fingerprints")
    )


@query(
    "c22_normalize",
    "SELECT SrcAddr, time_window, " + ", ".join(f"round({c}, 4) AS {c}" for c in SCALED) + ", " + ", ".join(FEATURE_SQL[11:]) + " FROM camp",
    "camp",
)
def c22(spark: SparkSession, sf: str) -> DataFrame:
    out = fingerprints.normalize(S.fingerprint_table(spark, sf)).select("SrcAddr", "time_window", *FEATURES)
    return rounded(out, *SCALED)


@query(
    "c23_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, "
        f"round(quantile_cont({c}, 0.25), 4)::DOUBLE AS p25, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS p50, round(quantile_cont({c}, 0.75), 4)::DOUBLE AS p75, "
        f"max({c})::DOUBLE AS max FROM fp"
        for c in FEATURE_SQL
    ),
    "fp",
)
def c23(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.describe(S.fingerprint_table(spark, sf))


@query(
    "c_f9_known_botnets",
    """SELECT r.SrcAddr, r.time_window, coalesce(i.vt, 0) AS vt_score, CASE WHEN c2_beacon_score < 0.3 AND payload_asymmetry < 0.5 THEN 'C2_Beaconing'
 WHEN scan_entropy > 3.5 AND horizontal_scan_flag = 1 THEN 'Horizontal_PortScan' WHEN vertical_scan_flag = 1 THEN 'Vertical_PortScan'
 WHEN iot_port_affinity > 0.6 THEN 'IoT_Malware' WHEN payload_asymmetry > 10 THEN 'Data_Exfiltration'
 WHEN c2_beacon_score < 0.3 AND coalesce(i.vt, 0) > 5 THEN 'Known_Botnet_C2' ELSE 'Unknown' END AS attack_type
FROM fp_raw r LEFT JOIN (SELECT ip, max(vt_malicious) AS vt FROM intel GROUP BY 1) i ON r.SrcAddr = i.ip""",
    "fp_raw", "intel",
)
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.relabel_known_botnets(S.flows(spark, sf), fixture.intel_table(spark, sf))


# ---- per-address profile ----------------------------------------------------

P_WHOLE = {"flow_count", "unique_dst_ports", "unique_dst_ips"}


@query(
    "d_profile",
    "SELECT SrcAddr, label, " + ", ".join(c if c in P_WHOLE else f"round({c}, 4) AS {c}" for c in PROFILE_SQL) + " FROM profile",
    "profile",
)
def d_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.per_ip_rows(S.flows(spark, sf))
    return rounded(per_ip.profile_fingerprints(rows), *[c for c in PER_IP_FEATURES if c not in P_WHOLE])


@query(
    "d12_normalized",
    "SELECT SrcAddr, " + ", ".join(f"round(v[{i + 1}], 4) AS {c}" for i, c in enumerate(PROFILE_SQL)) + " FROM profile",
    "profile",
)
def d12(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("norm_features")
    return S.profile(spark, sf).select("SrcAddr", *[F.round(vec[i], 4).alias(c) for i, c in enumerate(PER_IP_FEATURES)])


@query(
    "c2_sketched_distinct",
    ", ".join(["", *[f"w{h} AS (SELECT SrcAddr, time_bucket(INTERVAL '{h} hours', StartTime, TIMESTAMP '2000-01-01') AS t FROM flows GROUP BY ALL)" for h in (6, 24)]])
    + " SELECT '6 hours' AS width, count(*) AS windows, 0::BIGINT AS beyond_error FROM w6 UNION ALL SELECT '1 day', count(*), 0 FROM w24",
    "flows",
)
def c2(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of two widths from one table of hourly sketches, and how many estimates miss the exact count by more than the stated error."""
    flows = S.flows(spark, sf)
    hours = S.staged(spark, sf, "hourly-sketches", lambda: sketches.hourly_sketches(flows))
    found = None
    for width in ("6 hours", "1 day"):
        keyed = flows.select("SrcAddr", N.window_start("StartTime", width).alias("time_window"), "DstAddr", "Dport")
        exact = grouped.value_statistics(keyed, ["SrcAddr", "time_window"], ["DstAddr", "Dport"]).select(
            "SrcAddr", "time_window", F.col("DstAddr_distinct").alias("hosts"), F.col("Dport_distinct").alias("ports")
        )
        both = exact.join(sketches.distinct_counts(hours, width), ["SrcAddr", "time_window"], "left")
        off = [F.abs(F.col(f"{c}_distinct") - F.col(e)) > F.col(e) * sketches.relative_error() for c, e in (("DstAddr", "hosts"), ("Dport", "ports"))]
        rows = both.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.coalesce(off[0] | off[1], F.lit(True))).alias("beyond_error")).withColumn("width", F.lit(width))
        found = rows if found is None else found.unionByName(rows)
    return found


# ---- clustering -------------------------------------------------------------

MATRIX = [*FEATURE_SQL, "ds_CTU-13", "ds_IoT-23", "ds_Mixed"]
_MATRIX_SQL = {c: f"coalesce({c}, 0)::DOUBLE" for c in FEATURE_SQL} | {
    f"ds_{s}": f"(CASE WHEN dataset_source = '{s}' THEN 1.0 ELSE 0.0 END)" for s in ("CTU-13", "IoT-23", "Mixed")
}


@query(
    "e1_e2_standardized",
    "SELECT SrcAddr, time_window, " + ", ".join(
        f"round(({_MATRIX_SQL[c]} - avg({_MATRIX_SQL[c]}) OVER ()) / CASE WHEN stddev_pop({_MATRIX_SQL[c]}) OVER () > 0 THEN "
        f"stddev_pop({_MATRIX_SQL[c]}) OVER () ELSE 1 END, 4) + 0.0 AS z{i}" for i, c in enumerate(MATRIX)
    ) + " FROM camp",
    "camp",
)
def e1(spark: SparkSession, sf: str) -> DataFrame:
    matrix, names = clustering.design_matrix(S.campaigns(spark, sf))
    z = clustering.standardize(matrix, names)
    return z.select("SrcAddr", "time_window", *[(F.round(F.col("features")[i], 4) + 0.0).alias(f"z{i}") for i in range(len(names))])


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("features")
    )


EMB = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"
CENT = (
    "SELECT label, [" + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE)" for i in range(DIMS)) + "] AS c, count(*) AS n FROM embeddings GROUP BY label"
)


@query(
    "e6_davies_bouldin",
    f"""WITH e AS ({EMB}), c AS ({CENT}), s AS (SELECT label, any_value(c) AS c, avg(list_distance(v, c)) AS s FROM e JOIN c USING (label) GROUP BY label)
SELECT round(avg(w), 4) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS w FROM s a JOIN s b ON a.label <> b.label GROUP BY 1)""",
)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering.davies_bouldin(embeddings(spark, sf), "label", "features", DIMS), "davies_bouldin")


SILHOUETTE_ROWS = 20_000  # the pairwise form is a sampling query at every size; e5_squared_silhouette takes all points


@query(
    "e5_silhouette",
    f"""WITH e AS ({EMB} ORDER BY md5(concat_ws('|', vec_id, '42')), vec_id LIMIT {SILHOUETTE_ROWS}), d AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.v, b.v)) AS s, count(*) AS n
 FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
x AS (SELECT vec_id, max(CASE WHEN label = own THEN s / n END) AS a, min(CASE WHEN label <> own THEN s / n END) AS b FROM d GROUP BY vec_id)
SELECT 'label' AS labelling, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM x""",
)
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering.silhouettes(embeddings(spark, sf), ["label"], ["vec_id"], sample=SILHOUETTE_ROWS), "silhouette")


def _between(a: str, b: str) -> str:
    return f"round(avg(CASE WHEN a IS NULL OR greatest({a}, {b}) = 0 THEN 0 ELSE ({b} - {a}) / greatest({a}, {b}) END), 4)"


@query(
    "e5_silhouette_interval",
    f"""WITH e AS ({EMB}), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', vec_id))) AS rn,
 count(*) OVER (PARTITION BY label) AS n FROM e),
d AS (SELECT a.vec_id, a.label AS own, b.label, b.n - (CASE WHEN a.label = b.label THEN 1 ELSE 0 END) AS others, count(*) AS m,
 avg(list_distance(a.v, b.v)) AS mean, var_samp(list_distance(a.v, b.v)) AS v FROM k a JOIN k b ON b.rn <= 20 AND a.vec_id <> b.vec_id GROUP BY ALL),
g AS (SELECT *, 4 * sqrt(coalesce(v, 0) / m * greatest(1 - m / others, 0)) AS z FROM d),
x AS (SELECT vec_id, max(mean) FILTER (label = own) AS a, greatest(max(mean - z) FILTER (label = own), 0) AS a_low, max(mean + z) FILTER (label = own) AS a_high,
 min(mean) FILTER (label <> own) AS b, min(greatest(mean - z, 0)) FILTER (label <> own) AS b_low, min(mean + z) FILTER (label <> own) AS b_high FROM g GROUP BY vec_id)
SELECT {_between("a", "b")} AS silhouette, {_between("a_high", "b_low")} AS low, {_between("a_low", "b_high")} AS high FROM x""",
)
def e5i(spark: SparkSession, sf: str) -> DataFrame:
    """Average silhouette of all points from 20 reference points of every label, with its bounds."""
    each = clustering.estimated_silhouette(embeddings(spark, sf), "label", ["vec_id"], per_cluster=20)
    return each.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("silhouette", "low", "high")])


@query(
    "e5_squared_silhouette",
    f"""WITH e AS ({EMB}), d AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.v, b.v) ** 2) AS s, count(*) AS n
 FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
x AS (SELECT vec_id, max(CASE WHEN label = own THEN s / n END) AS a, min(CASE WHEN label <> own THEN s / n END) AS b FROM d GROUP BY vec_id)
SELECT 'label' AS labelling, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM x""",
)
def e5s(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering.squared_silhouettes(embeddings(spark, sf), ["label"]), "silhouette")


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.centroids_of(embeddings(spark, sf), "label", "features", DIMS)


@query(
    "e7_nearest_centroid",
    f"""WITH e AS ({EMB}), c AS ({CENT}) SELECT vec_id, label, nearest, round(distance, 4) AS distance FROM (
 SELECT e.vec_id, e.label, c.label AS nearest, list_distance(v, c) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), c.label) AS rn
 FROM e, c) WHERE rn = 1""",
)
def e7(spark: SparkSession, sf: str) -> DataFrame:
    near = clustering.nearest_centroid(embeddings(spark, sf), label_centroids(spark, sf), "label", "features")
    return rounded(near.select("vec_id", "label", "nearest", "distance"), "distance")


@query(
    "e7_lloyd_step",
    f"""WITH e AS ({EMB}), c AS ({CENT}), a AS (SELECT v, nearest FROM (SELECT v, c.label AS nearest, row_number() OVER (PARTITION BY vec_id
 ORDER BY list_distance(v, c), c.label) AS rn FROM e, c) WHERE rn = 1)
SELECT nearest, count(*) AS size, round(avg(v[1]), 4) + 0.0 AS c0, round(avg(v[32]), 4) + 0.0 AS c31, round(avg(v[64]), 4) + 0.0 AS c63 FROM a GROUP BY 1""",
)
def e7b(spark: SparkSession, sf: str) -> DataFrame:
    step = clustering.lloyd_step(embeddings(spark, sf), label_centroids(spark, sf), "label", "features", DIMS)
    return step.select("nearest", "size", *[(F.round(F.col("centroid")[i], 4) + 0.0).alias(f"c{i}") for i in (0, 31, 63)])


@query(
    "e9_simplified_silhouette",
    f"""WITH e AS ({EMB}), c AS ({CENT}), d AS (SELECT vec_id, max(CASE WHEN e.label = c.label THEN list_distance(v, c) END) AS a,
 min(CASE WHEN e.label <> c.label THEN list_distance(v, c) END) AS b FROM e, c GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette FROM d""",
)
def e9(spark: SparkSession, sf: str) -> DataFrame:
    points = embeddings(spark, sf)
    return rounded(clustering.simplified_silhouette(points, label_centroids(spark, sf), "label", "features", "label"), "silhouette")


def standardized(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        matrix, names = clustering.design_matrix(S.campaigns(spark, sf).drop("campaign_id"))
        return clustering.standardize(matrix, names)

    return S.staged(spark, sf, "standardized", build)


Z_SQL = "SELECT SrcAddr, time_window, [" + ", ".join(
    f"({_MATRIX_SQL[c]} - avg({_MATRIX_SQL[c]}) OVER ()) / CASE WHEN stddev_pop({_MATRIX_SQL[c]}) OVER () > 0 THEN stddev_pop({_MATRIX_SQL[c]}) OVER () ELSE 1 END"
    for c in MATRIX
) + "] AS v FROM camp"
TOTAL_SQL = f"SELECT count(*) AS rows, round(sum(list_dot_product(v, v)), 2) AS squares FROM ({Z_SQL}) z"  # z-scores have mean zero


def _squares(points: DataFrame, label: str, dims: int) -> DataFrame:
    """Clusters, rows and squared deviations within plus between the clusters of a labelling, which add up to those about the mean."""
    cents = clustering.centroids_of(points, label, "features", dims)
    within = points.join(cents, label).agg(F.sum(V.squared_distance(F.col("features"), F.col("centroid")))).scalar()
    mean = points.agg(F.array(*[F.avg(F.col("features")[i]) for i in range(dims)])).scalar()
    between = F.sum(F.col("size") * V.squared_distance(F.col("centroid"), F.col("m")))
    found = cents.withColumn("m", mean).agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("rows"), between.alias("between"))
    return found.select("clusters", "rows", F.round(F.col("between") + within, 2).alias("squares"))


def _misplaced(points: DataFrame, model: kmeans.Centres) -> DataFrame:
    """Points and how many of them are not with the nearest of the model's centres."""
    labelled = kmeans.assign(points, model)
    near = clustering.nearest_centroid(labelled, kmeans.centre_table(points, model), "id", "features")
    return near.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("nearest") != F.col("campaign_id")).alias("misplaced"))


@query("e3_kmeans", f"SELECT 4::BIGINT AS clusters, rows, squares, 0::BIGINT AS misplaced FROM ({TOTAL_SQL})", "camp")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    points = standardized(spark, sf)
    model = kmeans.fit(points, [4])[4]
    return _squares(kmeans.assign(points, model), "campaign_id", len(MATRIX)).join(_misplaced(points, model), "rows")


@query("e4_k_sweep", "SELECT k::INT AS k, TRUE AS agrees, TRUE AS best_is_highest FROM range(2, 11) r(k)")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    """The curve against silhouettes of the labels each model gives."""
    points = standardized(spark, sf)
    curve, best, found = clustering.sweep_k(points)
    labelled = points.select("features", *[kmeans.nearest(m).alias(f"k{k}") for k, m in found.items()])
    again = clustering.squared_silhouettes(labelled, [f"k{k}" for k in found])
    both = curve.join(again.select(F.substring("labelling", 2, 9).cast("int").alias("k"), F.col("silhouette").alias("s")), "k")
    top = curve.agg(F.max_by("k", F.struct("silhouette", -F.col("k")))).scalar()
    return both.select("k", (F.abs(F.col("s") - F.col("silhouette")) < 1e-6).alias("agrees"), (top == best).alias("best_is_highest"))


@query("e8_e10_profile_k", "SELECT k::INT AS k, (SELECT count(*) FROM profile) AS rows, 0::BIGINT AS misplaced, TRUE AS best_is_highest FROM range(4, 7) r(k)", "profile")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    points = S.profile(spark, sf).select("SrcAddr", F.col("norm_features").alias("features"))
    curve, best, _ = clustering.best_k_simplified(points, (4, 6))
    top = curve.agg(F.max_by("k", F.struct("silhouette", -F.col("k")))).scalar()
    found = None
    for k, model in kmeans.fit(points, [4, 5, 6], 1, max_iter=100, tol=1e-6).items():
        rows = _misplaced(points, model).withColumn("k", F.lit(k))
        found = rows if found is None else found.unionByName(rows)
    return found.select("k", "rows", "misplaced", (top == best).alias("best_is_highest"))


@query("e11_hierarchical", f"SELECT 4::BIGINT AS clusters, rows, squares, squares AS merged_squares, TRUE AS heights_rise FROM ({TOTAL_SQL})", "camp")
def e11(spark: SparkSession, sf: str) -> DataFrame:
    """Deviations inside the leaves and gained by all merges add up to those about the mean, as those of the labels do."""
    points = standardized(spark, sf)
    tree = ward.fit(points)
    merged = round(float(tree.spread.sum() + tree.gains.sum()), 2)
    rise = bool((tree.heights[1:] >= tree.heights[:-1]).all())
    return _squares(ward.assign(points, tree, 4), "campaign_id", len(MATRIX)).withColumns({"merged_squares": F.lit(merged), "heights_rise": F.lit(rise)})


def _density_sql(vectors: str, dims: int, radius: float, levels: int, size: int = DEFAULT.min_cluster_size, samples: int = DEFAULT.min_samples) -> str:
    """The definition on all pairs: components level by level, then stability from the smallest radius up.

    ``vectors`` selects key and v (a list); the result names each row's cluster by its smallest key.
    """
    radii, gain = density.squared_radii(levels), density.persistence(levels)
    q = [f"q{i}" for i in range(dims)]
    squared = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in q)
    level = "CASE " + " ".join(f"WHEN d <= {t} THEN {k}" for k, t in enumerate(radii, 1)) + " END"
    parts = [
        f"vec AS ({vectors})",
        "grid AS MATERIALIZED (SELECT key, " + ", ".join(f"floor(v[{i + 1}] * {density.STEPS / radius} + 0.5)::BIGINT AS {c}" for i, c in enumerate(q)) + " FROM vec)",
        f"pt AS MATERIALIZED (SELECT {', '.join(q)}, count(*) AS w, row_number() OVER () AS id FROM grid GROUP BY {', '.join(q)})",
        f"pair AS MATERIALIZED (SELECT a, b, {level} AS lev FROM (SELECT a.id AS a, b.id AS b, {squared} AS d FROM pt a JOIN pt b ON a.id < b.id) x WHERE d <= {radii[-1]})",
        "seen AS (SELECT id, lev, sum(n) AS n FROM (SELECT a AS id, lev, b.w AS n FROM pair JOIN pt b ON b.id = b UNION ALL SELECT b, lev, a.w FROM pair JOIN pt a ON a.id = a) GROUP BY 1, 2)",
        f"core AS MATERIALIZED (SELECT id, w, min(l) AS c FROM (SELECT p.id, p.w, l, p.w - 1 + coalesce(sum(n), 0) AS others FROM pt p CROSS JOIN range(1, {levels + 1}) r(l) "
        f"LEFT JOIN seen ON seen.id = p.id AND seen.lev <= l GROUP BY 1, 2, 3) WHERE others >= {samples} GROUP BY 1, 2)",
        "link AS MATERIALIZED (SELECT a, b, greatest(lev, x.c, y.c) AS lev FROM pair JOIN core x ON x.id = a JOIN core y ON y.id = b)",
    ]
    for k in range(1, levels + 1):
        # Components of the level before are single vertices of this one.
        here = "SELECT id, id AS base FROM core WHERE c <= 1" if k == 1 else f"SELECT core.id, coalesce(m.comp, core.id) AS base FROM core LEFT JOIN m{k - 1} m USING (id) WHERE c <= {k}"
        parts += [
            f"h{k} AS MATERIALIZED ({here})",
            f"e{k} AS MATERIALIZED (SELECT DISTINCT x.base AS a, y.base AS b FROM link JOIN h{k} x ON x.id = link.a JOIN h{k} y ON y.id = link.b WHERE lev = {k} AND x.base <> y.base)",
            f"t{k} AS MATERIALIZED (SELECT a, b FROM e{k} UNION SELECT b, a FROM e{k})",
            f"g{k}(k, comp) USING KEY (k) AS (SELECT DISTINCT a, a FROM t{k} UNION SELECT t.a, min(n.comp) FROM t{k} t JOIN g{k} n ON n.k = t.b "
            f"JOIN recurring.g{k} o ON o.k = t.a WHERE n.comp < o.comp GROUP BY t.a)",
            f"m{k} AS MATERIALIZED (SELECT id, coalesce(g.comp, base) AS comp FROM h{k} LEFT JOIN g{k} g ON g.k = base)",
        ]
    for k in range(1, levels + 1):
        parent = f"(SELECT id, comp AS parent FROM m{k + 1})" if k < levels else "(SELECT id, NULL::BIGINT AS parent FROM core)"
        parts.append(f"n{k} AS (SELECT x.comp, u.parent, x.size FROM (SELECT comp, sum(w) AS size FROM m{k} JOIN core USING (id) GROUP BY comp HAVING sum(w) >= {size}) x JOIN {parent} u ON u.id = x.comp)")
        if k == 1:
            parts.append(f"s1 AS MATERIALIZED (SELECT comp, parent, 0 AS kids, size * {gain[0]} AS chain, NULL::HUGEINT AS inner_best FROM n1)")
        else:
            parts.append(
                f"s{k} AS MATERIALIZED (SELECT n.comp, n.parent, coalesce(kids, 0) AS kids, n.size * {gain[k - 1]} + CASE WHEN kids = 1 THEN on_chain ELSE 0 END AS chain, "
                f"CASE WHEN kids = 1 THEN on_inner ELSE best END AS inner_best FROM n{k} n LEFT JOIN (SELECT parent, count(*) AS kids, max(chain) AS on_chain, max(inner_best) AS on_inner, "
                f"sum(greatest(chain, coalesce(inner_best, chain))) AS best FROM s{k - 1} GROUP BY parent) p ON p.parent = n.comp)"
            )
    won = []
    for k in range(1, levels + 1):
        top = f"JOIN s{k + 1} u ON u.comp = s.parent AND u.kids > 1" if k < levels else ""
        won.append(f"SELECT m.id, {k} AS lev, s.comp FROM s{k} s {top} JOIN m{k} m ON m.comp = s.comp WHERE s.chain >= coalesce(s.inner_best, s.chain)")
    parts += [
        "won AS (" + " UNION ALL ".join(won) + ")",
        "owner AS (SELECT id, max(lev)::BIGINT * 1000000000 + arg_max(comp, lev) AS own FROM won GROUP BY id)",
        f"placed AS (SELECT key, own FROM grid JOIN pt USING ({', '.join(q)}) LEFT JOIN owner USING (id))",
    ]
    return (", " + ",\n".join(parts) + "\nSELECT key, CASE WHEN own IS NULL THEN key ELSE min(key) OVER (PARTITION BY own) END AS cluster_first, "
            "CASE WHEN own IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY own) END AS cluster_rows FROM placed")


def _named_clusters(found: DataFrame, key: Column) -> DataFrame:
    """Rows with their cluster's smallest key and size, which do not depend on its number."""
    keyed = found.select(key.alias("key"), "campaign_id")
    own = keyed.groupBy("campaign_id").agg(F.min("key").alias("cluster_first"), F.count(F.lit(1)).alias("cluster_rows"))
    return keyed.join(own, "campaign_id").select("key", "cluster_first", "cluster_rows")


@query(
    "e12_density",
    _density_sql(f"SELECT SrcAddr || ' ' || time_window AS key, v FROM ({Z_SQL}) z", len(MATRIX), 2.0, 12),
    "camp",
)
def e12(spark: SparkSession, sf: str) -> DataFrame:
    found = density.density_clusters(standardized(spark, sf), ["SrcAddr", "time_window"])
    return _named_clusters(found, F.concat("SrcAddr", F.lit(" "), F.col("time_window").cast("string")))


@query("e12_density_profile", _density_sql("SELECT SrcAddr AS key, v FROM profile", len(PROFILE_SQL), 0.5, 12), "profile")
def e12p(spark: SparkSession, sf: str) -> DataFrame:
    points = S.profile(spark, sf).select("SrcAddr", F.col("norm_features").alias("features"))
    return _named_clusters(density.density_clusters(points, ["SrcAddr"], radius=0.5), F.col("SrcAddr"))


@query("e13_e14_characterize", "SELECT * FROM summary", "summary")
def e13(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.characterize(S.campaigns(spark, sf))


@query(
    "e15_cluster_summary",
    """SELECT campaign_id, count(*) AS fingerprint_count, round(100.0 * count(*) FILTER (dataset_source = 'IoT-23') / count(*), 2) AS iot_pct,
 round(100.0 * count(*) FILTER (dataset_source = 'CTU-13') / count(*), 2) AS ctu_pct,
 (count(*) FILTER (dataset_source = 'IoT-23') > 0 AND count(*) FILTER (dataset_source = 'CTU-13') > 0) OR count(*) FILTER (dataset_source = 'Mixed') > 0 AS cross_dataset,
 round(avg(device_role_score), 4) AS mean_device_role_score, round(avg(coalesce(c2_beacon_score, 0)), 4) AS mean_c2_beacon_score,
 round(100.0 * avg(horizontal_scan_flag), 2) AS pct_horizontal_scan FROM camp GROUP BY 1""",
    "camp",
)
def e15(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster_summary(S.campaigns(spark, sf))


@query(
    "e16_e18_forest",
    "SELECT 'class ' || label AS item, round(count(*) * 0.2) AS value FROM camp GROUP BY label UNION ALL "
    f"SELECT 'importances', 1.0 UNION ALL SELECT 'features', {len(MATRIX)}.0",
    "camp",
)
def e16(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows of each class as the report counts them, and the features' importances as shares of one."""
    camps = S.campaigns(spark, sf)
    matrix, names = clustering.design_matrix(camps)
    train, test = models.stratified_split(matrix, "label", ["SrcAddr", "time_window"])
    model = models.train_forest(train, names)
    report = models.classification_report(models.predict(model, test, names))
    top = models.feature_importances(model, names, camps)
    shares = top.agg(F.round(F.sum("importance"), 4).alias("importances"), F.count(F.lit(1)).cast("double").alias("features"))
    return report.select(F.concat(F.lit("class "), F.col("label").cast("string")).alias("item"), F.col("support").cast("double").alias("value")).unionByName(
        shares.unpivot([], ["importances", "features"], "item", "value")
    )


@query(
    "e16_split",
    "SELECT label, CASE WHEN test THEN round(n * 0.2) ELSE n - round(n * 0.2) END::BIGINT AS rows, test FROM "
    "(SELECT label, count(*) AS n FROM camp GROUP BY 1), (VALUES (TRUE), (FALSE)) t(test)",
    "camp",
)
def e16s(spark: SparkSession, sf: str) -> DataFrame:
    train, test = models.stratified_split(S.campaigns(spark, sf), "label", ["SrcAddr", "time_window"])
    n = F.count(F.lit(1)).alias("rows")
    return train.groupBy("label").agg(n).withColumn("test", F.lit(False)).unionByName(
        test.groupBy("label").agg(n).withColumn("test", F.lit(True))
    )


PREDICTED = "CASE WHEN attack_type <> 'Unknown' THEN 1 ELSE 0 END"


@query("e17_confusion", f"SELECT label, {PREDICTED} AS prediction, count(*) AS rows FROM camp GROUP BY 1, 2", "camp")
def e17(spark: SparkSession, sf: str) -> DataFrame:
    return models.confusion_matrix(S.campaigns(spark, sf).withColumn("prediction", F.expr(PREDICTED)))


@query(
    "e17_report",
    f"""SELECT c AS label, round(p, 4) AS "precision", round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1, support FROM (
 SELECT c, count(*) FILTER (label = c AND q = c) / count(*) FILTER (q = c) AS p, count(*) FILTER (label = c AND q = c) / count(*) FILTER (label = c) AS r,
 count(*) FILTER (label = c) AS support FROM (SELECT label, {PREDICTED} AS q FROM camp), (VALUES (0), (1)) t(c) GROUP BY c)""",
    "camp",
)
def e17r(spark: SparkSession, sf: str) -> DataFrame:
    return models.classification_report(S.campaigns(spark, sf).withColumn("prediction", F.expr(PREDICTED)))


def _power_sql(name: str, matrix: str, steps: int = 400) -> str:
    """Largest eigenvalue and its vector, by power iteration."""
    return (f"{name}_walk(step, v) AS (SELECT 0, list_transform(range({len(MATRIX)}), lambda i: 1.0::DOUBLE / (i + 1)) UNION ALL SELECT step + 1, "
            f"list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT step, list_transform(m, lambda r: list_dot_product(r, v)) AS w "
            f"FROM {name}_walk, {matrix} WHERE step < {steps}) t), "
            f"{name} AS MATERIALIZED (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS lambda_ FROM {name}_walk, {matrix} WHERE step = {steps})")


PROJECTION_SQL = (
    f", z AS ({Z_SQL}), cell AS (SELECT i, j, avg(v[i] * v[j]) AS c FROM z, range(1, {len(MATRIX) + 1}) a(i), range(1, {len(MATRIX) + 1}) b(j) GROUP BY i, j), "
    "cov AS MATERIALIZED (SELECT list(r ORDER BY i) AS m, sum(r[i]) AS trace FROM (SELECT i, list(c ORDER BY j) AS r FROM cell GROUP BY i)), "
    + _power_sql("first", "cov")
    + ", rest AS MATERIALIZED (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - lambda_ * v[i] * v[j])) AS m FROM cov, first), "
    + _power_sql("second", "rest")
    + " SELECT (SELECT count(*) FROM z) AS rows, TRUE AS centred, TRUE AS ordered, round(first.lambda_ / trace, 4) AS explained_1, "
    "round(second.lambda_ / trace, 4) AS explained_2, TRUE AS shares_agree FROM cov, first, second"
)


@query("e19_projection", PROJECTION_SQL, "camp")
def e19(spark: SparkSession, sf: str) -> DataFrame:
    """Explained shares, and whether the projected points' own variances have them."""
    points = standardized(spark, sf)
    rows, explained = models.project_2d(points, dims=len(MATRIX))
    total = points.agg(sum((F.var_pop(F.col("features")[i]) for i in range(len(MATRIX))), F.lit(0.0))).scalar()
    shares = [F.abs(F.var_pop(c) / F.max("_total") - F.lit(e)) < 1e-6 for c, e in zip(("pc1", "pc2"), explained)]
    return rows.withColumn("_total", total).agg(
        F.count(F.lit(1)).alias("rows"), (F.abs(F.avg("pc1")) < 1e-6).alias("centred"),
        (F.var_pop("pc1") >= F.var_pop("pc2")).alias("ordered"), (shares[0] & shares[1]).alias("shares_agree"),
    ).withColumn("explained_1", F.lit(round(explained[0], 4))).withColumn("explained_2", F.lit(round(explained[1], 4)))


# ---- intelligence -----------------------------------------------------------

@query("f1_prioritised", "SELECT campaign_id, SrcAddr, label, round(conn_count, 4) AS conn_count FROM chosen", "chosen")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(enrichment.prioritise_addresses(S.campaigns(spark, sf), 25), "conn_count")


@query(
    "f2_f4_intel_join",
    "SELECT SrcAddr AS ip, coalesce(vt_malicious, 0) AS vt_malicious, coalesce(vt_suspicious, 0) AS vt_suspicious, coalesce(abuse_score, 0) AS abuse_score, "
    "coalesce(asn, '') AS asn, coalesce(country, '') AS country, coalesce(shodan_ports, '') AS shodan_ports, coalesce(shodan_tags, '') AS shodan_tags, "
    "CASE WHEN p >= 4 THEN 'CRITICAL' WHEN p >= 2 THEN 'HIGH' WHEN p >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level FROM (SELECT s.SrcAddr, i.*, "
    "(CASE WHEN coalesce(vt_malicious, 0) > 3 THEN 2 ELSE 0 END) + (CASE WHEN coalesce(vt_suspicious, 0) > 0 THEN 1 ELSE 0 END) + "
    "(CASE WHEN coalesce(abuse_score, 0) > 50 THEN 2 ELSE 0 END) + (CASE WHEN coalesce(abuse_score, 0) > 20 THEN 1 ELSE 0 END) AS p "
    "FROM (SELECT DISTINCT SrcAddr FROM member) s LEFT JOIN intel i ON s.SrcAddr = i.ip)",
    "member", "intel",
)
def f2(spark: SparkSession, sf: str) -> DataFrame:
    ips = S.campaigns(spark, sf).select(F.col("SrcAddr").alias("ip")).distinct()
    return enrichment.with_threat_level(enrichment.join_intel(ips, fixture.intel_table(spark, sf)))


@query(
    "f3_missing_sentinel",
    "SELECT SrcAddr AS ip, coalesce(vt_malicious, -1) AS vt_malicious, coalesce(vt_suspicious, -1) AS vt_suspicious, "
    "coalesce(abuse_score, -1) AS abuse_score FROM (SELECT DISTINCT SrcAddr FROM member) s LEFT JOIN intel i ON s.SrcAddr = i.ip",
    "member", "intel",
)
def f3(spark: SparkSession, sf: str) -> DataFrame:
    ips = S.campaigns(spark, sf).select(F.col("SrcAddr").alias("ip")).distinct()
    joined = enrichment.join_intel(ips, fixture.intel_table(spark, sf), missing="sentinel")
    return joined.select("ip", "vt_malicious", "vt_suspicious", "abuse_score")


@query("f5_techniques", "SELECT campaign_id, campaign_type, technique_id, technique_name, tactic FROM summary JOIN technique USING (campaign_type)", "summary", "technique")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    summary = clustering.characterize(S.campaigns(spark, sf)).select("campaign_id", "campaign_type")
    return enrichment.with_technique(summary).drop("mitre_url")


@query("f6_enriched", "SELECT * FROM enriched", "enriched")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    camps = S.campaigns(spark, sf)
    out = enrichment.enrich(camps, clustering.characterize(camps), fixture.intel_table(spark, sf))
    return out.drop("mitre_url", "shodan_ports", "shodan_tags")


@query(
    "f7_indicator_matches",
    "SELECT ip, event, '' AS threat_actor, tlp FROM (SELECT DISTINCT SrcAddr AS ip FROM member) JOIN indicator USING (ip)",
    "member", "indicator",
)
def f7(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.indicator_matches(S.campaigns(spark, sf), fixture.indicator_table(spark, sf))


LINES = (
    "SELECT ip, string_agg(line, chr(10) ORDER BY line) AS matches FROM (SELECT ip, line, row_number() OVER (PARTITION BY ip ORDER BY line) AS rn "
    "FROM (SELECT ip, concat(event, ' | TLP=', tlp) AS line FROM (SELECT DISTINCT SrcAddr AS ip FROM member) JOIN indicator USING (ip))) WHERE rn <= 5 GROUP BY 1"
)


@query("f8_matches_per_address", LINES, "member", "indicator")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    matches = enrichment.indicator_matches(S.campaigns(spark, sf), fixture.indicator_table(spark, sf), first=None)
    return enrichment.matches_per_address(matches)


# ---- scores -----------------------------------------------------------------

@query("g1_cohesion", "SELECT campaign_id, round(B, 4) AS B FROM cohesion", "cohesion")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.cohesion(S.campaigns(spark, sf)), "B")


@query(
    "g2_cohesion_pairs",
    f"WITH e AS ({EMB}) SELECT a.label, round(avg(list_cosine_similarity(a.v, b.v)), 4) AS B FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1",
)
def g2(spark: SparkSession, sf: str) -> DataFrame:
    """Checked against all pairs in SQL; the query itself forms none."""
    return rounded(scoring.cohesion_of_vectors(embeddings(spark, sf), "features", DIMS, "label"), "B")


@query("g3_overlap", "SELECT campaign_id, round(I, 4) AS I FROM overlap", "overlap")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.infrastructure_overlap(members(spark, sf), scoring.asn_by_address(S.enriched(spark, sf))), "I")


@query(
    "g4_subnet_share",
    "SELECT campaign_id, round(max(n) / sum(n), 4) AS I FROM (SELECT campaign_id, regexp_extract(SrcAddr, '^(\\d+\\.\\d+\\.\\d+)', 1) AS net, count(*) AS n FROM member GROUP BY 1, 2) GROUP BY 1",
    "member",
)
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.subnet_share(members(spark, sf)), "I")


@query("g5_timing", "SELECT campaign_id, round(T, 4) AS T FROM timing", "timing")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.timing_correlation(S.hourly(spark, sf), members(spark, sf)), "T")


@query("g6_profile_timing", "SELECT campaign_id, round(T, 4) AS T FROM ptiming", "ptiming")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    mem = S.profile(spark, sf).select("campaign_id", "SrcAddr")
    return rounded(scoring.timing_correlation(S.hourly(spark, sf), mem, min_rows=3), "T")


@query("g7_threat_match", "SELECT campaign_id, round(M, 4) AS M FROM threat", "threat")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.threat_match(S.enriched(spark, sf)), "M")


@query("g8_label_match", f"SELECT campaign_id, round(avg(CASE WHEN {HOSTILE} THEN 1.0 ELSE 0.0 END), 4) AS M FROM profile GROUP BY 1", "profile")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    p = S.profile(spark, sf)
    return rounded(scoring.label_match(p.select("campaign_id", "SrcAddr"), p), "M")


@query(
    "g9_confidence",
    "SELECT campaign_id, round(B, 4) AS B, round(I, 4) AS I, round(T, 4) AS T, round(M, 4) AS M, round(greatest(0.0, least(1.0, C)) * 100, 2) AS confidence_pct FROM factor",
    "factor",
)
def g9(spark: SparkSession, sf: str) -> DataFrame:
    parts = scoring.factors(S.campaigns(spark, sf), S.enriched(spark, sf), S.hourly(spark, sf))
    scored = parts.withColumn("confidence_pct", scoring.confidence_pct(F.col("C"))).drop("C")
    return rounded(scored, "B", "I", "T", "M")


def drift_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_series(S.campaigns(spark, sf))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        camps = S.campaigns(spark, sf)
        return scoring.cluster_documents(
            camps, S.enriched(spark, sf), S.hourly(spark, sf), drift.drift_flags(drift_table(spark, sf)), clustering.cluster_summary(camps)
        )

    return S.staged(spark, sf, "documents", build)


@query("g10_documents", "SELECT * FROM doc", "doc")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "cluster_id", "confidence_pct", "label", "attack_type", "contributing_factors.*",
        F.array_join("top_ttps", ", ").alias("top_ttps"), "drift_detected", "cross_dataset",
    )


_UPSERT_SQL = (
    "SELECT coalesce(d.cluster_id, f.campaign_id) AS cluster_id, d.attack_type, d.confidence_pct, f.majority_sublabel, f.iot_family "
    "FROM (SELECT * FROM doc WHERE cluster_id <> 0) d FULL JOIN family f ON d.cluster_id = f.campaign_id"
)
_UPSERTED = ["cluster_id", "attack_type", "confidence_pct", "majority_sublabel", "iot_family"]


@query("g11_upsert", _UPSERT_SQL, "doc", "family")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    old = documents(spark, sf).filter("cluster_id <> 0")
    merged = scoring.upsert_documents(old, families.family_entries(S.flows(spark, sf), members(spark, sf)))
    return merged.select(*_UPSERTED)


@query("g11_upsert_store", _UPSERT_SQL, "doc", "family")
def g11s(spark: SparkSession, sf: str) -> DataFrame:
    """The same merge as two batches of a store, the second one twice."""
    kept = store.DocumentStore(spark, buckets=16)
    kept.upsert(1, documents(spark, sf).filter("cluster_id <> 0"))
    entries = materialize(families.family_entries(S.flows(spark, sf), members(spark, sf)), "families")
    for _ in range(2):
        kept.upsert(2, entries)
    return kept.read().select(*_UPSERTED)


@query(
    "g11_profile_store",
    "SELECT SrcAddr, CASE WHEN flow_count > 20 THEN 'revised' ELSE label END AS label, flow_count FROM profile", "profile",
)
def g11p(spark: SparkSession, sf: str) -> DataFrame:
    """Every address's profile kept in a store; labels of busy addresses revised by a second batch."""
    rows = S.profile(spark, sf).select("SrcAddr", "label", "flow_count")
    kept = store.DocumentStore(spark, key="SrcAddr")
    kept.upsert(1, rows)
    kept.upsert(2, rows.filter("flow_count > 20").select("SrcAddr", F.lit("revised").alias("label")))
    return kept.read()


def profile_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.profile_campaigns(S.profile(spark, sf), S.hourly(spark, sf), len(PER_IP_FEATURES))


@query(
    "g12_profile_campaigns",
    "SELECT campaign_id, ip_count, round(confidence, 4) AS confidence, B, I, T, M, dominant_subnet, top_label FROM pcamp", "pcamp",
)
def g12(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile_campaigns(spark, sf), "confidence")


@query("g13_latest_campaign", "SELECT SrcAddr, max_by(campaign_id, time_window) AS campaign_id, max_by(attack_type, time_window) AS attack_type FROM camp GROUP BY 1", "camp")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.latest_campaign(S.campaigns(spark, sf))


@query(
    "g14_tiers",
    "SELECT cluster_id, CASE WHEN confidence_pct < 50 THEN 'low' WHEN confidence_pct < 75 THEN 'mid' ELSE 'high' END AS tier, "
    "CASE WHEN confidence_pct >= 80 THEN 'high' WHEN confidence_pct >= 50 THEN 'medium' ELSE 'low' END AS severity FROM doc",
    "doc",
)
def g14(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "cluster_id", N.confidence_band("confidence_pct").alias("tier"), N.severity_tier(F.col("confidence_pct") / 100).alias("severity")
    )


# ---- drift ------------------------------------------------------------------

@query("h1_drift", "SELECT * FROM drift", "drift")
def h1(spark: SparkSession, sf: str) -> DataFrame:
    return drift_table(spark, sf)


@query(
    "h1_drift_low_threshold",
    "SELECT campaign_id, bool_or(1 - list_cosine_similarity(v, nv) > 0.0001) AS drift_detected FROM (SELECT campaign_id, v, lead(v) OVER "
    "(PARTITION BY campaign_id ORDER BY window_start) AS nv FROM centroid) WHERE nv IS NOT NULL GROUP BY 1",
    "centroid",
)
def h1b(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_flags(drift.drift_series(S.campaigns(spark, sf), threshold=0.0001))


@query(
    "h2_profile_drift",
    """SELECT campaign_id, window_start, window_next, round(1 - list_cosine_similarity(v, nv), 4) AS drift, 1 - list_cosine_similarity(v, nv) > 0.15 AS flagged
FROM (SELECT campaign_id, window_start, v, lead(window_start) OVER w AS window_next, lead(v) OVER w AS nv FROM (
 SELECT campaign_id, window_start, [""" + ", ".join(f"avg(v[{i + 1}])" for i in range(len(PROFILE_SQL))) + """] AS v FROM (
  SELECT DISTINCT SrcAddr, time_bucket(INTERVAL '6 hours', StartTime, TIMESTAMP '2024-06-01') AS window_start FROM flows) JOIN profile USING (SrcAddr) GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY campaign_id ORDER BY window_start)) WHERE window_next IS NOT NULL""",
    "flows", "profile",
)
def h2(spark: SparkSession, sf: str) -> DataFrame:
    return drift.profile_drift(S.profile(spark, sf), S.hourly(spark, sf), len(PER_IP_FEATURES))


@query(
    "h3_drift_matrix",
    "SELECT window_start AS t, " + ", ".join(f"max(drift) FILTER (campaign_id = {c}) AS c{c}" for c in range(6)) + " FROM drift GROUP BY 1", "drift",
)
def h3(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_matrix(drift_table(spark, sf), range(6))


# ---- families ---------------------------------------------------------------

@query("i1_i3_families", "SELECT campaign_id, majority_sublabel, iot_family, ttps FROM family", "family")
def i1(spark: SparkSession, sf: str) -> DataFrame:
    out = families.family_entries(S.flows(spark, sf), members(spark, sf))
    return out.select("campaign_id", "majority_sublabel", "iot_family", F.array_join("ttps", ",").alias("ttps"))


@query(
    "i2_sublabel_map",
    "SELECT SubLabel AS sublabel, CASE WHEN s LIKE '%portscan%' THEN 'Scanner' WHEN s LIKE '%okiru%' THEN 'Okiru/Bashlite' WHEN s LIKE '%torii%' THEN 'Torii' "
    "WHEN s LIKE '%c&c%' THEN 'C2 Implant' ELSE 'Unknown IoT' END AS iot_family, count(*) AS flows FROM (SELECT SubLabel, lower(SubLabel) AS s FROM flows) GROUP BY ALL",
    "flows",
)
def i2(spark: SparkSession, sf: str) -> DataFrame:
    counts = S.flows(spark, sf).groupBy(F.col("SubLabel").alias("sublabel")).agg(F.count(F.lit(1)).alias("flows"))
    return families.map_families(counts, "sublabel").drop("ttps")


# ---- graph ------------------------------------------------------------------

def graph_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    def listed() -> DataFrame:
        return graph.with_families(S.enriched(spark, sf), families.family_entries(S.flows(spark, sf), members(spark, sf)))

    rows = S.staged(spark, sf, "enriched_families", listed)
    nodes = S.staged(spark, sf, "nodes", lambda: graph.build_nodes(members(spark, sf), rows))
    edges = S.staged(spark, sf, "edges", lambda: graph.build_edges(members(spark, sf), rows))
    return nodes, edges


@query("j1_nodes", "SELECT * FROM node", "node")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return graph_tables(spark, sf)[0]


@query("j2_edges", "SELECT * FROM edge", "edge")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    return graph_tables(spark, sf)[1]


@query("j3_degree", "SELECT * FROM degree", "degree")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree_centrality(*graph_tables(spark, sf))


@query("j4_betweenness", "SELECT id, 0.0::DOUBLE AS betweenness_centrality FROM node", "node")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    """Directed: every edge ends in a sink, so no node lies between two others."""
    return graph.betweenness_centrality(*graph_tables(spark, sf))


def _shortest_path_sql(depth: int = 8, directed: bool = False, pivots: int | None = None) -> str:
    """Brandes level by level from every node or pivot, for graphs whose shortest paths have at most ``depth`` - 1 edges."""
    way = "SELECT src, dst FROM edge WHERE src <> dst" + ("" if directed else " UNION SELECT dst, src FROM edge WHERE src <> dst")
    some = f"(SELECT id FROM node ORDER BY sha256('{DEFAULT.seed}:' || id), id LIMIT {pivots or 1 << 60})"
    parts = [f"way AS (SELECT DISTINCT * FROM ({way}))",
             f"l0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0::DOUBLE AS sigma FROM {some})"]
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT s, v FROM l{i}" for i in range(k))
        parts.append(f"l{k} AS MATERIALIZED (SELECT s, v, sigma FROM (SELECT s, dst AS v, sum(sigma) AS sigma FROM l{k - 1} JOIN way ON v = src GROUP BY 1, 2) "
                     f"ANTI JOIN ({before}) USING (s, v))")
    parts.append(f"d{depth} AS (SELECT s, v, sigma, 0.0::DOUBLE AS delta FROM l{depth})")
    for k in range(depth - 1, 0, -1):
        parts.append(f"d{k} AS MATERIALIZED (SELECT l.s, l.v, l.sigma, coalesce(sum(l.sigma / w.sigma * (1 + w.delta)), 0) AS delta FROM l{k} l "
                     f"LEFT JOIN (SELECT u.s, b.src, u.sigma, u.delta FROM d{k + 1} u JOIN way b ON b.dst = u.v) w ON w.s = l.s AND w.src = l.v GROUP BY ALL)")
    every = " UNION ALL ".join(f"SELECT v, delta FROM d{k}" for k in range(1, depth + 1))
    scale = "(SELECT count(*) / (SELECT count(*) FROM l0) / ((count(*) - 1) * (count(*) - 2)) FROM node)"
    return (", " + ", ".join(parts) + f" SELECT id, round(coalesce(sum(delta), 0) * {scale}, 6) AS betweenness_centrality "
            f"FROM node LEFT JOIN ({every}) ON id = v GROUP BY id")


@query("j4_betweenness_undirected", _shortest_path_sql(), "node", "edge")
def j4u(spark: SparkSession, sf: str) -> DataFrame:
    return graph.betweenness_centrality(*graph_tables(spark, sf), directed=False)


# Customers reach suppliers and regions through their nation and the nations after it.
ROUTE_TABLES = ("customer", "supplier", "nation", "region")
ROUTES = {
    "node": "SELECT 'c' || c_custkey AS id FROM {customer} UNION ALL SELECT 's' || s_suppkey FROM {supplier} UNION ALL SELECT 'n' || n_nationkey FROM {nation} "
            "UNION ALL SELECT 'r' || r_regionkey FROM {region}",
    "edge": "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM {customer} UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM {supplier} "
            "UNION ALL SELECT 'n' || a.n_nationkey, 'n' || b.n_nationkey FROM {nation} a JOIN {nation} b ON b.n_nationkey = a.n_nationkey + 1 AND b.n_nationkey % 5 <> 0 "
            "UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM {nation} WHERE n_nationkey % 5 = 4",
}


def routes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph with long paths out of the given tables: chains of nations with stars around them."""
    tables = {t: fixture.table(spark, sf, t) for t in ROUTE_TABLES}
    nodes, edges = (spark.sql(ROUTES[part], **tables) for part in ("node", "edge"))
    return nodes, edges


def _routes_sql(**kwargs) -> str:
    names = {t: t for t in ROUTE_TABLES}
    return "WITH " + ", ".join(f"{n} AS ({sql.format(**names)})" for n, sql in ROUTES.items()) + _shortest_path_sql(**kwargs)


@query("j4_betweenness_routes", _routes_sql(directed=True))
def j4r(spark: SparkSession, sf: str) -> DataFrame:
    return graph.betweenness_centrality(*routes(spark, sf))


@query("j4_betweenness_pivots", _routes_sql(directed=True, pivots=500))
def j4p(spark: SparkSession, sf: str) -> DataFrame:
    return graph.betweenness_centrality(*routes(spark, sf), pivots=500)


@query(
    "j5_subgraph",
    "SELECT 'node' AS kind, id AS a, '' AS b FROM node WHERE campaign_id = 3 UNION ALL SELECT 'edge', src, dst FROM edge "
    "WHERE src IN (SELECT id FROM node WHERE campaign_id = 3) AND dst IN (SELECT id FROM node WHERE campaign_id = 3)",
    "node", "edge",
)
def j5(spark: SparkSession, sf: str) -> DataFrame:
    return _graph_rows(*graph.induced_subgraph(*graph_tables(spark, sf), 3))


def _graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query(
    "j6_capped_graph",
    """, keep AS (SELECT id FROM (SELECT id, type, row_number() OVER (PARTITION BY campaign_id, type ORDER BY degree_centrality DESC, id) AS rn FROM degree)
 WHERE type <> 'ip' OR rn <= 1200)
SELECT 'node' AS kind, id AS a, '' AS b FROM keep UNION ALL SELECT 'edge', src, dst FROM edge WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)""",
    "degree",
)
def j6(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf)
    return _graph_rows(*graph.capped_graph(graph.degree_centrality(nodes, edges), edges, cap=1200))


_END = (
    "CASE WHEN n.type = 'ip' AND n.campaign_id = 4 THEN concat('__subnet__', replace(array_to_string(string_split(n.id, '.')[1:3], '.'), '.', '_')) "
    "WHEN n.type = 'ip' THEN NULL WHEN n.type = 'campaign' AND n.id <> 'campaign_4' THEN NULL ELSE n.id END"
)


@query(
    "j7_collapsed_graph",
    f"SELECT DISTINCT a.e AS src, b.e AS dst, relation FROM edge JOIN (SELECT id, {_END} AS e FROM node n) a ON src = a.id "
    f"JOIN (SELECT id, {_END} AS e FROM node n) b ON dst = b.id WHERE a.e <> b.e",
    "node", "edge",
)
def j7(spark: SparkSession, sf: str) -> DataFrame:
    return graph.collapsed_graph(*graph_tables(spark, sf), 4)[1]


@query(
    "j7_subnet_nodes",
    "SELECT concat('__subnet__', replace(p, '.', '_')) AS id, concat(p, '.x (', count(*), ' IPs)') AS label, count(*) AS ip_count FROM "
    "(SELECT array_to_string(string_split(id, '.')[1:3], '.') AS p FROM node WHERE type = 'ip' AND campaign_id = 4) GROUP BY p",
    "node",
)
def j7n(spark: SparkSession, sf: str) -> DataFrame:
    return graph.collapsed_graph(*graph_tables(spark, sf), 4)[0].filter("type = 'subnet'").select("id", "label", "ip_count")


@query(
    "j8_profile_graph",
    """, top AS (SELECT * FROM profile ORDER BY flow_count DESC, SrcAddr LIMIT 300)
SELECT 'node' AS kind, SrcAddr AS a, '' AS b FROM top UNION ALL SELECT DISTINCT 'node', concat(regexp_extract(SrcAddr, '^(\\d+\\.\\d+\\.\\d+)', 1), '.0'), '' FROM top
UNION ALL SELECT DISTINCT 'node', concat('atk_', label), '' FROM top UNION ALL SELECT 'edge', SrcAddr, concat(regexp_extract(SrcAddr, '^(\\d+\\.\\d+\\.\\d+)', 1), '.0') FROM top
UNION ALL SELECT 'edge', SrcAddr, concat('atk_', label) FROM top""",
    "profile",
)
def j8(spark: SparkSession, sf: str) -> DataFrame:
    return _graph_rows(*graph.profile_graph(S.profile(spark, sf), profile_campaigns(spark, sf)))


CUTOFF = "2024-06-01 06:00:00"


@query(
    "j9_visible_graph",
    f""", seen AS (SELECT id FROM node WHERE type = 'ip' AND id IN (SELECT SrcAddr FROM flows GROUP BY 1 HAVING min(StartTime) <= TIMESTAMP '{CUTOFF}'))
SELECT 'node' AS kind, id AS a, '' AS b FROM seen""",
    "node", "flows",
)
def j9(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf)
    seen = timeline.visible_at(
        nodes.filter("type = 'ip'").select(F.col("id").alias("ip")), timeline.first_seen(S.flows(spark, sf)), cutoff()
    )
    return _graph_rows(*graph.visible_subgraph(nodes, edges, seen))


def cutoff() -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{CUTOFF}'")


@query("j10_enriched_families", "SELECT campaign_id, ip, iot_family FROM enriched JOIN family USING (campaign_id)", "enriched", "family")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    entries = families.family_entries(S.flows(spark, sf), members(spark, sf))
    return graph.with_families(S.enriched(spark, sf), entries).select("campaign_id", "ip", "iot_family")


@query(
    "j11_display_labels",
    "SELECT id, CASE type WHEN 'ip' THEN array_to_string(string_split(id, '.')[3:4], '.') WHEN 'campaign' THEN concat('C', campaign_id) "
    "WHEN 'malware_family' THEN left(id, 18) ELSE id END AS label FROM node",
    "node",
)
def j11(spark: SparkSession, sf: str) -> DataFrame:
    return graph.display_labels(graph_tables(spark, sf)[0]).select("id", "label")


# ---- timeline ---------------------------------------------------------------

@query("k1_replay_timeline", "SELECT idx, t FROM step", "step")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.replay_timeline(S.flows(spark, sf))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return S.staged(spark, sf, "timeline", lambda: timeline.replay_timeline(S.flows(spark, sf)))


@query(
    "k2_replay_seed",
    """, anchor AS (SELECT min(SrcAddr) AS ip FROM camp WHERE campaign_id = 0 AND time_window = (SELECT min(time_window) FROM camp WHERE campaign_id = 0)),
span AS (SELECT min(StartTime) AS t0, max(StartTime) AS t1 FROM flows, anchor WHERE SrcAddr LIKE concat(array_to_string(string_split(ip, '.')[1:3], '.'), '.%')),
pick AS (SELECT (SELECT idx FROM step ORDER BY abs(epoch_us(t) - epoch_us(t0)), idx LIMIT 1) AS lo,
  (SELECT idx FROM step ORDER BY abs(epoch_us(t) - epoch_us(least(t0 + INTERVAL 2 HOURS, t1))), idx LIMIT 1) AS hi FROM span)
SELECT 0 AS anchor_campaign, lo AS default_idx, least((SELECT max(idx) FROM step), greatest(lo, (lo + hi) // 2)) AS mid_idx FROM pick""",
    "step", "camp",
)
def k2(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.replay_seed(S.flows(spark, sf), S.campaigns(spark, sf), _steps(spark, sf), 0)


@query(
    "k2_replay_seeds",
    """, anchor AS (SELECT campaign_id, array_to_string(string_split(arg_min(SrcAddr, (time_window, SrcAddr)), '.')[1:3], '.') AS p FROM camp GROUP BY 1),
span AS (SELECT campaign_id, min(StartTime) AS t0, max(StartTime) AS t1 FROM flows JOIN anchor ON array_to_string(string_split(SrcAddr, '.')[1:3], '.') = p GROUP BY 1),
pick AS (SELECT campaign_id, arg_min(idx, abs(epoch_us(t) - epoch_us(t0)) * 10000 + idx) AS lo,
  arg_min(idx, abs(epoch_us(t) - epoch_us(least(t0 + INTERVAL 2 HOURS, t1))) * 10000 + idx) AS hi FROM span, step GROUP BY 1)
SELECT campaign_id AS anchor_campaign, lo AS default_idx, least((SELECT max(idx) FROM step), greatest(lo, (lo + hi) // 2)) AS mid_idx FROM pick""",
    "step", "camp",
)
def k2_all(spark: SparkSession, sf: str) -> DataFrame:
    """Replay positions of every campaign; every fixture address is dotted."""
    return timeline.replay_seeds(S.flows(spark, sf), S.campaigns(spark, sf), _steps(spark, sf))


@query(
    "k2_first_seen_steps",
    "SELECT ip, arg_min(idx, abs(epoch_us(t) - epoch_us(first_seen)) * 10000 + idx) AS idx FROM "
    "(SELECT SrcAddr AS ip, min(StartTime) AS first_seen FROM flows GROUP BY 1), step GROUP BY 1",
    "step", "flows",
)
def k2_first(spark: SparkSession, sf: str) -> DataFrame:
    """Timeline step nearest to each address's first flow."""
    probes = timeline.first_seen(S.flows(spark, sf)).withColumnRenamed("first_seen", "t")
    return asof.asof_join(probes, _steps(spark, sf).select("idx", "t"), "t").select("ip", "match.idx")


@query("k3_first_seen", "SELECT SrcAddr AS ip, min(StartTime) AS first_seen FROM flows GROUP BY 1", "flows")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.first_seen(S.flows(spark, sf))


@query(
    "k4_replay_feed",
    f"""SELECT StartTime, strftime(StartTime, '%H:%M') AS clock, f.SrcAddr, DstAddr, array_to_string(string_split(f.SrcAddr, '.')[3:4], '.') AS src,
 array_to_string(string_split(DstAddr, '.')[3:4], '.') AS dst, Proto, c.campaign_id, c.attack_type,
 CASE WHEN lower(attack_type) LIKE '%bot%' OR lower(attack_type) LIKE '%mirai%' THEN 'Botnet' WHEN lower(attack_type) LIKE '%c2%' OR lower(attack_type) LIKE '%beacon%' THEN 'C2'
 WHEN lower(attack_type) LIKE '%scan%' THEN 'Scanner' ELSE left(attack_type, 16) END AS event
FROM (SELECT * FROM flows WHERE StartTime <= TIMESTAMP '{CUTOFF}' ORDER BY StartTime DESC, SrcAddr, DstAddr, Sport, Dport LIMIT 10) f
LEFT JOIN (SELECT SrcAddr, max_by(campaign_id, time_window) AS campaign_id, max_by(attack_type, time_window) AS attack_type FROM camp GROUP BY 1) c USING (SrcAddr)""",
    "flows", "camp",
)
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.replay_feed(S.flows(spark, sf), S.campaigns(spark, sf), cutoff())


@query(
    "k5_campaign_spans",
    """SELECT c.campaign_id, t0, CASE WHEN t1 <= t0 THEN t0 + INTERVAL 1 HOUR ELSE t1 END AS t1,
 (epoch(CASE WHEN t1 <= t0 THEN t0 + INTERVAL 1 HOUR ELSE t1 END) - epoch(t0))::BIGINT AS duration_s, n_ips, coalesce(confidence_pct, 0) AS confidence_pct
FROM (SELECT campaign_id, min(time_window) AS t0, max(time_window) AS t1, count(DISTINCT SrcAddr) AS n_ips FROM camp GROUP BY 1) c
LEFT JOIN doc ON doc.cluster_id = c.campaign_id""",
    "camp", "doc",
)
def k5(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.campaign_spans(S.campaigns(spark, sf), documents(spark, sf))


# ---- reports ----------------------------------------------------------------

@query(
    "l1_kpis",
    "SELECT (SELECT count(DISTINCT campaign_id) FROM camp) AS campaigns, (SELECT count(*) FROM camp WHERE label > 0) AS malicious_rows, "
    "round(avg(confidence_pct), 4) AS mean_confidence, count(*) FILTER (drift_detected) AS drifting, count(*) FILTER (confidence_pct >= 75) AS high_confidence FROM doc",
    "camp", "doc",
)
def l1(spark: SparkSession, sf: str) -> DataFrame:
    return reports.kpis(S.campaigns(spark, sf), documents(spark, sf))


TABLE = (
    "SELECT cluster_id AS campaign_id, label, attack_type, n_ips, confidence_pct, top_ttps AS top_ttp, drift_detected AS drift, cross_dataset FROM doc "
    "JOIN (SELECT campaign_id, count(DISTINCT SrcAddr) AS n_ips FROM camp GROUP BY 1) n ON n.campaign_id = doc.cluster_id"
)


@query("l2_campaign_table", TABLE, "doc", "camp")
def l2(spark: SparkSession, sf: str) -> DataFrame:
    return reports.campaign_table(S.campaigns(spark, sf), documents(spark, sf))


@query("l3_low_confidence", f"SELECT *, TRUE AS low_confidence FROM ({TABLE}) WHERE confidence_pct < 60", "doc", "camp")
def l3(spark: SparkSession, sf: str) -> DataFrame:
    return reports.low_confidence(l2(spark, sf))


@query("l4_factor_matrix", "SELECT cluster_id, B, I, T, M FROM doc", "doc")
def l4(spark: SparkSession, sf: str) -> DataFrame:
    return reports.factor_matrix(documents(spark, sf))


@query(
    "l5_profiler_points",
    """SELECT campaign_id, SrcAddr, time_window, scan_entropy, c2_beacon_score, malicious FROM (SELECT campaign_id, SrcAddr, time_window, scan_entropy, c2_beacon_score,
 label > 0 AS malicious, row_number() OVER (PARTITION BY campaign_id, label > 0 ORDER BY md5(concat_ws('|', SrcAddr, strftime(time_window, '%Y-%m-%d %H:%M:%S'), '42')), SrcAddr, time_window) AS rn
 FROM camp WHERE scan_entropy IS NOT NULL AND c2_beacon_score IS NOT NULL) WHERE malicious OR rn <= 4000""",
    "camp",
)
def l5(spark: SparkSession, sf: str) -> DataFrame:
    return reports.profiler_points(S.campaigns(spark, sf))


@query(
    "l6_report_campaigns",
    """SELECT cluster_id AS campaign_id, attack_type, confidence_pct, CASE WHEN confidence_pct < 50 THEN 'low' WHEN confidence_pct < 75 THEN 'medium' ELSE 'high' END AS confidence_band,
 n_ips AS ip_count, coalesce(e.n, 0) AS listed_ips, coalesce(d.n, 0) AS drift_windows FROM doc
 JOIN (SELECT campaign_id, count(DISTINCT SrcAddr) AS n_ips FROM camp GROUP BY 1) n ON n.campaign_id = doc.cluster_id
 LEFT JOIN (SELECT campaign_id, count(*) AS n FROM enriched GROUP BY 1) e ON e.campaign_id = doc.cluster_id
 LEFT JOIN (SELECT campaign_id, count(*) AS n FROM drift GROUP BY 1) d ON d.campaign_id = doc.cluster_id WHERE confidence_pct >= 30 AND cluster_id IN (0, 1, 3, 4)""",
    "doc", "camp", "enriched", "drift",
)
def l6(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.report_campaigns(
        S.campaigns(spark, sf), documents(spark, sf), S.enriched(spark, sf), drift_table(spark, sf),
        campaigns=[0, 1, 3, 4], min_confidence=30, include=["ips", "drift"],
    )
    return out.select(
        "campaign_id", "attack_type", "confidence_pct", "confidence_band", "ip_count",
        F.coalesce(F.array_size("enriched_ips"), F.lit(0)).cast("bigint").alias("listed_ips"),
        F.coalesce(F.array_size("drift_windows"), F.lit(0)).cast("bigint").alias("drift_windows"),
    )


@query(
    "l6_report_dataset",
    "SELECT count(*) AS total_flows, count(DISTINCT SrcAddr) AS unique_source_ips, (SELECT count(*) FROM camp) AS fingerprints, (SELECT count(*) FROM doc) AS campaigns_total, "
    "(SELECT count(*) FROM doc WHERE confidence_pct >= 30) AS campaigns_selected, (SELECT count(DISTINCT ip) FROM enriched) AS enriched_ips FROM flows",
    "flows", "camp", "doc", "enriched",
)
def l6d(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    selected = reports.report_campaigns(S.campaigns(spark, sf), docs, min_confidence=30)
    return reports.report_dataset(S.flows(spark, sf), S.campaigns(spark, sf), docs, S.enriched(spark, sf), selected)


@query(
    "l7_contributions",
    "SELECT cluster_id, 'B' AS factor, 'Behavioral cohesion' AS description, B AS value, 0.35::DOUBLE AS weight, round(B * 0.35, 4) AS contribution FROM doc UNION ALL "
    "SELECT cluster_id, 'I', 'Infrastructure overlap', I, 0.25, round(I * 0.25, 4) FROM doc UNION ALL SELECT cluster_id, 'T', 'Timing correlation', T, 0.2, round(T * 0.2, 4) FROM doc UNION ALL "
    "SELECT cluster_id, 'M', 'Threat-intel match', M, 0.2, round(M * 0.2, 4) FROM doc",
    "doc",
)
def l7(spark: SparkSession, sf: str) -> DataFrame:
    return reports.contribution_lines(documents(spark, sf))


@query(
    "l8_run_summary",
    "SELECT 'flows' AS metric, count(*) AS value FROM flows UNION ALL SELECT 'fingerprints', count(*) FROM camp UNION ALL SELECT 'source_ips', count(DISTINCT SrcAddr) FROM camp "
    "UNION ALL SELECT 'feature_columns', 19 UNION ALL SELECT 'clusters', count(DISTINCT campaign_id) FROM camp UNION ALL SELECT 'enriched_ips', count(DISTINCT ip) FROM enriched "
    "UNION ALL SELECT 'iot_families', count(DISTINCT iot_family) FROM family UNION ALL SELECT 'nodes', count(*) FROM node UNION ALL SELECT 'edges', count(*) FROM edge",
    "flows", "camp", "enriched", "family", "node", "edge",
)
def l8(spark: SparkSession, sf: str) -> DataFrame:
    entries = families.family_entries(S.flows(spark, sf), members(spark, sf))
    return reports.run_summary(S.flows(spark, sf), S.campaigns(spark, sf), S.enriched(spark, sf), entries, *graph_tables(spark, sf))


@query(
    "l9_node_details",
    f"SELECT ip, campaign_id, campaign_type, threat_level, vt_malicious, abuse_score, asn, country, matches, "
    "CASE WHEN score > 0.2 THEN 'Strong' WHEN score > 0.08 THEN 'Moderate' ELSE 'Weak' END AS beacon "
    f"FROM enriched LEFT JOIN ({LINES}) USING (ip) LEFT JOIN (SELECT campaign_id, avg(coalesce(c2_beacon_score, 0)) AS score FROM camp GROUP BY 1) USING (campaign_id)",
    "enriched", "member", "indicator", "camp",
)
def l9(spark: SparkSession, sf: str) -> DataFrame:
    matches = enrichment.indicator_matches(S.campaigns(spark, sf), fixture.indicator_table(spark, sf), first=None)
    return reports.node_details(S.enriched(spark, sf), matches, S.campaigns(spark, sf))


@query(
    "l10_malicious_addresses",
    f"SELECT SrcAddr AS ip, label, regexp_extract(SrcAddr, '^(\\d+\\.\\d+\\.\\d+)', 1) AS subnet, campaign_id, flow_count, round(payload_asymmetry, 4) AS payload_asymmetry "
    f"FROM profile WHERE {HOSTILE} ORDER BY flow_count DESC, SrcAddr LIMIT 200",
    "profile",
)
def l10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.malicious_addresses(S.profile(spark, sf)), "payload_asymmetry")


@query(
    "l10_top_subnets",
    f"SELECT regexp_extract(SrcAddr, '^(\\d+\\.\\d+\\.\\d+)', 1) AS subnet, count(*) AS count FROM profile WHERE {HOSTILE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "profile",
)
def l10s(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_subnets(S.profile(spark, sf))


@query(
    "l10_top_labels",
    "SELECT CASE WHEN length(label) > 24 THEN concat(left(label, 24), '…') ELSE label END AS label, count FROM (SELECT label, count(*) AS count FROM profile GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)",
    "profile",
)
def l10l(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_label_counts(S.profile(spark, sf))


@query("l11_search_campaigns", "SELECT campaign_id, ip_count, dominant_subnet, top_label FROM pcamp WHERE lower(top_label) LIKE '%bot%' OR dominant_subnet LIKE '%bot%'", "pcamp")
def l11(spark: SparkSession, sf: str) -> DataFrame:
    return reports.search_campaigns(profile_campaigns(spark, sf), "Bot").select("campaign_id", "ip_count", "dominant_subnet", "top_label")


@query("l12_search_addresses", "SELECT SrcAddr FROM profile WHERE SrcAddr LIKE '%0.0.1%' ORDER BY 1 LIMIT 12", "profile")
def l12(spark: SparkSession, sf: str) -> DataFrame:
    return reports.search_addresses(S.profile(spark, sf), "0.0.1")


@query("l12_search_indexed", "SELECT SrcAddr FROM profile WHERE SrcAddr LIKE '%0.0.1%' ORDER BY 1 LIMIT 12", "profile")
def l12i(spark: SparkSession, sf: str) -> DataFrame:
    return reports.search_indexed(_address_index(spark, sf), "0.0.1")


@query("l12_addresses_holding", "SELECT SrcAddr FROM profile WHERE SrcAddr LIKE '%.11%'", "profile")
def l12all(spark: SparkSession, sf: str) -> DataFrame:
    """Every address that holds a text, from the index."""
    return _address_index(spark, sf).search(".11").select(F.col("text").alias("SrcAddr"))


def _address_index(spark: SparkSession, sf: str) -> grams.GramIndex:
    return grams.GramIndex.build(S.profile(spark, sf), "SrcAddr")


@query(
    "l13_overview",
    "SELECT sum(ip_count)::BIGINT AS total_ips, count(*) AS campaigns, count(*) FILTER (confidence >= 0.8) AS high_confidence FROM pcamp", "pcamp",
)
def l13(spark: SparkSession, sf: str) -> DataFrame:
    return reports.overview(profile_campaigns(spark, sf))


@query(
    "l13_tiers",
    "SELECT concat('C', campaign_id) AS name, round(confidence * 100, 1) AS confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS tier FROM pcamp",
    "pcamp",
)
def l13t(spark: SparkSession, sf: str) -> DataFrame:
    return reports.campaign_tiers(profile_campaigns(spark, sf))


@query(
    "l14_address_features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round({c}::DOUBLE, 4) AS raw, round(v[{i + 1}], 4) AS normalised FROM profile WHERE SrcAddr = '13.0.0.4'"
        for i, c in enumerate(PROFILE_SQL)
    ),
    "profile",
)
def l14(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.address_features(S.profile(spark, sf), "13.0.0.4"), "raw", "normalised")


@query("l15_members", "SELECT SrcAddr FROM profile WHERE campaign_id = 3 ORDER BY 1 LIMIT 100", "profile")
def l15(spark: SparkSession, sf: str) -> DataFrame:
    return reports.campaign_members(S.profile(spark, sf), 3)


# ---- sampling and scalars ---------------------------------------------------

ROW_KEY = ["SrcAddr", "DstAddr", "Sport", "Dport", "TotPkts", "SrcBytes", "DstBytes", "Proto", "micros", "State", "Label_raw", "SubLabel", "eighths"]
_ROW_SQL = f"concat_ws('|', {', '.join(ROW_KEY)}, '42')"
_ROWS_SQL = f"""SELECT {', '.join(ROW_KEY)} FROM (SELECT *, epoch_us(StartTime) AS micros, (Dur * 8)::BIGINT AS eighths FROM flows)
ORDER BY md5({_ROW_SQL}), {', '.join(ROW_KEY)} LIMIT 50000"""


def _keyed_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows with every column as text or whole number; together they are a row's key."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', StartTime)")
    return S.flows(spark, sf).withColumns({"micros": micros, "eighths": (F.col("Dur") * 8).cast("bigint")}).select(*ROW_KEY)


@query("r1_reservoir", _ROWS_SQL, "flows")
def r1(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.reservoir(_keyed_flows(spark, sf), ROW_KEY, limit=50_000)


@query("r1_reservoir_incremental", _ROWS_SQL, "flows")
def r1i(spark: SparkSession, sf: str) -> DataFrame:
    flows = _keyed_flows(spark, sf)
    folder = fresh_path(spark, "arriving")
    flows.write.parquet(folder)
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    sampler = StreamSampler(ROW_KEY, limit=50_000)
    sampler.start(stream).awaitTermination()
    return sampler.result(flows)


@query(
    "r2_vector_scalars",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 4) + 0.0 AS cosine, round(list_distance(a.v, b.v), 4) AS euclid,
 round((SELECT corr(x, y) FROM (SELECT unnest(a.v) AS x, unnest(b.v) AS y)), 4) + 0.0 AS pearson,
 round((SELECT stddev_pop(x) / avg(x) FROM (SELECT unnest(list_transform(a.v, lambda q: q * q)) AS x)), 4) AS cov,
 round((SELECT -sum(p * log2(p)) FROM (SELECT x / sum(x) OVER () AS p FROM (SELECT unnest(list_transform(a.v, lambda q: q * q)) AS x))), 4) AS bits
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""",
)
def r2(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    pairs = e.select("vec_id", "features").join(
        e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("features").alias("other")), "vec_id"
    ).withColumn("squares", F.transform("features", lambda x: x * x))
    return pairs.select(
        "vec_id", (F.round(V.cosine("features", "other"), 4) + 0.0).alias("cosine"), F.round(V.euclidean("features", "other"), 4).alias("euclid"),
        (F.round(V.pearson("features", "other"), 4) + 0.0).alias("pearson"), F.round(V.coefficient_of_variation("squares"), 4).alias("cov"),
        F.round(V.shannon_bits("squares"), 4).alias("bits"),
    )


@query(
    "r3_mode",
    "SELECT SrcAddr, Dport FROM (SELECT SrcAddr, Dport, row_number() OVER (PARTITION BY SrcAddr ORDER BY count(*) DESC, Dport) AS rn FROM flows GROUP BY 1, 2) WHERE rn = 1",
    "flows",
)
def r3(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.most_common(S.flows(spark, sf), ["SrcAddr"], "Dport")


@query(
    "g10_rule_codes", "SELECT DISTINCT attack_type, campaign_id FROM camp", "camp",
)
def codes(spark: SparkSession, sf: str) -> DataFrame:
    fp = S.fingerprint_table(spark, sf)
    return fp.select("attack_type", rules.attack_code(F.col("attack_type")).alias("campaign_id")).distinct()
