"""Flow, intelligence and indicator tables derived from the TPC-H-like tables.

The given tables hold no flows, so the contract queries read this view. It is
made of row-wise projections only (no window, no join, no shuffle): order keys
are dense, which gives regular beacons and sweeps by arithmetic, and line items
give irregular traffic. ``FIXTURES.md`` lists the columns. Every address, hour
and flow count grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'2024-06-01 00:00:00'"

# Row-wise SQL shared in shape with the check SQL in checks.py.
_LINE_ADDRESS = (
    "concat_ws('.', 10 + {k} % 10, ({k} div 62500) % 250, ({k} div 250) % 250, {k} % 250 + 1)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_address(key: str) -> str:
    return _LINE_ADDRESS.format(k=key)


def _line_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS sk", "l_partkey AS pk", "l_orderkey AS ok", "l_linenumber AS ln",
        "l_suppkey % 10 AS m", "concat(l_returnflag, l_linestatus) AS st",
    )
    return t.selectExpr(
        f"timestampadd(MICROSECOND, ((ok * 7919 + pk * 613 + ln * 101) % 129600) * 1000000"
        f" + (pk * 7919 + ok) % 1000000, {EPOCH}) AS StartTime",
        f"{supplier_address('sk')} AS SrcAddr",
        "CAST(CASE WHEN m IN (5, 6) AND pk % 3 = 0 THEN 53 WHEN pk % 11 = 0 THEN 1024"
        " ELSE 1025 + (pk * 7919) % 60000 END AS INT) AS Sport",
        "CASE WHEN m = 3 THEN concat('203.0.113.', pk % 2 + 5)"
        " ELSE concat_ws('.', 172, 16 + (pk div 62500) % 4, (pk div 250) % 250, pk % 250 + 1) END AS DstAddr",
        "CAST(CASE WHEN m = 3 THEN 443 WHEN m = 4 AND pk % 5 > 0 THEN 7547"
        " ELSE element_at(array(80, 443, 53, 8080), CAST(pk % 4 AS INT) + 1) END AS INT) AS Dport",
        "CASE WHEN m <= 4 OR ln % 3 <> 0 THEN ' TCP' WHEN m = 9 AND ln = 6 THEN 'arp'"
        " WHEN m = 8 AND ln = 6 THEN 'rtp' WHEN ln % 6 = 0 THEN 'icmp' ELSE 'UDP ' END AS Proto",
        "(pk % 64) / 8.0D AS Dur",
        "CASE WHEN m = 3 THEN 50000 + pk % 1000 ELSE 100 + pk % 200 END AS SrcBytes",
        "CASE WHEN m = 3 THEN 100 ELSE 90 + pk % 170 END AS DstBytes",
        "1 + pk % 20 AS TotPkts",
        "CASE st WHEN 'NO' THEN 'CON' WHEN 'NF' THEN 'INT' WHEN 'RF' THEN 'RST' WHEN 'RO' THEN 'FSPA_FSPA'"
        " ELSE 'URP' END AS State",
        "CASE WHEN m <= 3 AND ok % 10 <> 0 THEN concat('flow=From-Botnet-V4', m, '-TCP-Attempt')"
        " ELSE 'flow=Background' END AS Label",
        "CASE WHEN m = 5 THEN 'PartOfAHorizontalPortScan' WHEN m = 6 THEN 'C&C-Torii'"
        " WHEN m >= 7 AND pk % 2 = 0 THEN 'Okiru' WHEN m >= 7 THEN '-' ELSE '' END AS SubLabel",
        "CASE WHEN m <= 4 OR (m >= 8 AND ln % 2 = 0) THEN 'CTU-13' ELSE 'IoT-23' END AS DatasetSource",
    )


def _order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_custkey AS c", "o_orderkey % 5 AS r", "o_orderkey div 5 AS j",
    )
    # r=0 beacons (240 flows, 30 s apart), r=1 host sweeps (600, 12 s),
    # r=2 port sweeps (360, 20 s), else: customers, most of them seen once an hour.
    t = t.selectExpr(
        "*",
        "CASE r WHEN 0 THEN j div 240 WHEN 1 THEN j div 600 WHEN 2 THEN j div 360 ELSE c END AS b",
        "CASE r WHEN 0 THEN j % 240 WHEN 1 THEN j % 600 WHEN 2 THEN j % 360 ELSE 0 END AS p",
    )
    return t.selectExpr(
        f"timestampadd(MICROSECOND, (CASE r WHEN 0 THEN (b * 5 % 30) * 3600 + p * 30 + k % 3"
        f" WHEN 1 THEN (b * 7 % 30) * 3600 + p * 12 WHEN 2 THEN (b * 11 % 30) * 3600 + p * 20"
        f" ELSE (k * 7907 + c * 31) % 129600 END) * 1000000, {EPOCH}) AS StartTime",
        "concat_ws('.', CASE WHEN r <= 2 THEN 20 + r ELSE 100 END, (b div 62500) % 250, (b div 250) % 250,"
        " b % 250 + 1) AS SrcAddr",
        "CAST(CASE WHEN r = 2 THEN 53 ELSE 1025 + k % 60000 END AS INT) AS Sport",
        "CASE r WHEN 0 THEN concat('203.0.113.', b % 2 + 5)"
        " WHEN 1 THEN concat_ws('.', 172, 20 + p div 250, b % 250, p % 250 + 1)"
        " WHEN 2 THEN concat('198.51.100.', p % 3 + 1)"
        " ELSE concat_ws('.', 172, 16, (k div 250) % 250, k % 250 + 1) END AS DstAddr",
        "CAST(CASE r WHEN 0 THEN 443 WHEN 1 THEN IF(k % 2 = 0, 23, 2323) WHEN 2 THEN 1000 + p"
        " ELSE element_at(array(80, 443, 53, 8080), CAST(k % 4 AS INT) + 1) END AS INT) AS Dport",
        "CASE WHEN r <= 2 OR k % 3 > 0 THEN 'tcp' ELSE 'udp' END AS Proto",
        "(k % 32) / 8.0D AS Dur",
        "CASE r WHEN 0 THEN 110 ELSE 100 + k % 300 END AS SrcBytes",
        "CASE r WHEN 0 THEN 740 ELSE 80 + k % 190 END AS DstBytes",
        "1 + k % 12 AS TotPkts",
        "CASE WHEN r <= 2 THEN 'INT' ELSE 'CON' END AS State",
        "CASE WHEN r = 0 THEN 'flow=From-Botnet-V50-TCP-CC' WHEN r <= 2 THEN 'flow=To-Botnet-V51'"
        " WHEN k % 7 = 0 THEN 'an unclassified capture label longer than 32 characters'"
        " ELSE 'flow=Background' END AS Label",
        "CASE WHEN r = 0 AND b % 2 = 1 THEN 'C&C-HeartBeat' WHEN r = 1 THEN 'PartOfAHorizontalPortScan'"
        " ELSE '' END AS SubLabel",
        "CASE WHEN r = 1 OR (r = 0 AND b % 2 = 1) THEN 'IoT-23' ELSE 'CTU-13' END AS DatasetSource",
    )


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned flows: two sources with the same columns, text labels."""
    return _line_flows(spark, sf_dir).unionByName(_order_flows(spark, sf_dir))


def intel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One intelligence row per supplier address; every seventh is missing."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 7 <> 0")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return s.join(n, s.s_nationkey == n.n_nationkey).selectExpr(
        f"{supplier_address('s_suppkey')} AS ip",
        "s_suppkey % 8 AS vt_malicious",
        "s_suppkey % 3 AS vt_suspicious",
        "(s_suppkey * 37) % 100 AS abuse_score",
        "concat('AS', 64496 + s_nationkey % 3, ' NET-', s_nationkey) AS asn",
        "n_name AS country",
        "'23,80' AS shodan_ports",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'telnet' ELSE '' END AS shodan_tags",
    )


def indicator_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator rows: up to eight events for every fifth supplier address."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 = 0")
    return s.selectExpr(
        f"{supplier_address('s_suppkey')} AS ip", "s_suppkey",
        "explode(sequence(0L, s_suppkey % 8)) AS i",
    ).selectExpr("ip", "concat('EVT-', s_suppkey % 4, '-', i) AS event", "CAST(s_suppkey % 3 AS STRING) AS tlp")
