"""Check SQL (DuckDB dialect): the same results, written independently.

Each check is one ``WITH`` chain over the given tables. The building blocks are
named CTEs; a check lists the ones it needs by name and dependencies follow.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


def chain(query: str, *needs: str) -> str:
    """Prefix a query with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in CTES[name][1]:
                visit(dep)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return query
    with_list = "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order)
    # A query that starts with a comma goes on with CTEs of its own.
    return with_list + ("" if query.startswith(",") else "\n") + query


def address(k: str) -> str:
    return (
        f"concat_ws('.', 10 + {k} % 10, ({k} // 62500) % 250, ({k} // 250) % 250, {k} % 250 + 1)"
    )


cte(
    "raw",
    f"""
SELECT TIMESTAMP '2024-06-01' + to_microseconds(((ok * 7919 + pk * 613 + ln * 101) % 129600) * 1000000
         + (pk * 7919 + ok) % 1000000) AS StartTime,
  {address('sk')} AS SrcAddr,
  CASE WHEN m IN (5, 6) AND pk % 3 = 0 THEN 53 WHEN pk % 11 = 0 THEN 1024 ELSE 1025 + (pk * 7919) % 60000 END AS Sport,
  CASE WHEN m = 3 THEN concat('203.0.113.', pk % 2 + 5)
       ELSE concat_ws('.', 172, 16 + (pk // 62500) % 4, (pk // 250) % 250, pk % 250 + 1) END AS DstAddr,
  CASE WHEN m = 3 THEN 443 WHEN m = 4 AND pk % 5 > 0 THEN 7547 ELSE ([80, 443, 53, 8080])[pk % 4 + 1] END AS Dport,
  CASE WHEN m <= 4 OR ln % 3 <> 0 THEN ' TCP' WHEN m = 9 AND ln = 6 THEN 'arp' WHEN m = 8 AND ln = 6 THEN 'rtp'
       WHEN ln % 6 = 0 THEN 'icmp' ELSE 'UDP ' END AS Proto,
  (pk % 64) / 8.0::DOUBLE AS Dur,
  CASE WHEN m = 3 THEN 50000 + pk % 1000 ELSE 100 + pk % 200 END AS SrcBytes,
  CASE WHEN m = 3 THEN 100 ELSE 90 + pk % 170 END AS DstBytes,
  1 + pk % 20 AS TotPkts,
  CASE st WHEN 'NO' THEN 'CON' WHEN 'NF' THEN 'INT' WHEN 'RF' THEN 'RST' WHEN 'RO' THEN 'FSPA_FSPA' ELSE 'URP' END AS State,
  CASE WHEN m <= 3 AND ok % 10 <> 0 THEN concat('flow=From-Botnet-V4', m, '-TCP-Attempt') ELSE 'flow=Background' END AS Label,
  CASE WHEN m = 5 THEN 'PartOfAHorizontalPortScan' WHEN m = 6 THEN 'C&C-Torii'
       WHEN m >= 7 AND pk % 2 = 0 THEN 'Okiru' WHEN m >= 7 THEN '-' ELSE '' END AS SubLabel,
  CASE WHEN m <= 4 OR (m >= 8 AND ln % 2 = 0) THEN 'CTU-13' ELSE 'IoT-23' END AS DatasetSource
FROM (SELECT l_suppkey AS sk, l_partkey AS pk, l_orderkey AS ok, l_linenumber AS ln, l_suppkey % 10 AS m,
             concat(l_returnflag, l_linestatus) AS st FROM lineitem)
UNION ALL
SELECT TIMESTAMP '2024-06-01' + to_microseconds((CASE r WHEN 0 THEN (b * 5 % 30) * 3600 + p * 30 + k % 3
         WHEN 1 THEN (b * 7 % 30) * 3600 + p * 12 WHEN 2 THEN (b * 11 % 30) * 3600 + p * 20
         ELSE (k * 7907 + c * 31) % 129600 END) * 1000000),
  concat_ws('.', CASE WHEN r <= 2 THEN 20 + r ELSE 100 END, (b // 62500) % 250, (b // 250) % 250, b % 250 + 1),
  CASE WHEN r = 2 THEN 53 ELSE 1025 + k % 60000 END,
  CASE r WHEN 0 THEN concat('203.0.113.', b % 2 + 5)
         WHEN 1 THEN concat_ws('.', 172, 20 + p // 250, b % 250, p % 250 + 1)
         WHEN 2 THEN concat('198.51.100.', p % 3 + 1)
         ELSE concat_ws('.', 172, 16, (k // 250) % 250, k % 250 + 1) END,
  CASE r WHEN 0 THEN 443 WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 23 ELSE 2323 END WHEN 2 THEN 1000 + p
         ELSE ([80, 443, 53, 8080])[k % 4 + 1] END,
  CASE WHEN r <= 2 OR k % 3 > 0 THEN 'tcp' ELSE 'udp' END,
  (k % 32) / 8.0::DOUBLE,
  CASE r WHEN 0 THEN 110 ELSE 100 + k % 300 END,
  CASE r WHEN 0 THEN 740 ELSE 80 + k % 190 END,
  1 + k % 12,
  CASE WHEN r <= 2 THEN 'INT' ELSE 'CON' END,
  CASE WHEN r = 0 THEN 'flow=From-Botnet-V50-TCP-CC' WHEN r <= 2 THEN 'flow=To-Botnet-V51'
       WHEN k % 7 = 0 THEN 'an unclassified capture label longer than 32 characters' ELSE 'flow=Background' END,
  CASE WHEN r = 0 AND b % 2 = 1 THEN 'C&C-HeartBeat' WHEN r = 1 THEN 'PartOfAHorizontalPortScan' ELSE '' END,
  CASE WHEN r = 1 OR (r = 0 AND b % 2 = 1) THEN 'IoT-23' ELSE 'CTU-13' END
FROM (SELECT *, CASE r WHEN 0 THEN j // 240 WHEN 1 THEN j // 600 WHEN 2 THEN j // 360 ELSE c END AS b,
             CASE r WHEN 0 THEN j % 240 WHEN 1 THEN j % 600 WHEN 2 THEN j % 360 ELSE 0 END AS p
      FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 5 AS r, o_orderkey // 5 AS j FROM orders))
""",
)

cte(
    "labelled",
    """
SELECT StartTime, SrcAddr, Sport::INT AS Sport, DstAddr, Dport::INT AS Dport, lower(trim(Proto)) AS Proto, Dur,
       SrcBytes::BIGINT AS SrcBytes, DstBytes::BIGINT AS DstBytes, (SrcBytes + DstBytes)::BIGINT AS TotBytes,
       TotPkts::BIGINT AS TotPkts, State, Label AS Label_raw, SubLabel, DatasetSource,
       CASE WHEN regexp_matches(Label, 'Botnet|Attack|Malicious|PortScan|C&C|C2', 'i') THEN 1 ELSE 0 END AS is_malicious
FROM raw
""",
    "raw",
)
cte("flows", "SELECT DISTINCT * FROM labelled", "labelled")

cte(
    "fp_raw",
    """
SELECT a.SrcAddr, a.time_window, a.conn_count, a.unique_dst_ips, a.unique_dst_ports, p.h AS proto_entropy,
  a.avg_duration, a.avg_bytes, a.bytes_per_packet, a.unique_dst_ips / a.conn_count AS scan_score, a.night_ratio,
  CASE WHEN a.conn_count < 2 THEN 0.0 ELSE g.sd END AS burst_score, a.src_bytes_ratio, a.device_role_score,
  d.h AS scan_entropy,
  CASE WHEN a.conn_count < 2 THEN 1.0 WHEN g.mu <= 1e-9 THEN 0.0 ELSE g.sp / g.mu END AS c2_beacon_score,
  a.protocol_diversity, a.iot_port_affinity, a.payload_asymmetry,
  CASE WHEN a.unique_dst_ips > 50 AND a.unique_dst_ports < 3 THEN 1 ELSE 0 END AS horizontal_scan_flag,
  CASE WHEN a.unique_dst_ports > 20 AND a.unique_dst_ips < 5 THEN 1 ELSE 0 END AS vertical_scan_flag,
  a.label, a.dataset_source
FROM (SELECT SrcAddr, date_trunc('hour', StartTime) AS time_window, count(*) AS conn_count,
        count(DISTINCT DstAddr) AS unique_dst_ips, count(DISTINCT Dport) AS unique_dst_ports,
        avg(Dur) AS avg_duration, avg(TotBytes) AS avg_bytes, avg(TotBytes) / avg(TotPkts) AS bytes_per_packet,
        avg(CASE WHEN hour(StartTime) < 6 THEN 1.0 ELSE 0.0 END) AS night_ratio,
        sum(SrcBytes)::DOUBLE / sum(TotBytes)::DOUBLE AS src_bytes_ratio,
        CASE WHEN count(*) FILTER (Sport <> 1024) = 0 THEN 0.5
             ELSE count(*) FILTER (Sport < 1024) / count(*) FILTER (Sport <> 1024) END AS device_role_score,
        count(DISTINCT Proto) AS protocol_diversity,
        count(*) FILTER (Dport IN (23, 2323, 7547, 8080, 8443, 5555, 48101, 37215)) / count(*) AS iot_port_affinity,
        avg(SrcBytes) / avg(DstBytes) AS payload_asymmetry,
        CASE WHEN sum(is_malicious) * 2 > count(*) THEN 1 ELSE 0 END AS label,
        CASE WHEN count(DISTINCT DatasetSource) = 1 THEN min(DatasetSource) ELSE 'Mixed' END AS dataset_source
      FROM flows GROUP BY 1, 2) a
JOIN (SELECT SrcAddr, time_window, -sum(c / n * ln(c / n)) + 0.0 AS h FROM
       (SELECT SrcAddr, date_trunc('hour', StartTime) AS time_window, count(*) AS c,
               sum(count(*)) OVER (PARTITION BY SrcAddr, date_trunc('hour', StartTime)) AS n
        FROM flows GROUP BY SrcAddr, date_trunc('hour', StartTime), Proto) GROUP BY 1, 2) p USING (SrcAddr, time_window)
JOIN (SELECT SrcAddr, time_window, -sum(c / n * log2(c / n)) + 0.0 AS h FROM
       (SELECT SrcAddr, date_trunc('hour', StartTime) AS time_window, count(*) AS c,
               sum(count(*)) OVER (PARTITION BY SrcAddr, date_trunc('hour', StartTime)) AS n
        FROM flows GROUP BY SrcAddr, date_trunc('hour', StartTime), DstAddr) GROUP BY 1, 2) d USING (SrcAddr, time_window)
JOIN (SELECT SrcAddr, time_window, avg(gap) AS mu, stddev_pop(gap) AS sp, stddev_samp(gap) AS sd FROM
       (SELECT SrcAddr, date_trunc('hour', StartTime) AS time_window,
               (epoch_us(StartTime) - epoch_us(lag(StartTime) OVER (
                  PARTITION BY SrcAddr, date_trunc('hour', StartTime) ORDER BY StartTime))) / 1e6 AS gap
        FROM flows) GROUP BY 1, 2) g USING (SrcAddr, time_window)
""",
    "flows",
)

cte(
    "fp",
    """
SELECT SrcAddr, time_window, dataset_source, conn_count, unique_dst_ips, unique_dst_ports,
  round(proto_entropy, 4) AS proto_entropy, round(avg_duration, 4) AS avg_duration, round(avg_bytes, 4) AS avg_bytes,
  round(bytes_per_packet, 4) AS bytes_per_packet, round(scan_score, 4) AS scan_score, round(night_ratio, 4) AS night_ratio,
  round(burst_score, 4) AS burst_score, round(src_bytes_ratio, 4) AS src_bytes_ratio,
  round(device_role_score, 4) AS device_role_score, round(scan_entropy, 4) AS scan_entropy,
  round(c2_beacon_score, 4) AS c2_beacon_score, protocol_diversity, round(iot_port_affinity, 4) AS iot_port_affinity,
  round(payload_asymmetry, 4) AS payload_asymmetry, horizontal_scan_flag, vertical_scan_flag, label,
  CASE WHEN c2_beacon_score < 0.3 AND payload_asymmetry < 0.5 THEN 'C2_Beaconing'
       WHEN scan_entropy > 3.5 AND horizontal_scan_flag = 1 THEN 'Horizontal_PortScan'
       WHEN vertical_scan_flag = 1 THEN 'Vertical_PortScan'
       WHEN iot_port_affinity > 0.6 THEN 'IoT_Malware'
       WHEN payload_asymmetry > 10 THEN 'Data_Exfiltration' ELSE 'Unknown' END AS attack_type
FROM fp_raw
""",
    "fp_raw",
)

FEATURE_SQL = [
    "conn_count", "unique_dst_ips", "unique_dst_ports", "proto_entropy", "avg_duration", "avg_bytes",
    "bytes_per_packet", "scan_score", "night_ratio", "burst_score", "src_bytes_ratio", "device_role_score",
    "scan_entropy", "c2_beacon_score", "protocol_diversity", "iot_port_affinity", "payload_asymmetry",
    "horizontal_scan_flag", "vertical_scan_flag",
]
SCALED = FEATURE_SQL[:11]

cte(
    "camp",
    "SELECT f.SrcAddr, f.time_window, f.dataset_source, "
    + ", ".join(
        f"(f.{c}::DOUBLE - r.lo_{c}) / CASE WHEN r.hi_{c} = r.lo_{c} THEN 1.0 ELSE r.hi_{c} - r.lo_{c} END AS {c}"
        for c in SCALED
    )
    + ", " + ", ".join(f"f.{c}" for c in FEATURE_SQL[11:])
    + """, f.label, f.attack_type,
  CASE f.attack_type WHEN 'C2_Beaconing' THEN 0 WHEN 'Data_Exfiltration' THEN 1 WHEN 'Horizontal_PortScan' THEN 2
       WHEN 'IoT_Malware' THEN 3 WHEN 'Unknown' THEN 4 ELSE 5 END AS campaign_id
FROM fp f, (SELECT """
    + ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}" for c in SCALED)
    + " FROM fp) r",
    "fp",
)
cte("member", "SELECT DISTINCT campaign_id, SrcAddr FROM camp", "camp")
cte(
    "intel",
    f"""SELECT {address('s_suppkey')} AS ip, s_suppkey % 8 AS vt_malicious, s_suppkey % 3 AS vt_suspicious,
  (s_suppkey * 37) % 100 AS abuse_score, concat('AS', 64496 + s_nationkey % 3, ' NET-', s_nationkey) AS asn,
  n_name AS country, '23,80' AS shodan_ports, CASE WHEN s_suppkey % 2 = 0 THEN 'telnet' ELSE '' END AS shodan_tags
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0""",
)
cte(
    "indicator",
    f"""SELECT {address('s_suppkey')} AS ip, concat('EVT-', s_suppkey % 4, '-', i) AS event,
  (s_suppkey % 3)::VARCHAR AS tlp FROM (SELECT s_suppkey, unnest(range(0, s_suppkey % 8 + 1)) AS i FROM supplier
  WHERE s_suppkey % 5 = 0)""",
)
cte(
    "summary",
    "SELECT *, CASE WHEN scan_score > 0.5 THEN 'Reconnaissance / Scanning' WHEN burst_score > 0.6 THEN "
    "'Botnet C2 Communication' WHEN conn_count > 0.7 AND avg_bytes < 0.3 THEN 'DDoS / Flood' WHEN src_bytes_ratio > 0.7 "
    "THEN 'Data Exfiltration' ELSE 'Benign / Unknown' END AS campaign_type FROM (SELECT campaign_id, "
    + ", ".join(f"round(avg({c}), 4) AS {c}" for c in FEATURE_SQL)
    + ", count(*) AS fingerprint_count, count(DISTINCT SrcAddr) AS ip_count FROM camp GROUP BY campaign_id)",
    "camp",
)
cte(
    "technique",
    """SELECT * FROM (VALUES
 ('Reconnaissance / Scanning', 'T1046', 'Network Service Discovery', 'Discovery'),
 ('Botnet C2 Communication', 'T1071', 'Application Layer Protocol (C2)', 'Command and Control'),
 ('DDoS / Flood', 'T1499', 'Endpoint Denial of Service', 'Impact'),
 ('Data Exfiltration', 'T1041', 'Exfiltration Over C2 Channel', 'Exfiltration'),
 ('Benign / Unknown', 'N/A', 'N/A', 'N/A')) t(campaign_type, technique_id, technique_name, tactic)""",
)
cte(
    "chosen",
    """SELECT campaign_id, SrcAddr, label, conn_count FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY label DESC, conn_count DESC, SrcAddr) AS rn FROM (
    SELECT campaign_id, SrcAddr, label, conn_count, row_number() OVER (
      PARTITION BY campaign_id, SrcAddr ORDER BY label DESC, conn_count DESC) AS r1 FROM camp) WHERE r1 = 1)
WHERE rn <= 25""",
    "camp",
)
cte(
    "enriched",
    """SELECT c.campaign_id, s.campaign_type, c.SrcAddr AS ip, coalesce(i.vt_malicious, 0) AS vt_malicious,
  coalesce(i.vt_suspicious, 0) AS vt_suspicious, coalesce(i.abuse_score, 0) AS abuse_score, coalesce(i.asn, '') AS asn,
  coalesce(i.country, '') AS country, t.technique_id, t.technique_name, t.tactic,
  CASE WHEN p >= 4 THEN 'CRITICAL' WHEN p >= 2 THEN 'HIGH' WHEN p >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level
FROM (SELECT c.*, (CASE WHEN coalesce(i.vt_malicious, 0) > 3 THEN 2 ELSE 0 END)
        + (CASE WHEN coalesce(i.vt_suspicious, 0) > 0 THEN 1 ELSE 0 END)
        + (CASE WHEN coalesce(i.abuse_score, 0) > 50 THEN 2 ELSE 0 END)
        + (CASE WHEN coalesce(i.abuse_score, 0) > 20 THEN 1 ELSE 0 END) AS p
      FROM (SELECT DISTINCT campaign_id, SrcAddr FROM camp) c LEFT JOIN intel i ON c.SrcAddr = i.ip) c
LEFT JOIN intel i ON c.SrcAddr = i.ip JOIN summary s USING (campaign_id) JOIN technique t USING (campaign_type)""",
    "camp", "intel", "summary", "technique",
)

_LEN = "sqrt(" + " + ".join(f"coalesce({c}, 0) ** 2" for c in FEATURE_SQL) + ")"
cte(
    "cohesion",
    "SELECT campaign_id, CASE WHEN n < 2 THEN 0.0 ELSE ("
    + " + ".join(f"u_{c} ** 2" for c in FEATURE_SQL)
    + " - nz) / (n * (n - 1.0)) END AS B FROM (SELECT campaign_id, count(*) AS n, count(*) FILTER (len > 0) AS nz, "
    + ", ".join(f"sum(CASE WHEN len > 0 THEN coalesce({c}, 0) / len ELSE 0 END) AS u_{c}" for c in FEATURE_SQL)
    + f" FROM (SELECT *, {_LEN} AS len FROM camp) GROUP BY campaign_id)",
    "camp",
)
cte(
    "overlap",
    """SELECT campaign_id, avg(CASE WHEN (asn <> '' AND asn = top_asn) OR (net <> '' AND net = top_net) THEN 1.0 ELSE 0.0 END) AS I
FROM (SELECT m.campaign_id, m.SrcAddr, CASE WHEN upper(coalesce(a.asn, '')) LIKE 'AS%' THEN split_part(upper(a.asn), ' ', 1) ELSE '' END AS asn,
        regexp_extract(m.SrcAddr, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) AS net
      FROM member m LEFT JOIN (SELECT ip, max_by(asn, campaign_id) AS asn FROM enriched GROUP BY ip) a ON m.SrcAddr = a.ip) k
LEFT JOIN (SELECT campaign_id, asn AS top_asn FROM (SELECT campaign_id, asn, row_number() OVER (PARTITION BY campaign_id
        ORDER BY count(*) DESC, asn) AS rn FROM (SELECT m.campaign_id, split_part(upper(a.asn), ' ', 1) AS asn FROM member m
        JOIN (SELECT ip, max_by(asn, campaign_id) AS asn FROM enriched GROUP BY ip) a ON m.SrcAddr = a.ip WHERE a.asn <> '')
        GROUP BY campaign_id, asn) WHERE rn = 1) ta USING (campaign_id)
LEFT JOIN (SELECT campaign_id, net AS top_net FROM (SELECT campaign_id, net, row_number() OVER (PARTITION BY campaign_id
        ORDER BY count(*) DESC, net) AS rn FROM (SELECT campaign_id, regexp_extract(SrcAddr, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) AS net
        FROM member) GROUP BY campaign_id, net) WHERE rn = 1) tn USING (campaign_id)
GROUP BY campaign_id""",
    "member", "enriched",
)
cte(
    "timing",
    """SELECT campaign_id, CASE WHEN count(*) < 3 OR min(a) = max(a) OR min(b) = max(b) THEN 0.0 ELSE abs(corr(a, b)) END AS T
FROM (SELECT g.campaign_id, g.hour, g.a::DOUBLE AS a, coalesce(s.b, 0)::DOUBLE AS b
      FROM (SELECT c.campaign_id, h.hour, h.a FROM (SELECT DISTINCT campaign_id FROM member) c,
              (SELECT date_trunc('hour', StartTime) AS hour, count(*) AS a FROM flows GROUP BY 1) h) g
      LEFT JOIN (SELECT m.campaign_id, date_trunc('hour', StartTime) AS hour, count(*) AS b FROM flows f
              JOIN member m USING (SrcAddr) GROUP BY 1, 2) s ON s.campaign_id = g.campaign_id AND s.hour = g.hour)
GROUP BY campaign_id""",
    "flows", "member",
)
cte(
    "threat",
    "SELECT campaign_id, avg(CASE WHEN vt_malicious > 0 OR abuse_score > 25 THEN 1.0 ELSE 0.0 END) AS M FROM enriched GROUP BY 1",
    "enriched",
)
cte(
    "factor",
    "SELECT *, B * 0.35 + I * 0.25 + T * 0.2 + M * 0.2 AS C FROM cohesion JOIN overlap USING (campaign_id) "
    "JOIN timing USING (campaign_id) JOIN threat USING (campaign_id)",
    "cohesion", "overlap", "timing", "threat",
)
_BIN = "time_bucket(INTERVAL '6 hours', time_window, TIMESTAMP '2024-06-01')"
cte(
    "centroid",
    f"SELECT campaign_id, {_BIN} AS window_start, [" + ", ".join(f"avg(coalesce({c}, 0)::DOUBLE)" for c in FEATURE_SQL)
    + "] AS v FROM camp GROUP BY 1, 2",
    "camp",
)
cte(
    "drift",
    """SELECT campaign_id, window_start, window_next, round(1 - list_cosine_similarity(v, nv), 4) AS drift,
  1 - list_cosine_similarity(v, nv) > {threshold} AS flagged
FROM (SELECT campaign_id, window_start, v, lead(window_start) OVER w AS window_next, lead(v) OVER w AS nv FROM centroid
      WINDOW w AS (PARTITION BY campaign_id ORDER BY window_start)) WHERE window_next IS NOT NULL""".replace("{threshold}", "0.15"),
    "centroid",
)
cte(
    "doc",
    """SELECT f.campaign_id AS cluster_id, round(greatest(0.0, least(1.0, C)) * 100, 2) AS confidence_pct, l.label::VARCHAR AS label,
  a.attack_type, round(B, 4) AS B, round(I, 4) AS I, round(T, 4) AS T, round(M, 4) AS M, coalesce(t.top_ttps, '') AS top_ttps,
  coalesce(d.drift_detected, FALSE) AS drift_detected, x.cross_dataset
FROM factor f
JOIN (SELECT campaign_id, attack_type FROM (SELECT campaign_id, attack_type, row_number() OVER (PARTITION BY campaign_id
   ORDER BY count(*) DESC, attack_type) AS rn FROM camp GROUP BY 1, 2) WHERE rn = 1) a USING (campaign_id)
JOIN (SELECT campaign_id, label FROM (SELECT campaign_id, label, row_number() OVER (PARTITION BY campaign_id
   ORDER BY count(*) DESC, label) AS rn FROM camp GROUP BY 1, 2) WHERE rn = 1) l USING (campaign_id)
LEFT JOIN (SELECT campaign_id, string_agg(technique_id, ', ' ORDER BY technique_id) AS top_ttps FROM (
   SELECT DISTINCT campaign_id, technique_id FROM enriched WHERE technique_id <> 'N/A') GROUP BY 1) t USING (campaign_id)
LEFT JOIN (SELECT campaign_id, bool_or(flagged) AS drift_detected FROM drift GROUP BY 1) d USING (campaign_id)
JOIN (SELECT campaign_id, (count(*) FILTER (dataset_source = 'IoT-23') > 0 AND count(*) FILTER (dataset_source = 'CTU-13') > 0)
   OR count(*) FILTER (dataset_source = 'Mixed') > 0 AS cross_dataset FROM camp GROUP BY 1) x USING (campaign_id)""",
    "factor", "camp", "enriched", "drift",
)
cte(
    "family",
    """SELECT campaign_id, majority_sublabel, CASE WHEN s LIKE '%portscan%' THEN 'Scanner' WHEN s LIKE '%okiru%' THEN 'Okiru/Bashlite'
    WHEN s LIKE '%mirai%' THEN 'Mirai' WHEN s LIKE '%torii%' THEN 'Torii' WHEN s LIKE '%hakai%' THEN 'Hakai' WHEN s LIKE '%ddos%' THEN 'DDoS Bot'
    WHEN s LIKE '%c&c%' THEN 'C2 Implant' WHEN s LIKE '%filedownload%' THEN 'Dropper' ELSE 'Unknown IoT' END AS iot_family,
  CASE WHEN s LIKE '%portscan%' THEN 'T1046' WHEN s LIKE '%okiru%' THEN 'T1498,T1571' WHEN s LIKE '%mirai%' THEN 'T1498,T1021,T1078'
    WHEN s LIKE '%torii%' THEN 'T1573,T1033' WHEN s LIKE '%hakai%' THEN 'T1498,T1190' WHEN s LIKE '%ddos%' THEN 'T1498'
    WHEN s LIKE '%c&c%' THEN 'T1071,T1573' WHEN s LIKE '%filedownload%' THEN 'T1105' ELSE '' END AS ttps
FROM (SELECT c.campaign_id, coalesce(m.sub, '') AS majority_sublabel, lower(coalesce(m.sub, '')) AS s
  FROM (SELECT DISTINCT campaign_id FROM member) c LEFT JOIN (
    SELECT campaign_id, sub FROM (SELECT campaign_id, trim(SubLabel) AS sub, row_number() OVER (PARTITION BY campaign_id
       ORDER BY count(*) DESC, min(StartTime), trim(SubLabel)) AS rn FROM flows JOIN member USING (SrcAddr)
       WHERE DatasetSource LIKE '%IoT%' AND trim(SubLabel) <> '' GROUP BY 1, 2) WHERE rn = 1) m USING (campaign_id))""",
    "flows", "member",
)
cte(
    "node",
    """SELECT ip AS id, 'ip' AS type, coalesce(max(e), min(c)) AS campaign_id FROM (
  SELECT ip, campaign_id AS e, NULL AS c FROM enriched UNION ALL SELECT SrcAddr, NULL, campaign_id FROM member) GROUP BY 1
UNION ALL SELECT DISTINCT asn, 'asn', NULL FROM enriched WHERE asn LIKE 'AS%'
UNION ALL SELECT DISTINCT f.iot_family, 'malware_family', NULL FROM enriched JOIN family f USING (campaign_id)
UNION ALL SELECT DISTINCT concat('campaign_', campaign_id), 'campaign', campaign_id FROM member""",
    "enriched", "member", "family",
)
cte(
    "edge",
    """SELECT DISTINCT ip AS src, asn AS dst, 'belongs_to_asn' AS relation FROM enriched WHERE asn LIKE 'AS%'
UNION ALL SELECT DISTINCT ip, f.iot_family, 'associated_malware' FROM enriched JOIN family f USING (campaign_id)
UNION ALL SELECT DISTINCT SrcAddr, concat('campaign_', campaign_id), 'shares_campaign' FROM member""",
    "enriched", "member", "family",
)
cte(
    "degree",
    """SELECT n.*, round(coalesce(d.deg, 0) / ((SELECT count(*) FROM node) - 1), 6) AS degree_centrality FROM node n
LEFT JOIN (SELECT id, count(*) AS deg FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1) d USING (id)""",
    "node", "edge",
)

PROFILE_SQL = [
    "proto_entropy", "scan_entropy", "c2_beacon_score", "payload_asymmetry", "burst_score", "night_ratio", "scan_score",
    "flow_count", "avg_duration", "avg_bytes", "avg_pkts", "tcp_ratio", "udp_ratio", "unique_dst_ports",
    "unique_dst_ips", "avg_sport_entropy", "state_entropy", "bytes_per_pkt", "pkts_per_flow",
]


def _entropy(column: str) -> str:
    return (
        f"(SELECT SrcAddr, -sum(c / n * log2(c / n)) + 0.0 AS h FROM (SELECT SrcAddr, count(*) AS c, sum(count(*)) OVER "
        f"(PARTITION BY SrcAddr) AS n FROM prow GROUP BY SrcAddr, {column}) GROUP BY 1)"
    )


_RX = "'flow=(?:To-|From-)?(\\w+?)(?:-V\\d+)?(?:-([\\w-]+))?$'"
SIMPLE_LABEL = (
    f"CASE WHEN coalesce(l, '') = '' THEN 'Unknown' WHEN regexp_extract(l, {_RX}, 1) <> '' THEN concat(regexp_extract(l, {_RX}, 1), "
    f"CASE WHEN regexp_extract(l, {_RX}, 2) <> '' THEN concat(' (', regexp_extract(l, {_RX}, 2), ')') ELSE '' END) "
    "WHEN length(l) > 32 THEN concat(left(l, 32), '…') ELSE l END"
)
cte(
    "prow",
    """SELECT StartTime, SrcAddr, DstAddr, Proto, Sport, Dport, State, Label_raw AS l, Dur, TotPkts, TotBytes, SrcBytes,
  greatest(0, TotBytes - SrcBytes) AS DstBytes FROM flows""",
    "flows",
)
cte(
    "profile_raw",
    f"""SELECT a.*, p.h AS proto_entropy, d.h AS scan_entropy, s.h AS avg_sport_entropy, t.h AS state_entropy,
  CASE WHEN a.flow_count < 2 THEN 0.0 WHEN g.mu = 0 THEN 1.0 ELSE 1 / (1 + g.sp / g.mu) END AS c2_beacon_score,
  b.burst_score, l.label, a.avg_pkts AS pkts_per_flow
FROM (SELECT SrcAddr, count(*) AS flow_count, avg(SrcBytes) / (avg(DstBytes) + 1) AS payload_asymmetry,
    avg(CASE WHEN hour(StartTime) >= 22 OR hour(StartTime) < 6 THEN 1.0 ELSE 0.0 END) AS night_ratio,
    least(1.0, count(DISTINCT DstAddr) / sum(TotPkts)) AS scan_score, avg(Dur) AS avg_duration, avg(TotBytes) AS avg_bytes,
    avg(TotPkts) AS avg_pkts, avg(CASE WHEN Proto = 'tcp' THEN 1.0 ELSE 0.0 END) AS tcp_ratio,
    avg(CASE WHEN Proto = 'udp' THEN 1.0 ELSE 0.0 END) AS udp_ratio, count(DISTINCT Dport) AS unique_dst_ports,
    count(DISTINCT DstAddr) AS unique_dst_ips, avg(TotBytes / TotPkts) AS bytes_per_pkt FROM prow GROUP BY 1) a
JOIN {_entropy('Proto')} p USING (SrcAddr) JOIN {_entropy('DstAddr')} d USING (SrcAddr)
JOIN {_entropy('Sport')} s USING (SrcAddr) JOIN {_entropy('State')} t USING (SrcAddr)
JOIN (SELECT SrcAddr, avg(gap) AS mu, stddev_pop(gap) AS sp FROM (SELECT SrcAddr, (epoch_us(StartTime) - epoch_us(lag(StartTime)
   OVER (PARTITION BY SrcAddr ORDER BY StartTime))) / 1e6 AS gap FROM prow) GROUP BY 1) g USING (SrcAddr)
JOIN (SELECT SrcAddr, sum(CASE WHEN rn <= greatest(1, ceil(n * 0.1)) THEN c ELSE 0 END) / sum(c) AS burst_score FROM (
   SELECT SrcAddr, count(*) AS c, row_number() OVER (PARTITION BY SrcAddr ORDER BY count(*) DESC) AS rn,
     count(*) OVER (PARTITION BY SrcAddr) AS n FROM prow GROUP BY SrcAddr, date_trunc('hour', StartTime)) GROUP BY 1) b USING (SrcAddr)
JOIN (SELECT SrcAddr, label FROM (SELECT SrcAddr, label, row_number() OVER (PARTITION BY SrcAddr ORDER BY count(*) DESC,
   min(StartTime), label) AS rn FROM (SELECT SrcAddr, StartTime, {SIMPLE_LABEL} AS label FROM prow) GROUP BY 1, 2) WHERE rn = 1) l USING (SrcAddr)""",
    "prow",
)
HOSTILE = "(lower(label) LIKE '%botnet%' OR lower(label) LIKE '%malicious%' OR lower(label) LIKE '%attack%')"
cte(
    "profile",
    "SELECT q.*, [" + ", ".join(
        f"(q.{c} - r.lo_{c}) / CASE WHEN r.hi_{c} = r.lo_{c} THEN 1.0 ELSE (r.hi_{c} - r.lo_{c})::DOUBLE END" for c in PROFILE_SQL
    ) + f"] AS v, CASE WHEN {HOSTILE} AND payload_asymmetry > 10 THEN 0 WHEN {HOSTILE} THEN 1 WHEN flow_count = 1 THEN 2 ELSE 3 END "
    "AS campaign_id FROM profile_raw q, (SELECT "
    + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in PROFILE_SQL) + " FROM profile_raw) r",
    "profile_raw",
)
cte(
    "pcohesion",
    "SELECT campaign_id, CASE WHEN n < 2 THEN 0.0 ELSE (list_sum(list_transform(s, lambda x: x * x)) - nz) / (n * (n - 1.0)) END AS B FROM "
    "(SELECT campaign_id, count(*) AS n, count(*) FILTER (len > 0) AS nz, ["
    + ", ".join(f"sum(CASE WHEN len > 0 THEN v[{i + 1}] / len ELSE 0 END)" for i in range(len(PROFILE_SQL)))
    + "] AS s FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM profile) GROUP BY 1)",
    "profile",
)
cte(
    "ptiming",
    """SELECT campaign_id, CASE WHEN count(*) < 3 OR min(a) = max(a) OR min(b) = max(b) OR sum(b) < 3 THEN 0.0 ELSE abs(corr(a, b)) END AS T
FROM (SELECT g.campaign_id, g.a::DOUBLE AS a, coalesce(s.b, 0)::DOUBLE AS b
      FROM (SELECT c.campaign_id, h.hour, h.a FROM (SELECT DISTINCT campaign_id FROM profile) c,
              (SELECT date_trunc('hour', StartTime) AS hour, count(*) AS a FROM flows GROUP BY 1) h) g
      LEFT JOIN (SELECT m.campaign_id, date_trunc('hour', StartTime) AS hour, count(*) AS b FROM flows f
              JOIN profile m USING (SrcAddr) GROUP BY 1, 2) s ON s.campaign_id = g.campaign_id AND s.hour = g.hour)
GROUP BY campaign_id""",
    "flows", "profile",
)
cte(
    "pcamp",
    f"""SELECT campaign_id, ip_count, greatest(0.0, least(1.0, B * 0.35 + I * 0.25 + T * 0.2 + M * 0.2)) AS confidence,
  round(B, 4) AS B, round(I, 4) AS I, round(T, 4) AS T, round(M, 4) AS M, dominant_subnet, top_label
FROM (SELECT campaign_id, count(*) AS ip_count, avg(CASE WHEN {HOSTILE} THEN 1.0 ELSE 0.0 END) AS M FROM profile GROUP BY 1) a
JOIN pcohesion USING (campaign_id) JOIN ptiming USING (campaign_id)
JOIN (SELECT campaign_id, net AS dominant_subnet, n / tot AS I FROM (SELECT campaign_id, regexp_extract(SrcAddr, '^(\\d+\\.\\d+\\.\\d+)', 1) AS net,
   count(*) AS n, sum(count(*)) OVER (PARTITION BY campaign_id) AS tot, row_number() OVER (PARTITION BY campaign_id
   ORDER BY count(*) DESC, regexp_extract(SrcAddr, '^(\\d+\\.\\d+\\.\\d+)', 1)) AS rn FROM profile GROUP BY 1, 2) WHERE rn = 1) s USING (campaign_id)
JOIN (SELECT campaign_id, label AS top_label FROM (SELECT campaign_id, label, row_number() OVER (PARTITION BY campaign_id
   ORDER BY count(*) DESC, label) AS rn FROM profile GROUP BY 1, 2) WHERE rn = 1) l USING (campaign_id)""",
    "profile", "pcohesion", "ptiming",
)
cte(
    "step",
    """SELECT idx, t FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS rk FROM (SELECT DISTINCT StartTime AS t FROM flows)) r
JOIN (SELECT j AS idx, CASE WHEN n > 1500 THEN round_even(j * (n - 1.0) / 1499, 0)::BIGINT ELSE j END AS rk
  FROM (SELECT unnest(range(0, least(1500, n))) AS j, n FROM (SELECT count(DISTINCT StartTime) AS n FROM flows))) p USING (rk)""",
    "flows",
)
