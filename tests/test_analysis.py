"""Scores, drift, families, graph, timeline and reports."""

import datetime as dt
import hashlib
from collections import deque

import pytest
from pyspark.sql import functions as F

from netquarry.functions import network as N
from netquarry.operators import drift, enrichment, families, graph, ranking, reports, scoring, timeline
from netquarry.operators.sampling import sample_per_group


def test_overlap_three_of_four(spark):
    m = spark.createDataFrame([(0, ip) for ip in ("10.0.0.1", "10.0.0.2", "10.0.0.3", "99.1.1.1")], ["campaign_id", "SrcAddr"])
    asn = spark.createDataFrame([(f"10.0.0.{i}", "AS100 X") for i in (1, 2, 3)], ["ip", "asn"])
    assert scoring.infrastructure_overlap(m, asn).first()["I"] == 0.75
    assert scoring.infrastructure_overlap(m, asn.filter("ip = ''")).first()["I"] == 0.75
    assert scoring.subnet_share(m).first()["I"] == 0.75


def test_addresses_are_not_sent_through_the_driver(spark):
    """A table of addresses that is small as a file is joined where its rows are."""
    m = spark.range(1000).selectExpr("CAST(id % 3 AS INT) AS campaign_id", "concat('10.0.', id % 4, '.', id) AS SrcAddr")
    asn = m.selectExpr("SrcAddr AS ip", "concat('AS', campaign_id, ' NET') AS asn")
    found = scoring.infrastructure_overlap(m, asn)
    assert {r["campaign_id"]: r["I"] for r in found.collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    assert "BroadcastHashJoin [SrcAddr" not in found._jdf.queryExecution().executedPlan().toString()


def hourly(spark, series):
    rows = [(ip, h, n) for ip, counts in series.items() for h, n in enumerate(counts) if n]
    return spark.createDataFrame(rows, "SrcAddr string, h int, n bigint").selectExpr(
        "SrcAddr", "timestampadd(HOUR, h, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS hour", "n")


def test_timing(spark):
    m = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "gone")], ["campaign_id", "SrcAddr"])
    alone = hourly(spark, {"a": [4, 11, 3, 8, 6]})
    got = {r["campaign_id"]: r["T"] for r in scoring.timing_correlation(alone, m).collect()}
    assert got[0] == pytest.approx(1.0) and got[1] == got[3] == 0.0
    mixed = hourly(spark, {"a": [4, 11, 3, 8, 6], "b": [0, 3, 0, 1, 0], "c": [2, 2, 2, 2, 2]})
    got = {r["campaign_id"]: r["T"] for r in scoring.timing_correlation(mixed, m).collect()}
    from statistics import correlation
    total, b = [6, 16, 5, 11, 8], [0, 3, 0, 1, 0]
    assert got[1] == pytest.approx(abs(correlation(total, b))) and got[2] == 0.0
    short = hourly(spark, {"a": [5, 9]})
    assert scoring.timing_correlation(short, m).filter("campaign_id = 0").first()["T"] == 0.0


def test_match_and_weights(spark):
    enr = spark.createDataFrame([(0, 3, 0), (0, 0, 90), (0, 0, 10), (0, 0, 0)], "campaign_id int, vt_malicious int, abuse_score int")
    assert scoring.threat_match(enr).first()["M"] == 0.5
    one = spark.range(1).select(scoring.confidence(F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit(0.375)).alias("c"))
    assert one.first()["c"] == pytest.approx(0.475)
    assert spark.range(1).select(scoring.confidence_pct(F.lit(0.475)).alias("p"), scoring.confidence_pct(F.lit(1.7)).alias("q")).first() == (47.5, 100.0)


def camps(spark, rows):
    df = spark.createDataFrame(rows, "campaign_id int, t string, scan_entropy double, c2_beacon_score double")
    return df.withColumn("time_window", F.col("t").cast("timestamp_ntz"))


def test_drift_flag(spark):
    moved = camps(spark, [(0, "2024-01-01 00:00:00", 1.0, 0.0), (0, "2024-01-01 01:00:00", 1.0, 0.0), (0, "2024-01-01 03:00:00", 0.0, 0.0),
                          (0, "2024-01-01 06:00:00", 0.0, 0.0), (0, "2024-01-01 13:00:00", 0.0, 2.0)])
    got = drift.drift_series(moved).collect()
    assert len(got) == 1  # the window without any length is skipped
    assert got[0]["drift"] == 1.0 and got[0]["flagged"] and got[0]["window_next"] == dt.datetime(2024, 1, 1, 12)
    still = camps(spark, [(0, "2024-01-01 00:00:00", 1.0, 0.5), (0, "2024-01-01 06:00:00", 2.0, 1.0)])
    assert drift.drift_series(still).first()["drift"] == 0.0 and not drift.drift_flags(drift.drift_series(still)).first()["drift_detected"]
    assert drift.drift_matrix(drift.drift_series(moved), [0]).columns == ["t", "c0"]


def test_upsert(spark):
    old = spark.createDataFrame([(0, "x", "keep"), (1, "y", "keep")], ["cluster_id", "a", "b"])
    new = spark.createDataFrame([(1, None, 5), (2, "z", 6)], "cluster_id int, a string, c int")
    got = {r["cluster_id"]: (r["a"], r["b"], r["c"]) for r in scoring.upsert_documents(old, new).collect()}
    assert got == {0: ("x", "keep", None), 1: (None, "keep", 5), 2: ("z", None, 6)}


def test_enrichment(spark):
    c = spark.createDataFrame([(0, "a", 0, 9.0), (0, "a", 1, 1.0), (0, "b", 1, 5.0), (0, "c", 0, 99.0)], "campaign_id int, SrcAddr string, label int, conn_count double")
    assert [r["SrcAddr"] for r in enrichment.prioritise_addresses(c, 2).orderBy(F.desc("conn_count")).collect()] == ["b", "a"]
    intel = spark.createDataFrame([("b", 9, 1, 82, "AS1", "NL", "", "")], "ip string, vt_malicious bigint, vt_suspicious bigint, abuse_score bigint, asn string, country string, shodan_ports string, shodan_tags string")
    summary = spark.createDataFrame([(0, "Data Exfiltration")], "campaign_id int, campaign_type string")
    got = {r["ip"]: r for r in enrichment.enrich(c, summary, intel).collect()}
    assert got["b"]["threat_level"] == "CRITICAL" and got["a"]["threat_level"] == "LOW" and got["c"]["technique_id"] == "T1041"
    ips = spark.createDataFrame([("zz",)], ["ip"])
    assert enrichment.join_intel(ips, intel, missing="sentinel").first()["abuse_score"] == -1
    ind = spark.createDataFrame([("b", f"E{i}", "2") for i in range(8)], ["ip", "event", "tlp"])
    lines = enrichment.matches_per_address(enrichment.indicator_matches(c, ind)).collect()
    assert len(lines) == 1 and lines[0]["matches"].split("\n") == [f"E{i} | TLP=2" for i in range(5)]


def test_families(spark, make_flows):
    flows = make_flows([(1, "a", "Okiru", "IoT-23"), (2, "a", "Mirai", "IoT-23"), (3, "a", " ", "IoT-23"), (0, "a", "Torii", "CTU-13"), (5, "b", "new thing", "IoT-23")],
                       ["StartTime", "SrcAddr", "SubLabel", "DatasetSource"])
    m = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], ["campaign_id", "SrcAddr"])
    got = {r["campaign_id"]: r for r in families.family_entries(flows, m).collect()}
    assert got[0]["majority_sublabel"] == "Okiru" and got[0]["iot_family"] == "Okiru/Bashlite" and got[0]["ttps"] == ["T1498", "T1571"]
    assert got[1]["iot_family"] == got[2]["iot_family"] == "Unknown IoT" and got[2]["ttps"] == []
    rows = spark.createDataFrame([("PartOfAHorizontalPortScan",), ("C&C-Mirai",), ("ddos",), ("C&C",)], ["s"])
    assert [r["iot_family"] for r in families.map_families(rows, "s").collect()] == ["Scanner", "Mirai", "DDoS Bot", "C2 Implant"]


def small_graph(spark):
    m = spark.createDataFrame([(0, "10.0.0.1"), (0, "10.0.0.2"), (1, "10.0.0.2"), (1, "10.0.1.9")], "campaign_id int, SrcAddr string")
    e = spark.createDataFrame([(0, "10.0.0.2", "AS1", "Mirai"), (1, "10.0.0.2", "AS1", "Mirai"), (1, "10.0.1.9", "x", "")], "campaign_id int, ip string, asn string, iot_family string")
    return graph.build_nodes(m, e), graph.build_edges(m, e)


def test_graph_nodes_edges_degree(spark):
    nodes, edges = small_graph(spark)
    got = {r["id"]: (r["type"], r["campaign_id"]) for r in nodes.collect()}
    assert got == {"10.0.0.1": ("ip", 0), "10.0.0.2": ("ip", 1), "10.0.1.9": ("ip", 1), "AS1": ("asn", None), "Mirai": ("malware_family", None),
                   "campaign_0": ("campaign", 0), "campaign_1": ("campaign", 1)}
    assert edges.count() == 6
    deg = {r["id"]: r["degree_centrality"] for r in graph.degree_centrality(nodes, edges).collect()}
    assert deg["10.0.0.2"] == pytest.approx(4 / 6, abs=1e-6) and deg["campaign_0"] == pytest.approx(2 / 6, abs=1e-6)
    n, e = graph.induced_subgraph(nodes, edges, 1)
    assert n.count() == 3 and {r["dst"] for r in e.collect()} == {"campaign_1"} and e.count() == 2
    labels = {r["id"]: r["label"] for r in graph.display_labels(nodes).collect()}
    assert labels["10.0.1.9"] == "1.9" and labels["campaign_1"] == "C1"


def brandes(nodes, links, sources=None):
    score, sources = dict.fromkeys(nodes, 0.0), sources or nodes
    for s in sources:
        dist, sigma, pred, order = {s: 0}, dict.fromkeys(nodes, 0.0), {v: [] for v in nodes}, []
        sigma[s] = 1.0
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in links.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(nodes)
    return {v: round(x * n / len(sources) / ((n - 1) * (n - 2)), 6) for v, x in score.items()}


@pytest.mark.parametrize("directed", [True, False])
def test_betweenness_matches_brute_force(spark, directed):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("d", "f"), ("b", "f")]
    # Nodes with equal neighbours: leaves, parallel ways, and twins that are sources and go-betweens.
    pairs += [(f"leaf{i}", "b") for i in range(4)] + [x for i in range(3) for x in (("f", f"way{i}"), (f"way{i}", "g"))] + [("g", "a")]
    names = sorted({x for p in pairs for x in p} | {"z"})
    links = {}
    for a, b in pairs:
        links.setdefault(a, []).append(b)
        if not directed:
            links.setdefault(b, []).append(a)
    nodes = spark.createDataFrame([(x,) for x in names], ["id"])
    edges = spark.createDataFrame(pairs, ["src", "dst"])
    got = {r["id"]: r["betweenness_centrality"] for r in graph.betweenness_centrality(nodes, edges, directed).collect()}
    assert got == pytest.approx(brandes(names, links), abs=2e-6)


@pytest.mark.parametrize("directed", [True, False])
def test_pivot_betweenness(spark, directed):
    """A chain with stars: all pivots are exact, some pivots equal Brandes from those, within the stated error."""
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [(f"in{i}", f"n{i % 3}") for i in range(9)] + [(f"n{i % 4 + 2}", f"out{i}") for i in range(8)]
    names = sorted({x for p in pairs for x in p})
    links = {}
    for a, b in pairs:
        links.setdefault(a, []).append(b)
        if not directed:
            links.setdefault(b, []).append(a)
    nodes, edges = spark.createDataFrame([(x,) for x in names], ["id"]), spark.createDataFrame(pairs, ["src", "dst"])

    def scores(**kwargs):
        return {r["id"]: r["betweenness_centrality"] for r in graph.betweenness_centrality(nodes, edges, directed, **kwargs).collect()}

    exact = brandes(names, links)
    assert max(exact.values()) > 0.05 and scores(pivots=10**9) == pytest.approx(exact, abs=2e-6)
    chosen = sorted(names, key=lambda x: (hashlib.sha256(f"7:{x}".encode()).hexdigest(), x))[:9]
    some = scores(pivots=9, seed=7)
    assert some == pytest.approx(brandes(names, links, chosen), abs=2e-6)
    bound = graph.betweenness_error(len(names), 9)
    assert all(abs(some[x] - exact[x]) <= bound for x in names) and graph.betweenness_error(len(names), len(names)) == 0.0
    assert graph.betweenness_error(10**6, 40_000) < 0.02


def test_star_graph_has_no_betweenness(spark):
    assert {r["betweenness_centrality"] for r in graph.betweenness_centrality(*small_graph(spark)).collect()} == {0.0}


def test_cap_and_collapse(spark):
    ips = [(f"10.{i % 2}.0.{i}", "ip", 0, i / 100) for i in range(30)]
    nodes = spark.createDataFrame([*ips, ("campaign_0", "campaign", 0, 1.0), ("AS1", "asn", None, 0.1), ("campaign_9", "campaign", 9, 0.1)],
                                  "id string, type string, campaign_id int, degree_centrality double")
    edges = spark.createDataFrame([(i[0], "campaign_0", "shares_campaign") for i in ips] + [(ips[0][0], "AS1", "belongs_to_asn")], ["src", "dst", "relation"])
    kept, links = graph.capped_graph(nodes, edges, cap=10)
    assert kept.filter("type = 'ip'").agg(F.min("degree_centrality")).first()[0] == 0.2 and kept.count() == 13 and links.count() == 10
    shown, joined = graph.collapsed_graph(nodes, edges, 0)
    assert {r["id"] for r in shown.collect()} == {"__subnet__10_0_0", "__subnet__10_1_0", "campaign_0", "AS1"} and joined.count() == 3
    shown, joined = graph.collapsed_graph(nodes, edges, 0, expanded=["10.1.0"])
    assert shown.count() == 1 + 15 + 2 and joined.count() == 15 + 2
    assert graph.collapsed_graph(nodes, edges, 0, threshold=30)[1].count() == 31
    seen = spark.createDataFrame([(ips[0][0],)], ["ip"])
    n, e = graph.visible_subgraph(nodes, edges, seen)
    assert n.count() == 1 and e.count() == 0


def test_top_n_with_slices_equals_plain(spark):
    df = spark.range(6000).selectExpr("id % 2 AS g", "id", "hash(id) AS v")
    big = ranking.top_n_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 1500).collect()
    want = []
    for g in (0, 1):
        want += sorted((r for r in df.filter(f"g = {g}").collect()), key=lambda r: (-r["v"], r["id"]))[:1500]
    assert sorted(big) == sorted(want)
    assert sample_per_group(df, ["g"], ["id"], 7).count() == 14


def test_replay_timeline(spark, make_flows):
    flows = make_flows([(i * 7, f"10.0.0.{i % 9}") for i in range(400)] + [(0, "10.0.0.1")], ["StartTime", "SrcAddr"])
    every = timeline.replay_timeline(flows, 1500).orderBy("idx").collect()
    assert len(every) == 400 and [r["idx"] for r in every] == list(range(400))
    some = timeline.replay_timeline(flows, 50).orderBy("idx").collect()
    base = dt.datetime(2024, 1, 1, 12)
    want = [base + dt.timedelta(seconds=7 * round(j * 399 / 49)) for j in range(50)]
    assert [r["t"] for r in some] == want and [r["idx"] for r in some] == list(range(50))
    even = timeline.replay_timeline(flows.limit(399).union(flows.limit(399)), 5).orderBy("idx").collect()
    assert len(even) == 5 and [r["idx"] for r in even] == list(range(5))


def test_visibility_feed_and_spans(spark, make_flows):
    flows = make_flows([(i * 60, f"10.0.0.{i % 3}", "8.8.8.8", "tcp", 80, 1, 5) for i in range(30)], ["StartTime", "SrcAddr", "DstAddr", "Proto", "Dport", "Sport", "TotBytes"])
    cut = F.expr("TIMESTAMP_NTZ'2024-01-01 12:01:30'")
    ips = spark.createDataFrame([("10.0.0.0",), ("10.0.0.2",), ("10.0.0.99",)], ["ip"])
    assert {r["ip"] for r in timeline.visible_at(ips, timeline.first_seen(flows), cut).collect()} == {"10.0.0.0", "10.0.0.99"}
    c = spark.createDataFrame([(0, "10.0.0.0", 1, "Vertical_PortScan"), (1, "10.0.0.0", 2, "C2_Beaconing")], "campaign_id int, SrcAddr string, d int, attack_type string")
    c = c.selectExpr("*", "timestampadd(DAY, d, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS time_window")
    feed = timeline.replay_feed(flows, c, cut).orderBy("StartTime").collect()
    assert [(r["clock"], r["campaign_id"], r["event"]) for r in feed] == [("12:00", 1, "C2"), ("12:01", None, "Flow")]
    span = {r["campaign_id"]: r for r in timeline.campaign_spans(c, spark.createDataFrame([(0, 50.0)], "cluster_id int, confidence_pct double")).collect()}
    assert span[0]["duration_s"] == 3600 and span[1]["confidence_pct"] == 0.0


def test_text_helpers(spark):
    df = spark.createDataFrame([("flow=To-Botnet-V42-UDP-SPAM", "1.2.3.4"), ("x" * 40, "a.b.c"), ("", "host"), ("flow=Background", "1.2.3")], ["l", "ip"])
    got = df.select(N.simple_label("l"), N.subnet24("ip"), N.subnet24_lenient("ip"), N.last_octets("ip")).collect()
    assert [r[0] for r in got] == ["Botnet (UDP-SPAM)", "x" * 32 + "…", "Unknown", "Background"]
    assert [r[1] for r in got] == ["1.2.3", "", "", "1.2.3"] and [r[2] for r in got] == ["1.2.3", "a.b.c", "host", "1.2.3"]
    assert [r[3] for r in got] == ["3.4", "b.c", "host", "2.3"]


def test_report_with_nothing_selected(spark):
    docs = spark.createDataFrame([(0, 40.0, "0", "Unknown", False, False, "")], "cluster_id int, confidence_pct double, label string, attack_type string, drift_detected boolean, cross_dataset boolean, iot_family string")
    docs = docs.withColumn("top_ttps", F.array(F.lit("T1"))).withColumn("contributing_factors", F.struct(*[F.lit(0.5).alias(c) for c in "BITM"]))
    c = spark.createDataFrame([(0, "a", 1)], "campaign_id int, SrcAddr string, label int")
    assert reports.report_campaigns(c, docs, campaigns=[7]).count() == 0
    r = reports.report_campaigns(c, docs).first()
    assert r["confidence_band"] == "low" and r["ip_count"] == 1
    k = reports.kpis(c, docs).first()
    assert (k["campaigns"], k["malicious_rows"], k["mean_confidence"], k["high_confidence"]) == (1, 1, 40.0, 0)
    assert reports.low_confidence(reports.campaign_table(c, docs)).first()["low_confidence"] is True
    lines = {r["factor"]: r["contribution"] for r in reports.contribution_lines(docs).collect()}
    assert lines["B"] == 0.175 and reports.factor_matrix(docs).first()["M"] == 0.5
