"""Fingerprint features against plain Python on small frames."""

import math
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netquarry.operators import cleaning, fingerprints as fp, grouped, per_ip
from netquarry.plans import stages

COLUMNS = ["StartTime", "SrcAddr", "DstAddr", "Dport", "Proto", "Dur", "SrcBytes", "DstBytes", "TotPkts", "Label"]


def flow(t, src="1.1.1.1", dst="2.2.2.2", port=80, proto="tcp", sb=10, db=100, label=0):
    return (t, src, dst, port, proto, 1.0, sb, db, 2, label)


def one(make_flows, rows):
    return fp.fingerprints(make_flows(rows, COLUMNS)).collect()[0]


def test_scan_entropy_bits(make_flows):
    assert one(make_flows, [flow(i, dst=f"9.9.9.{i}") for i in range(4)])["scan_entropy"] == 2.0
    assert one(make_flows, [flow(i) for i in range(4)])["scan_entropy"] == 0.0


def test_beacon_and_burst(make_flows):
    regular = one(make_flows, [flow(30 * i) for i in range(20)])
    assert regular["c2_beacon_score"] == 0.0 and regular["burst_score"] == 0.0
    times = [0, 3, 7, 40, 44, 210, 213, 777, 1290]
    gaps = [b - a for a, b in zip(times, times[1:])]
    uneven = one(make_flows, [flow(t) for t in times])
    assert uneven["c2_beacon_score"] == pytest.approx(statistics.pstdev(gaps) / statistics.mean(gaps), abs=1e-4)
    assert uneven["burst_score"] == pytest.approx(statistics.stdev(gaps), abs=1e-4)
    assert one(make_flows, [flow(0)])["c2_beacon_score"] == 1.0
    pair = one(make_flows, [flow(0), flow(9)])
    assert pair["burst_score"] is None and pair["c2_beacon_score"] == 0.0
    same = one(make_flows, [flow(5), flow(5), flow(5)])
    assert same["c2_beacon_score"] == 0.0 and same["burst_score"] == 0.0


def test_asymmetry_affinity_flags(make_flows):
    assert one(make_flows, [flow(0, sb=500), flow(1, sb=1300)])["payload_asymmetry"] == 9.0
    assert one(make_flows, [flow(0, sb=7, db=0)])["payload_asymmetry"] == 7.0
    assert one(make_flows, [flow(0, sb=0, db=0)])["payload_asymmetry"] == 1.0
    assert one(make_flows, [flow(i, port=p) for i, p in enumerate((7547, 5555, 22, 8443))])["iot_port_affinity"] == 0.75
    wide = one(make_flows, [flow(i * i, dst=f"9.9.{i}.1", port=23, sb=200) for i in range(60)])
    assert wide["horizontal_scan_flag"] == 1 and wide["attack_type"] == "Horizontal_PortScan"
    deep = one(make_flows, [flow(i * i, port=1000 + i, sb=200) for i in range(30)])
    assert deep["vertical_scan_flag"] == 1 and deep["attack_type"] == "Vertical_PortScan"


def test_rule_precedence(spark):
    rows = [(0.1, 0.2, 4.0, 0.9, 1, 1), (0.5, 0.2, 4.0, 0.9, 1, 1), (0.5, 0.2, 1.0, 0.9, 1, 1), (0.5, 0.2, 1.0, 0.9, 0, 0), (0.5, 11.0, 1.0, 0.1, 0, 0), (0.1, 5.0, 1.0, 0.1, 0, 0)]
    names = ["c2_beacon_score", "payload_asymmetry", "scan_entropy", "iot_port_affinity", "horizontal_scan_flag", "vertical_scan_flag"]
    df = spark.createDataFrame(rows, names)
    want = ["C2_Beaconing", "Horizontal_PortScan", "Vertical_PortScan", "IoT_Malware", "Data_Exfiltration", "Unknown"]
    assert [r["attack_type"] for r in fp.with_attack_type(df).collect()] == want
    assert fp.with_attack_type(df, F.lit(9)).collect()[-1]["attack_type"] == "Known_Botnet_C2"


def test_missing_optional_columns(make_flows):
    rows = make_flows([(i, "1.1.1.1", f"2.2.2.{i}", 80, "tcp", 1.0, 2) for i in range(3)], ["StartTime", "SrcAddr", "DstAddr", "Dport", "Proto", "Dur", "TotPkts"])
    got = fp.fingerprints(rows).collect()[0]
    assert (got["avg_bytes"], got["src_bytes_ratio"], got["device_role_score"], got["label"], got["dataset_source"]) == (0.0, 0.0, 1.0, -1, "Mixed")


def random_flows(n=800, hot=0.6):
    """One source holds most rows and most of them fall into one hour."""
    rng = random.Random(7)
    rows = []
    for _ in range(n):
        src = "10.0.0.1" if rng.random() < hot else f"10.0.0.{rng.randint(2, 6)}"
        t = rng.randint(0, 900) if src == "10.0.0.1" else rng.randint(0, 20000)
        rows.append(flow(t, src, f"8.8.8.{rng.randint(1, 9)}", rng.choice([23, 80, 443]), rng.choice(["tcp", "udp", "icmp"]), rng.randint(1, 500), rng.randint(1, 500), rng.randint(0, 1)))
    return rows


def entropy(values, base):
    counts = Counter(values)
    n = sum(counts.values())
    return -sum(c / n * math.log(c / n, base) for c in counts.values())


def test_against_plain_python_with_a_hot_source(make_flows):
    rows = random_flows()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1], r[0] // 3600)].append(r)
    got = {(r["SrcAddr"], r["time_window"].hour - 12): r for r in fp.fingerprints(make_flows(rows, COLUMNS)).collect()}
    assert set(got) == set(groups)
    for key, g in groups.items():
        f = got[key]
        times = sorted(r[0] for r in g)
        gaps = [b - a for a, b in zip(times, times[1:])]
        assert f["conn_count"] == len(g)
        assert f["scan_entropy"] == pytest.approx(entropy([r[2] for r in g], 2), abs=1e-4)
        assert f["proto_entropy"] == pytest.approx(entropy([r[4] for r in g], math.e), abs=1e-4)
        assert f["unique_dst_ports"] == len({r[3] for r in g})
        assert f["label"] == (1 if sum(r[9] for r in g) * 2 > len(g) else 0)
        if len(gaps) > 1:
            assert f["burst_score"] == pytest.approx(statistics.stdev(gaps), abs=1e-3)
            assert f["c2_beacon_score"] == pytest.approx(statistics.pstdev(gaps) / statistics.mean(gaps), abs=1e-3)


def test_same_result_for_any_partitioning(spark, make_flows):
    flows = make_flows(random_flows(300), COLUMNS)
    want = sorted(fp.fingerprints(flows.coalesce(1)).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(fp.fingerprints(flows.repartition(9)).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_gap_ranges_do_not_change_results(spark, make_flows):
    flows = make_flows(random_flows(300), COLUMNS)
    spread = ["DstAddr", "Dport"]
    whole = {r["SrcAddr"]: r for r in grouped.gap_statistics(flows, ["SrcAddr"], spread=spread, parts=1).collect()}
    split = grouped.gap_statistics(flows, ["SrcAddr"], spread=spread, parts=23).collect()
    assert len(split) == len(whole)
    for r in split:
        for c in ("gaps", "gap_mean", "gap_std_pop", "gap_std_samp"):
            assert whole[r["SrcAddr"]][c] == pytest.approx(r[c], rel=1e-9)


def test_gaps_of_one_crowded_time_and_null_times(spark):
    """Most rows of one key at one time spread over ranges; null times do not count."""
    rows = [("hot", 5, i) for i in range(4000)] + [("hot", 1, 0), ("hot", 9, 0), ("none", None, 1), ("none", None, 2)]
    rows += [("part", None, 1), ("part", 3, 1), ("part", 10, 2), (None, 1, 1), (None, 4, 2)]
    df = spark.createDataFrame(rows, "k string, s int, d int").selectExpr(
        "k", "timestampadd(SECOND, s, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS StartTime", "d"
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = {r["k"]: r for r in grouped.gap_statistics(df, ["k"], spread=["d"], parts=6).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    gaps = [4.0] + [0.0] * 3999 + [4.0]
    assert got["hot"]["gaps"] == 4001
    assert got["hot"]["gap_mean"] == pytest.approx(8 / 4001)
    assert got["hot"]["gap_std_pop"] == pytest.approx(statistics.pstdev(gaps), rel=1e-9)
    assert got["hot"]["gap_std_samp"] == pytest.approx(statistics.stdev(gaps), rel=1e-9)
    assert (got["none"]["gaps"], got["none"]["gap_mean"]) == (0, None)
    assert (got["part"]["gaps"], got["part"]["gap_mean"], got["part"]["gap_std_samp"]) == (1, 7.0, None)
    assert (got[None]["gaps"], got[None]["gap_mean"]) == (1, 3.0)


def test_normalize_keeps_nulls_and_raw_scores(spark):
    df = spark.createDataFrame([(1, None, 5.0), (3, 2.0, 5.0), (5, 4.0, 5.0)], "conn_count int, burst_score double, scan_entropy double")
    got = fp.normalize(df).orderBy("conn_count").collect()
    assert [r["conn_count"] for r in got] == [0.0, 0.5, 1.0]
    assert [r["burst_score"] for r in got] == [None, 0.0, 1.0] and got[0]["scan_entropy"] == 5.0


def test_describe_quartiles(spark):
    values = [float(i * i % 97) for i in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "conn_count double")
    r = fp.describe(df, ["conn_count"]).collect()[0]
    q = statistics.quantiles(values, n=4, method="inclusive")
    assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(q, abs=1e-4) and r["count"] == 501


def test_profile_features(make_flows):
    rows = [flow(t, dst=f"3.3.3.{t % 3}", label="flow=From-Botnet-V42-TCP") for t in (0, 10, 20, 30, 7200)]
    flows = make_flows(rows, COLUMNS).withColumn("TotBytes", F.col("SrcBytes") + F.col("DstBytes"))
    got = per_ip.profile_fingerprints(cleaning.per_ip_rows(flows)).collect()[0]
    gaps = [10, 10, 10, 7170]
    assert got["label"] == "Botnet (TCP)" and got["flow_count"] == 5
    assert got["c2_beacon_score"] == pytest.approx(1 / (1 + statistics.pstdev(gaps) / statistics.mean(gaps)))
    assert got["burst_score"] == pytest.approx(4 / 5) and got["scan_score"] == pytest.approx(3 / 10)
    assert got["bytes_per_pkt"] == pytest.approx(55.0) and got["tcp_ratio"] == 1.0


def test_third_source_and_numeric_labels(make_flows):
    rows = [(*flow(i), tag, label) for i, (tag, label) in enumerate([("LAN", 0), ("LAN", 1), ("LAN", 1), ("LAN", 1), ("LAN", 2)])]
    one_source = make_flows(rows, [*COLUMNS, "DatasetSource", "is_malicious"])
    got = fp.fingerprints(one_source).first()
    assert got["dataset_source"] == "LAN" and got["label"] == 1
    mixed = make_flows([(*flow(0), "LAN", 2), (*flow(1), "CTU-13", 0)], [*COLUMNS, "DatasetSource", "is_malicious"])
    assert fp.fingerprints(mixed).first()["dataset_source"] == "Mixed" and fp.fingerprints(mixed).first()["label"] == 0


def test_sketches_merge_to_wider_windows(make_flows):
    from netquarry.operators import sketches

    rows = [(i * 40, "a", f"d{i % 700}", i % 300) for i in range(1500)] + [(5, "b", "x", 1), (9, "b", "x", 2), (3, "c", None, None)]
    flows = make_flows(rows, ["StartTime", "SrcAddr", "DstAddr", "Dport"])
    hours = sketches.hourly_sketches(flows)
    assert hours.filter("SrcAddr = 'a'").count() == 17
    got = {r["SrcAddr"]: r for r in sketches.distinct_counts(hours, "1 day").filter("time_window < '2024-01-02'").collect()}
    exact = len({r[2] for r in rows if r[1] == "a" and r[0] < 43200})
    assert abs(got["a"]["DstAddr_distinct"] - exact) <= exact * sketches.relative_error()
    assert (got["b"]["DstAddr_distinct"], got["b"]["Dport_distinct"]) == (1, 2) and got["c"]["DstAddr_distinct"] == 0


def test_flows_are_exchanged_before_they_fold(make_flows):
    """Folding a whole input split first holds nearly all its rows in memory and spills them."""
    rows = [(i // 2, "1.1.1.1", "2.2.2.2", "tcp", 0.0 if i % 2 else -0.0) for i in range(40)] + [(0, "1.1.1.1", "2.2.2.2", "tcp", 1.0)]
    got = cleaning.clean(make_flows(rows, ["StartTime", "SrcAddr", "DstAddr", "Proto", "Dur"]), parts=3)
    assert got.count() == 21  # zeros of both signs are equal
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan.split("Exchange")[1]
    assert got.rdd.getNumPartitions() == 3


def test_profile_is_derived_once(spark, make_flows, monkeypatch):
    """Ranges and rows both read the written profile, so the flows are not profiled again for the ranges."""
    flows = cleaning.clean(make_flows([flow(60 * i, src=f"1.1.1.{i % 7}", port=i % 5) for i in range(70)], COLUMNS))
    plans = []

    def normalized(profile):
        plans.append(profile._jdf.queryExecution().executedPlan().toString())
        return per_ip_normalized(profile)

    per_ip_normalized = stages.per_ip.normalized_profile
    monkeypatch.setattr(stages.per_ip, "normalized_profile", normalized)
    monkeypatch.setitem(stages._TABLES, (spark.sparkContext.applicationId, "own rows", "flows"), flows)
    found = stages.profile(spark, "own rows")
    assert found.count() == 7 and len(plans) == 1
    assert "FileScan" in plans[0] and "Exchange" not in plans[0]


def _mixed_flows(make_flows):
    """Keys of one to 40 flows: equal times, several labels on a tie, null values and null keys."""
    columns = ["StartTime", "SrcAddr", "DstAddr", "Dport", "Sport", "Proto", "Dur", "SrcBytes", "DstBytes", "TotPkts", "is_malicious", "DatasetSource"]
    rows = []
    for n, ip in ((40, "10.0.0.1"), (9, "10.0.0.2"), (2, "10.0.0.3"), (1, "10.0.0.4"), (6, None)):
        for i in range(n):
            rows.append((
                i * i % 17, ip, None if i == 3 else f"172.16.0.{i % 5}", i % 7 if i % 4 else None, 53 if i % 3 else 4000, "tcp" if i % 2 else "udp",
                i / 8, 100 + i, 90 - i, 1 + i % 3, i % 2 if i != 4 else None, "A" if ip != "10.0.0.2" or i % 2 else "B",
            ))
    kinds = "StartTime int, SrcAddr string, DstAddr string, Dport int, Sport int, Proto string, Dur double, SrcBytes long, DstBytes long, TotPkts long, is_malicious int, DatasetSource string"
    flows = make_flows(rows, kinds)
    return flows.selectExpr("timestampadd(SECOND, StartTime, TIMESTAMP_NTZ'2024-01-01 12:00:00') AS StartTime", *columns[1:])


def test_gathered_and_spread_keys_have_the_same_statistics(spark, monkeypatch):
    flows = _mixed_flows(spark.createDataFrame)
    got = {}
    for most in (1_000, 9, 0):  # all keys gathered, the largest spread, all spread
        monkeypatch.setattr(fp, "GATHERED", most)
        got[most] = {r["SrcAddr"]: r.asDict() for r in fp.raw_fingerprints(flows).collect()}
    assert set(got[0]) == {"10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4"}
    assert got[0]["10.0.0.2"]["dataset_source"] == "Mixed"
    for most in (1_000, 9):
        assert set(got[most]) == set(got[0])
        for ip, row in got[0].items():
            assert set(got[most][ip]) == set(row)
            for name, value in row.items():
                assert got[most][ip][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (most, ip, name)


def test_flows_of_usual_keys_are_exchanged_once(spark):
    plan = fp.raw_fingerprints(_mixed_flows(spark.createDataFrame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plan


def test_profile_of_gathered_and_spread_addresses(spark, make_flows, monkeypatch):
    """Values of usual addresses are not counted in one table of all of them, and addresses of any size have the same features."""
    columns = ["StartTime", "SrcAddr", "DstAddr", "Sport", "Dport", "Proto", "State", "Label", "Dur", "SrcBytes", "DstBytes", "TotPkts"]
    rows = [
        (i * i % 5000, ip, f"172.16.0.{i % 5}", 4000 + i % 3, i % 7, "TCP" if i % 2 else "udp", None if i % 4 else "CON", "a" if i % 3 else None, i / 8, 100 + i, 90 - i, i % 3)
        for n, ip in ((40, "10.0.0.1"), (9, "10.0.0.2"), (2, "10.0.0.3"), (1, "10.0.0.4"), (6, " "), (6, None)) for i in range(n)
    ]
    flows = cleaning.per_ip_rows(make_flows([*rows, rows[0]], columns))
    got = {}
    for most in (1_000, 9, 0):  # all addresses gathered, the largest spread, all spread
        monkeypatch.setattr(per_ip, "GATHERED", most)
        profile = per_ip.profile_fingerprints(flows)
        assert ("Expand" in profile._jdf.queryExecution().executedPlan().toString()) == (most < 1_000)
        got[most] = {r["SrcAddr"]: r.asDict() for r in profile.collect()}
    assert set(got[0]) == {"10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4"} and got[0]["10.0.0.1"]["flow_count"] == 41
    for most in (1_000, 9):
        assert set(got[most]) == set(got[0])
        for ip, row in got[0].items():
            for name, value in row.items():
                assert got[most][ip][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (most, ip, name)
