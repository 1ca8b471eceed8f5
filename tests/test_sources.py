"""Readers, cleaning and sinks on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from netquarry.operators.cleaning import clean, parse_time, per_ip_rows
from netquarry.schema import UNIFIED_COLUMNS
from netquarry.sources import intel, readers, writers
from netquarry.streaming.sampler import StreamSampler
from netquarry.operators.sampling import reservoir

HEADER = "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label"
ROW = "2013/11/02 21:07:19.405,1.75,TCP ,192.0.2.77,40112,->,198.51.100.9,2323,CON,0,0,6,912,655,flow=From-Botnet-T9"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_binetflow_parse_label_and_bytes(spark, tmp_path):
    bad = ROW.replace("192.0.2.77", "")
    late = ROW.replace("2013/11/02 21:07:19.405", "not a time")
    path = write(tmp_path / "a.binetflow", HEADER, ROW, ROW, bad, late, ROW.replace("912,655", "100,655").replace("40112", "0x0303"))
    got = clean(readers.read_flows(spark, path)).orderBy("DstBytes").collect()
    assert len(got) == 2  # duplicate, missing address and unreadable time are gone
    assert [r["DstBytes"] for r in got] == [0, 257]
    assert [r["Sport"] for r in got] == [0, 40112]
    r = got[1]
    assert (r["Proto"], r["ProtoCode"], r["is_malicious"], r["Label"], r["DatasetSource"]) == ("tcp", 0, 1, 1, "CTU-13")
    assert r["StartTime"] == dt.datetime(2013, 11, 2, 21, 7, 19, 405000)


def test_times(spark):
    texts = ["2013/11/02 21:07:19.405", "2011-08-15T10:42:52", "05/07/2017 08:42:42", "5/7/2017 8:42:42 PM", "12/07/2017 12:05:00 AM", "nope", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_time(F.col("t")).alias("x"), parse_time(F.col("t"), True).alias("y"))
    got = [(r["x"], r["y"]) for r in df.collect()]
    d = dt.datetime
    assert got[0][0] == d(2013, 11, 2, 21, 7, 19, 405000) and got[1][0] == d(2011, 8, 15, 10, 42, 52)
    assert got[2] == (d(2017, 5, 7, 8, 42, 42), d(2017, 7, 5, 8, 42, 42))
    assert got[3][0] == d(2017, 5, 7, 20, 42, 42) and got[4][0] == d(2017, 12, 7, 0, 5)
    assert got[5] == got[6] == (None, None)


def test_zeek_layouts(spark, tmp_path):
    write(tmp_path / "x1.conn.log.labeled", "#separator \\x09",
          "\t".join(["#fields", "ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "label", "detailed-label"]),
          "\t".join(["1545402842.863", "192.168.1.1", "41040", "1.2.3.4", "80", "TCP", "-", "10", "20", "3", "Malicious", "C&C"]),
          "\t".join(["1545402843", "192.168.1.2", "1", "1.2.3.4", "80", "udp", "2.5"]), "#close")
    write(tmp_path / "x2.conn.log.labeled", "\t".join(["#fields", "proto", "id.orig_h", "ts"]), "\t".join(["icmp", "192.168.1.3", "1545402844"]))
    got = readers.read_zeek(spark, str(tmp_path / "*.labeled")).orderBy("SrcAddr").collect()
    assert [r["SrcAddr"] for r in got] == ["192.168.1.1", "192.168.1.2", "192.168.1.3"]
    a, b, c = got
    assert a["StartTime"] == dt.datetime(2018, 12, 21, 14, 34, 2, 863000)
    assert (a["Label"], a["SubLabel"], a["Dur"], a["TotPkts"], a["Proto"]) == (1, "C&C", 0.0, 3, "tcp")
    assert (b["Label"], b["SubLabel"], b["Dur"], b["SrcBytes"]) == (0, "", 2.5, 0)
    assert (c["Proto"], c["DstAddr"], c["Dport"]) == ("icmp", "", 0)
    named = readers.read_zeek(spark, str(tmp_path / "x2.conn.log.labeled"), fields=["proto", "id.orig_h", "ts"])
    assert named.collect() == [c]


def test_cic_and_aliases(spark, tmp_path):
    path = write(tmp_path / "f.csv", "Src IP,Dst IP,Timestamp,Protocol,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Label",
                 "1.1.1.1,2.2.2.2,2018-02-14 08:31:01,TCP,12.0,3,4,100,x,DDoS attack", "1.1.1.1,2.2.2.2,2018-02-14 08:31:02,udp,,,,,,BENIGN")
    assert readers.detect_format(spark, path) == "cic"
    a, b = readers.read_flows(spark, path).orderBy("StartTime").collect()
    assert (a["TotPkts"], a["SrcBytes"], a["DstBytes"], a["Label"], a["Dur"]) == (7, 100, 0, 1, 12.0)
    assert (b["TotPkts"], b["Label"]) == (0, 0)
    assert readers.match_column(["Dur"], "flow_duration") is None
    assert readers.match_column(["Dur"], "flow_duration", lenient=True) == "Dur"


def test_generic_union_store_and_expand(spark, tmp_path):
    g = write(tmp_path / "g.csv", "StartTime,SrcAddr,DstAddr,Proto,Label", "2024-01-01 00:00:00,1.1.1.1,2.2.2.2,tcp,Attack")
    flows = clean(readers.read_flows(spark, g))
    assert flows.first()["is_malicious"] == 1 and flows.first()["DatasetSource"] == "IoT-23"
    with pytest.raises(ValueError):
        readers.read_flows(spark, write(tmp_path / "h.csv", "a,b", "1,2"))
    with pytest.raises(ValueError):
        readers.detect_format(spark, "x.pcap")
    deep = tmp_path / "in" / "deep"
    deep.mkdir(parents=True)
    one, two = write(tmp_path / "in" / "1.binetflow", HEADER, ROW), write(deep / "2.binetflow", HEADER, ROW)
    patterns = [f"{tmp_path}/in/*.binetflow", f"{tmp_path}/in/**/*.binetflow", f"{tmp_path}/none/*.csv"]
    assert readers.expand_inputs(spark, patterns) == sorted([one, two])
    assert readers.expand_inputs(spark, patterns, exclude=[one]) == [two]
    both = readers.union_sources([flows, clean(readers.read_flows(spark, one))])
    assert both.count() == 2
    out = str(tmp_path / "out")
    writers.write_flows(both, out, csv_path=out + ".csv")
    back = readers.read_stored(spark, out)
    assert set(UNIFIED_COLUMNS) <= set(back.columns)
    key = ["StartTime", "SrcAddr", "Label"]
    assert sorted(back.select(key).collect()) == sorted(readers.read_stored(spark, out + ".csv", "csv").select(key).collect())


def test_intel_map(spark, tmp_path):
    path = write(tmp_path / "ti.json", '{\n "1.1.1.1": {"vt_malicious": 9, "abuse_score": 82, "asn": "AS1"},\n "2.2.2.2": {"country": "NL"}\n}')
    got = {r["ip"]: r for r in intel.read_intel_map(spark, path, per_line=False).collect()}
    assert got["1.1.1.1"]["vt_malicious"] == 9 and got["2.2.2.2"]["country"] == "NL" and got["2.2.2.2"]["asn"] is None


def test_profile_rows_defaults(spark, make_flows):
    rows = make_flows([("2024-01-01 00:00:00", " 1.1.1.1 ", "2.2.2.2", "TCP", 0.0, 10.0, 30.0), ("2024-01-01 00:00:00", "", "2.2.2.2", "TCP", 1.0, 1.0, 1.0)],
                      ["StartTime", "SrcAddr", "DstAddr", "Proto", "TotPkts", "TotBytes", "SrcBytes"])
    got = per_ip_rows(rows.withColumn("Label", F.lit("x"))).collect()
    assert len(got) == 1
    assert (got[0]["SrcAddr"], got[0]["TotPkts"], got[0]["DstBytes"], got[0]["State"]) == ("1.1.1.1", 1.0, 0.0, "")


def test_reservoir_batch_equals_incremental(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id % 7 AS v")
    batch = reservoir(df, ["id"], 50)
    assert batch.count() == 50 and reservoir(df, ["id"], 5000).count() == 1000
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    sampler = StreamSampler(["id"], 50)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    sampler.start(stream).awaitTermination()
    assert sorted(sampler.result(df).collect()) == sorted(batch.collect())


def test_mixed_sources_share_one_schema(spark, tmp_path):
    """The usage shown in the README, over four formats with bad cells, empty keys and repeats."""
    write(tmp_path / "a.binetflow", HEADER, ROW, ROW, ROW.replace("192.0.2.77", ""))
    fields = "\t".join(["#fields", *(f"x{i}" for i in range(1200)), "ts", "id.orig_h", "id.resp_h", "proto", "label", "detailed-label"])
    cells = "\t".join([*("-" for _ in range(1200)), "1383426439.5", "192.0.2.8", "198.51.100.2", "TCP", "Malicious", "Okiru"])
    write(tmp_path / "x.conn.log.labeled", fields, cells)
    write(tmp_path / "cic.csv", "Timestamp,Source IP,Destination IP,Protocol,Flow Duration,Label", "05/07/2017 08:42:42,192.0.2.1,192.0.2.2,6,3,BENIGN")
    write(tmp_path / "own.csv", "StartTime,SrcAddr,DstAddr,Proto,Dport,Label,DatasetSource", "2020-01-01T00:00:00,192.0.2.3,192.0.2.4,udp,0x0303,1,LAN",
          "2020-01-01T00:00:00,192.0.2.5,192.0.2.4,udp,53,0,LAN", "some day,192.0.2.5,192.0.2.4,udp,53,0,LAN")
    paths = readers.expand_inputs(spark, [str(tmp_path / "*.*")])
    flows = clean(readers.union_sources([readers.read_flows(spark, p) for p in paths]))
    got = {(r["SrcAddr"], r["Dport"], r["Label"], r["DatasetSource"]) for r in flows.collect()}
    assert flows.count() == 5 and got == {
        ("192.0.2.77", 2323, 1, "CTU-13"), ("192.0.2.8", 0, 1, "IoT-23"), ("192.0.2.1", 0, 0, "IoT-23"), ("192.0.2.3", 0, 1, "LAN"), ("192.0.2.5", 53, 0, "LAN"),
    }
    with pytest.raises(ValueError, match="StartTime"):
        readers.union_sources([readers.read_binetflow(spark, paths[0]), flows])


def test_stream_sample_of_nothing(spark, tmp_path):
    schema = "k bigint"
    (tmp_path / "in").mkdir()
    sampler = StreamSampler(["k"], limit=5, path=str(tmp_path / "out"))
    sampler.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).awaitTermination()
    assert sampler.result(spark.createDataFrame([], schema)).count() == 0


def test_log_without_header_is_reported(spark, tmp_path):
    path = write(tmp_path / "y.conn.log.labeled", "1383426439.5\t192.0.2.8")
    with pytest.raises(Exception, match="no #fields line"):
        readers.read_zeek(spark, path).collect()
