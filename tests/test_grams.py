"""Gram index against a scan."""

from netquarry.operators.grams import GramIndex


def test_search_equals_a_scan(spark):
    texts = [f"10.{a}.{b}.{a * b % 250}" for a in range(12) for b in range(12)] * 2
    texts += ["é%_é", "aaaa", "aa", "a", "", None, "ab'c\"d", "Zeta 10.1"]
    rows = spark.createDataFrame([(t, 1) for t in texts], "SrcAddr string, text int")
    index = GramIndex.build(rows, "SrcAddr", folders=32)
    for query in ("10.1", "0.1.", ".11.11", "aa", "aaa", "aaaaa", "%_", "é%_é", "b'c\"", "10", "zz", "missing text", "Zeta", "zeta"):
        want = sorted({t for t in texts if t and query in t})
        assert sorted(r["text"] for r in index.search(query).collect()) == want, query
    for short in ("", "a"):
        assert index.search(short).collect() == []
    assert GramIndex(spark, index.path, 32).search("Zeta").count() == 1


def test_search_reads_only_its_folders(spark):
    rows = spark.range(3000).selectExpr("concat_ws('.', id % 250, id % 17, id) AS ip")
    index = GramIndex.build(rows, "ip")
    found = index.search("199")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(gram" in plan or "EqualTo(gram" in plan
    assert found.count() == rows.filter("ip LIKE '%199%'").count()


def test_empty_table(spark):
    index = GramIndex.build(spark.createDataFrame([], "ip string"), "ip")
    assert index.search("abc").collect() == []
