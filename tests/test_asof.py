"""As-of joins against a direct search."""

import random

import pytest

from netquarry.operators.asof import asof_join
from netquarry.operators.timeline import replay_seeds

BASE = "timestampadd(SECOND, s, TIMESTAMP_NTZ'2024-01-01 00:00:00')"


def timed(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr(*[c for c in df.columns if c != "s"], "s AS at", f"{BASE} AS t")


def expected(probe, rows, direction):
    key, s = probe
    if s is None:
        return None
    mine = [r for r in rows if r[0] == key and r[1] is not None]
    before = max((r[1] for r in mine if r[1] <= s), default=None)
    after = min((r[1] for r in mine if r[1] >= s), default=None)
    if direction == "backward" or after is None:
        return before if direction != "forward" else after
    if direction == "forward" or before is None:
        return after
    return before if s - before <= after - s else after


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_equals_direct_search_with_a_busy_key(spark, direction):
    rng = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(keys), rng.randrange(400)) for _ in range(150)] + [("hot", None), ("only-rows", 5)]
    probes = [(rng.choice(keys), rng.randrange(-20, 420)) for _ in range(500)] + [("hot", 100)] * 300 + [("hot", None), ("only-probes", 7)]
    left = timed(spark, [(i, *p) for i, p in enumerate(probes)], "i int, k string, s int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = asof_join(left, timed(spark, rows, "k string, s int").withColumnRenamed("at", "row_at"), "t", ["k"], direction).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(probes)
    for r in got:
        found = r["match"]["row_at"] if r["match"] else None
        assert found == expected(probes[r["i"]], rows, direction), (probes[r["i"]], direction)


def test_empty_sides(spark):
    rows, none = timed(spark, [("a", 1)], "k string, s int"), timed(spark, [], "k string, s int")
    assert asof_join(none, rows, "t", ["k"]).collect() == []
    assert [r["match"] for r in asof_join(rows, none, "t").collect()] == [None]
    with pytest.raises(ValueError):
        asof_join(rows, rows, "t", direction="sideways")


def test_replay_seeds_of_every_campaign(spark):
    flows = spark.createDataFrame(
        [("1.1.1.1", 0), ("1.1.1.2", 30), ("1.1.1.2", 36000), ("2.2.2.2", 7000), ("host", 50000)], "SrcAddr string, s int"
    ).selectExpr("SrcAddr", f"{BASE} AS StartTime")
    camps = spark.createDataFrame([(0, "1.1.1.2", 0), (1, "2.2.2.2", 3600), (2, "host", 0)], "campaign_id int, SrcAddr string, s int").selectExpr(
        "campaign_id", "SrcAddr", f"{BASE} AS time_window"
    )
    steps = spark.range(11).selectExpr("id AS idx", "timestampadd(SECOND, CAST(id * 5000 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS t")
    got = {r[0]: tuple(r)[1:] for r in replay_seeds(flows, camps, steps).collect()}
    # 0: from 0 to 7200 s, nearest steps 0 and 1; 1: one flow at 7000 s; 2: all flows, from 0.
    assert got == {0: (0, 0), 1: (1, 1), 2: (0, 0)}
