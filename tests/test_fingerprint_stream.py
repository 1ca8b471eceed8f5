"""Fingerprints of a stream against the batch operator."""

import random

import pytest

from netquarry.functions.storage import fresh_path
from netquarry.operators.fingerprints import fingerprints
from netquarry.streaming.fingerprints import FingerprintStream

SCHEMA = "s double, SrcAddr string, DstAddr string, Sport int, Dport int, Proto string, Dur double, SrcBytes bigint, DstBytes bigint, TotPkts bigint, Label int"


def flows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr(
        "timestampadd(MICROSECOND, CAST(s * 1000000 AS BIGINT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS StartTime", "* EXCEPT (s)"
    )


def some(rng, lo, hi, n):
    return [
        (rng.randrange(lo * 1000, hi * 1000) / 1000, rng.choice(["10.0.0.1"] * 3 + ["10.0.0.2", "10.0.0.3"]), f"172.16.0.{rng.randrange(9)}",
         rng.randrange(2000), rng.choice([23, 80, 443]), rng.choice(["tcp", "udp"]), rng.random(), rng.randrange(500), rng.randrange(500), 1 + rng.randrange(9),
         rng.randrange(2))
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def batches(spark):
    """Four hours in three batches; the second also brings flows an hour back, the third some of closed windows."""
    rng = random.Random(8)
    return [
        some(rng, 0, 5400, 120),
        some(rng, 3600, 9000, 80) + some(rng, 5400, 9000, 60),
        some(rng, 9000, 14400, 120) + [(10.0, "10.0.0.1", "172.16.0.1", 1, 80, "tcp", 0.1, 1, 1, 1, 0), (None, "10.0.0.1", "172.16.0.1", 1, 80, "tcp", 0.1, 1, 1, 1, 0)],
    ]


def arrive(spark, folder, batch):
    flows(spark, batch).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, stream):
    source = spark.readStream.schema(flows(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream.start(source).awaitTermination()


def test_closed_windows_equal_the_batch_operator(spark, batches):
    folder, stream = fresh_path(spark, "arriving"), FingerprintStream(delay="25 minutes")
    emitted = []
    for batch in batches:
        arrive(spark, folder, batch)
        run(spark, folder, stream)
        emitted.append(sorted(stream.result(flows(spark, [])).collect(), key=repr))
    kept = [r for b in batches for r in b if r[0] is not None and not (b is batches[2] and r[0] == 10.0)]
    horizon = max(r[0] for r in kept) - 25 * 60
    whole = [r for r in fingerprints(flows(spark, kept)).collect() if (r["time_window"].hour + 1) * 3600 <= horizon]
    assert emitted[2] == sorted(whole, key=repr)
    assert {r["time_window"].hour for r in emitted[0]} == {0} and {r["time_window"].hour for r in emitted[2]} == {0, 1, 2}
    assert set(emitted[0]) <= set(emitted[1]) <= set(emitted[2])  # emitted once, never revised
    assert stream.late_flows(spark) == 1


def test_batches_run_again_change_nothing(spark, batches):
    stream = FingerprintStream(delay="25 minutes", path=fresh_path(spark, "again"))
    like = flows(spark, [])
    stream._merge(flows(spark, batches[0]), 0)
    lost = FingerprintStream(delay="25 minutes", path=stream.path)
    import netquarry.streaming.fingerprints as module

    kept = module.write_once
    module.write_once = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    before = sorted(stream.result(like).collect(), key=repr)
    try:
        with pytest.raises(OSError):
            lost._merge(flows(spark, batches[1]), 1)
    finally:
        module.write_once = kept
    assert sorted(stream.result(like).collect(), key=repr) == before  # not committed, not seen
    stream._merge(flows(spark, batches[1]), 1)
    once = sorted(stream.result(like).collect(), key=repr)
    stream._merge(flows(spark, batches[1]), 1)
    stream._merge(flows(spark, batches[0]), 0)
    assert sorted(stream.result(like).collect(), key=repr) == once
    kept = [r for b in batches[:2] for r in b]
    horizon = max(r[0] for r in kept) - 25 * 60
    whole = [r for r in fingerprints(flows(spark, kept)).collect() if (r["time_window"].hour + 1) * 3600 <= horizon]
    assert once == sorted(whole, key=repr)


def test_empty_batches(spark):
    stream = FingerprintStream(path=fresh_path(spark, "empty"))
    like = flows(spark, [])
    stream._merge(like, 0)
    assert stream.result(like).collect() == [] and stream.late_flows(spark) == 0
