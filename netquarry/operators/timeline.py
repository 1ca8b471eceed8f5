"""Replay timeline, visibility and campaign spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.config import DEFAULT
from netquarry.functions.network import event_class, last_octets, micros_between, subnet24_lenient, window_start
from netquarry.functions.storage import materialize
from netquarry.operators.asof import asof_join
from netquarry.operators.scoring import latest_campaign


def _step_rank(j: Column, n: Column, picks: Column) -> Column:
    """Rank of the j-th of ``picks`` evenly spaced picks among n, rounded half to even."""
    whole, rest = j * (n - 1), F.greatest(picks - 1, F.lit(1))
    q = F.floor(whole / rest)
    r = whole - q * rest
    up = (r * 2 > rest) | ((r * 2 == rest) & (q % 2 == 1))
    return q + up.cast("int")


def replay_timeline(flows: DataFrame, steps: int = DEFAULT.replay_steps) -> DataFrame:
    """At most ``steps`` evenly spaced distinct flow times (idx, t).

    Distinct times are counted per second; running totals over hours and inside
    an hour give each second the ranks it holds, so the picks that fall into it are
    known without ordering a time. Only times of seconds with a pick are ranked.
    """
    times = flows.filter(F.col("StartTime").isNotNull()).select(F.col("StartTime").alias("t")).distinct()
    times = materialize(times.withColumn("_s", window_start("t", "1 second")), "times")
    seconds = times.groupBy("_s").agg(F.count(F.lit(1)).alias("_size")).withColumn("_h", window_start("_s", "1 hour"))
    hours = seconds.groupBy("_h").agg(F.sum("_size").alias("_hour"))
    before = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("_h", F.coalesce(F.sum("_hour").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_h").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    placed = seconds.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(hours, "_h")
    placed = placed.withColumn("_n", seconds.agg(F.sum("_size")).scalar()).withColumn("_first", F.col("_base") + F.col("_in"))
    n, first, after = F.col("_n"), F.col("_first"), F.col("_first") + F.col("_size")
    picks = F.least(n, F.lit(steps))
    # The pick nearest to a rank is rank * (picks - 1) / (n - 1), give or take one.
    share = (picks - 1) / F.greatest(n - 1, F.lit(1))
    low = F.greatest(F.floor(first * share) - 1, F.lit(0))
    high = F.least(F.floor((after - 1) * share) + 2, picks - 1)
    near = placed.select("_s", n, first, after.alias("_after"), F.explode(F.sequence(low, F.greatest(low, high))).alias("_j"))
    target = _step_rank(F.col("_j"), n, picks)
    hits = near.withColumn("_rank", target).filter((F.col("_j") < picks) & (F.col("_rank") >= first) & (F.col("_rank") < F.col("_after")))
    hits = materialize(hits.select("_s", F.col("_j").alias("idx"), (F.col("_rank") - first).alias("_r")), "picks")  # at most ``steps`` rows
    hit_times = times.join(hits.select("_s").distinct(), "_s")
    ranked = hit_times.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("t")) - 1)
    return ranked.join(hits, ["_s", "_r"]).select("idx", "t")


def replay_seed(flows: DataFrame, camps: DataFrame, timeline: DataFrame, anchor: int) -> DataFrame:
    """Default and middle timeline index for an anchor campaign.

    The start of the anchor's first /24 and a point two hours later (or its
    end) are matched to their nearest timeline steps.
    """
    hosts = camps.filter((F.col("campaign_id") == anchor) & F.col("SrcAddr").rlike(r"^[^.]*(\.[^.]*){3}$"))
    first = hosts.agg(F.min(F.struct("time_window", "SrcAddr"))["SrcAddr"].alias("ip")).select(
        F.concat(subnet24_lenient("ip"), F.lit(".")).alias("p")
    )
    span = (
        flows.withColumn("_p", first.scalar())
        .filter(F.col("SrcAddr").startswith(F.coalesce("_p", F.lit(""))))
        .agg(F.struct(F.min("StartTime").alias("t0"), F.max("StartTime").alias("t1")).alias("s"))
    )
    rows = timeline.withColumn("_s", span.scalar())
    t0 = F.col("_s.t0")
    t1 = F.least(F.timestamp_add("HOUR", F.lit(2), t0), F.col("_s.t1"))

    def nearest(target: Column) -> Column:
        gap = F.abs(micros_between(target, F.col("t")))
        return F.min_by("idx", F.struct(gap, F.col("idx")))

    picks = rows.agg(nearest(t0).alias("lo"), nearest(t1).alias("hi"), F.max("idx").alias("last"))
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    return picks.select(
        F.lit(anchor).alias("anchor_campaign"),
        F.col("lo").alias("default_idx"),
        F.least(F.col("last"), F.greatest(F.col("lo"), mid)).alias("mid_idx"),
    )


def replay_seeds(flows: DataFrame, camps: DataFrame, timeline: DataFrame) -> DataFrame:
    """Default and middle timeline index of every campaign, as ``replay_seed`` gives for one.

    Flows fold to one span per /24 before they meet a campaign; both ends of all
    spans are matched to the timeline together. A campaign without a dotted address
    starts where the flows start.
    """
    dotted = F.col("SrcAddr").rlike(r"^[^.]*(\.[^.]*){3}$")
    first = F.min(F.when(dotted, F.struct("time_window", "SrcAddr")))["SrcAddr"]
    anchors = camps.groupBy(F.col("campaign_id").alias("anchor_campaign")).agg(subnet24_lenient(first).alias("_p"))
    net = F.when(F.col("SrcAddr").rlike(r"^[^.]*(\.[^.]*){3,}$"), subnet24_lenient("SrcAddr"))
    spans = materialize(
        flows.groupBy(net.alias("_net")).agg(F.min("StartTime").alias("t0"), F.max("StartTime").alias("t1")), "spans"
    )
    whole = spans.agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).withColumn("_net", F.lit(None).cast("string"))
    placed = anchors.join(spans.filter("_net IS NOT NULL").unionByName(whole), F.col("_p").eqNullSafe(F.col("_net")), "left")
    later = F.least(F.timestamp_add("HOUR", F.lit(2), F.col("t0")), F.col("t1"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("t0").alias("t")), F.struct(F.lit(1).alias("end"), later.alias("t"))))
    steps = timeline.select("idx", "t")
    found = asof_join(placed.select("anchor_campaign", ends.alias("_e")).select("anchor_campaign", "_e.*"), steps, "t")
    picks = found.groupBy("anchor_campaign").agg(
        F.max(F.when(F.col("end") == 0, F.col("match.idx"))).alias("lo"), F.max(F.when(F.col("end") == 1, F.col("match.idx"))).alias("hi")
    ).withColumn("last", steps.agg(F.max("idx")).scalar())
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    return picks.select(
        "anchor_campaign",
        F.coalesce("lo", F.lit(0)).cast("bigint").alias("default_idx"),
        F.coalesce(F.least(F.col("last"), F.greatest(F.col("lo"), mid)), F.floor(F.col("last") / 2)).cast("bigint").alias("mid_idx"),
    )


def first_seen(flows: DataFrame) -> DataFrame:
    return flows.groupBy(F.col("SrcAddr").alias("ip")).agg(F.min("StartTime").alias("first_seen"))


def visible_at(addresses: DataFrame, seen: DataFrame, cutoff: Column) -> DataFrame:
    """Addresses first seen by the cutoff; an address never seen is visible."""
    joined = addresses.select("ip").distinct().join(seen, "ip", "left")
    return joined.filter(F.col("first_seen").isNull() | (F.col("first_seen") <= cutoff)).select("ip")


def replay_feed(flows: DataFrame, camps: DataFrame, cutoff: Column, rows: int = 10) -> DataFrame:
    """Last flows at or before the cutoff with their latest campaign.

    The limit comes first, so only its rows meet the campaign table.
    """
    tail = (
        flows.filter(F.col("StartTime") <= cutoff)
        .select("StartTime", "SrcAddr", "DstAddr", "Proto", "Dport", "Sport", "TotBytes")
        .orderBy(F.desc("StartTime"), F.asc("SrcAddr"), F.asc("DstAddr"), F.asc("Sport"), F.asc("Dport"))
        .limit(rows)
    )
    wanted = camps.join(tail.select("SrcAddr").distinct(), "SrcAddr", "left_semi")
    joined = tail.join(latest_campaign(wanted), "SrcAddr", "left")
    return joined.select(
        "StartTime", F.date_format("StartTime", "HH:mm").alias("clock"), "SrcAddr", "DstAddr",
        last_octets("SrcAddr").alias("src"), last_octets("DstAddr").alias("dst"), "Proto", "campaign_id", "attack_type",
        event_class("attack_type").alias("event"),
    )


def campaign_spans(camps: DataFrame, scores: DataFrame) -> DataFrame:
    """First and last window per campaign with its score; at least one hour long."""
    spans = camps.groupBy("campaign_id").agg(
        F.min("time_window").alias("t0"), F.max("time_window").alias("_t1"), F.countDistinct("SrcAddr").alias("n_ips")
    )
    t1 = F.when(F.col("_t1") <= F.col("t0"), F.timestamp_add("HOUR", F.lit(1), F.col("t0"))).otherwise(F.col("_t1"))
    out = spans.withColumn("t1", t1).withColumn(
        "duration_s", F.timestamp_diff("SECOND", F.col("t0"), F.col("t1"))
    )
    s = scores.select(F.col("cluster_id").alias("campaign_id"), "confidence_pct")
    return out.join(s, "campaign_id", "left").select(
        "campaign_id", "t0", "t1", "duration_s", "n_ips", F.coalesce("confidence_pct", F.lit(0.0)).alias("confidence_pct")
    )
