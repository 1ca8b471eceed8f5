"""Address/campaign graph as two DataFrames, with centralities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import DEFAULT
from netquarry.functions.network import (
    last_octets, malicious_profile, subnet24_lenient,
)
from netquarry.functions.storage import materialize
from netquarry.functions.rules import UNKNOWN_FAMILY
from netquarry.operators.ranking import top_n_per_group

HUB_PREFIX = "campaign_"


def _hub(cid: Column) -> Column:
    return F.concat(F.lit(HUB_PREFIX), cid.cast("string"))


def with_families(enriched: DataFrame, entries: DataFrame) -> DataFrame:
    """Attach each campaign's family to its enriched rows."""
    fam = entries.select("campaign_id", "iot_family")
    return enriched.join(fam, "campaign_id", "left").withColumn("iot_family", F.coalesce("iot_family", F.lit("")))


def _named_family(drop_unknown: bool) -> Column:
    fam = F.col("iot_family")
    keep = F.coalesce(fam, F.lit("")).isin("", "None", "nan")
    return ~keep & (fam != UNKNOWN_FAMILY) if drop_unknown else ~keep


def _is_asn() -> Column:
    return F.coalesce(F.upper("asn").startswith("AS"), F.lit(False))


def build_nodes(members: DataFrame, enriched: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """Node table (id, type, campaign_id).

    An address listed in the enrichment takes its highest enriched campaign;
    any other takes its lowest campaign. One combining aggregate settles both.
    """
    listed = enriched.filter(F.coalesce("ip", F.lit("")) != "")
    none = F.lit(None).cast("int")
    candidates = listed.select("ip", F.col("campaign_id").alias("e"), none.alias("c")).unionByName(
        members.select(F.col("SrcAddr").alias("ip"), none.alias("e"), F.col("campaign_id").alias("c"))
    )
    ips = candidates.groupBy("ip").agg(F.coalesce(F.max("e"), F.min("c")).alias("campaign_id")).select(
        F.col("ip").alias("id"), F.lit("ip").alias("type"), "campaign_id"
    )
    asns = listed.filter(_is_asn()).select(F.col("asn").alias("id"), F.lit("asn").alias("type"), none.alias("campaign_id"))
    out = ips.unionByName(asns.distinct())
    if "iot_family" in enriched.columns:
        fams = listed.filter(_named_family(drop_unknown)).select(
            F.col("iot_family").alias("id"), F.lit("malware_family").alias("type"), none.alias("campaign_id")
        )
        out = out.unionByName(fams.distinct())
    hubs = members.select("campaign_id").distinct().select(
        _hub(F.col("campaign_id")).alias("id"), F.lit("campaign").alias("type"), "campaign_id"
    )
    return out.unionByName(hubs)


def build_edges(members: DataFrame, enriched: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """De-duplicated edge table (src, dst, relation); campaigns are stars, not cliques."""
    listed = enriched.filter(F.coalesce("ip", F.lit("")) != "")
    edges = listed.filter(_is_asn()).select(
        F.col("ip").alias("src"), F.col("asn").alias("dst"), F.lit("belongs_to_asn").alias("relation")
    ).distinct()
    if "iot_family" in enriched.columns:
        edges = edges.unionByName(
            listed.filter(_named_family(drop_unknown)).select(
                F.col("ip").alias("src"), F.col("iot_family").alias("dst"), F.lit("associated_malware").alias("relation")
            ).distinct()
        )
    stars = members.select(
        F.col("SrcAddr").alias("src"), _hub(F.col("campaign_id")).alias("dst"), F.lit("shares_campaign").alias("relation")
    )
    return edges.unionByName(stars.distinct())


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(in + out degree) / (n - 1), rounded to 6; a single node scores 1."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_deg"))
    n = nodes.agg(F.count(F.lit(1))).scalar()
    joined = nodes.join(ends, "id", "left").withColumn("_n", n)
    score = F.when(F.col("_n") <= 1, F.lit(1.0)).otherwise(
        F.try_divide(F.coalesce("_deg", F.lit(0)), F.col("_n") - 1)
    )
    return joined.select(*nodes.columns, F.round(score, 6).alias("degree_centrality"))


def _classes(links: DataFrame) -> DataFrame:
    """(id, cls): nodes with equal neighbour sets, in both directions, share a class.

    Sets compare by their size and two XORs of independent hashes, so they are
    never gathered.
    """
    def side(own: str, other: str, name: str) -> DataFrame:
        return links.groupBy(F.col(own).alias("id")).agg(
            F.struct(F.bit_xor(F.xxhash64(other)).alias("x"), F.bit_xor(F.xxhash64(other, F.lit(1))).alias("y"), F.count(F.lit(1)).alias("n")).alias(name)
        )

    both = side("src", "dst", "out").join(side("dst", "src", "back"), "id", "full")
    # A missing side is told apart by its flag: hashes pass over nulls.
    parts = [F.col("out").isNull(), F.col("out"), F.col("back").isNull(), F.col("back")]
    return both.select("id", F.concat_ws("_", F.xxhash64(F.lit(0), *parts), F.xxhash64(F.lit(1), *parts)).alias("cls"))


def betweenness_error(n: int, pivots: int, confidence: float = 0.95) -> float:
    """How far any node's score from so many pivots may be off, all nodes at once, with this confidence.

    A pivot's share of a node's score lies between 0 and n / (n - 1), so Hoeffding's
    inequality holds for the mean over pivots drawn without replacement.
    """
    if pivots >= n or n <= 2:
        return 0.0
    return n / (n - 1) * math.sqrt(math.log(2 * n / (1 - confidence)) / (2 * pivots))


def pivot_order(node: Column, seed: int = DEFAULT.seed) -> Column:
    """Hash by which pivots are drawn."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), node), 256)


def betweenness_centrality(
    nodes: DataFrame, edges: DataFrame, directed: bool = True, pivots: int | None = None, seed: int = DEFAULT.seed,
) -> DataFrame:
    """Normalised shortest-path betweenness (id, betweenness_centrality); exact without ``pivots``.

    With ``pivots`` paths start only from so many nodes, drawn by a seeded hash, and
    scores scale up by nodes / pivots; ``betweenness_error`` bounds the error, and as
    many pivots as nodes are exact again. Rows are then at most pivots x classes.

    Nodes with equal neighbour sets lie on equally many shortest paths, so they
    fold into weighted classes and the search runs on the graph of classes, which
    for addresses around campaigns is small however many addresses there are. All
    source classes advance together: one frontier join per path length going out,
    one per length coming back, each level written to the shared folder. In a
    source's own class the source (at_source) is kept apart from its peers.
    """
    zero = F.lit(0.0).alias("betweenness_centrality")
    n = nodes.count()
    drawn = n if pivots is None else min(pivots, n)
    links = edges.select("src", "dst").filter("src <> dst")
    if not directed:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = materialize(links.distinct(), "links")
    if n <= 2 or drawn < 1 or links.isEmpty():
        return nodes.select("id", zero)
    classes = materialize(_classes(links), "classes")
    sizes = materialize(classes.groupBy("cls").agg(F.count(F.lit(1)).cast("double").alias("m")), "class-sizes")
    arcs = (
        links.join(classes.select(F.col("id").alias("src"), F.col("cls").alias("c")), "src")
        .join(classes.select(F.col("id").alias("dst"), F.col("cls").alias("d")), "dst").select("c", "d").distinct()
    )
    arcs = materialize(arcs.join(sizes.select(F.col("cls").alias("d"), F.col("m").alias("md")), "d"), "class-arcs")
    # p: pivots among a class's nodes; every node is one if all are drawn.
    marked = classes.withColumn("pivot", F.lit(1))
    if drawn < n:
        chosen = nodes.select("id").orderBy(pivot_order(F.col("id"), seed), "id").limit(drawn).withColumn("pivot", F.lit(1))
        marked = materialize(classes.join(chosen, "id", "left").withColumn("pivot", F.coalesce("pivot", F.lit(0))), "pivots")
    sources = materialize(marked.groupBy(F.col("cls").alias("s")).agg(F.sum("pivot").cast("double").alias("p")).filter("p > 0"), "pivot-classes")
    # m: how many nodes the row stands for, seen from one source.
    level = materialize(
        sizes.join(sources, F.col("cls") == F.col("s")).select("s", F.col("cls").alias("v"), F.lit(True).alias("at_source"), F.lit(1.0).alias("m"), F.lit(1.0).alias("sigma")),
        "level",
    )
    levels, seen = [level], None
    while True:
        step = (
            levels[-1].join(arcs, F.col("v") == F.col("c"))
            .groupBy("s", F.col("d").alias("v")).agg(F.sum(F.col("m") * F.col("sigma")).alias("sigma"), F.max("md").alias("md"))
            .withColumn("m", F.when(F.col("s") == F.col("v"), F.col("md") - 1).otherwise(F.col("md"))).filter("m > 0")
        )
        if seen is not None:
            step = step.join(seen, ["s", "v"], "left_anti")
        step = materialize(step.select("s", "v", F.lit(False).alias("at_source"), "m", "sigma"), "level")
        if step.isEmpty():
            break
        levels.append(step)
        seen = step.select("s", "v") if seen is None else seen.unionByName(step.select("s", "v"))
    delta = levels[-1].withColumn("delta", F.lit(0.0))
    total = None
    for d in range(len(levels) - 1, 0, -1):
        part = delta.select("s", "v", "delta")
        total = part if total is None else total.unionByName(part)
        if d == 1:
            break
        above = delta.select("s", F.col("v").alias("d"), (F.col("m") * (1 + F.col("delta")) / F.col("sigma")).alias("share"))
        gained = (
            levels[d - 1].join(arcs, F.col("v") == F.col("c")).join(above, ["s", "d"])
            .groupBy("s", "v").agg(F.sum(F.col("sigma") * F.col("share")).alias("delta"))
        )
        delta = materialize(
            levels[d - 1].join(gained, ["s", "v"], "left").select("s", "v", "m", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")), "delta"
        )
    if total is None:
        return nodes.select("id", zero)
    # A node is no go-between on paths from itself: in its own class one pivot less counts if it is one.
    same = F.col("s") == F.col("v")
    sums = total.join(sources, "s").groupBy(F.col("v").alias("cls")).agg(
        F.sum(F.when(same, 0.0).otherwise(F.col("p") * F.col("delta"))).alias("others"),
        F.coalesce(F.sum(F.when(same, F.col("delta"))), F.lit(0.0)).alias("own"), F.coalesce(F.sum(F.when(same, F.col("p"))), F.lit(0.0)).alias("p"),
    )
    b = F.col("others") + F.col("own") * (F.col("p") - F.col("pivot"))
    scale = n / drawn / ((n - 1) * (n - 2))
    return nodes.select("id").join(marked.join(sums, "cls").select("id", b.alias("b")), "id", "left").select(
        "id", F.round(F.coalesce("b", F.lit(0.0)) * scale, 6).alias("betweenness_centrality")
    )


def induced_subgraph(nodes: DataFrame, edges: DataFrame, campaign_id: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that carry a campaign id, and the edges between them."""
    kept = nodes.filter(F.col("campaign_id") == campaign_id)
    return kept, edges_between(edges, kept)


def edges_between(edges: DataFrame, kept: DataFrame) -> DataFrame:
    ids = kept.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    ).select(*edges.columns)


def capped_graph(nodes: DataFrame, edges: DataFrame, cap: int = DEFAULT.graph_display_cap) -> tuple[DataFrame, DataFrame]:
    """Most central addresses per campaign for display; other nodes untouched."""
    is_ip = F.col("type") == "ip"
    top = top_n_per_group(nodes.filter(is_ip), ["campaign_id"], [F.desc("degree_centrality"), F.asc("id")], cap)
    kept = top.unionByName(nodes.filter(~is_ip))
    return kept, edges_between(edges, kept)


def collapsed_graph(
    nodes: DataFrame, edges: DataFrame, campaign_id: int, expanded: Sequence[str] = (), threshold: int = 20
) -> tuple[DataFrame, DataFrame]:
    """One campaign with its addresses folded into /24 nodes.

    Folding starts above ``threshold`` addresses and skips expanded prefixes.
    Edges of other campaigns' addresses or hubs are left out.
    """
    hub = f"{HUB_PREFIX}{campaign_id}"
    mine = nodes.filter((F.col("type") == "ip") & (F.col("campaign_id") == campaign_id))
    prefix = subnet24_lenient("id")
    n = mine.agg(F.count(F.lit(1))).scalar()
    folded = F.concat(F.lit("__subnet__"), F.replace(prefix, F.lit("."), F.lit("_")))
    open_prefix = prefix.isin(list(expanded)) if expanded else F.lit(False)
    mapping = mine.withColumn("_n", n).select(
        F.col("id").alias("node"),
        F.when((F.col("_n") > threshold) & ~open_prefix, folded).otherwise(F.col("id")).alias("shown"),
        prefix.alias("prefix"),
    )
    fixed = nodes.filter((F.col("type") != "ip") & ((F.col("type") != "campaign") | (F.col("id") == hub)))
    ends = mapping.select("node", "shown").unionByName(fixed.select(F.col("id").alias("node"), F.col("id").alias("shown")))
    out_edges = (
        edges.join(ends.select(F.col("node").alias("src"), F.col("shown").alias("s")), "src")
        .join(ends.select(F.col("node").alias("dst"), F.col("shown").alias("d")), "dst")
        .filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst"), "relation").distinct()
    )
    subnets = mapping.filter("node <> shown").groupBy("shown", "prefix").agg(F.count(F.lit(1)).alias("ip_count")).select(
        F.col("shown").alias("id"), F.lit("subnet").alias("type"),
        F.concat("prefix", F.lit(".x ("), F.col("ip_count").cast("string"), F.lit(" IPs)")).alias("label"), "ip_count",
    )
    plain = nodes.filter((F.col("type") != "ip") | (F.col("campaign_id") == campaign_id)).select(
        "id", "type", F.col("id").alias("label"), F.lit(None).cast("bigint").alias("ip_count")
    )
    used = out_edges.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(
        nodes.filter(F.col("id") == hub).select("id")
    ).distinct()
    return subnets.unionByName(plain).join(used, "id", "left_semi"), out_edges


def visible_subgraph(nodes: DataFrame, edges: DataFrame, visible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the listed addresses, with edges that have both ends among them."""
    ids = visible.select(F.col("ip").alias("id")).distinct()
    kept = nodes.filter(F.col("type") == "ip").join(ids, "id", "left_semi")
    return kept, edges_between(edges, ids)


def display_labels(nodes: DataFrame) -> DataFrame:
    """Short node label by node type."""
    t = F.col("type")
    org = F.left(F.coalesce("asn_org", F.lit("")), F.lit(14)) if "asn_org" in nodes.columns else F.lit("")
    label = (
        F.when(t == "ip", last_octets("id"))
        .when(t == "campaign", F.concat(F.lit("C"), F.col("campaign_id").cast("string")))
        .when(t == "malware_family", F.left("id", F.lit(18)))
        .when(t == "asn", F.when(org != "", F.concat("id", F.lit("\n"), org)).otherwise(F.col("id")))
        .otherwise(F.left("id", F.lit(16)))
    )
    return nodes.withColumn("label", label)


def profile_graph(assigned: DataFrame, campaigns: DataFrame, max_ips: int = 300) -> tuple[DataFrame, DataFrame]:
    """Per-address profile graph: busiest addresses, their /24 and their label."""
    top = assigned.select("SrcAddr", "flow_count", "label", "campaign_id").orderBy(
        F.desc("flow_count"), F.asc("SrcAddr")
    ).limit(max_ips)
    net = F.concat(subnet24_lenient("SrcAddr"), F.lit(".0"))
    name = F.when(F.coalesce("label", F.lit("")) == "", F.lit("Unknown")).otherwise(F.col("label"))
    rows = top.join(campaigns.select("campaign_id", "confidence"), "campaign_id", "left").select(
        "SrcAddr", "campaign_id", "flow_count", "label", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        net.alias("net"), F.concat(F.lit("atk_"), name).alias("atk"), name.alias("atk_label"),
    )
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    none_l, none_i, none_b = F.lit(None).cast("bigint"), F.lit(None).cast("int"), F.lit(None).cast("boolean")
    ips = rows.select(
        F.col("SrcAddr").alias("id"), F.lit("ip").alias("type"), "flow_count", "label", "campaign_id", "confidence",
        malicious_profile("label").alias("malicious"),
    )
    # A shared /24 keeps the campaign of its busiest address.
    nets = rows.groupBy(F.col("net").alias("id")).agg(
        F.max_by("campaign_id", F.struct(F.col("flow_count"), F.col("SrcAddr"))).alias("campaign_id")
    ).select("id", F.lit("subnet").alias("type"), none_l.alias("flow_count"), none_s.alias("label"), "campaign_id",
             none_d.alias("confidence"), none_b.alias("malicious"))
    atks = rows.select("atk", "atk_label").distinct().select(
        F.col("atk").alias("id"), F.lit("attacktype").alias("type"), none_l.alias("flow_count"),
        F.col("atk_label").alias("label"), none_i.alias("campaign_id"), none_d.alias("confidence"), none_b.alias("malicious"),
    )
    edges = rows.select(F.col("SrcAddr").alias("src"), F.col("net").alias("dst"), F.lit("belongs_to").alias("relation")).unionByName(
        rows.select(F.col("SrcAddr").alias("src"), F.col("atk").alias("dst"), F.lit("classified_as").alias("relation"))
    )
    return ips.unionByName(nets).unionByName(atks), edges
