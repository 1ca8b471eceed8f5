"""Hierarchical density clustering in the full feature space, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import DEFAULT
from netquarry.functions.storage import materialize
from netquarry.operators.ranking import ranked_by_bucket

STEPS = 128  # grid steps of the radius; vectors are rounded to the grid
CROWD = 1500  # points of a bucket that one task compares at once
_WORTHWHILE = 0.8  # a split must leave at most this share of a bucket's points on either side
_CHEAP = 0.65  # the same for a bucket with few points that ask
BAND = 3  # levels whose neighbours meet in the same buckets
_SMALL = 10  # chunks of points up to which all levels share their buckets
_LEVEL_BITS = 5  # a (point, level) vertex is one bigint


def connected_components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest reachable vertex id per vertex (v, comp).

    Min-label steps with pointer jumping, so rounds grow with the logarithm of
    the longest chain; every round is written to the shared folder.
    """
    both = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = materialize(vertices.select(F.col("v"), F.col("v").alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("v").alias("b"), F.col("comp").alias("c")), "b").groupBy(
            F.col("a").alias("v")
        ).agg(F.min("c").alias("c"))
        lowered = labels.join(seen, "v", "left").select("v", "comp", F.least("comp", F.coalesce("c", "comp")).alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("comp").alias("c2"))
        step = materialize(
            lowered.join(jump, "low", "left").select("v", F.least("low", F.coalesce("c2", "low")).alias("comp"),
                                                     (F.least("low", F.coalesce("c2", "low")) != F.col("comp")).alias("moved")),
            "labels",
        )
        labels = step.select("v", "comp")
        if step.filter("moved").isEmpty():
            return labels


def squared_radii(levels: int) -> list[int]:
    """Squared radius of each level in grid steps: doubling up to the whole radius."""
    return [STEPS * STEPS >> (levels - k) for k in range(1, levels + 1)]


def persistence(levels: int) -> list[int]:
    """What a point adds to its cluster's stability at each level: the step of 1/distance up to the next level, in millionths."""
    inverse = [round(1e6 / np.sqrt(t)) for t in [*squared_radii(levels), 2 * STEPS * STEPS]]
    return [a - b for a, b in zip(inverse, inverse[1:])]


def _cuts(members: DataFrame, dims: int, reach: int) -> DataFrame:
    """bucket, dim, at, larger: the cut of each bucket at a component's median whose larger side, copies included, is smallest."""
    medians = members.groupBy("bucket").agg(*[F.percentile_approx(F.col("q")[j], 0.5).alias(f"m{j}") for j in range(dims)])
    medians = materialize(medians, "bucket-medians")
    sides = members.join(medians, "bucket").groupBy("bucket").agg(
        *[F.greatest(F.count_if(F.col("q")[j] <= F.col(f"m{j}") + reach), F.count_if(F.col("q")[j] >= F.col(f"m{j}") - reach)).alias(f"l{j}") for j in range(dims)]
    )
    best = F.array_min(F.array(*[F.struct(F.col(f"l{j}").alias("larger"), F.lit(j).alias("dim"), F.col(f"m{j}").alias("at")) for j in range(dims)]))
    return medians.join(sides, "bucket").select("bucket", best.alias("cut")).select("bucket", "cut.larger", "cut.dim", "cut.at")


def _buckets(points: DataFrame, dims: int, reach: int, crowd: int) -> DataFrame:
    """id, q, home, bucket: points grouped so that each open point meets all its neighbours within ``reach`` in its home bucket.

    ``points``: id, q, rank (null before a point is core, else that of its
    component). A point is open in its home bucket unless it is of the component of
    highest rank there: of two points of different components, the one of lower
    rank then meets the other. Buckets without an open point are left out. Crowded
    buckets are cut in two at a component's median while that leaves fewer points
    on both sides; points within reach of the cut are copied across it.
    """
    members = points.select("id", "q", "rank", F.lit(0).cast("bigint").alias("bucket"), F.lit(True).alias("home"))
    done = None
    while True:
        ranks = members.groupBy("bucket", "rank").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("h"))
        opened = F.sum("h") - F.coalesce(F.max_by("h", "rank"), F.lit(0))
        sizes = materialize(ranks.groupBy("bucket").agg(F.sum("n").alias("n"), opened.alias("open")).filter("open > 0"), "bucket-sizes")
        crowded = sizes.filter(F.col("n") > crowd)
        share = F.when(F.col("open") > crowd, _WORTHWHILE).otherwise(_CHEAP)
        cuts = None
        if not crowded.isEmpty():
            cuts = _cuts(members.join(crowded.select("bucket"), "bucket"), dims, reach).join(crowded, "bucket").filter(F.col("larger") <= share * F.col("n"))
            cuts = materialize(cuts.select("bucket", "dim", "at"), "bucket-cuts")
        last = cuts is None or cuts.isEmpty()
        sized = members.join(sizes.select("bucket"), "bucket", "left_semi")
        sized = sized if last else sized.join(cuts, "bucket", "left")
        final = (sized if last else sized.filter("dim IS NULL")).select("id", "q", "home", "bucket")
        done = final if done is None else done.unionByName(final)
        if last:
            return done
        x, at = F.get("q", F.col("dim")), F.col("at")
        left = F.when(x <= at + reach, F.struct(F.lit(0).alias("side"), (x <= at).alias("own")))
        right = F.when(x >= at - reach, F.struct(F.lit(1).alias("side"), (x > at).alias("own")))
        cut = sized.filter("dim IS NOT NULL").withColumn("c", F.explode(F.array_compact(F.array(left, right))))
        cut = cut.select("id", "q", "rank", F.xxhash64("bucket", "dim", "at", "c.side").alias("bucket"), (F.col("home") & F.col("c.own")).alias("home"))
        members = materialize(cut, "bucket-members")


def _met(members: DataFrame, crowd: int) -> DataFrame:
    """The rows of ``members`` in groups (bucket, c, o) in which points that ask meet points of their bucket.

    ``open`` tells who asks. Every such point of a bucket meets each of its points,
    itself included, in one group, which holds at most about ``crowd`` of either.
    """
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.count_if("open").alias("_open")).filter("_open > 0")
    sized = members.join(materialize(counts, "bucket-chunks"), "bucket")
    parts, asking = (F.ceil(F.col(c) / crowd).cast("int") for c in ("_n", "_open"))

    def chunk(salt: int, n: Column) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")

    every = sized.withColumns({"c": chunk(1, parts), "o": F.explode(F.sequence(F.lit(0), asking - 1)), "asks": F.lit(False)})
    some = sized.filter("open").withColumns({"c": F.explode(F.sequence(F.lit(0), parts - 1)), "o": chunk(2, asking), "asks": F.lit(True)})
    # Dealt by group, or the groups of a bucket stay in the task that its join put the bucket in.
    slots = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.unionByName(some).drop("_n", "_open", "open").repartition(slots, "bucket", "c", "o")


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).astype(float)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a group's points that ask and of those they meet."""
    asks = table.column("asks").to_numpy()
    return np.flatnonzero(asks), np.flatnonzero(~asks)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T)  # whole numbers, exact


def _neighbour_counts(radii: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """Per asking point of a group: weight of the points it meets within each radius, its own included."""

    def run(table: pa.Table) -> pa.Table:
        q, weight = _matrix(table), table.column("w").to_numpy().astype(float)
        left, right = _sides(table)
        counts = np.zeros((len(left), len(radii)), np.int64)
        for start in range(0, len(left), 256):
            squared = _squared(q[left[start : start + 256]], q[right])
            for k, most in enumerate(radii):
                counts[start : start + 256, k] = (squared <= most) @ weight[right]
        return pa.Table.from_arrays([table.column("id").take(pa.array(left)), *(pa.array(c) for c in counts.T)], ["id", *(f"n{k}" for k in range(len(radii)))])

    return run


def spanning_forest(level: np.ndarray, levels: int) -> list[tuple[int, int, int]]:
    """Minimum spanning forest (a, b, level) of a symmetric matrix of levels, without the pairs beyond the last."""
    n = len(level)
    best, parent, out = np.full(n, levels + 1, np.int8), np.full(n, -1), []
    open_ = np.ones(n, bool)
    at = 0
    for _ in range(n):
        open_[at] = False
        closer = open_ & (level[at] < best)
        best[closer], parent[closer] = level[at][closer], at
        if not open_.any():
            break
        at = int(np.where(open_, best, levels + 2).argmin())
        if best[at] <= levels:
            out.append((int(parent[at]), at, int(best[at])))
    return out


def _level_roots(forest: list[tuple[int, int, int]], ids: np.ndarray, levels: int) -> list[np.ndarray]:
    """Per level, each point's smallest connected id by the forest's edges up to there."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, edges = [], sorted(forest, key=lambda e: -e[2])
    for level in range(1, levels + 1):
        while edges and edges[-1][2] <= level:
            a, b, _ = edges.pop()
            parent[root(a)] = root(b)
        roots = np.array([root(i) for i in range(len(ids))])
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, ids)
        out.append(least[roots])
    return out


def _least_level(level: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest entry per distinct row name and column name, with both lists of names."""
    by_row, by_column = np.argsort(rows, kind="stable"), np.argsort(columns, kind="stable")
    names, starts = np.unique(rows[by_row], return_index=True)
    others, ends = np.unique(columns[by_column], return_index=True)
    return np.minimum.reduceat(np.minimum.reduceat(level[by_row], starts, axis=0)[:, by_column], ends, axis=1), names, others


def _links(radii: np.ndarray, first: int) -> Callable[[pa.Table], pa.Table]:
    """Per level, every component of a group tied to the smallest one it is connected to there under mutual reachability.

    ``base`` is a point's component before these levels, or itself, ``core`` its
    first core level from 1 on; levels found are counted from ``first``.
    """
    levels = len(radii)

    def run(table: pa.Table) -> pa.Table:
        q, core, base = _matrix(table), table.column("core").to_numpy().astype(np.int8), table.column("base").to_numpy()
        left, right = _sides(table)
        a, b, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(left) and len(right):
            between = (np.searchsorted(radii, _squared(q[left], q[right]).ravel(), side="left") + 1).astype(np.int8).reshape(len(left), len(right))
            between = np.maximum(between, np.maximum(core[left][:, None], core[right]))
            least, asking, met = _least_level(between, base[left], base[right])
            names = np.union1d(asking, met)
            level = np.full((len(names), len(names)), levels + 1, np.int8)
            x, y = np.searchsorted(names, asking), np.searchsorted(names, met)
            level[np.ix_(x, y)] = least
            level = np.minimum(level, level.T)
            for k, root in enumerate(_level_roots(spanning_forest(level, levels), names, levels), first):
                tied = np.flatnonzero(root != names)
                a.append(names[tied])
                b.append(root[tied])
                at.append(np.full(len(tied), k))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, at)], ["a", "b", "level"])

    return run


def _vertex(point: str, level: str) -> Column:
    return F.shiftleft(point, _LEVEL_BITS) + F.col(level)


def _selected(nodes: DataFrame, levels: int) -> DataFrame:
    """Components (comp, level) chosen as clusters: the most stable ones, none inside another.

    ``nodes``: comp, level, parent, size of components that are large enough. A
    component goes on in its parent's if it is the only one there; where several
    meet, the parent is a new cluster. From the smallest radius up, a cluster's own
    stability is held against the best of what it is made of.
    """
    gain = persistence(levels)
    states, below = [], None
    for level in range(1, levels + 1):
        state = nodes.filter(F.col("level") == level)
        own = F.col("size") * gain[level - 1]
        if below is None:
            state = state.select("comp", "level", "parent", F.lit(0).cast("bigint").alias("parts"), own.alias("chain"), F.lit(None).cast("bigint").alias("inner"))
        else:
            parts = below.groupBy(F.col("parent").alias("comp")).agg(
                F.count(F.lit(1)).alias("parts"), F.max("chain").alias("on"), F.max("inner").alias("inside"),
                F.sum(F.greatest("chain", F.coalesce("inner", "chain"))).alias("best"),
            )
            one = F.col("parts") == 1
            state = state.join(parts, "comp", "left").select(
                "comp", "level", "parent", F.coalesce("parts", F.lit(0).cast("bigint")).alias("parts"),
                (own + F.when(one, F.col("on")).otherwise(0)).alias("chain"),
                F.when(one, F.col("inside")).otherwise(F.col("best")).alias("inner"),
            )
        below = materialize(state, "density-level")
        states.append(below)
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    above = every.select(F.col("comp").alias("parent"), (F.col("parts") > 1).alias("splits"))
    tops = every.join(above, "parent", "left").filter(F.coalesce("splits", F.lit(True)))
    return tops.filter(F.col("chain") >= F.coalesce("inner", "chain")).select("comp", "level")


def _band(
    points: DataFrame, dims: int, low: int, high: int, levels: int, min_samples: int, crowd: int,
) -> tuple[DataFrame, DataFrame]:
    """One band of levels: the points with core, base and size after it, and the component of every core point's vertices (v, comp).

    ``points``: id, q, w, core (first level, null if none yet), base (smallest id
    of the component at the level before) and size (its points). Points not core
    yet count their neighbours; then points meet those of other components.
    """
    radii = np.array(squared_radii(levels)[low - 1 : high], float)
    rank = F.when(F.col("core").isNotNull(), F.struct("size", "base"))
    members = materialize(_buckets(points.select("id", "q", rank.alias("rank")), dims, int(np.sqrt(radii[-1])), crowd), "density-members")
    group = ["bucket", "c", "o"]

    asking = members.join(points.select("id", "w", "core"), "id").withColumn("open", F.col("home") & F.col("core").isNull()).drop("core", "home")
    names = [f"n{k}" for k in range(len(radii))]
    counts = _met(asking, crowd).groupBy(*group).applyInArrow(_neighbour_counts(radii), "id bigint, " + ", ".join(f"{n} bigint" for n in names))
    totals = counts.groupBy("id").agg(*[F.sum(n).alias(n) for n in names])
    core = F.coalesce("core", *[F.when(F.col(n) - 1 >= min_samples, low + k) for k, n in enumerate(names)])
    # A component of one new core point ranks below all earlier ones, so no point that was not open has to meet it.
    fresh = F.col("core").isNotNull() & F.col("base").isNull()
    known = points.join(totals, "id", "left").withColumn("core", core).select(
        "id", "q", "w", "core", F.when(fresh, F.col("id")).otherwise(F.col("base")).alias("base"),
        F.when(fresh, F.lit(0).cast("bigint")).otherwise(F.col("size")).alias("size"),
    )
    known = materialize(known, "density-cores")

    rank = F.struct("size", "base")
    meeting = members.join(known.filter("core IS NOT NULL").select("id", "core", "base", "size"), "id").withColumn("core", F.greatest(F.col("core") - low + 1, F.lit(1)))
    tops = materialize(meeting.groupBy("bucket").agg(F.max(rank).alias("top")), "bucket-tops")
    meeting = meeting.join(tops, "bucket").withColumn("open", F.col("home") & (rank < F.col("top"))).drop("home", "top", "size")
    reachable = _met(meeting, crowd).groupBy(*group).applyInArrow(_links(radii, low), "a bigint, b bigint, level bigint")
    links = materialize(reachable.select(_vertex("a", "level").alias("a"), _vertex("b", "level").alias("b")).distinct(), "density-links")
    joined = connected_components(links.select(F.explode(F.array("a", "b")).alias("v")).distinct(), links)

    vertices = known.filter("core IS NOT NULL").select("id", "base", F.explode(F.sequence(F.greatest(F.col("core"), F.lit(low)), F.lit(high))).alias("level"))
    own = _vertex("base", "level")
    labels = vertices.select(_vertex("id", "level").alias("v"), own.alias("own")).join(joined.select(F.col("v").alias("own"), "comp"), "own", "left")
    labels = materialize(labels.select("v", F.coalesce("comp", "own").alias("comp")), "density-labels")
    if high == levels:
        return known, labels
    after = labels.filter(F.col("v").bitwiseAND(F.lit((1 << _LEVEL_BITS) - 1)) == high).select(
        F.shiftright("v", _LEVEL_BITS).alias("id"), F.shiftright("comp", _LEVEL_BITS).alias("base")
    )
    sizes = after.groupBy("base").agg(F.count(F.lit(1)).alias("size"))
    known = known.drop("base", "size").join(after.join(sizes, "base"), "id", "left").select("id", "q", "w", "core", "base", "size")
    return materialize(known, "density-points"), labels


def density_clusters(
    points: DataFrame, key: Sequence[str], features: str = "features", radius: float = 2.0, levels: int = 12,
    min_cluster_size: int = DEFAULT.min_cluster_size, min_samples: int = DEFAULT.min_samples,
    out: str = "campaign_id", crowd: int = CROWD,
) -> DataFrame:
    """Hierarchical density clusters of whole vectors; points of no cluster become clusters of one.

    Vectors are rounded to a grid of ``radius / 128`` and equal ones fold into one
    weighted point, so a crowded spot is one row. ``levels`` radii, each the root of
    two times the one before, end at ``radius``. A point is core from the level where
    ``min_samples`` others lie within its radius; two core points are connected from
    the level where both are core and each within the other's radius (mutual
    reachability, rounded up to a level). Components of at least ``min_cluster_size``
    points at some level form the hierarchy, out of which the most stable clusters
    are selected; a cluster holds all points connected to it where it begins.

    Levels are taken ``BAND`` at a time, from the smallest radii up (all at once for at
    most ten times ``crowd`` points). Neighbours meet
    in buckets cut at medians, with points near a cut copied across it; a task
    compares at most two chunks of ``crowd`` points and passes on counts per point
    and ties between components, never pairs. Only points that are not core yet, or
    not of the largest component of their bucket, look for neighbours: a spot within
    one radius costs its points times those still open there. Vectors are finite and
    of one length.
    """
    grid = F.transform(features, lambda x: F.floor(x * (STEPS / radius) + 0.5).cast("int"))
    placed = points.withColumn("_q", grid)
    first = placed.select(F.size("_q")).first()
    if first is None:
        return points.withColumn(out, F.lit(None).cast("bigint"))
    folded = placed.groupBy(F.col("_q").alias("q")).agg(F.count(F.lit(1)).alias("w")).withColumn("id", F.monotonically_increasing_id())
    folded = materialize(folded, "density-points")
    none = F.lit(None).cast("bigint")
    cores = folded.withColumns({"core": F.lit(None).cast("int"), "base": none, "size": none})
    labels, band = None, BAND if folded.count() > _SMALL * crowd else levels
    for low in range(1, levels + 1, band):
        cores, found = _band(cores, first[0], low, min(low + band - 1, levels), levels, min_samples, crowd)
        labels = found if labels is None else labels.unionByName(found)
    cores = cores.filter("core IS NOT NULL")

    weights = cores.select("id", "w")
    sizes = labels.withColumn("id", F.shiftright("v", _LEVEL_BITS)).join(weights, "id").groupBy("comp").agg(F.sum("w").alias("size"))
    above = labels.select((F.col("v") - 1).alias("comp"), F.col("comp").alias("parent"))
    # A component's label is one of its vertices, whose next level is the vertex after it.
    nodes = sizes.filter(F.col("size") >= min_cluster_size).withColumn("level", F.col("comp").bitwiseAND(F.lit((1 << _LEVEL_BITS) - 1)))
    nodes = nodes.join(above, "comp", "left").select("comp", "level", F.when(F.col("level") < levels, F.col("parent")).alias("parent"), "size")
    chosen = _selected(materialize(nodes, "density-nodes"), levels)

    widest = labels.join(chosen, "comp").groupBy(F.shiftright("v", _LEVEL_BITS).alias("id")).agg(F.max(F.struct("level", "comp")).alias("c"))
    owners = materialize(widest.select("id", F.col("c.comp").alias("comp")), "density-owners")
    numbered = ranked_by_bucket(owners.select("comp").distinct(), F.pmod(F.xxhash64("comp"), F.lit(1024)), [F.asc("comp")], "_id")
    numbered = materialize(numbered, "density-numbers")
    kept = folded.join(owners, "id").join(numbered, "comp").select(F.col("q").alias("_q"), "_id")
    found = placed.join(materialize(kept, "density-kept"), "_q", "left").drop("_q")
    clustered, noise = found.filter(F.col("_id").isNotNull()), found.filter(F.col("_id").isNull()).drop("_id")
    h = F.xxhash64(*[F.col(c) for c in key])
    start = numbered.agg(F.coalesce(F.max("_id") + 1, F.lit(0))).scalar()
    singles = ranked_by_bucket(noise, F.pmod(h, F.lit(4096)), [F.col(c) for c in key], "_r").withColumn("_start", start)
    singles = singles.withColumn("_id", F.col("_start") + F.col("_r")).drop("_start", "_r")
    return clustered.unionByName(singles).withColumnRenamed("_id", out)
