"""Integer k-means over vectors in Hilbert-curve blocks with zone maps.

Vectors become integers and are ordered along a Hilbert curve through all
components; runs of the curve are stored as blocks, each with the smallest and
largest value of every component. A block's box bounds its distance to a centroid
from below and above: a centroid whose least distance exceeds another's greatest
cannot be nearest to any vector of the block. The centroids left, the block's
candidates, are compared exactly in one matrix product.

Blocks are written once and read by every round. A round sends one row per task
and cluster through the shuffle, however many vectors a cluster has; the driver
sees the centroids only. Equal vectors, however many, spread over blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.storage import materialize

COMPONENTS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
BITS = 4  # of each component in a vector's place on the curve
BLOCK = 256  # vectors of a block
LIMIT = 1 << 26  # a component's integer; beyond it a squared distance would leave a long
_EXACT = 1 << 20  # up to here products of whole vectors are exact in doubles


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(64 * x) as integers, held to +-LIMIT."""
    with np.errstate(over="ignore"):  # infinity is held to the limit too
        return np.clip(np.floor(SCALE * values.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (n x d), as n rows of big-endian bytes.

    Skilling's transform: undo the curve's rotations from the top bit down, take
    the Gray code over the components, then interleave the bits of all components.
    """
    x = cells.T.astype(np.uint32)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(len(x)):
            inverted = (x[i] >> np.uint32(level)) & np.uint32(1) == 1
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(inverted, low, swapped)
            x[i] ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1) == 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flips
    levels = np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]
    planes = ((x[None] >> levels) & np.uint32(1)).astype(np.uint8)  # level x component x row
    return np.packbits(planes.reshape(-1, x.shape[1]).T, axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some vector inside the box."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)  # to the farther end of every component
    return np.flatnonzero(least <= most.min())


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on a tie) and exact squared distance of each vector."""
    if max(np.abs(vectors).max(), np.abs(centroids).max()) <= _EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        distances = ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        distances = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = distances.argmin(axis=1)
    return at, distances[np.arange(len(vectors)), at]


def _bounds(components: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(components, LIMIT), np.full(components, -LIMIT)
        for batch in batches:
            if batch.num_rows:
                v = _flat(batch.column("vector"), components)
                low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(components)), pa.array(low), pa.array(high)], ["component", "low", "high"])

    return run


def _flat(column: pa.Array, components: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components))


def _placed(low: np.ndarray, high: np.ndarray):
    """Rows with their key on the curve; cells divide each component's own range."""
    span = (high - low + 1).astype(np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _flat(batch.column("vector"), len(low))
            cells = ((v - low) * float(1 << BITS) / span).astype(np.uint32)
            keys = [k.tobytes() for k in hilbert_keys(cells, BITS)]
            rows = [r.tobytes() for r in v.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("row"), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["vec_id", "row", "key", "vector"]
            )

    return run


def _blocked(components: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_ids", "vectors", "low", "high"]
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                raw = b"".join(part.column("vector").to_pylist())
                v = np.frombuffer(raw, np.int32).reshape(-1, components)
                out.append((part.column("vec_id").to_pylist(), raw, v.min(axis=0).tobytes(), v.max(axis=0).tobytes()))
            if out:
                ids, *binary = map(list, zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), *(pa.array(b, pa.binary()) for b in binary)], names)

    return run


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row number, vectors, nearest centroids and distances of each block of a batch."""
    components = centroids.shape[1]
    for i in range(batch.num_rows):
        v, low, high = (np.frombuffer(batch.column(c)[i].as_py(), np.int32).astype(np.int64) for c in ("vectors", "low", "high"))
        v = v.reshape(-1, components)
        some = candidates(low, high, centroids)
        at, distance = nearest(v, centroids[some])
        yield i, v, some[at], distance


def _partials(centroids: np.ndarray):
    """One row per task and cluster: vectors, sums of components, sum of distances (as text, of any length)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        n, sums, inertia = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64), [0] * k
        for batch in batches:
            for _, v, at, distance in _assigned(batch, centroids):
                for c in np.unique(at).tolist():
                    mine = at == c
                    n[c] += mine.sum()
                    sums[c] += v[mine].sum(axis=0)
                    inertia[c] += sum(distance[mine].tolist())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64())), pa.array([str(inertia[c]) for c in some])],
            ["cluster", "n", "sums", "inertia"],
        )

    return run


def _emitted(centroids: np.ndarray, facts: list[tuple[int | None, str]], total: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        for batch in batches:
            for i, _, at, distance in _assigned(batch, centroids):
                clusters = pa.array(at, pa.int32())
                own, digest = (pa.array(list(x)).take(clusters) for x in zip(*facts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_ids")[i].values, clusters, pa.array(distance), own.cast(pa.int64()), pa.array([total] * len(at), pa.int64()), digest], names
                )

    return run


def usable(vectors: DataFrame, column: str, components: int) -> DataFrame:
    """vec_id and vector of the rows that have exactly so many components, none of them null or non-finite."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector")).filter((F.size("vector") == components) & finite)


def start_order(vec_id: Column) -> Column:
    """Hash by which starting centroids are drawn."""
    return F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")).cast("binary"), 256)


def zone_maps(kept: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Blocks in the order of the curve: vec_ids, and as little-endian 32-bit integers vectors, low and high."""
    bounds = kept.select("vector").mapInArrow(_bounds(components), "component bigint, low bigint, high bigint")
    box = bounds.groupBy("component").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("component").collect()
    low, high = (np.array([r[c] for r in box], np.int64) for c in ("low", "high"))
    if (low > high).any():  # no rows
        low = high = np.zeros(components, np.int64)
    rows = kept.withColumn("row", F.monotonically_increasing_id())
    placed = rows.mapInArrow(_placed(low, high), "vec_id bigint, row bigint, key binary, vector binary")
    placed = materialize(placed, "centroid-places")
    # Equal keys, as of one very common vector, are spread by row.
    dealt = placed.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    blocks = dealt.select("vec_id", "vector").mapInArrow(_blocked(components), "vec_ids array<bigint>, vectors binary, low binary, high binary")
    return materialize(blocks, "centroid-blocks")


@dataclass
class Clustering:
    centroids: np.ndarray  # k x components, after the last round
    blocks: DataFrame

    def assigned(self) -> DataFrame:
        """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
        schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        if not len(self.centroids):
            return self.blocks.sparkSession.createDataFrame([], schema)
        own = {r["cluster"]: int(r["inertia"]) for r in _totals(self.blocks, self.centroids)}

        def fits(x: int) -> int | None:
            return x if x < 1 << 63 else None

        facts = [(fits(own.get(c, 0)), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(self.centroids.tolist())]
        return self.blocks.mapInArrow(_emitted(self.centroids, facts, fits(sum(own.values()))), schema)


def _totals(blocks: DataFrame, centroids: np.ndarray) -> list:
    """Vectors, sums and inertia of the clusters that have any; at most one row per centroid."""
    partials = blocks.mapInArrow(_partials(centroids), "cluster int, n bigint, sums array<bigint>, inertia string")
    sums = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(centroids.shape[1])]
    return partials.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), *sums).collect()


def cluster(
    vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, k: int = CENTROIDS, rounds: int = ROUNDS,
    order: Callable[[Column], Column] = start_order,
) -> Clustering:
    """K-means on integers floor(64 * x), from the k vectors with the smallest ``order`` of their vec_id.

    Each round assigns every vector to its nearest centroid (squared Euclidean
    distance, ties to the smaller number) and replaces each centroid that has
    vectors by the floor of their mean; ``assigned`` assigns once more.

    Rows whose vector is null, has another number of components, or holds a null or
    non-finite one are left out. Repeated rows count each; rows of one vec_id start
    in the order of their vectors, a null vec_id starts last. With fewer than k
    vectors there are fewer centroids; an empty table gives an empty result. A
    component beyond 2^26 counts as 2^26; a sum of distances beyond a long is null.
    Other columns are not read.
    """
    kept = usable(vectors, column, components)
    first = kept.select("vector", order(F.col("vec_id")).alias("drawn")).orderBy(F.col("drawn").asc_nulls_last(), "vector").limit(k).collect()
    blocks = zone_maps(kept, components)
    centroids = scaled(np.array([r["vector"] for r in first]).reshape(-1, components))
    for _ in range(rounds if first else 0):
        for r in _totals(blocks, centroids):
            centroids[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(components)]
    return Clustering(centroids, blocks)


def _sql() -> str:
    kept = f"""
v AS (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(greatest(-{LIMIT}, least({LIMIT}, floor({SCALE} * CAST(x AS DOUBLE)))) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}
),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS INTEGER) AS k, e FROM v
  QUALIFY k < {CENTROIDS}
)"""
    assign = """
a{i} AS (
  SELECT r, vec_id, v.e, k,
    CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM v CROSS JOIN c{i} c
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
)"""
    update = f"""
s{{i}} AS (
  SELECT k, j, sum(e[j]) AS s, count(*) AS n FROM a{{i}} CROSS JOIN range(1, {COMPONENTS + 1}) t(j) GROUP BY k, j
),
c{{j}} AS (
  SELECT c.k, coalesce(m.e, c.e) AS e FROM c{{i}} c
  LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM s{{i}} GROUP BY k) m ON m.k = c.k
)"""
    steps = [kept]
    for i in range(ROUNDS):
        steps += [assign.format(i=i), update.format(i=i, j=i + 1)]
    steps.append(assign.format(i=ROUNDS))
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, a.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k"""


SQL = _sql()
