"""Campaign discovery: design matrix, k-means, model selection, cluster quality."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import DEFAULT, EngineConfig
from netquarry.functions import rules
from netquarry.functions.vectors import array_of, euclidean, squared_distance
from netquarry.operators import kmeans, ward
from netquarry.operators.ranking import top_n_per_group
from netquarry.operators.sampling import reservoir
from netquarry.schema import FEATURES

def design_matrix(fp: DataFrame, sources: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Fingerprints with one 0/1 column per data source, and the matrix columns.

    Without ``sources`` those that occur are taken; they become columns, so there
    are few of them.
    """
    if sources is None:
        sources = sorted(r[0] for r in fp.select("dataset_source").filter("dataset_source IS NOT NULL").distinct().collect())
    dummies = {f"ds_{s}": (F.col("dataset_source") == s).cast("int") for s in sources}
    names = [c for c in FEATURES if c in fp.columns] + list(dummies)
    return fp.withColumns(dummies), names


def standardize(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Array column of z-scores (population deviation); a constant column becomes 0."""
    filled = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]
    parts = [p for i, c in enumerate(filled) for p in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]
    moments = df.agg(F.struct(*parts).alias("m")).scalar()
    scaled = df.withColumn("_m", moments)
    z = [
        (c - F.col("_m")[f"m{i}"]) / F.when(F.col("_m")[f"s{i}"] > 0, F.col("_m")[f"s{i}"]).otherwise(F.lit(1.0))
        for i, c in enumerate(filled)
    ]
    return scaled.withColumn(out, F.array(*z)).drop("_m")


def hierarchical(points: DataFrame, k: int, features: str = "features", leaves: int = ward.LEAVES) -> DataFrame:
    """Agglomerative clustering into k clusters by Ward's linkage over at most ``leaves`` cluster features."""
    return ward.assign(points, ward.fit(points, leaves, features), k, features)


def _silhouette_sums(x: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of silhouette values of the given rows, one entry per labelling."""
    sq = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(sq[rows, None] + sq[None, :] - 2.0 * x[rows] @ x.T, 0.0))
    d[np.arange(len(rows)), rows] = 0.0
    out = np.zeros(labels.shape[1])
    for j in range(labels.shape[1]):
        code = np.unique(labels[:, j], return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        sizes = np.bincount(code)
        sums = np.add.reduceat(d[:, order], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=1)
        own = code[rows]
        at = np.arange(len(rows))
        own_others = np.maximum(sizes[own] - 1, 1)
        a = sums[at, own] / own_others
        means = sums / sizes
        means[at, own] = np.inf
        b = means.min(axis=1)
        top = np.maximum(a, b)
        s = np.divide(b - a, top, out=np.zeros_like(a), where=top > 0)
        s[sizes[own] == 1] = 0.0
        out[j] = s.sum()
    return out


def silhouettes(
    points: DataFrame, label_columns: Sequence[str], order_key: Sequence[str],
    sample: int, features: str = "features", seed: int = DEFAULT.seed,
) -> DataFrame:
    """Euclidean silhouette of several labellings on a seeded sample of points.

    The measure is quadratic, so the caller states how many points it is taken
    on; ``squared_silhouettes`` covers all points. One distance pass serves all
    labellings.
    """
    spark = points.sparkSession
    wanted = points.select(*dict.fromkeys([features, *label_columns, *order_key]))
    local = reservoir(wanted, order_key, sample, seed).select(features, *label_columns).toPandas()
    names = list(label_columns)
    schema = "labelling string, total double, n bigint"
    if len(local) == 0:
        return spark.createDataFrame([], "labelling string, silhouette double")
    x = np.stack(local[features].to_numpy()).astype(float)
    shared = spark.sparkContext.broadcast((x, local[names].to_numpy()))
    many = local[names].nunique().gt(1).to_dict()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs, labels = shared.value
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for at in range(0, len(ids), 256):
                rows = ids[at : at + 256]
                sums = _silhouette_sums(xs, labels, rows)
                yield pd.DataFrame({"labelling": names, "total": sums, "n": len(rows)})

    blocks = max(1, min(len(local) // 256, 4 * spark.sparkContext.defaultParallelism))
    sums = spark.range(0, len(local), 1, blocks).mapInPandas(score, schema)
    valid = [n for n in names if many[n]]
    return (
        sums.filter(F.col("labelling").isin(valid))
        .groupBy("labelling")
        .agg((F.sum("total") / F.sum("n")).alias("silhouette"))
    )


REFERENCE_BYTES = 256 << 20  # most the reference points of an estimate may take in a task


def _estimates(names: list[str], sizes: np.ndarray, marks: list[np.ndarray], vectors: list[np.ndarray]):
    """Task body: silhouette and bounds of each row (vector, label, mark) from the reference points of every cluster."""
    at = {name: k for k, name in enumerate(names)}
    place = [{m: i for i, m in enumerate(some)} for some in marks]

    def bounded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        top = np.maximum(a, b)
        return np.divide(b - a, top, out=np.zeros_like(top), where=top > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                own = np.array([at[v] for v in batch.column(1).to_pylist()])
                ids = batch.column(2).to_pylist()
                mean, wide = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
                for k, refs in enumerate(vectors):
                    apart = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (refs**2).sum(1) - 2.0 * (x @ refs.T), 0.0))
                    counted = np.ones(apart.shape, bool)
                    for i in np.flatnonzero(own == k):
                        if ids[i] in place[k]:
                            counted[i, place[k][ids[i]]] = False
                    m = counted.sum(1)
                    others = np.maximum(sizes[k] - (own == k), 1)
                    mean[:, k] = (apart * counted).sum(1) / np.maximum(m, 1)
                    squares = (((apart - mean[:, [k]]) ** 2) * counted).sum(1) / np.maximum(m - 1, 1)
                    wide[:, k] = 4.0 * np.sqrt(squares / np.maximum(m, 1) * np.maximum(1.0 - m / others, 0.0))
                    wide[(m < 2) & (m < others), k] = np.inf  # nothing is known about the spread
                rows = np.arange(len(x))
                far = mean.copy()
                far[rows, own] = np.inf
                a, a_off = mean[rows, own], wide[rows, own]
                b = far.min(1)
                b_low, b_high = np.maximum(far - np.where(np.isinf(far), 0, wide), 0).min(1), (far + wide).min(1)
                s = bounded(a, b)
                low = np.where(np.isinf(a_off), -1.0, bounded(np.where(np.isinf(a_off), 0, a + a_off), b_low))
                high = np.where(np.isinf(b_high), 1.0, bounded(np.maximum(a - a_off, 0), np.where(np.isinf(b_high), 0, b_high)))
                alone = sizes[own] == 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), *[pa.array(np.where(alone, 0.0, v)) for v in (s, low, high)]], ["label", "silhouette", "low", "high"]
                )

    return run


def estimated_silhouette(
    points: DataFrame, label: str, key: Sequence[str], per_cluster: int = 200, seed: int = DEFAULT.seed, features: str = "features"
) -> DataFrame:
    """Euclidean silhouette of every point (label, silhouette, low, high), estimated from reference points.

    Each cluster gives up to ``per_cluster`` reference points, those of the smallest
    md5 of seed and key; every point meets all of them, so the work is points times
    references. The bounds are four standard errors of each mean distance, corrected
    for the share of the cluster drawn: with all of a cluster as references they
    close and the value is exact. The average of a column estimates, or bounds, the
    average silhouette. The few references and cluster sizes pass the driver and must
    fit REFERENCE_BYTES. ``key`` is unique; a single label gives no rows.
    """
    spark = points.sparkSession
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    wanted = points.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("string").alias("label"), mark.alias("mark"))
    schema = "label string, silhouette double, low double, high double"
    sizes = {r["label"]: r["n"] for r in wanted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return spark.createDataFrame([], schema)
    dims = wanted.select(F.size("x")).first()[0]
    drawn = sum(min(n, per_cluster) for n in sizes.values())
    if drawn * dims * 8 > REFERENCE_BYTES:
        raise ValueError(f"{drawn} reference points of {dims} components exceed {REFERENCE_BYTES} bytes; take fewer per cluster")
    refs = top_n_per_group(wanted, ["label"], [F.col("mark"), F.col("x")], per_cluster).toPandas()
    names = list(sizes)
    of = {name: some for name, some in refs.groupby("label", dropna=False)}
    ordered = [of[name] if name is not None else refs[refs["label"].isna()] for name in names]
    body = _estimates(
        names, np.array([sizes[name] for name in names]), [some["mark"].to_numpy() for some in ordered],
        [np.stack(some["x"].to_numpy()).astype(float) for some in ordered],
    )
    return wanted.mapInArrow(body, schema)


def k_bounds(n: int, k_min: int, k_max: int) -> list[int]:
    """Cluster counts to try for n points."""
    hi = min(k_max, max(k_min + 1, n - 1))
    return [k for k in range(k_min, hi + 1) if k < n]


def _silhouette_pass(stats: list[tuple[np.ndarray, np.ndarray, np.ndarray]], own_of):
    """Task body: summed silhouettes by squared distance per labelling, from cluster sizes, sums and square sums.

    The mean squared distance of x to a cluster is (n |x|^2 - 2 x.S + Q) / n; in its
    own cluster the point itself is left out of the count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros(len(stats)), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            lengths = (x**2).sum(axis=1)[:, None]
            seen += len(x)
            for j, (n, sums, squares) in enumerate(stats):
                apart = np.maximum(n * lengths - 2.0 * (x @ sums.T) + squares, 0.0)
                own, at = own_of(batch, x, j), np.arange(len(x))
                a = apart[at, own] / np.maximum(n[own] - 1, 1)
                means = np.where(n > 0, apart / np.maximum(n, 1), np.inf)
                means[at, own] = np.inf
                b = means.min(axis=1)
                top = np.maximum(a, b)
                s = np.divide(b - a, top, out=np.zeros_like(a), where=(top > 0) & np.isfinite(b))
                totals[j] += s[n[own] > 1].sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(stats))), pa.array(totals), pa.array(np.full(len(stats), seen))], ["labelling", "total", "n"]
        )

    return run


def _silhouette_means(parts: DataFrame) -> dict[int, float]:
    sums = parts.groupBy("labelling").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("s"))
    return {r["labelling"]: r["s"] for r in sums.collect() if r["s"] is not None}


_SILHOUETTE_PARTS = "labelling bigint, total double, n bigint"


def squared_silhouettes(points: DataFrame, label_columns: Sequence[str], features: str = "features") -> DataFrame:
    """Silhouette by squared distance (labelling, silhouette), exact over all points in O(points x clusters).

    Cluster sums come to the driver, so labels are few (a stated k). Labellings
    with one value are left out.
    """
    stats, codes, names = [], [], []
    for name in label_columns:
        squares = F.aggregate(features, F.lit(0.0), lambda s, v: s + v.cast("double") * v)
        dims = points.select(F.size(features)).first()
        if dims is None:
            break
        sums = [F.sum(F.col(features)[i].cast("double")).alias(f"s{i}") for i in range(dims[0])]
        table = points.groupBy(F.col(name).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(squares).alias("q"), *sums).toPandas()
        if len(table) > 1:
            names.append(name)
            codes.append({label: k for k, label in enumerate(table["label"])})
            stats.append((table["n"].to_numpy(float), table[[f"s{i}" for i in range(dims[0])]].to_numpy(), table["q"].to_numpy(float)))
    spark = points.sparkSession
    if not names:
        return spark.createDataFrame([], "labelling string, silhouette double")

    def own_of(batch: pa.RecordBatch, x: np.ndarray, j: int) -> np.ndarray:
        return np.array([codes[j][v] for v in batch.column(j + 1).to_pylist()])

    wanted = points.select(features, *[F.col(n).cast("string").alias(f"l{j}") for j, n in enumerate(names)])
    found = _silhouette_means(wanted.mapInArrow(_silhouette_pass(stats, own_of), _SILHOUETTE_PARTS))
    return spark.createDataFrame([(names[j], float(s)) for j, s in sorted(found.items())], "labelling string, silhouette double")


def model_silhouettes(points: DataFrame, models: Sequence[kmeans.Centres], features: str = "features") -> list[float]:
    """Silhouette by squared distance of each model's assignment, over all points, in two shared passes."""
    centres = [m.centres for m in models]
    vectors = points.select(features)
    n, sums, costs = kmeans._folded(vectors, centres)
    ends = np.cumsum([len(c) for c in centres])
    stats = []
    for c, z in zip(centres, ends):
        span = slice(z - len(c), z)
        # The fold's cost is the sum of |x - c|^2, from which the sum of |x|^2 follows.
        squares = costs[span] + 2.0 * (c * sums[span]).sum(axis=1) - n[span] * (c**2).sum(axis=1)
        stats.append((n[span], sums[span], squares))

    def own_of(batch: pa.RecordBatch, x: np.ndarray, j: int) -> np.ndarray:
        return ((centres[j] ** 2).sum(axis=1) - 2.0 * (x @ centres[j].T)).argmin(axis=1)

    found = _silhouette_means(vectors.mapInArrow(_silhouette_pass(stats, own_of), _SILHOUETTE_PARTS))
    return [found.get(j, 0.0) for j in range(len(centres))]


def sweep_k(points: DataFrame, cfg: EngineConfig = DEFAULT, features: str = "features"):
    """Silhouette curve over k and the best k.

    Returns (curve DataFrame [k, silhouette], best k, models by k). The score is the
    silhouette by squared distance over all points.
    """
    n = points.count()
    ks = k_bounds(n, cfg.k_min, cfg.k_max)
    models = kmeans.fit(points, ks, cfg.n_init, cfg.seed, features=features) if ks else {}
    rows = dict(zip(models, model_silhouettes(points, list(models.values()), features))) if models else {}
    best = max(sorted(rows), key=lambda k: rows[k]) if rows else min(2, max(1, n // 2))
    curve = points.sparkSession.createDataFrame(sorted((k, float(s)) for k, s in rows.items()), "k int, silhouette double")
    return curve, best, models


def centroids_of(points: DataFrame, cluster: str, features: str, dims: int) -> DataFrame:
    """Mean vector per cluster (one combining aggregate)."""
    means = F.array(*[F.avg(F.col(features)[i].cast("double")) for i in range(dims)])
    return points.groupBy(cluster).agg(means.alias("centroid"), F.count(F.lit(1)).alias("size"))


def centroid_list(centroids: DataFrame, cluster: str, features: str = "centroid") -> Column:
    """All k centroids as one scalar array, for row-wise comparison without a join."""
    entry = F.struct(F.col(cluster).alias("id"), F.col(features).alias("v"))
    return centroids.agg(F.sort_array(F.collect_list(entry)).alias("c")).scalar()


def _ranked_distances(vec: Column, cents: Column) -> Column:
    return F.transform(cents, lambda c: F.struct(squared_distance(vec, c["v"]).alias("d"), c["id"].alias("id")))


def nearest_centroid(points: DataFrame, centroids: DataFrame, cluster: str, features: str, out: str = "nearest") -> DataFrame:
    """Closest centroid of every point, lowest id on a tie; no shuffle of points."""
    best = F.array_min(_ranked_distances(F.col(features), F.col("_c")))
    return (
        points.withColumn("_c", centroid_list(centroids, cluster))
        .withColumn("_b", best)
        .withColumn(out, F.col("_b")["id"])
        .withColumn("distance", F.sqrt(F.col("_b")["d"]))
        .drop("_b", "_c")
    )


def lloyd_step(points: DataFrame, centroids: DataFrame, cluster: str, features: str, dims: int) -> DataFrame:
    """One assignment and update: new centroids and sizes."""
    moved = nearest_centroid(points, centroids, cluster, features)
    return centroids_of(moved, "nearest", features, dims)


def simplified_silhouette(points: DataFrame, centroids: DataFrame, cluster: str, features: str, label: str) -> DataFrame:
    """Mean centroid-distance silhouette, linear in points times k."""
    ranked = points.withColumn("_c", centroid_list(centroids, cluster)).withColumn(
        "_d", _ranked_distances(F.col(features), F.col("_c"))
    )
    own = F.filter("_d", lambda e: e["id"] == F.col(label))[0]["d"]
    other = F.array_min(F.filter("_d", lambda e: e["id"] != F.col(label)))["d"]
    a, b = F.sqrt(own), F.sqrt(other)
    s = F.coalesce(F.try_divide(b - a, F.nullif(F.greatest(a, b), F.lit(0.0))), F.lit(0.0))
    return ranked.agg(F.avg(s).alias("silhouette"))


def best_k_simplified(
    points: DataFrame, k_range: tuple[int, int], features: str = "features", seed: int = DEFAULT.seed
):
    """k-means over a short k range, chosen by the simplified silhouette."""
    ks = range(k_range[0], k_range[1] + 1)
    results = []
    for k, model in kmeans.fit(points, ks, 1, seed, max_iter=100, tol=1e-6, features=features).items():
        cents = kmeans.centre_table(points, model)
        labelled = kmeans.assign(points, model, features)
        score = simplified_silhouette(labelled, cents, "id", features, "campaign_id").first()[0]
        results.append((k, float(score or 0.0), model))
    best = max(results, key=lambda r: r[1])
    curve = points.sparkSession.createDataFrame([(k, s) for k, s, _ in results], "k int, silhouette double")
    return curve, best[0], best[2]


# Centroids compared per joined block, which bounds one array whatever k is.
_BLOCK = 1024


def davies_bouldin(points: DataFrame, cluster: str, features: str, dims: int) -> DataFrame:
    """Davies-Bouldin index: mean over clusters of the worst (s_i + s_j) / d_ij."""
    cents = centroids_of(points, cluster, features, dims).select(cluster, "centroid")
    spread = (
        points.select(cluster, features)
        .join(cents, cluster)
        .groupBy(cluster)
        .agg(F.avg(euclidean(features, "centroid")).alias("s"))
    )
    stats = cents.join(spread, cluster)
    blocks_wanted = F.floor(cents.agg(F.count(F.lit(1))).scalar() / F.lit(_BLOCK)).cast("int")
    placed = stats.withColumn("_n", blocks_wanted)
    entry = F.struct(F.col(cluster).alias("id"), F.col("centroid").alias("v"), F.col("s"))
    blocks = (
        placed.withColumn("_block", F.pmod(F.xxhash64(cluster), F.col("_n") + 1).cast("int"))
        .groupBy("_block")
        .agg(F.collect_list(entry).alias("others"))
    )
    ratio = F.transform(
        F.filter("others", lambda o: o["id"] != F.col(cluster)),
        lambda o: F.coalesce(F.try_divide(F.col("s") + o["s"], euclidean(F.col("centroid"), o["v"])), F.lit(0.0)),
    )
    worst = (
        placed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n"))))
        .join(blocks, "_block")
        .groupBy(cluster)
        .agg(F.max(F.array_max(ratio)).alias("worst"))
    )
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def characterize(camps: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Mean profile per campaign and the campaign type it implies.

    ``fingerprint_count`` counts fingerprints, ``ip_count`` distinct addresses.
    """
    names = [c for c in columns if c in camps.columns]
    means = camps.groupBy("campaign_id").agg(
        *[F.round(F.avg(f"`{c}`"), 4).alias(c) for c in names],
        F.count(F.lit(1)).alias("fingerprint_count"),
        F.countDistinct("SrcAddr").alias("ip_count"),
    )
    kind = rules.campaign_type(
        F.col("scan_score"), F.col("burst_score"), F.col("conn_count"), F.col("avg_bytes"), F.col("src_bytes_ratio")
    )
    return means.withColumn("campaign_type", kind)


def cluster_summary(camps: DataFrame) -> DataFrame:
    """Source mix and headline behaviour per campaign."""
    n = F.count(F.lit(1))
    source = F.col("dataset_source")
    iot, ctu, mixed = (F.count_if(source == s) for s in ("IoT-23", "CTU-13", "Mixed"))

    def mean(c: str) -> Column:
        return F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))

    return camps.groupBy("campaign_id").agg(
        n.alias("fingerprint_count"),
        F.round(iot * 100 / n, 2).alias("iot_pct"),
        F.round(ctu * 100 / n, 2).alias("ctu_pct"),
        ((F.min(source) != F.max(source)) | (mixed > 0)).alias("cross_dataset"),
        F.round(mean("device_role_score"), 4).alias("mean_device_role_score"),
        F.round(mean("c2_beacon_score"), 4).alias("mean_c2_beacon_score"),
        F.round(mean("horizontal_scan_flag") * 100, 2).alias("pct_horizontal_scan"),
    )


def feature_vectors(camps: DataFrame, columns: Sequence[str] = FEATURES, out: str = "features") -> DataFrame:
    return camps.withColumn(out, array_of([c for c in columns if c in camps.columns]))
