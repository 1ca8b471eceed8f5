"""Clustering and models on blobs, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.config import EngineConfig
from netquarry.operators import clustering, density, kmeans, models, scoring, ward


def blobs(spark, centres, n, spread=0.3, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for b, c in enumerate(centres):
        for i in range(n):
            rows.append((b * n + i, b, [float(v) for v in np.array(c) + rng.normal(0, spread, len(c))]))
    return spark.createDataFrame(rows, "id bigint, blob int, features array<double>")


CENTRES = [(0, 0, 0), (6, 6, 6), (-6, 6, 0)]


def silhouette(x, labels, squared=False):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d = d if squared else np.sqrt(d)
    s = []
    for i in range(len(x)):
        own = (labels == labels[i]) & (np.arange(len(x)) != i)
        if not own.any():
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, labels == k].mean() for k in set(labels) if k != labels[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_matches_brute_force(spark):
    df = blobs(spark, CENTRES, 40, spread=2.5).withColumn("other", F.col("id") % 5)
    x = np.array([r["features"] for r in df.collect()])
    got = {r["labelling"]: r["silhouette"] for r in clustering.silhouettes(df, ["blob", "other"], ["id"], sample=1000).collect()}
    assert got["blob"] == pytest.approx(silhouette(x, np.repeat([0, 1, 2], 40)), abs=1e-9)
    assert got["other"] == pytest.approx(silhouette(x, np.arange(120) % 5), abs=1e-9)


def test_silhouette_sample_and_singletons(spark):
    df = blobs(spark, CENTRES, 60)
    assert clustering.silhouettes(df, ["blob"], ["id"], sample=50).first()["silhouette"] > 0.8
    assert clustering.silhouettes(df.withColumn("one", F.lit(1)), ["one"], ["id"], sample=50).count() == 0
    lone = df.withColumn("lone", F.when(F.col("id") == 0, 9).otherwise(F.col("blob")))
    x = np.array([r["features"] for r in lone.orderBy("id").collect()])
    labels = np.repeat([0, 1, 2], 60)
    labels[0] = 9
    assert clustering.silhouettes(lone, ["lone"], ["id"], sample=1000).first()["silhouette"] == pytest.approx(silhouette(x, labels))


def test_estimated_silhouette_holds_the_exact_one(spark, monkeypatch):
    df = blobs(spark, CENTRES, 40, spread=2.5).withColumn("other", F.col("id") % 5)
    x = np.array([r["features"] for r in df.collect()])
    for name, labels in (("blob", np.repeat([0, 1, 2], 40)), ("other", np.arange(120) % 5)):
        exact = silhouette(x, labels)
        whole = clustering.estimated_silhouette(df, name, ["id"], per_cluster=40).toPandas()
        assert len(whole) == 120
        for c in ("silhouette", "low", "high"):
            assert whole[c].mean() == pytest.approx(exact, abs=1e-6)
        some = clustering.estimated_silhouette(df, name, ["id"], per_cluster=8).toPandas()
        assert some["low"].mean() <= exact <= some["high"].mean() and (some["low"] <= some["high"]).all()
        assert some["silhouette"].mean() == pytest.approx(exact, abs=0.1)
        one = clustering.estimated_silhouette(df, name, ["id"], per_cluster=1).toPandas()
        assert one["low"].mean() <= exact <= one["high"].mean()
    assert clustering.estimated_silhouette(df.withColumn("one", F.lit(1)), "one", ["id"]).count() == 0
    monkeypatch.setattr(clustering, "REFERENCE_BYTES", 1000)
    with pytest.raises(ValueError):
        clustering.estimated_silhouette(df, "blob", ["id"])


def test_squared_silhouette_matches_brute_force(spark):
    df = blobs(spark, CENTRES, 40, spread=2.5).withColumn("other", F.col("id") % 5).withColumn("one", F.lit(1))
    df = df.withColumn("lone", F.when(F.col("id") == 0, 9).otherwise(F.col("blob")))
    rows = df.orderBy("id").collect()
    x = np.array([r["features"] for r in rows])
    got = {r["labelling"]: r["silhouette"] for r in clustering.squared_silhouettes(df, ["blob", "other", "one", "lone"]).collect()}
    assert set(got) == {"blob", "other", "lone"}
    for name in got:
        assert got[name] == pytest.approx(silhouette(x, np.array([r[name] for r in rows]), squared=True), abs=1e-9)
    model = kmeans.fit(df, [3], n_init=2)[3]
    labels = ((x[:, None] - model.centres[None]) ** 2).sum(-1).argmin(1)
    assert clustering.model_silhouettes(df, [model])[0] == pytest.approx(silhouette(x, labels, squared=True), abs=1e-9)


def test_seeding_reaches_rare_far_points(spark):
    """A few points far off among many get a centre of their own."""
    rows = [(float(i % 50) / 50, 0.0) for i in range(3000)] + [(100.0, 100.0)] * 2 + [(-100.0, 100.0)]
    df = spark.createDataFrame([([a, b],) for a, b in rows], "features array<double>")
    assert kmeans.fit(df, [3], n_init=2)[3].cost < 300


def test_sweep_finds_three(spark):
    df = blobs(spark, CENTRES, 70)
    curve, best, found = clustering.sweep_k(df, EngineConfig(k_min=2, k_max=5, n_init=4))
    assert best == 3 and curve.count() == 4
    pairs = kmeans.assign(df, found[3]).select("blob", "campaign_id").distinct().collect()
    assert len(pairs) == 3 and len({p["campaign_id"] for p in pairs}) == 3
    assert clustering.k_bounds(3, 2, 10) == [2] and clustering.k_bounds(100, 2, 4) == [2, 3, 4]
    assert clustering.best_k_simplified(df, (2, 4))[1] == 3


def test_restarts_never_cost_more(spark):
    df = blobs(spark, [(i % 3 * 2, i // 3 * 2) for i in range(6)], 30, spread=0.6)
    one = kmeans.fit(df, [6], n_init=1)[6]
    many = kmeans.fit(df, [6], n_init=8)[6]
    assert many.cost <= one.cost + 1e-9
    x = np.array([r["features"] for r in df.collect()])
    near = ((x[:, None] - many.centres[None]) ** 2).sum(-1).min(1).sum()
    assert near == pytest.approx(many.cost, rel=1e-3)


def test_hierarchical_splits_centred_data(spark):
    df = blobs(spark, [(-5, 0), (5, 0)], 40)
    got = clustering.hierarchical(df, 2).select("blob", "campaign_id").distinct().collect()
    assert len(got) == 2 and len({r["campaign_id"] for r in got}) == 2


def direct_ward(x):
    """Merge the pair of clusters with the least gain until one is left: gains and the partition at each size."""
    n, mean, parts = np.ones(len(x)), x.copy(), [{i} for i in range(len(x))]
    d = ((mean[:, None] - mean[None]) ** 2).sum(-1) / 2
    np.fill_diagonal(d, np.inf)
    gains, cuts = [], {len(x): {frozenset(p) for p in parts}}
    for left in range(len(x) - 1, 0, -1):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        gains.append(d[i, j])
        mean[i] = (n[i] * mean[i] + n[j] * mean[j]) / (n[i] + n[j])
        n[i], parts[i], parts[j] = n[i] + n[j], parts[i] | parts[j], None
        d[j, :] = d[:, j] = np.inf
        alive = np.array([p is not None and q != i for q, p in enumerate(parts)])
        new = n * n[i] / (n + n[i]) * ((mean - mean[i]) ** 2).sum(1)
        d[i, alive] = d[alive, i] = new[alive]
        if left <= 12:
            cuts[left] = {frozenset(p) for p in parts if p}
    return np.array(gains), cuts


def test_ward_with_a_leaf_per_point_is_direct_ward(spark):
    df = blobs(spark, [(0, 0, 0), (4, 1, 0), (-3, 5, 2), (9, 9, 9)], 250, spread=1.0).repartition(5)
    x = np.array([r["features"] for r in df.orderBy("id").collect()])
    gains, cuts = direct_ward(x)
    tree = ward.fit(df)
    assert len(tree.n) == 1000 and (np.diff(tree.heights) >= 0).all()
    assert tree.gains == pytest.approx(gains, rel=1e-6)
    for k in (2, 4, 11):
        groups = {}
        for r in ward.assign(df, tree, k).collect():
            groups.setdefault(r["campaign_id"], set()).add(r["id"])
        assert {frozenset(g) for g in groups.values()} == cuts[k]


def test_ward_over_few_leaves(spark):
    df = blobs(spark, [(0, 0), (20, 0), (0, 20)], 700, spread=1.0).unionByName(blobs(spark, [(50, 50)], 300, spread=0.0).withColumn("blob", F.lit(3))).repartition(6)
    x = np.array([r["features"] for r in df.collect()])
    tree = ward.fit(df, leaves=60)
    assert 4 <= len(tree.n) <= 60 and tree.n.sum() == len(x) and (np.diff(tree.heights) >= 0).all()
    assert tree.spread.sum() + tree.gains.sum() == pytest.approx(((x - x.mean(0)) ** 2).sum())
    got = ward.assign(df, tree, 4).select("blob", "campaign_id").distinct().collect()
    assert len(got) == 4 and len({r["campaign_id"] for r in got}) == 4
    assert ward.fit(df.filter("id < 0")).cut(3).tolist() == [] and ward.fit(df.filter("blob = 3")).cut(3).tolist() == [0]


def test_davies_bouldin_brute_force(spark):
    df = blobs(spark, CENTRES, 20, spread=1.0)
    x, lab = np.array([r["features"] for r in df.collect()]), np.repeat([0, 1, 2], 20)
    c = np.array([x[lab == k].mean(0) for k in range(3)])
    s = [np.linalg.norm(x[lab == k] - c[k], axis=1).mean() for k in range(3)]
    want = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert clustering.davies_bouldin(df, "blob", "features", 3).first()[0] == pytest.approx(want)


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    z = np.array([r["features"] for r in clustering.standardize(df, ["a", "b"]).collect()])
    a = np.array([1.0, 3.0, 0.0])
    assert z[:, 0] == pytest.approx((a - a.mean()) / a.std()) and list(z[:, 1]) == [0, 0, 0]


def brute_density(x, radius, levels, min_cluster_size, min_samples):
    """Label per row (-1: noise) by the definition, on all pairs: components per level, then the most stable clusters."""
    q = np.floor(np.asarray(x) * (density.STEPS / radius) + 0.5)
    d = ((q[:, None] - q[None]) ** 2).sum(-1)
    radii, gain = density.squared_radii(levels), density.persistence(levels)
    core = [int(np.searchsorted(radii, np.sort(np.delete(d[i], i))[min_samples - 1])) + 1 if len(x) > min_samples else levels + 1 for i in range(len(x))]
    comps = []
    for level in range(1, levels + 1):
        left, found = {i for i in range(len(x)) if core[i] <= level}, []
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                i = todo.pop()
                group.add(i)
                near = [j for j in left if d[i, j] <= radii[level - 1]]
                left.difference_update(near)
                todo += near
            if len(group) >= min_cluster_size:
                found.append(frozenset(group))
        comps.append(found)

    def best(group, level):
        """Own stability of the cluster that ends in this component, the best of its parts (None without), clusters of the parts."""
        parts = [c for c in comps[level - 2] if c <= group] if level > 1 else []
        own = len(group) * gain[level - 1]
        if len(parts) == 1:
            chain, inner, inside = best(parts[0], level - 1)
            return chain + own, inner, inside
        if not parts:
            return own, None, []
        done = [(p, best(p, level - 1)) for p in parts]
        value = sum(chain if inner is None or chain >= inner else inner for _, (chain, inner, _) in done)
        return own, value, [c for p, (chain, inner, inside) in done for c in ([p] if inner is None or chain >= inner else inside)]

    labels = np.full(len(x), -1)
    for top in comps[-1]:
        chain, inner, inside = best(top, levels)
        for c in [top] if inner is None or chain >= inner else inside:
            labels[list(c)] = min(c)
    return labels


def same_partition(got, want):
    """Equal up to numbering; noise is a cluster of one."""
    groups = {}
    for g, w in zip(got, want):
        groups.setdefault(g, set()).add(int(w))
    sizes = {g: sum(x == g for x in got) for g in groups}
    firsts = [next(iter(w)) for g, w in groups.items() if w != {-1}]
    return all(len(w) == 1 and (w != {-1} or sizes[g] == 1) for g, w in groups.items()) and len(set(firsts)) == len(firsts)


@pytest.mark.parametrize("crowd", [20, 400])
def test_density_equals_brute_force(spark, crowd):
    rng = np.random.default_rng(8)
    parts = [rng.normal(c, s, (n, 5)) for c, s, n in (((0,) * 5, 0.3, 120), ((2.5, 0, 0, 0, 0), 0.15, 80), ((3.4, 0, 0, 0, 0), 0.1, 40), ((9, 9, 0, 0, 0), 0.8, 60))]
    line = np.zeros((30, 5))
    line[:, 1] = np.linspace(-9, -4, 30)
    x = np.vstack([*parts, line, rng.uniform(-15, 15, (40, 5)), np.tile([20.0, 0, 0, 0, 0], (25, 1)), np.tile([21.0, 0, 0, 0, 0], (4, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>").repartition(4)
    for kwargs in ({"radius": 2.0, "levels": 12}, {"radius": 1.0, "levels": 4, "min_cluster_size": 10, "min_samples": 5}):
        got = [r["campaign_id"] for r in density.density_clusters(df, ["id"], crowd=crowd, **kwargs).orderBy("id").collect()]
        want = brute_density(x, kwargs["radius"], kwargs["levels"], kwargs.get("min_cluster_size", 5), kwargs.get("min_samples", 3))
        assert len(set(want)) > 4 and -1 in want
        assert same_partition(got, want) and sorted(set(got)) == list(range(len(set(got))))


def test_density_on_2000_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 3, (12, 22))
    x = np.vstack([rng.normal(c, rng.uniform(0.05, 0.6), (150, 22)) for c in centres] + [rng.normal(0, 4, (200, 22))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>")
    got = [r["campaign_id"] for r in density.density_clusters(df, ["id"], crowd=300).orderBy("id").collect()]
    assert same_partition(got, brute_density(x, 2.0, 12, 5, 3))


def test_density_of_few_points(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [5.0, 5.0])], "id bigint, features array<double>")
    assert sorted(r["campaign_id"] for r in density.density_clusters(df, ["id"]).collect()) == [0, 1, 2]
    assert density.density_clusters(df.filter("id < 0"), ["id"]).count() == 0


def test_points_of_one_spot_and_component_do_not_meet(spark):
    """A spot within one radius costs its points times those still open, not their square."""
    rng = np.random.default_rng(5)
    q = np.unique(rng.integers(0, 90, (900, 3)), axis=0)
    rows = [(i, [int(v) for v in r], (100, 0) if i % 100 else (0, i), True) for i, r in enumerate(q)]
    points = spark.createDataFrame(rows, "id bigint, q array<int>, rank struct<size:bigint,base:bigint>, open boolean")
    buckets = density._buckets(points, 3, density.STEPS, crowd=100)
    assert buckets.count() == buckets.filter("home").count() == len(q)
    closed = points.withColumn("rank", F.expr("named_struct('size', 100L, 'base', 0L)"))
    assert density._buckets(closed, 3, density.STEPS, crowd=100).count() == 0

    few = buckets.join(points.select("id", "rank"), "id").withColumn("open", F.col("rank.size") == 0).drop("rank")
    met = density._met(few, crowd=100)
    asking, parts = -(-len(q) // 100), -(-len(q) // 100)
    assert met.filter("NOT asks").count() == len(q) and met.filter("asks").count() == asking * parts
    pairs = met.filter("asks").select("bucket", "c", "o", F.col("id").alias("a")).join(met.filter("NOT asks"), ["bucket", "c", "o"])
    assert pairs.count() == pairs.select("a", "id").distinct().count() == asking * len(q)


def test_spanning_forest_connects_every_level():
    rng = np.random.default_rng(3)
    level = np.triu(rng.integers(1, 6, (30, 30)), 1).astype(np.int8)
    level = level + level.T + np.eye(30, dtype=np.int8) * 9

    def parts(edges):
        comp = list(range(30))
        for a, b in edges:
            comp = [comp[a] if c == comp[b] else c for c in comp]
        return [[comp[i] == comp[j] for j in range(30)] for i in range(30)]

    forest = density.spanning_forest(level, 4)
    for k in range(1, 5):
        assert parts([(a, b) for a, b, w in forest if w <= k]) == parts(np.argwhere(level <= k).tolist())


def test_connected_components_chain(spark):
    v = spark.createDataFrame([(f"n{i:02d}",) for i in range(30)], ["v"])
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(29) if i != 14], ["a", "b"])
    got = {r["v"]: r["comp"] for r in density.connected_components(v, e).collect()}
    assert {got[f"n{i:02d}"] for i in range(15)} == {"n00"} and {got[f"n{i:02d}"] for i in range(15, 30)} == {"n15"}


def test_characterize_and_summary(spark):
    rows = [(0, "a", 0.9, 0.1, 0.1, 0.1, 0.1, "IoT-23", 0.5, 1.0, 1), (0, "a", 0.7, 0.1, 0.1, 0.1, 0.1, "CTU-13", 0.1, None, 0), (1, "b", 0.1, 0.9, 0.1, 0.1, 0.1, "CTU-13", 0.2, 0.4, 0)]
    df = spark.createDataFrame(rows, "campaign_id int, SrcAddr string, scan_score double, burst_score double, conn_count double, avg_bytes double, src_bytes_ratio double, dataset_source string, device_role_score double, c2_beacon_score double, horizontal_scan_flag int")
    got = {r["campaign_id"]: r for r in clustering.characterize(df).collect()}
    assert got[0]["campaign_type"] == "Reconnaissance / Scanning" and got[1]["campaign_type"] == "Botnet C2 Communication"
    assert got[0]["scan_score"] == 0.8 and got[0]["fingerprint_count"] == 2 and got[0]["ip_count"] == 1
    s = {r["campaign_id"]: r for r in clustering.cluster_summary(df).collect()}
    assert s[0]["cross_dataset"] and not s[1]["cross_dataset"] and s[0]["mean_c2_beacon_score"] == 0.5 and s[0]["pct_horizontal_scan"] == 50.0


def test_forest_report_and_projection(spark):
    df = blobs(spark, [(0, 0), (5, 5)], 50).withColumn("label", F.col("blob"))
    df = df.select("id", "label", "features", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))
    train, test = models.stratified_split(df, "label", ["id"])
    assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {0: 10, 1: 10}
    assert train.join(test, "id").count() == 0 and train.count() == 80
    model = models.train_forest(train, ["a", "b"], trees=10)
    report = {r["label"]: r for r in models.classification_report(models.predict(model, test, ["a", "b"])).collect()}
    assert report[0]["f1"] == report[1]["f1"] == 1.0 and report[1]["support"] == 10
    total = models.feature_importances(model, ["a", "b"], df).agg(F.sum("importance")).first()[0]
    assert total == pytest.approx(1.0)
    rows, explained = models.project_2d(df, dims=2)
    assert explained[0] > 0.9 and rows.agg(F.avg("pc1")).first()[0] == pytest.approx(0, abs=1e-9)


def test_cohesion_is_pairwise_mean(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8))
    x[:5] = 0.0
    df = spark.createDataFrame([(0, [float(v) for v in r]) for r in x], "g int, features array<double>")
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
    want = (u @ u.T)[np.triu_indices(120, 1)].mean()
    assert scoring.cohesion_of_vectors(df, "features", 8, "g").first()["B"] == pytest.approx(want)
