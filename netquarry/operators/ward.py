"""Agglomerative clustering with Ward's linkage over a bounded number of cluster features.

A cluster feature is a count, a mean and a sum of squares about it; two of them
merge exactly. Every task folds its points into at most ``leaves`` features, the
features of several tasks fold into one set in rounds, and Ward's method runs over
the last set by nearest-neighbour chains. With as many leaves as distinct points
the result is that of Ward's method on the points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.storage import materialize

LEAVES = 2000
_MERGED_TASKS = 16  # sets of features that one task folds together
_BLOCK = 512
_SCHEMA = "n double, mean array<double>, spread double"


class Features:
    """At most ``limit`` cluster features; the radius within which points join one grows when there are too many."""

    def __init__(self, limit: int, dims: int) -> None:
        self.limit, self.radius2 = limit, 0.0
        self.n, self.mean, self.spread = np.empty(0), np.empty((0, dims)), np.empty(0)

    def add(self, n: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> None:
        for start in range(0, len(n), _BLOCK):
            part = slice(start, start + _BLOCK)
            self._join(n[part], mean[part], spread[part])
            while len(self.n) > self.limit:
                self._coarsen()

    def _join(self, n: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> None:
        """Each entry joins the nearest feature within the radius, or starts one."""
        near, far = self._nearest(mean, self.mean)
        joins = far <= self.radius2
        self._fold(near[joins], n[joins], mean[joins], spread[joins])
        n, mean, spread = n[~joins], mean[~joins], spread[~joins]
        while len(n):
            # The first one left starts a feature; those within the radius of it join.
            close = ((mean - mean[0]) ** 2).sum(axis=1) <= self.radius2
            close[0] = True
            self.n, self.mean, self.spread = np.append(self.n, n[0]), np.vstack([self.mean, mean[:1]]), np.append(self.spread, spread[0])
            close_rest = close.copy()
            close_rest[0] = False
            self._fold(np.full(close_rest.sum(), len(self.n) - 1), n[close_rest], mean[close_rest], spread[close_rest])
            n, mean, spread = n[~close], mean[~close], spread[~close]

    def _fold(self, into: np.ndarray, n: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> None:
        if not len(into):
            return
        weight, total, inner = np.zeros(len(self.n)), np.zeros_like(self.mean), np.zeros(len(self.n))
        np.add.at(weight, into, n)
        np.add.at(total, into, n[:, None] * mean)
        hit = np.flatnonzero(weight)
        new_n = self.n[hit] + weight[hit]
        new_mean = (self.n[hit, None] * self.mean[hit] + total[hit]) / new_n[:, None]
        at = np.full(len(self.n), -1)
        at[hit] = np.arange(len(hit))
        np.add.at(inner, into, spread + n * ((mean - new_mean[at[into]]) ** 2).sum(axis=1))
        self.spread[hit] += inner[hit] + self.n[hit] * ((self.mean[hit] - new_mean) ** 2).sum(axis=1)
        self.n[hit], self.mean[hit] = new_n, new_mean

    @staticmethod
    def _nearest(x: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(to):
            return np.zeros(len(x), int), np.full(len(x), np.inf)
        d = (to**2).sum(axis=1) - 2.0 * (x @ to.T)
        at = d.argmin(axis=1)
        return at, ((x - to[at]) ** 2).sum(axis=1)

    def _coarsen(self) -> None:
        """Widen the radius to where a good part of the features has a neighbour, and join them again."""
        gaps = []
        for start in range(0, len(self.n), _BLOCK):
            x = self.mean[start : start + _BLOCK]
            d = (x**2).sum(axis=1)[:, None] + (self.mean**2).sum(axis=1) - 2.0 * (x @ self.mean.T)
            d[np.arange(len(x)), start + np.arange(len(x))] = np.inf
            gaps.append(d.min(axis=1))
        self.radius2 = max(self.radius2 * 1.5, float(np.quantile(np.concatenate(gaps), 0.2)), 1e-12)
        n, mean, spread = self.n, self.mean, self.spread
        self.n, self.mean, self.spread = np.empty(0), np.empty((0, mean.shape[1])), np.empty(0)
        self._join(n, mean, spread)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.n), pa.array(list(self.mean), pa.list_(pa.float64())), pa.array(self.spread)], ["n", "mean", "spread"])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(float)


def _folded(limit: int, points: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0 if points else 1), batch.num_rows)
                found = found or Features(limit, x.shape[1])
                ones = np.ones(len(x))
                found.add(ones if points else batch.column(0).to_numpy(), x, 0.0 * ones if points else batch.column(2).to_numpy())
        if found is not None:
            yield found.batch()

    return run


@dataclass(frozen=True)
class Tree:
    """Leaves (count, mean, spread about it) and the merges over them, by rising height.

    A merge joins the clusters that hold leaves ``a`` and ``b``; ``gains`` is the
    increase of the squared deviations, a height its square root times root two.
    """

    n: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    merges: list[tuple[int, int]]
    gains: np.ndarray

    @property
    def heights(self) -> np.ndarray:
        return np.sqrt(2.0 * self.gains)

    def cut(self, k: int) -> np.ndarray:
        """Cluster number of each leaf when k clusters (or as many as there are leaves) are left."""
        label = np.arange(len(self.n))
        for a, b in self.merges[: max(len(self.n) - k, 0)]:
            label[label == label[b]] = label[a]
        return np.unique(label, return_inverse=True)[1]


def chain_merges(n: np.ndarray, mean: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Ward's merges of weighted points by nearest-neighbour chains, sorted by their gain."""
    n, mean = n.astype(float).copy(), mean.astype(float).copy()
    active, chain, merges, gains = np.ones(len(n), bool), [], [], []
    for _ in range(len(n) - 1):
        if not chain:
            chain = [int(active.argmax())]
        while True:
            at = chain[-1]
            gain = np.where(active, n * n[at] / (n + n[at]) * ((mean - mean[at]) ** 2).sum(axis=1), np.inf)
            gain[at] = np.inf
            best = int(gain.argmin())
            # The one before wins ties, so that the chain ends.
            if len(chain) > 1 and gain[chain[-2]] <= gain[best]:
                best = chain[-2]
                break
            chain.append(best)
        chain = chain[:-2]
        merges.append((best, at))
        gains.append(float(gain[best]))
        mean[best] = (n[best] * mean[best] + n[at] * mean[at]) / (n[best] + n[at])
        n[best] += n[at]
        active[at] = False
    order = np.argsort(gains, kind="stable")
    return [merges[i] for i in order], np.array(gains)[order] if gains else np.empty(0)


def fit(points: DataFrame, leaves: int = LEAVES, features: str = "features") -> Tree:
    """Ward's tree over at most ``leaves`` cluster features of all points; only those reach the driver."""
    vectors = points.select(F.col(features).cast("array<double>").alias("x"))
    found = materialize(vectors.mapInArrow(_folded(leaves, points=True), _SCHEMA), "ward-features")
    tasks = -(-found.count() // leaves)
    while tasks > 1:
        tasks = -(-tasks // _MERGED_TASKS)
        found = materialize(found.repartition(tasks).mapInArrow(_folded(leaves, points=False), _SCHEMA), "ward-features")
        if tasks > 1:
            tasks = -(-found.count() // leaves)
    last = Features(leaves, 0)
    rows = found.toPandas()
    if len(rows):
        mean = np.stack(rows["mean"].to_numpy())
        # Rows in a fixed order, so that ties do not depend on the tasks.
        order = np.lexsort(mean.T[::-1])
        last = Features(leaves, mean.shape[1])
        last.add(rows["n"].to_numpy(float)[order], mean[order], rows["spread"].to_numpy(float)[order])
    merges, gains = chain_merges(last.n, last.mean)
    return Tree(last.n, last.mean, last.spread, merges, gains)


def assign(points: DataFrame, tree: Tree, k: int, features: str = "features", out: str = "campaign_id") -> DataFrame:
    """Every point with the cluster of its nearest leaf."""
    labels, means = tree.cut(k), tree.mean
    lengths = (means**2).sum(axis=1)

    @F.pandas_udf("int")
    def cluster(values: pd.Series) -> pd.Series:
        found = [np.empty(0, int)]
        for start in range(0, len(values), _BLOCK):
            x = np.stack(values.iloc[start : start + _BLOCK].to_numpy())
            found.append(labels[(lengths - 2.0 * (x @ means.T)).argmin(axis=1)])
        return pd.Series(np.concatenate(found).astype("int32"))

    return points.withColumn(out, cluster(F.col(features)))
