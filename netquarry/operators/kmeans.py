"""k-means with many restarts and cluster counts in shared passes.

Model selection needs n_init restarts for every k. Fitting them one by one
reads the points once per restart and iteration; here one pass serves all
unfinished restarts together, so the number of passes is that of the slowest
restart. Points are never shuffled: each task folds its rows into per-centre
sums, and only those (bounded by the number of centres) are aggregated.

Starting centres come from all points: every restart draws a few candidates by
squared distance in shared oversampling passes, candidates are weighted by the
points nearest to them, and each k draws its centres among the weighted few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import DEFAULT

_BLOCK_ROWS = 4096
_SEEDING_ROUNDS = 3
_OVERSAMPLING = 2  # candidates a round draws on average, as a multiple of the largest k


@dataclass(frozen=True)
class Centres:
    """A fitted model: one row per centre, and its training cost."""

    k: int
    centres: np.ndarray
    cost: float
    passes: int


def _plus_plus(x: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spread-out starting centres among weighted points: each next one drawn by weight and squared distance."""
    weights = weights / weights.sum()
    chosen = [x[rng.choice(len(x), p=weights)]]
    d2 = ((x - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        mass = d2 * weights
        total = mass.sum()
        chosen.append(x[rng.choice(len(x), p=mass / total) if total > 0 else rng.integers(len(x))])
        d2 = np.minimum(d2, ((x - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _drawn(seed: int, step: int, keep):
    """Task body: rows kept per restart, as (restart, draw, vector); ``keep`` gets rows, restart and uniform numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, step, TaskContext.get().partitionId()])
        for batch in batches:
            x = _matrix(batch)
            for restart in range(keep.restarts):
                u = rng.random(len(x))
                for i in keep.rows(x, restart, u).tolist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([restart]), pa.array([float(u[i])]), pa.array([x[i].tolist()], pa.list_(pa.float64()))], ["restart", "draw", "vector"]
                    )

    return run


@dataclass(frozen=True)
class _FirstRow:
    restarts: int

    def rows(self, x: np.ndarray, restart: int, u: np.ndarray) -> np.ndarray:
        return np.array([int(u.argmin())]) if len(u) else np.empty(0, int)


@dataclass(frozen=True)
class _ByDistance:
    restarts: int
    candidates: list[np.ndarray]
    costs: np.ndarray
    wanted: int

    def rows(self, x: np.ndarray, restart: int, u: np.ndarray) -> np.ndarray:
        c = self.candidates[restart]
        d2 = np.maximum((x**2).sum(axis=1) + ((c**2).sum(axis=1) - 2.0 * (x @ c.T)).min(axis=1), 0.0)
        return np.flatnonzero(u * self.costs[restart] < self.wanted * d2) if self.costs[restart] > 0 else np.empty(0, int)


_DRAWN = "restart bigint, draw double, vector array<double>"


def _folded(vectors: DataFrame, models: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, sums and costs of all centres of all models, in one pass."""
    dims = models[0].shape[1]
    schema = "centre bigint, n double, cost double, " + ", ".join(f"s{i} double" for i in range(dims))
    totals = [F.sum(c).alias(c) for c in ["n", "cost", *[f"s{i}" for i in range(dims)]]]
    table = vectors.mapInArrow(_fold(models), schema).groupBy("centre").agg(*totals).toPandas().sort_values("centre")
    return table["n"].to_numpy(), table[[f"s{i}" for i in range(dims)]].to_numpy(), table["cost"].to_numpy()


def _seeds(vectors: DataFrame, restarts: int, most: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weighted candidates per restart, drawn over all points; (rounds x oversampling x largest k) of them on average."""
    first = vectors.mapInArrow(_drawn(seed, 0, _FirstRow(restarts)), _DRAWN).groupBy("restart").agg(F.min_by("vector", "draw").alias("vector"))
    at = {r["restart"]: np.array([r["vector"]]) for r in first.collect()}
    candidates = [at[i] for i in range(restarts)]

    def each(values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.cumsum([len(c) for c in candidates])[:-1])

    for step in range(1, _SEEDING_ROUNDS + 1):
        costs = np.array([c.sum() for c in each(_folded(vectors, candidates)[2])])
        rows = vectors.mapInArrow(_drawn(seed, step, _ByDistance(restarts, candidates, costs, _OVERSAMPLING * most)), _DRAWN)
        more: dict[int, list] = {i: [] for i in range(restarts)}
        for r in rows.orderBy("restart", "draw").collect():
            more[r["restart"]].append(r["vector"])
        candidates = [np.unique(np.vstack([c, *([more[i]] if more[i] else [])]), axis=0) for i, c in enumerate(candidates)]
    return list(zip(candidates, each(_folded(vectors, candidates)[0])))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def _fold(models: list[np.ndarray]):
    """Task body: per-centre sums, counts and cost of this task's rows."""
    stacked = np.vstack(models)
    ends = np.cumsum([len(m) for m in models])
    starts = ends - [len(m) for m in models]
    lengths = (stacked**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, costs = np.zeros_like(stacked), np.zeros(len(stacked)), np.zeros(len(stacked))
        for batch in batches:
            rows = _matrix(batch)
            for at in range(0, len(rows), _BLOCK_ROWS):
                x = rows[at : at + _BLOCK_ROWS]
                # Squared distance less the row's own length, which no argmin needs.
                d = lengths - 2.0 * (x @ stacked.T)
                member = np.zeros_like(d)
                own = np.arange(len(x))
                for a, z in zip(starts, ends):
                    member[own, a + d[:, a:z].argmin(axis=1)] = 1.0
                sums += member.T @ x
                counts += member.sum(axis=0)
                costs += (member * (d + (x**2).sum(axis=1)[:, None])).sum(axis=0)
        columns = [np.arange(len(stacked)), counts, costs, *sums.T]
        names = ["centre", "n", "cost", *[f"s{i}" for i in range(stacked.shape[1])]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def fit(
    points: DataFrame, ks: Sequence[int], n_init: int = DEFAULT.n_init,
    seed: int = DEFAULT.seed, max_iter: int = 300, tol: float = 1e-4, features: str = "features",
) -> dict[int, Centres]:
    """Best of ``n_init`` restarts for every k; ``points`` is read many times, so a written table.

    A restart stops once the squared shifts of its centres sum to at most
    ``tol`` (features are expected on a unit scale).
    """
    vectors = points.select(features)
    runs = [(k, i) for k in ks for i in range(n_init)]
    seeds = _seeds(vectors, n_init, max(ks), seed)
    at = {r: _plus_plus(*seeds[r[1]], r[0], np.random.default_rng([seed, *r])) for r in runs}
    cost: dict[tuple[int, int], float] = {}
    passes: dict[tuple[int, int], int] = {}
    open_runs = list(runs)
    for step in range(1, max_iter + 1):
        n, sums, costs = _folded(vectors, [at[r] for r in open_runs])
        start, moving = 0, []
        for r in open_runs:
            span = slice(start, start + r[0])
            start += r[0]
            filled = n[span] > 0
            new = at[r].copy()
            new[filled] = sums[span][filled] / n[span][filled][:, None]
            shift = ((new - at[r]) ** 2).sum()
            at[r], cost[r], passes[r] = new, float(costs[span].sum()), step
            if shift > tol:
                moving.append(r)
        open_runs = moving
        if not open_runs:
            break
    best = {k: min((r for r in runs if r[0] == k), key=lambda r: cost[r]) for k in ks}
    return {k: Centres(k, at[r], cost[r], passes[r]) for k, r in best.items()}


def nearest(model: Centres, features: str = "features") -> Column:
    """Id of the closest centre, as a vectorised column function."""
    centres = model.centres
    lengths = (centres**2).sum(axis=1)

    @F.pandas_udf("int")
    def closest(values: pd.Series) -> pd.Series:
        if len(values) == 0:
            return pd.Series([], dtype="int32")
        x = np.stack(values.to_numpy())
        return pd.Series((lengths - 2.0 * (x @ centres.T)).argmin(axis=1).astype("int32"))

    return closest(F.col(features))


def assign(points: DataFrame, model: Centres, features: str = "features", out: str = "campaign_id") -> DataFrame:
    return points.withColumn(out, nearest(model, features))


def centre_table(points: DataFrame, model: Centres) -> DataFrame:
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.centres)]
    return points.sparkSession.createDataFrame(rows, "id int, centroid array<double>")
