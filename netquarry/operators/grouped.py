"""Grouped statistics shared by both fingerprint profiles.

``value_statistics`` and ``gap_statistics`` are safe for a key that holds a large
share of all rows: every step either combines map-side or works on a range of rows
of bounded size. The ``gathered`` columns are for keys whose rows fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.storage import materialize

GATHERED = 500_000  # most rows of a key that one task sorts
TASK_ROWS = 200_000  # rows of a task, where no key has more
_FAR = np.iinfo(np.int64).max  # beyond every time


def value_columns(v: str, total: Column) -> list[Column]:
    """``v_distinct``, ``v_nats`` and ``v_bits`` from the distinct count, ``_s_v`` (sum of n ln n) and the rows."""
    nats = F.ln(total) - F.try_divide(F.col(f"_s_{v}"), total)
    nats = F.when(F.col(f"{v}_distinct") > 1, F.greatest(nats, F.lit(0.0))).otherwise(F.lit(0.0))
    return [F.col(f"{v}_distinct"), nats.alias(f"{v}_nats"), (nats / F.ln(F.lit(2.0))).alias(f"{v}_bits")]


def gap_columns() -> list[Column]:
    """Gap statistics from ``gaps``, ``gap_mean`` and ``_ss``, the squares about the mean."""
    return [
        F.col("gaps"), F.col("gap_mean"),
        F.sqrt(F.try_divide(F.col("_ss"), F.col("gaps"))).alias("gap_std_pop"),
        F.when(F.col("gaps") > 1, F.sqrt(F.try_divide(F.col("_ss"), F.col("gaps") - 1))).alias("gap_std_samp"),
    ]


def large_keys(rows: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame | None, int]:
    """Keys of more than ``most`` rows (none: no table), and the number of tasks that the rows of all others ask for."""
    n = F.col("_n")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # The large keys, and one row without a key for the rows of all others.
    counts = counts.select(*[F.when(n > most, F.col(k)).alias(k) for k in keys], n).groupBy(*keys).agg(F.sum(n).alias("_n"))
    counts = materialize(counts, "large-keys")
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    left = counts.filter(~known).agg(F.sum(n)).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-left // TASK_ROWS))
    large = counts.filter(known).select(*keys)
    return None if large.isEmpty() else large, parts


def _seconds(span: Column) -> Column:
    return span.cast("interval second").cast("decimal(18,6)").cast("double")


def gathered(rows: DataFrame, keys: Sequence[str], parts: int, counted: Sequence[str], time: str = "StartTime") -> DataFrame:
    """Rows of known keys after one exchange, with what ``gathered_sums`` adds up per key.

    A row has ``_v_rows``, the rows of its key with the same v, for each column v of
    ``counted``, ``_v_new`` on one of these, ``_gap`` to the row before in time and
    ``_mean``, the key's mean gap. Times are known.
    """
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    placed = rows.filter(known).repartition(parts, *keys)
    for name in counted:
        alike = Window.partitionBy(*keys, name).orderBy(name)
        every = alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        placed = placed.withColumns({f"_{name}_rows": F.count(F.lit(1)).over(every), f"_{name}_new": F.row_number().over(alike) == 1})
    ordered = Window.partitionBy(*keys).orderBy(time)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = _seconds(F.col(time) - F.lag(time).over(ordered))
    span = _seconds(F.last(time).over(whole) - F.first(time).over(whole))
    return placed.withColumns({"_gap": gap, "_mean": F.try_divide(span, F.count(F.lit(1)).over(whole) - 1)})


def gathered_sums(values: Sequence[str]) -> list[Column]:
    """Aggregates of a key's gathered rows that ``value_columns`` and ``gap_columns`` read."""
    return [
        *[F.count_if(f"_{v}_new").alias(f"{v}_distinct") for v in values],
        # Each row adds the logarithm of its value's rows, so a value adds n ln n.
        *[F.sum(F.ln(f"_{v}_rows")).alias(f"_s_{v}") for v in values],
        F.max("_mean").alias("gap_mean"),
        F.sum(F.pow(F.col("_gap") - F.col("_mean"), 2)).alias("_ss"),
        (F.count(F.lit(1)) - 1).alias("gaps"),
    ]


def value_statistics(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Distinct count and entropy of several columns per key, in one pass.

    Grouping sets count each (key, value) once per column with map-side
    combining; a second combining aggregate folds the counts. Emits, for each
    column c: ``c_distinct``, ``c_nats`` and ``c_bits``.
    """
    sets = [[*keys, v] for v in values]
    counts = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, *values]]).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[(F.grouping(v) == 0).alias(f"_is_{v}") for v in values],
    )
    aggs: list[Column] = []
    for v in values:
        mine = F.col(f"_is_{v}")
        aggs += [
            F.count_if(mine).alias(f"{v}_distinct"),
            F.sum(F.when(mine, F.col("_n"))).alias(f"_t_{v}"),
            F.sum(F.when(mine, F.col("_n") * F.ln("_n"))).alias(f"_s_{v}"),
        ]
    folded = counts.groupBy(*keys).agg(*aggs)
    return folded.select(*keys, *[c for v in values for c in value_columns(v, F.col(f"_t_{v}"))])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Gap moments of every run of equal keys in rows sorted by key and time.

    The run at the end of a batch stays open and is joined to the start of the
    next, so a task emits one row per key it holds.
    """
    held: tuple[list[pa.Array], list] | None = None

    def made(columns: list[pa.Array], numbers: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        ends = numbers[0] == 0  # no known time: no first and last
        arrays = [pa.array(v, kind, mask=ends if i >= 4 else None) for i, (v, kind) in enumerate(zip(numbers, kinds))]
        return pa.RecordBatch.from_arrays(columns + arrays, names=[f"c{i}" for i in range(keys + 6)])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i) for i in range(keys)]
        fresh = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            same = np.ones(batch.num_rows - 1, bool)
            for c in columns:
                equal = pc.fill_null(pc.equal(c[1:], c[:-1]), False)
                nulls = pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1]))
                same &= pc.or_(equal, nulls).to_numpy(zero_copy_only=False)
            fresh[1:] = ~same
        known = batch.column(keys).is_valid().to_numpy(zero_copy_only=False)
        t = pc.fill_null(batch.column(keys).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(fresh)
        inner = np.zeros(batch.num_rows, bool)
        inner[1:] = ~fresh[1:] & known[1:] & known[:-1]
        gap = np.where(inner, np.diff(t, prepend=t[:1]), 0) / 1e6
        points, gaps = np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(inner.astype(np.int64), starts)
        mean = np.add.reduceat(gap, starts) / np.maximum(gaps, 1)
        off = np.where(inner, gap - np.repeat(mean, np.diff(np.append(starts, batch.num_rows))), 0.0)
        first = np.minimum.reduceat(np.where(known, t, _FAR), starts)
        last = np.maximum.reduceat(np.where(known, t, -_FAR), starts)
        numbers = [points, gaps, mean, np.add.reduceat(off * off, starts), first, last]
        heads = [c.take(pa.array(starts)) for c in columns]
        if held:
            if all(a[0].as_py() == b[0].as_py() for a, b in zip(held[0], heads)):
                for column, value in zip(numbers, _joined(held[1], [column[0] for column in numbers])):
                    column[0] = value
            else:
                yield made(held[0], [np.array([v]) for v in held[1]])
        held = [c[-1:] for c in heads], [column[-1] for column in numbers]
        if len(starts) > 1:
            yield made([c[:-1] for c in heads], [column[:-1] for column in numbers])
    if held:
        yield made(held[0], [np.array([v]) for v in held[1]])


def _joined(a: list, b: list) -> list:
    """One run out of two that follow each other, the gap between them included."""
    if not a[0] or not b[0]:
        return list(b if not a[0] else a)
    border = (b[4] - a[5]) / 1e6
    n = a[1] + b[1] + 1
    mean = (a[1] * a[2] + b[1] * b[2] + border) / n
    squares = a[3] + b[3] + a[1] * (a[2] - mean) ** 2 + b[1] * (b[2] - mean) ** 2 + (border - mean) ** 2
    return [a[0] + b[0], n, mean, squares, a[4], b[5]]


def gap_statistics(
    df: DataFrame, keys: Sequence[str], time: str = "StartTime", spread: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Spread of the gaps between consecutive timestamps of each key.

    Rows are range partitioned by key, time and a hash of the ``spread`` columns,
    so a key with most rows, or most rows at one time, covers as many tasks as its
    share of the rows asks for. Each task folds its sorted rows in one pass into a
    row per key: first and last time and the moments of the gaps between them. The
    second step sees one row per key and task and adds the gaps across task
    borders. Its moments are about the key's mean gap, which telescopes to
    (last - first) / gaps, so no large sums cancel. Null times do not count; a key
    with null times only has no gap. Emits ``gaps``, ``gap_mean``, ``gap_std_pop``
    and ``gap_std_samp`` (null for a single gap), in seconds. ``parts`` sets the
    number of ranges, else it is the session's.
    """
    timed = df.select(*keys, F.col(time).alias("_t"), F.xxhash64(*spread, F.lit(0)).alias("_spread"))
    order = [*keys, "_t", "_spread"]
    ranged = timed.repartitionByRange(parts, *order) if parts else timed.repartitionByRange(*order)
    kinds = timed.select(*keys).schema
    for name, kind in (("points", "long"), ("n", "long"), ("m", "double"), ("ss", "double"), ("first", "long"), ("last", "long")):
        kinds = kinds.add(f"_{name}", kind)
    n_keys = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _runs(batches, n_keys):
            yield out.rename_columns(kinds.names)

    runs = ranged.sortWithinPartitions(*keys, "_t").drop("_spread").mapInArrow(fold, kinds)
    whole = Window.partitionBy(*keys)
    outer = whole.orderBy("_first", "_last")
    total = F.greatest(F.sum("_points").over(whole) - 1, F.lit(0))
    span = (F.max("_last").over(whole) - F.min("_first").over(whole)) / F.lit(1e6)
    border = (F.col("_first") - F.lag("_last").over(outer)) / F.lit(1e6)
    placed = runs.select(*keys, "_n", "_m", "_ss", border.alias("_border"), total.alias("_total"), F.try_divide(span, total).alias("_mean"))
    off_inner = F.col("_ss") + F.col("_n") * F.pow(F.col("_m") - F.col("_mean"), 2)
    off_border = F.coalesce(F.pow(F.col("_border") - F.col("_mean"), 2), F.lit(0.0))
    moments = placed.groupBy(*keys).agg(
        F.max("_total").alias("gaps"),
        F.max("_mean").alias("gap_mean"),
        F.sum(off_inner + off_border).alias("_ss"),
    )
    return moments.select(*keys, *gap_columns())


def range_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """Minimum and maximum of columns as one scalar-subquery struct."""
    parts = [f(F.col(c).cast("double")).alias(f"{p}_{c}") for c in columns for f, p in ((F.min, "lo"), (F.max, "hi"))]
    return df.agg(F.struct(*parts).alias("range")).scalar()
