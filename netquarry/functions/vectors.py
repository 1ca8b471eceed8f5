"""Vector and statistics helpers over array columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_of(columns: Sequence[str]) -> Column:
    """Feature columns as one dense double array; a missing value counts as 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return _total(
        F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    )


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mean_of(a: Column | str) -> Column:
    return F.try_divide(_total(F.transform(_col(a), lambda x: x.cast("double"))), F.size(_col(a)))


def coefficient_of_variation(a: Column | str) -> Column:
    """Population deviation over mean; 0 for an empty array or a zero mean."""
    m = mean_of(a)
    spread = _total(F.transform(_col(a), lambda x: (x - m) * (x - m)))
    return F.coalesce(
        F.try_divide(F.sqrt(F.try_divide(spread, F.size(_col(a)))), F.nullif(m, F.lit(0.0))), F.lit(0.0)
    )


def pearson(a: Column | str, b: Column | str) -> Column:
    """Pearson r of two arrays; 0 below three points or without variance."""
    xa, xb = _col(a), _col(b)
    ma, mb = mean_of(xa), mean_of(xb)
    cov = _total(F.zip_with(xa, xb, lambda x, y: (x - ma) * (y - mb)))
    va = _total(F.transform(xa, lambda x: (x - ma) * (x - ma)))
    vb = _total(F.transform(xb, lambda x: (x - mb) * (x - mb)))
    r = F.coalesce(F.try_divide(cov, F.sqrt(va * vb)), F.lit(0.0))
    return F.when(F.size(xa) < 3, F.lit(0.0)).otherwise(r)


def shannon_bits(counts: Column | str) -> Column:
    """Shannon entropy in bits of an array of occurrence counts."""
    c = F.filter(F.transform(_col(counts), lambda x: x.cast("double")), lambda x: x > 0)
    n = _total(c)
    return F.coalesce(
        F.aggregate(c, F.lit(0.0), lambda acc, x: acc - F.try_divide(x, n) * F.log2(F.try_divide(x, n))), F.lit(0.0)
    )


def min_max(value: Column | str, low: Column | str, high: Column | str) -> Column:
    """Rescale to [0, 1]; a constant column becomes 0, a null stays null."""
    v, lo, hi = _col(value), _col(low), _col(high)
    return (v - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
