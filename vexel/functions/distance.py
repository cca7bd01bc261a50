"""Vector arithmetic as Spark column expressions.

Elements are cast to double and summed from left to right, so values are the same bits as a
SQL engine's that does so. A null vector or element gives null; vectors of unequal length raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import Metric, as_metric


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _sub(v: Column, start: int | None, stop: int | None) -> Column:
    return v if start is None else F.slice(v, start + 1, stop - start)


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _pairwise(a: Column | str, b: Column | str, f, start: int | None = None, stop: int | None = None) -> Column:
    a, b = _col(a), _col(b)
    same = F.when(F.size(a) == F.size(b), a).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of unequal length"))))
    return _total(F.zip_with(_sub(same, start, stop), _sub(b, start, stop), lambda x, y: f(x.cast("double"), y.cast("double"))))


def sum_of_squares(a: Column | str, b: Column | str, start: int | None = None, stop: int | None = None) -> Column:
    """Sum of squared differences, over elements start to stop - 1 if they are given."""
    return _pairwise(a, b, lambda x, y: (x - y) * (x - y), start, stop)


def inner_product(a: Column | str, b: Column | str, start: int | None = None, stop: int | None = None) -> Column:
    return _pairwise(a, b, lambda x, y: x * y, start, stop)


def squared_norm(a: Column | str, start: int | None = None, stop: int | None = None) -> Column:
    return _total(F.transform(_sub(_col(a), start, stop), lambda x: x.cast("double") * x.cast("double")))


def l2(a: Column | str, b: Column | str, start: int | None = None, stop: int | None = None) -> Column:
    return F.sqrt(sum_of_squares(a, b, start, stop))


def cosine(a: Column | str, b: Column | str) -> Column:
    """1 - cos of the angle; 1 where a vector is zero."""
    m = F.sqrt(squared_norm(a) * squared_norm(b))
    return 1 - inner_product(a, b) / F.when(m == 0, 1.0).otherwise(m)


def cosine_normalized(a: Column | str, b: Column | str) -> Column:
    """cosine() of vectors of length 1."""
    return 1 - inner_product(a, b)


def normalize(a: Column | str) -> Column:
    """The vector at length 1 (doubles); a zero vector as it is."""
    a = _col(a)
    n = F.sqrt(squared_norm(a))
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def quantize_int8(a: Column | str, low: Column, high: Column) -> Column:
    """Affine map of each element from [low, high] (arrays, one value per dimension) to -128 .. 127."""
    scaled = F.zip_with(F.zip_with(_col(a), low, lambda x, l: x.cast("double") - l), F.zip_with(high, low, lambda h, l: h - l), lambda x, w: F.when(w == 0, 0.0).otherwise(x / w))
    return F.transform(scaled, lambda x: (F.round(x * 255) - 128).cast("byte"))


def distance(metric: Metric | int | str, a: Column | str, b: Column | str) -> Column:
    return {Metric.SUM_OF_SQUARES: sum_of_squares, Metric.L2: l2, Metric.INNER_PRODUCT: inner_product, Metric.COSINE: cosine}[as_metric(metric)](a, b)


def subify(vector: Column | str, subspaces: int) -> Column:
    """The vector cut into `subspaces` equal parts, as an array of arrays; null where its length is no multiple of them."""
    v = _col(vector)
    width = (F.size(v) / subspaces).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda s: F.slice(v, s * width + 1, width))
    return F.when(F.size(v) % subspaces == 0, parts)
