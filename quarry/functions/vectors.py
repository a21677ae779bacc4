"""Vector expressions over ``array<float>`` columns.

Distances follow the reference definition: the element difference is taken in
float32, then squared and summed in float64 from left to right.  The same order
of operations is used by the NumPy block kernel in ``operators.vectors`` so both
paths give bit-identical scores.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squared_l2(a, b) -> Column:
    a, b = _col(a), _col(b)
    diffs = F.zip_with(a, b, lambda x, y: (x - y).cast("double"))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda s, d: s + d * d)


def l2_distance(a, b, strict: bool = True) -> Column:
    """Euclidean distance.  Vectors of different dimension are an error, as in the
    reference; with ``strict=False`` they yield null.  A null vector yields null."""
    a, b = _col(a), _col(b)
    d = F.sqrt(squared_l2(a, b))
    if strict:
        d = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector dimensions differ")).cast("double")).otherwise(d)
    return d


def dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, p: s + p)


def norm(a) -> Column:
    a = _col(a)
    sq = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda s, p: s + p))


def cosine_distance(a, b) -> Column:
    """``1 - a.b / (|a| |b|)``; a zero vector gives null instead of a division error."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def dimension_ok(a, dim: int) -> Column:
    """True when the vector has exactly ``dim`` non-null elements."""
    a = _col(a)
    return (F.size(a) == F.lit(dim)) & F.forall(a, lambda x: x.isNotNull())
