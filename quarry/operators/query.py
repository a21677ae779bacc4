"""The relational query interface on the documents table.

Predicates, projection, ordering, grouping and aggregates are plain DataFrame
calls; Catalyst validates column names (``UNRESOLVED_COLUMN``) and pushes
predicates and projections into the scan.  This module adds the few calls that
have cardinality contracts: ``only``, ``exists``, ``page`` and ``count_where``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFoundError(LookupError):
    pass


class NotSingularError(LookupError):
    pass


def equal_fold(col, value: str) -> Column:
    """Case-insensitive equality (EqualFold)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(c) == F.lower(F.lit(value))


def contains_fold(col, value: str) -> Column:
    """Case-insensitive substring test (ContainsFold)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.contains(F.lower(c), F.lower(F.lit(value)))


def page(df: DataFrame, order: Sequence[Column | str], *, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Ordered page.  The order must be total (end it with a key) for stable pages."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out


def only(df: DataFrame) -> DataFrame:
    """The single row of ``df``; NotFound for none, NotSingular for more (reads <= 2 rows)."""
    n = df.limit(2).count()
    if n == 0:
        raise NotFoundError("document not found")
    if n > 1:
        raise NotSingularError("document not singular")
    return df


def get(df: DataFrame, id_value, *, id_col: str = "id") -> DataFrame:
    """The row with the given id; NotFound when absent (Get / UpdateOneID target)."""
    return only(df.filter(F.col(id_col) == F.lit(id_value)))


def first(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The first row by a total order (First); empty input gives NotFound."""
    out = df.orderBy(*order).limit(1)
    if out.limit(1).count() == 0:
        raise NotFoundError("document not found")
    return out


def update_one(df: DataFrame, id_value, sets: Mapping[str, Column], *, id_col: str = "id") -> DataFrame:
    """The table with the columns of one row set (UpdateOneID); NotFound when the id is absent."""
    only(df.filter(F.col(id_col) == F.lit(id_value)).select(id_col))
    hit = F.col(id_col) == F.lit(id_value)
    return df.select(*(F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in df.columns))


#: Scalar forms of a scan (A11): the reference's name and the type of its values.
SCALARS = {"strings": "string", "ints": "int", "float64s": "double", "bools": "boolean"}


def scan_as(df: DataFrame, column: str, form: str) -> DataFrame:
    """One column as strings, ints, float64s or bools; a value of another type is an error (ANSI cast)."""
    return df.select(F.col(column).cast(SCALARS[form]).alias(column))


def scalar_as(df: DataFrame, column: str, form: str) -> DataFrame:
    """The singular form of ``scan_as``: NotFound for no value, NotSingular for more than one."""
    return only(scan_as(df, column, form))


def exists(df: DataFrame) -> DataFrame:
    """One row ``exists boolean``; stops reading after the first match."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))


def count_where(df: DataFrame, pred: Column) -> DataFrame:
    return df.filter(pred).agg(F.count(F.lit(1)).alias("n"))
