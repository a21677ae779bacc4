"""Typed reading of JSON text with keys in any case.

``from_json`` matches keys exactly.  Model output and hand-written files do not always keep to the case of
the keys, so the text becomes a ``VARIANT`` first and each field is picked by its name: the exact
key where there is one, else the last key (in key order) that differs in case only.  Unknown keys
are ignored, values of another type give null, text that is not JSON gives a null struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once for each row, however often ``then`` names it: an expression
    repeated at every level of a nested type would be worked out a number of times that grows as a power of the depth."""
    return F.element_at(F.transform(F.array(value), then), 1)


def pick(found: Column, name: str) -> Column:
    """The value of ``name`` in an object read by ``keyed``."""
    at = F.size(found["alike"]) - F.array_position(found["alike"], F.lit(name.lower()))
    return F.when(F.map_contains_key(found["fields"], F.lit(name)), F.try_element_at(found["fields"], F.lit(name))).otherwise(
        F.get(F.map_values(found["fields"]), at.cast("int")))


def keyed(value: Column, kind: str = "variant") -> Column:
    """An object's fields, and its keys in lower case from the last to the first; null for anything else."""
    return once(fields(value, kind), lambda m: F.when(m.isNotNull(), F.struct(
        m.alias("fields"), F.transform(F.reverse(F.map_keys(m)), F.lower).alias("alike"))))


def fields(value: Column, kind: str = "variant") -> Column:
    """The fields of an object as a map of values of ``kind``; null for anything else."""
    return F.try_variant_get(value, "$", f"map<string,{kind}>")


def typed(value: Column, kind: T.DataType) -> Column:
    """``value`` (a variant) as ``kind``: structs by field names in any case, arrays and maps element by element."""
    if isinstance(kind, T.StructType):
        # a value that the exact keys fill whole needs no other: only one with a null somewhere is looked through key by key
        alike = {f.dataType.simpleString() for f in kind.fields if isinstance(f.dataType, T.AtomicType)}
        flat = len(alike) == 1 and all(isinstance(f.dataType, T.AtomicType) for f in kind.fields)
        found = keyed(value, alike.pop()) if flat else keyed(value)
        return once(F.try_variant_get(value, "$", kind.simpleString()), lambda exact: F.when(_whole(exact, kind), exact).otherwise(
            once(found, lambda x: _struct(x, kind, flat))))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: typed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(fields(value), lambda _k, x: typed(x, kind.valueType))
    return F.try_variant_get(value, "$", kind.simpleString())


def _whole(value: Column, kind: T.DataType) -> Column:
    """True where ``value`` has no null at any level."""
    full = value.isNotNull()
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            full = full & _whole(value[f.name], f.dataType)
    elif isinstance(kind, T.ArrayType):
        full = full & F.forall(value, lambda x: _whole(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        full = full & F.forall(F.map_values(value), lambda x: _whole(x, kind.valueType))
    return full


def _struct(found: Column, kind: T.StructType, flat: bool) -> Column:
    """``flat``: the fields found are of the fields' one type already."""
    whole = F.struct(*((pick(found, f.name) if flat else typed(pick(found, f.name), f.dataType)).alias(f.name) for f in kind.fields))
    return F.when(found.isNotNull(), whole)


def parse_any_case(json: Column, schema: T.StructType) -> Column:
    """JSON text as ``schema``."""
    return once(F.try_parse_json(json), lambda value: typed(value, schema))
