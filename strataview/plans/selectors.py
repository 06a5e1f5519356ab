"""Field selectors: which part of a record is explored.

A selector is 0 or () (the whole record), a 1-based position (1 is the record's
tag), a column name or dotted path, a function of the Columns, a Column, or a list of
selectors applied from left to right.  A record whose selector fails (no such field,
key or element, or null on the way) is skipped: it counts as processed, but is not explored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Selected:
    value: Column
    dtype: T.DataType
    #: True where the selector succeeded
    ok: Column


def whole_record(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def _step(value: Column, dtype: T.DataType, ok: Column, step) -> Selected:
    if isinstance(dtype, T.StructType):
        if isinstance(step, int):
            if step == 1 or step - 2 >= len(dtype.fields):
                return Selected(F.lit(None), T.NullType(), F.lit(False))
            field = dtype.fields[step - 2]
        else:
            field = next((f for f in dtype.fields if f.name == step), None)
            if field is None:
                return Selected(F.lit(None), T.NullType(), F.lit(False))
        return Selected(value.getField(field.name), field.dataType, ok & value.isNotNull())
    if isinstance(dtype, T.ArrayType) and isinstance(step, int):
        return Selected(F.try_element_at(value, F.lit(step)), dtype.elementType, ok & value.isNotNull() & (F.size(value) >= abs(step)))
    if isinstance(dtype, T.MapType):
        return Selected(F.try_element_at(value, F.lit(step).cast(dtype.keyType)), dtype.valueType, ok & F.coalesce(F.map_contains_key(value, F.lit(step).cast(dtype.keyType)), F.lit(False)))
    if isinstance(dtype, (T.VariantType, T.StringType)):
        variant = F.try_parse_json(value) if isinstance(dtype, T.StringType) else value
        path = f"$[{step - 1}]" if isinstance(step, int) else f"$['{step}']"
        found = F.try_variant_get(variant, path, "variant")
        return Selected(found, T.VariantType(), ok & found.isNotNull())
    return Selected(F.lit(None), T.NullType(), F.lit(False))


def select(df: DataFrame, selector) -> Selected:
    """Apply ``selector`` to the records of ``df``."""
    whole = Selected(whole_record(df), T.StructType(df.schema.fields), F.lit(True))
    steps = list(selector) if isinstance(selector, (list, tuple)) else [selector]
    if len(steps) == 1 and isinstance(steps[0], str) and steps[0] not in df.columns:
        steps = steps[0].split(".")
    out, first = whole, True
    for step in steps:
        if not isinstance(step, Column) and step == 0:
            continue
        if isinstance(step, Column) or callable(step):
            value = step if isinstance(step, Column) else step(out.value)
            dtype = df.select(value.alias("v")).schema[0].dataType
            out = Selected(value, dtype, out.ok & value.isNotNull())
        elif first and isinstance(step, str) and step in df.columns:
            out = Selected(F.col(f"`{step}`"), df.schema[step].dataType, F.lit(True))
        elif first and isinstance(step, int):
            field = df.schema.fields[step - 2] if 2 <= step <= len(df.columns) + 1 else None
            out = Selected(F.col(f"`{field.name}`"), field.dataType, F.lit(True)) if field else Selected(F.lit(None), T.NullType(), F.lit(False))
        else:
            out = _step(out.value, out.dtype, out.ok, step)
        first = False
    return out


def normalize_probe(probe) -> tuple[object, dict]:
    """(field selector, attributes) of a probe: the selector alone, or (selector, {name: selector})."""
    if isinstance(probe, tuple) and len(probe) == 2 and isinstance(probe[1], (dict, list)):
        return probe[0], dict(probe[1])
    return probe, {}
