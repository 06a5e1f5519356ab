"""Recursive flatten of records into facts: one row per value occurrence.

Everything is one expression per record, built from the schema, and one ``inline``:
an array of equal structs (path, class, vtext, inum, num, len).  Variant columns (or JSON
parsed to variant) are unrolled to their own depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataview.functions.hierarchy import IMPROPER, integer_class, scalar_class, step_column, step_name

FACT = "struct<path:string,class:string,vtext:string,inum:bigint,num:double,len:bigint>"
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Levels of a variant that are looked into: all.
VARIANT_DEPTH = None


def canonical_text(v: Column, dtype: T.DataType) -> Column:
    """The text by which values are told apart, hashed and shown."""
    if isinstance(dtype, T.BinaryType):
        return F.hex(v)
    return v.cast("string")


def _fact(path: Column, name: Column, vtext: Column, inum: Column | None = None, num: Column | None = None, size: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        path.alias("path"),
        name.alias("class"),
        vtext.alias("vtext"),
        (none if inum is None else inum).cast("bigint").alias("inum"),
        (none if num is None else num).cast("double").alias("num"),
        (none if size is None else size).cast("bigint").alias("len"),
    )


def scalar_fact(v: Column, dtype: T.DataType, path: Column, categorical: bool = False) -> Column:
    number = isinstance(dtype, (*INTEGRAL, T.DecimalType, T.FloatType, T.DoubleType))
    inum = v if isinstance(dtype, INTEGRAL) else F.expr("cast(null as bigint)")
    if isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        inum = v.try_cast("bigint")
    text = isinstance(dtype, (T.StringType, T.BinaryType))
    bits = F.octet_length(v).cast("bigint") * 8 if text and not categorical else None
    return _fact(path, scalar_class(v, dtype, categorical), canonical_text(v, dtype), inum, v if number else None, bits)


def facts_of(v: Column, dtype: T.DataType, path: Column, name: str, categorical: frozenset[str], depth: int | None = VARIANT_DEPTH, label: str = "$") -> Column:
    """Array of the facts of a value of any type."""
    if isinstance(dtype, T.StructType) and tuple(dtype.names) == IMPROPER and isinstance(dtype[0].dataType, T.ArrayType):
        items, tail = v.getField(IMPROPER[0]), v.getField(IMPROPER[1])
        own = F.array(_fact(path, F.when(v.isNull(), "null").otherwise("improper_list"), F.to_json(v), size=F.when(v.isNotNull(), F.size(items))))
        heads = F.flatten(F.transform(items, lambda x: facts_of(x, dtype[0].dataType.elementType, F.concat(path, F.lit("[]")), name, categorical, depth, f"{label}[]")))
        ends = facts_of(tail, dtype[1].dataType, F.concat(path, F.lit("[|]")), name, categorical, depth, f"{label}[|]")
        return F.when(v.isNull(), own).otherwise(F.concat(own, F.coalesce(heads, F.array().cast(f"array<{FACT}>")), ends))
    if isinstance(dtype, T.StructType):
        size = len(dtype.fields) + 1
        own = F.array(_fact(path, F.when(v.isNull(), "null").otherwise(f"#{name}/{size}"), F.lit(None).cast("string")))
        parts = [facts_of(v.getField(f.name), f.dataType, F.concat(path, F.lit(f".{step_name(f.name)}")), f.name, categorical, depth, f"{label}.{step_name(f.name)}") for f in dtype.fields]
        children = F.concat(*parts) if parts else F.array().cast(f"array<{FACT}>")
        return F.when(v.isNull(), own).otherwise(F.concat(own, children))
    if isinstance(dtype, T.ArrayType):
        kind = F.when(v.isNull(), "null").when(F.size(v) == 0, "[]").otherwise("nonempty_list")
        own = F.array(_fact(path, kind, F.to_json(v), size=F.when(F.size(v) > 0, F.size(v))))
        items = F.flatten(F.transform(v, lambda x: facts_of(x, dtype.elementType, F.concat(path, F.lit("[]")), name, categorical, depth, f"{label}[]")))
        return F.when(v.isNull(), own).otherwise(F.concat(own, items))
    if isinstance(dtype, T.MapType):
        own = F.array(_fact(path, F.when(v.isNull(), "null").otherwise("map"), F.lit(None).cast("string")))
        entries = F.transform(F.map_entries(v), lambda e: facts_of(e["value"], dtype.valueType, F.concat(path, F.lit("."), step_column(e["key"].cast("string"))), name, categorical, depth, f"{label}.*"))
        return F.when(v.isNull(), own).otherwise(F.concat(own, F.flatten(entries)))
    if isinstance(dtype, T.VariantType):
        return variant_facts(v, path, depth)
    return F.array(scalar_fact(v, dtype, path, label in categorical))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once; an expression that a lambda names twice is computed twice."""
    return F.element_at(F.transform(F.array(value), then), 1)


def variant_facts(v: Column, path: Column, depth: int | None) -> Column:
    """Facts of a variant and of all that it holds, level by level until a level is empty.

    The levels are folded in one expression whose size does not grow with them: the state is the next level's values and
    the facts so far.  A value cannot have more levels than its text has opening brackets.  With ``depth``
    levels below that are not looked into.  Each value is opened once; what it holds serves its fact and the next level.
    """
    text = v.cast("string")
    brackets = F.coalesce(F.length(text) - F.length(F.translate(text, "[{", "")), F.lit(0))
    levels = brackets if depth is None else F.least(brackets, F.lit(depth))
    none = F.array().cast(f"array<{FACT}>")
    start = F.struct(F.array(F.struct(path.alias("path"), v.alias("v"))).alias("level"), none.alias("facts"))

    def step(state: Column, at: Column) -> Column:
        # below the last level that brackets allow there are no lists, so the asked depth alone cuts
        cut = F.lit(False) if depth is None else at > depth
        opened = F.transform(state["level"], lambda x: _let(_opened(x["v"], x["path"]), _described))

        def folded(held: Column) -> Column:
            own = F.transform(held, lambda x: _variant_fact(x, cut))
            below = F.flatten(F.transform(held, _variant_parts))
            below = below if depth is None else F.when(cut, F.slice(state["level"], 1, 0)).otherwise(below)
            return F.struct(below.alias("level"), F.concat(state["facts"], own).alias("facts"))

        return F.when(F.size(state["level"]) == 0, state).otherwise(_let(opened, folded))

    return F.aggregate(F.sequence(F.lit(1), levels + 1), start, step, lambda state: state["facts"])


def _opened(v: Column, path: Column) -> Column:
    """A variant with what it holds: ``items`` of a list, ``entries`` of a map."""
    return F.struct(path.alias("path"), v.alias("v"), v.try_cast("array<variant>").alias("items"), v.try_cast("map<string,variant>").alias("entries"))


def _described(x: Column) -> Column:
    """An opened variant with its kind; the kind of a list or map is not derived from all that it holds."""
    kind = F.when(x["items"].isNotNull(), "ARRAY").when(x["entries"].isNotNull(), "OBJECT").otherwise(F.schema_of_variant(x["v"]))
    text = F.when(x["entries"].isNull(), x["v"].cast("string"))
    return F.struct(*(x[name].alias(name) for name in ("path", "v", "items", "entries")), kind.alias("kind"), text.alias("text"))


def _variant_parts(x: Column) -> Column:
    """(path, v) of what a list or map holds; empty for anything else."""
    items = F.transform(x["items"], lambda y: F.struct(F.concat(x["path"], F.lit("[]")).alias("path"), y.alias("v")))
    entries = F.transform(F.map_entries(x["entries"]), lambda e: F.struct(F.concat(x["path"], F.lit("."), step_column(e["key"])).alias("path"), e["value"].alias("v")))
    none = F.array().cast("array<struct<path:string,v:variant>>")
    return F.coalesce(items, entries, none)


def _variant_fact(x: Column, cut: Column) -> Column:
    """The fact of a variant itself: its class depends on the value at hand."""
    v, kind, text = x["v"], x["kind"], x["text"]
    integer, number = v.try_cast("bigint"), v.try_cast("double")
    is_list, is_map, is_decimal = kind == "ARRAY", kind == "OBJECT", kind.startswith("DECIMAL")
    length = F.size(x["items"])
    name = (
        F.when(v.isNull() | (kind == "VOID"), F.lit("null"))
        .when(is_map, F.lit("map"))
        .when(is_list & cut, F.lit("list"))
        .when(is_list, F.when(length == 0, "[]").otherwise("nonempty_list"))
        .when(kind == "BOOLEAN", F.lit("boolean"))
        .when(kind == "BIGINT", _let(integer, integer_class))
        .when(kind == "STRING", F.when(F.octet_length(text) == 0, "<<>>").otherwise("binary"))
        .when(is_decimal & kind.endswith(",0)"), integer_class(v.try_cast("decimal(38,0)")))  # integers beyond bigint
        .when((kind == "DOUBLE") | is_decimal, F.lit("float"))
        .otherwise("term")
    )
    size = F.when(kind == "STRING", F.octet_length(text).cast("bigint") * 8).when(is_list & ~cut & (length > 0), length.cast("bigint"))
    is_number = (kind == "BIGINT") | (kind == "DOUBLE") | is_decimal
    return _fact(x["path"], name, F.when((kind != "VOID") & ~is_map, text), F.when(kind == "BIGINT", integer), F.when(is_number, number), size)


def facts(df: DataFrame, value: Column, dtype: T.DataType, name: str = "row", categorical=(), keep=(), depth: int | None = VARIANT_DEPTH) -> DataFrame:
    """Facts of ``value`` for every record of ``df``; the columns ``keep`` come along."""
    array = facts_of(value, dtype, F.lit("$"), name, frozenset(categorical), depth)
    return df.select(*keep, F.inline(array))


def field_paths(dtype: T.DataType, path: str = "$") -> list[str]:
    """Paths of the schema's fields in their order."""
    if isinstance(dtype, T.StructType):
        if tuple(dtype.names) == IMPROPER:
            return [f"{path}[|]", *field_paths(dtype[0].dataType, path), *field_paths(dtype[1].dataType, f"{path}[|]")]
        return [p for f in dtype.fields for p in (f"{path}.{step_name(f.name)}", *field_paths(f.dataType, f"{path}.{step_name(f.name)}"))]
    if isinstance(dtype, T.ArrayType):
        return field_paths(dtype.elementType, f"{path}[]")
    return []


def record_fields(dtype: T.DataType, name: str = "row", path: str = "$") -> list[tuple[str, str, list[str]]]:
    """(path, class, names of the fields in their order) of every record that a schema names."""
    if isinstance(dtype, T.StructType):
        if tuple(dtype.names) == IMPROPER:
            return [*record_fields(dtype[0].dataType, name, path), *record_fields(dtype[1].dataType, name, f"{path}[|]")]
        own = (path, f"#{name}/{len(dtype.fields) + 1}", [step_name(f.name) for f in dtype.fields])
        return [own, *(r for f in dtype.fields for r in record_fields(f.dataType, f.name, f"{path}.{step_name(f.name)}"))]
    if isinstance(dtype, T.ArrayType):
        return record_fields(dtype.elementType, name, f"{path}[]")
    return []


def leaf_types(dtype: T.DataType) -> set[str]:
    """Names of the scalar types inside a type."""
    if isinstance(dtype, T.StructType):
        return {x for f in dtype.fields for x in leaf_types(f.dataType)}
    if isinstance(dtype, T.ArrayType):
        return {"array", *leaf_types(dtype.elementType)}
    if isinstance(dtype, T.MapType):
        return leaf_types(dtype.valueType)
    return {dtype.typeName()}
