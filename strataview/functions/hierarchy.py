"""Type hierarchy and classification of values, as Column expressions.

A node of a spec is (path, class).  ``PARENT`` gives each class's supertype; record
classes (``#name/size``), tuples (``tuple/N``) and functions (``fun/N``) are named by pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hierarchy, child to parent.
PARENT = {
    "atom": "term",
    "boolean": "atom",
    "number": "term",
    "integer": "number",
    "float": "number",
    "decimal": "number",
    "non_neg_integer": "integer",
    "neg_integer": "integer",
    "char": "non_neg_integer",
    "byte": "char",
    "0": "byte",
    "bitstring": "term",
    "binary": "bitstring",
    "<<>>": "binary",
    "pid": "term",
    "port": "term",
    "reference": "term",
    "fun": "term",
    "list": "term",
    "[]": "list",
    "nonempty_list": "list",
    "improper_list": "list",
    "tuple": "term",
    "{}": "tuple",
    "map": "term",
    "null": "term",
    "timestamp": "term",
    "date": "term",
}
UNIONS = {"term", "list", "tuple"}
GENERICS = {"nonempty_list", "improper_list", "map"}
MAX_BYTE, MAX_CHAR = 255, 0x10FFFF
#: Rank of a class's values in the order of all values.
RANK = {"number": 0, "atom": 1, "tuple": 6, "map": 7, "list": 9, "bitstring": 10, "null": 11, "timestamp": 12, "date": 13}


#: Field names by which a record stands for an improper list: its proper part and its tail.
IMPROPER = ("__items", "__tail")


def step_name(name: str) -> str:
    """A field name as it stands in a path: dots, brackets and backslashes are escaped."""
    return re.sub(r"([.\[\]\\])", r"\\\1", name)


def step_column(name: Column) -> Column:
    return F.regexp_replace(name, r"([.\[\]\\])", r"\\$1")


def path_above(path: str) -> str | None:
    """Path one level up: the record, list or map that holds the position; None for the root."""
    if path == "$":
        return None
    return next((path[: -len(end)] for end in ("[]", "[|]") if path.endswith(end)), None) or re.sub(r"\.(?:[^.\[\]\\]|\\.)*$", "", path)


def parent(name: str) -> str | None:
    """Supertype of a class; None for the root."""
    if name.startswith("#") or name.startswith("tuple/"):
        return "tuple"
    if name.startswith("fun/"):
        return "fun"
    return PARENT.get(name)


def ancestors(name: str) -> list[str]:
    """All supertypes, nearest first."""
    out = []
    while (name := parent(name)) is not None:
        out.append(name)
    return out


def chain(name: str) -> list[str]:
    """The root, ..., the class."""
    return [*reversed(ancestors(name)), name]


def kind(name: str) -> str:
    """union (abstract), generic (children are parameters) or ordinary."""
    if name in UNIONS:
        return "union"
    if name in GENERICS or name.startswith("#") or name.startswith("tuple/"):
        return "generic"
    return "ordinary"


def ancestors_column(name: Column, with_self: bool = False) -> Column:
    """Array of the ancestors of the class in ``name``."""
    entries = [F.lit(x) for c in PARENT for x in (c, ",".join(ancestors(c)))]
    listed = F.element_at(F.create_map(*entries), name)
    text = F.when(name.startswith("#") | name.startswith("tuple/"), "tuple,term").when(name.startswith("fun/"), "fun,term").when(name == "term", "").otherwise(listed)
    array = F.filter(F.split(text, ","), lambda x: x != "")
    return F.concat(F.array(name), array) if with_self else array


def parent_column(name: Column) -> Column:
    entries = [F.lit(x) for pair in PARENT.items() for x in pair]
    return F.when(name.startswith("#") | name.startswith("tuple/"), "tuple").when(name.startswith("fun/"), "fun").when(name == "term", F.lit(None)).otherwise(F.element_at(F.create_map(*entries), name))


def is_generic_column(name: Column) -> Column:
    return name.isin(*GENERICS) | name.startswith("#") | name.startswith("tuple/")


def integer_class(v: Column) -> Column:
    return F.when(v < 0, "neg_integer").when(v == 0, "0").when(v <= MAX_BYTE, "byte").when(v <= MAX_CHAR, "char").otherwise("non_neg_integer")


def scalar_class(v: Column, dtype: T.DataType, categorical: bool = False) -> Column:
    """Leaf class of a scalar value; NULL is a class of its own."""
    if isinstance(dtype, T.BooleanType):
        name = F.lit("boolean")
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (isinstance(dtype, T.DecimalType) and dtype.scale == 0):
        name = integer_class(v)
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        name = F.lit("float")
    elif isinstance(dtype, T.DecimalType):
        name = F.lit("decimal")
    elif isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        name = F.lit("atom") if categorical else F.when(F.octet_length(v) == 0, "<<>>").otherwise("binary")
    elif isinstance(dtype, T.BinaryType):
        name = F.when(F.octet_length(v) == 0, "<<>>").otherwise("binary")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        name = F.lit("timestamp")
    elif isinstance(dtype, T.DateType):
        name = F.lit("date")
    else:
        name = F.lit("term")
    return F.when(v.isNull(), "null").otherwise(name)


def type_to_string(name: str) -> str:
    """Short display name: records and tuples as ``#name/size`` and ``tuple/size``; other names that are no plain word are quoted."""
    if name.startswith("#") or re.fullmatch(r"(tuple|fun)/\d+|[a-z]\w*|0", name):
        return name
    return f"'{name}'"
