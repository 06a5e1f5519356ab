"""32-bit hashes of canonical text; a spec records which one it used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASHES = ("xxhash", "md5")


def hash32(text: Column, how: str = "xxhash") -> Column:
    """``xxhash`` is fast; ``md5`` (its first 32 bits) has a twin in other SQL engines."""
    if how == "md5":
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    if how == "xxhash":
        return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))
    raise ValueError(f"unknown hash {how!r}; one of {HASHES}")
