"""Predicates and lengths by column type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: Bytes by type name; strings have the longest value's length.
FIXED_BYTES = {
    "byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "date": 8, "timestamp": 8, "timestamp_ntz": 8, "boolean": 1,
}


def is_numeric(kind: T.DataType) -> bool:
    """Types that profiles treat as numbers; bytes are not among them."""
    return isinstance(kind, (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType))


def non_blank(name: str, kind: T.DataType) -> Column:
    """Whether a value is there: no null, NaN or string of white space."""
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return col.isNotNull() & ~F.isnan(col)
    if isinstance(kind, T.StringType):
        return col.isNotNull() & (F.trim(col) != "")
    if isinstance(kind, T.NullType):
        return F.lit(False)
    return col.isNotNull()


def type_name(kind: T.DataType) -> str:
    """Name of a type as profiles print it."""
    return kind.simpleString() if isinstance(kind, T.DecimalType) else kind.typeName()


def fixed_bytes(kind: T.DataType) -> int | None:
    """Bytes of a value of fixed size."""
    return 16 if isinstance(kind, T.DecimalType) else FIXED_BYTES.get(kind.typeName())
