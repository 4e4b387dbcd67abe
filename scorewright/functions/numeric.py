"""Number helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A tie such as 83.0003125 arrives as a double a hair below or above itself, depending on the order
# in which the executors summed. The nudge sends both to the same side, so that a result does not
# depend on task order.
NUDGE = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(value: Column | str, digits: int) -> Column:
    """Round half up, stable against the noise of floating sums; null for what is not finite (or beyond 9e18 units).

    The value is named once: scores are rounded in several layers, and each further mention would double the code.
    """
    scale = float(10**digits)
    whole = F.rint(col(value).cast("double") * F.lit(scale) + F.lit(NUDGE)).try_cast("bigint")
    return whole / F.lit(scale)


def finite(value: Column | str) -> Column:
    """NaN and both infinities become null."""
    v = col(value).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_entries(entries: Column) -> Column:
    """A map of (key, value) entries in which the last entry of a repeated key counts."""
    def build(found: Column) -> Column:
        keys = F.transform(found, lambda e: e["key"])
        last = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), -1))
        # Nearly every record names its keys once and is taken as it is.
        once = F.size(F.array_distinct(keys)) == F.size(keys)
        return F.when(once, F.map_from_entries(found)).otherwise(F.map_from_entries(last))

    return let(entries, build)


def finite_map(scores: Column | str) -> Column:
    return F.transform_values(col(scores), lambda _, v: finite(v))


def finite_deep(value: Column | str, kind: T.DataType) -> Column:
    """`value` of type `kind` with every NaN and infinity in it null, at any depth of structs, arrays and maps; all else as it is.

    Parts that can't hold such a number are taken whole. Keys of maps stay, as they can't be null.
    """
    v = col(value)
    if not _holds_doubles(kind):
        return v
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
    if isinstance(kind, T.ArrayType):
        return F.transform(v, lambda x: finite_deep(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(v, lambda _, x: finite_deep(x, kind.valueType)) if _holds_doubles(kind.valueType) else v
    fields = [finite_deep(v.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
    return F.when(v.isNotNull(), F.struct(*fields))


def _holds_doubles(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_doubles(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_doubles(kind.elementType)
    return _holds_doubles(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, (T.DoubleType, T.FloatType))


def sanitized(df: DataFrame) -> DataFrame:
    """Every column of `df` by `finite_deep`; names and types stay."""
    return df.select(*[finite_deep(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def ratio(num: Column | str, den: Column | str, default: float | None = None) -> Column:
    """num / den, with a default where the denominator is 0."""
    out = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))
