"""Numeric expressions: shares, rounding, numbers as text, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from purselight.schema import NO_DATA


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def number(text: Column) -> Column:
    """Text as a double; 0 where it is none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def adaptive(value: Column, group: WindowSpec) -> Column:
    """Rounded to two places if all values of the group are below 1, else to whole numbers."""
    return F.when(F.max(F.abs(value)).over(group) < 1, F.bround(value, 2)).otherwise(F.bround(value))


def as_text(value: Column) -> Column:
    """Three places at most, at least one; a fixed text for null and NaN."""
    value = value.cast("double")
    text = F.bround(value, 3).cast("decimal(38,3)").cast("string")
    text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")
    return F.when(value.isNull() | F.isnan(value), NO_DATA).otherwise(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    over = lambda size: F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(norm(a)), over), F.lit(0))  # so that the length is computed once, not for each element


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for a zero vector."""
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def softmax(logits: Column) -> Column:
    most = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - most))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def argmax(values: Column) -> Column:
    """The first place, from 0, of the largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
