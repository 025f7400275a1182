"""Vector functions: Column to Column, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalised(a: Column, eps: float = 1e-9) -> Column:
    length = norm(a) + eps
    return F.transform(_double(a), lambda x: x / length)


def arg_max(a: Column) -> Column:
    """The place of the largest component, from 0; the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(a: Column) -> Column:
    top = F.array_max(_double(a))
    powers = F.transform(_double(a), lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def fixed_length(a: Column, length: int, start: Column | int = 1) -> Column:
    """A cut of `length` components from `start`, padded with zeros where the vector is shorter."""
    cut = F.slice(_double(a), start, length)
    return F.concat(cut, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))
