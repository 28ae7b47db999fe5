"""Vectors: arrays of floats with element-wise arithmetic and distances, as folds inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def inner(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def negative_inner(a: Column, b: Column) -> Column:
    return -inner(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - inner(a, b) / (norm(a) * norm(b))


def spherical(a: Column, b: Column) -> Column:
    """Angle over pi, of vectors of unit length."""
    return F.acos(F.greatest(F.least(inner(a, b), F.lit(1.0)), F.lit(-1.0))) / F.pi()


def parse(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        parts = F.split(F.regexp_replace(x, r"[\[\]\s\"]", ""), ",")
        return F.transform(F.filter(parts, lambda v: v != ""), lambda v: v.cast("double"))
    return F.transform(x, lambda v: v.cast("double"))


FUNCTIONS = {
    "l2_distance": lambda c, t: l2(*c), "l2_squared_distance": lambda c, t: l2_squared(*c), "l1_distance": lambda c, t: l1(*c), "inner_product": lambda c, t: inner(*c),
    "negative_inner_product": lambda c, t: negative_inner(*c), "cosine_distance": lambda c, t: cosine(*c), "spherical_distance": lambda c, t: spherical(*c),
    "dims": lambda c, t: F.size(c[0]).cast("bigint"), "norm": lambda c, t: norm(c[0]),
}
PREFIX: dict = {}
CASTS = {"vector": parse}


def operator(op, a, b, ta, tb):
    return None
