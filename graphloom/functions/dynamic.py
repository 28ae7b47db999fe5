"""Values whose type differs from row to row: a struct of a sort key and JSON text.

The sort key is (rank of the type, number, text), so the total order over types is the order of structs: maps, lists, strings,
booleans, numbers, timestamps, dates, the rest. Numbers of all types compare as numbers. Only mixed lists, mixed properties and
comparisons across types use these; columns of one type stay what they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("sort", "json")


def is_dynamic(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and tuple(t.names) == NAMES


def rank(t: T.DataType) -> int:
    for n, kinds in enumerate(((T.StructType, T.MapType), (T.ArrayType,), (T.StringType,), (T.BooleanType,), (T.NumericType,), (T.TimestampType, T.TimestampNTZType), (T.DateType,))):
        if isinstance(t, kinds):
            return n
    return 7


def mixed(types: list[T.DataType]) -> bool:
    """Whether values of these types need a dynamic one to stand in one column."""
    known = [t for t in types if not isinstance(t, T.NullType)]
    if len({rank(t) for t in known}) > 1 or any(is_dynamic(t) for t in known):
        return len(known) > 1
    return any(rank(t) < 2 for t in known) and len({t.simpleString() for t in known}) > 1


def json_of(x: Column, t: T.DataType) -> Column:
    if is_dynamic(t):
        return x.getField("json")
    if isinstance(t, T.NullType):
        return F.lit("null")
    if rank(t) < 2:
        return F.to_json(x)
    text = x.cast("string")
    return text if rank(t) in (3, 4) else F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', "$1")


def encode(x: Column, t: T.DataType) -> Column:
    """A dynamic value; null stays null."""
    if is_dynamic(t):
        return x
    if isinstance(t, T.NullType):
        return F.lit(None).cast("struct<sort:struct<rank:int,number:double,text:string>,json:string>")
    r = rank(t)
    number = x.cast("double") if r == 4 else F.lit(None).cast("double")
    text = F.lit("") if r == 4 else json_of(x, t) if r < 2 else x.cast("string")
    return F.when(x.isNotNull(), F.struct(F.struct(F.lit(r).alias("rank"), number.alias("number"), text.alias("text")).alias("sort"), json_of(x, t).alias("json")))


def sort_key(x: Column, t: T.DataType) -> Column:
    return encode(x, t).getField("sort")


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether Spark compares the types as the language does. Texts may stand for dates and times."""
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return True
    if is_dynamic(a) or is_dynamic(b):
        return False
    ra, rb = rank(a), rank(b)
    return ra == rb or {ra, rb} <= {5, 6} or 7 in (ra, rb) or {ra, rb} in ({2, 5}, {2, 6})


def same_tag(a: T.DataType, b: T.DataType) -> bool:
    """Whether IN may find one type among the other: whole and other numbers are different."""
    if rank(a) != rank(b):
        return False
    if rank(a) == 4:
        return isinstance(a, T.IntegralType) == isinstance(b, T.IntegralType)
    return rank(a) > 1 or a.simpleString() == b.simpleString()
