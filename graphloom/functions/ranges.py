"""Ranges of numbers, dates and timestamps: structs lo, hi, lo_inc, hi_inc, empty. Ranges of whole numbers and days are kept as [lo, hi)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("lo", "hi", "lo_inc", "hi_inc", "empty")


def is_range(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and tuple(t.names) == NAMES


def make(kind: str, step: bool):
    def f(c, type_of) -> Column:
        lo, hi = c[0].cast(kind), c[1].cast(kind)
        bounds = c[2] if len(c) > 2 else F.lit("[)")
        lo_inc, hi_inc = F.startswith(bounds, F.lit("[")), F.endswith(bounds, F.lit("]"))
        if step:
            one = F.lit(1)
            nxt = (lambda x: F.date_add(x, one)) if kind == "date" else lambda x: x + 1
            lo, hi = F.when(lo_inc, lo).otherwise(nxt(lo)), F.when(hi_inc, nxt(hi)).otherwise(hi)
            lo_inc, hi_inc = F.lit(True), F.lit(False)
        empty = F.coalesce((lo > hi) | ((lo == hi) & ~(lo_inc & hi_inc)), F.lit(False))
        bad = F.coalesce(c[0].cast(kind) > c[1].cast(kind), F.lit(False))
        out = F.struct(lo.alias("lo"), hi.alias("hi"), (lo_inc & lo.isNotNull()).alias("lo_inc"), (hi_inc & hi.isNotNull()).alias("hi_inc"), empty.alias("empty"))
        return F.when(~bad, out).otherwise(F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast(f"struct<lo:{kind},hi:{kind},lo_inc:boolean,hi_inc:boolean,empty:boolean>"))

    return f


def contains_value(r: Column, x: Column) -> Column:
    low = r.getField("lo").isNull() | (x > r.getField("lo")) | ((x == r.getField("lo")) & r.getField("lo_inc"))
    high = r.getField("hi").isNull() | (x < r.getField("hi")) | ((x == r.getField("hi")) & r.getField("hi_inc"))
    return ~r.getField("empty") & low & high


def before(a: Column, b: Column) -> Column:
    """Whether all of a is below all of b."""
    ah, bl = a.getField("hi"), b.getField("lo")
    return ~a.getField("empty") & ~b.getField("empty") & F.coalesce((ah < bl) | ((ah == bl) & ~(a.getField("hi_inc") & b.getField("lo_inc"))), F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    return ~a.getField("empty") & ~b.getField("empty") & ~before(a, b) & ~before(b, a)


def covers(a: Column, b: Column) -> Column:
    al, bl, ah, bh = a.getField("lo"), b.getField("lo"), a.getField("hi"), b.getField("hi")
    low = al.isNull() | F.coalesce((al < bl) | ((al == bl) & (a.getField("lo_inc") | ~b.getField("lo_inc"))), F.lit(False))
    high = ah.isNull() | F.coalesce((ah > bh) | ((ah == bh) & (a.getField("hi_inc") | ~b.getField("hi_inc"))), F.lit(False))
    return b.getField("empty") | (~a.getField("empty") & low & high)


def adjacent(a: Column, b: Column) -> Column:
    def touch(x, y):
        return (x.getField("hi") == y.getField("lo")) & (x.getField("hi_inc") != y.getField("lo_inc"))

    return ~a.getField("empty") & ~b.getField("empty") & F.coalesce(touch(a, b) | touch(b, a), F.lit(False))


def both(a: Column, b: Column) -> Column:
    """The intersection."""
    lower_b = a.getField("lo").isNull() | (b.getField("lo") > a.getField("lo"))
    upper_b = a.getField("hi").isNull() | (b.getField("hi") < a.getField("hi"))
    pick = lambda c, n: F.when(F.coalesce(c, F.lit(False)), b.getField(n)).otherwise(a.getField(n))
    return F.struct(pick(lower_b, "lo").alias("lo"), pick(upper_b, "hi").alias("hi"), pick(lower_b, "lo_inc").alias("lo_inc"), pick(upper_b, "hi_inc").alias("hi_inc"), (~overlaps(a, b)).alias("empty"))


def parse(kind: str, step: bool):
    """From text such as [1,5)."""

    def f(x: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return x
        part = lambda i: F.nullif(F.trim(F.regexp_extract(x, r'^\s*[\[(]\s*"?([^,"]*)"?\s*,\s*"?([^,")\]]*)"?\s*[\])]\s*$', i)), F.lit(""))
        return make(kind, step)([part(1), part(2), F.concat(F.substring(F.trim(x), 1, 1), F.substring(F.trim(x), -1, 1))], None)

    return f


KINDS = {"intrange": ("bigint", True), "numrange": ("decimal(38,10)", False), "tsrange": ("timestamp_ntz", False), "tstzrange": ("timestamp", False), "daterange": ("date", True)}
FUNCTIONS = {n: make(*k) for n, k in KINDS.items()} | {"range_lower": lambda c, t: c[0].getField("lo"), "range_upper": lambda c, t: c[0].getField("hi"), "isempty": lambda c, t: c[0].getField("empty")}
PREFIX: dict = {}
CASTS = {n: parse(*k) for n, k in KINDS.items()} | {n.replace("range", "multirange"): (lambda k: lambda x, t: F.transform(F.regexp_extract_all(x, F.lit(r"([\[(][^\])]*[\])])"), F.lit(1)), lambda r: parse(*k)(r, T.StringType())))(k) for n, k in KINDS.items()}


def operator(op, a, b, ta, tb):
    if is_range(ta) and is_range(tb):
        table = {"&&": overlaps, "<<": before, ">>": lambda x, y: before(y, x), "@>": covers, "<@": lambda x, y: covers(y, x), "-|-": adjacent, "*": both}
        return table[op](a, b) if op in table else None
    if is_range(ta) and op == "@>":
        return contains_value(a, b)
    if is_range(tb) and op == "<@":
        return contains_value(b, a)
    if isinstance(ta, T.ArrayType) and is_range(ta.elementType):
        if is_range(tb) and op in ("&&", "@>"):
            return F.exists(a, lambda r: (overlaps if op == "&&" else covers)(r, b))
        if op == "@>":
            return F.exists(a, lambda r: contains_value(r, b))
    return None
