"""Functions, operators, casts, aggregates and windows of the query language, as builders of Columns.

Names are lower case. A builder gets Columns and, where the meaning depends on types, a function that gives a Column's type.
Built-in Spark functions throughout, except where none expresses the meaning (network addresses, see network.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dynamic, geometry, network, ranges, temporal, textsearch, vectors

AGGREGATES = frozenset(
    "count sum avg min max stdev stdevp collect percentilecont percentiledisc percentile_cont percentile_disc corr covar_pop covar_samp "
    "regr_sxx regr_syy regr_sxy regr_slope regr_intercept regr_avgx regr_avgy regr_r2 regr_count grouping string_agg array_agg bool_and bool_or every".split()
)
TypeOf = Callable[[Column], T.DataType]


def fail_unless(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok | ok.isNull(), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def _substring(c: list[Column]) -> Column:
    """1-based; a start before the text shortens the result instead of counting from the end."""
    start = c[1].cast("int")
    if len(c) == 2:
        return F.substring(c[0], F.greatest(start, F.lit(1)), F.lit(2147483647))
    return F.substring(c[0], F.greatest(start, F.lit(1)), F.greatest(c[2].cast("int") + F.least(start - 1, F.lit(0)), F.lit(0)))


def _left(c: list[Column]) -> Column:
    n = c[1].cast("int")
    return F.substring(c[0], F.lit(1), F.greatest(F.when(n >= 0, n).otherwise(F.length(c[0]) + n), F.lit(0)))


def _right(c: list[Column]) -> Column:
    n = c[1].cast("int")
    size = F.greatest(F.when(n >= 0, F.least(n, F.length(c[0]))).otherwise(F.length(c[0]) + n), F.lit(0))
    return F.substring(c[0], F.length(c[0]) - size + 1, size)


def _initcap(c: list[Column]) -> Column:
    """Upper case after every character that is neither letter nor digit."""
    parts = F.regexp_extract_all(F.lower(c[0]), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def _range(c: list[Column]) -> Column:
    step = c[2] if len(c) == 3 else F.lit(1).cast("bigint")
    none = F.array().cast("array<bigint>")
    return F.when(step == 0, F.raise_error(F.lit("step size of range cannot be 0")).cast("array<bigint>")).when((step > 0) & (c[0] <= c[1]) | (step < 0) & (c[0] >= c[1]), F.sequence(c[0], c[1], step)).otherwise(none)


def _gcd(c: list[Column]) -> Column:
    """Euclid's algorithm; 93 rounds suffice for any longs."""
    pair = F.struct(F.abs(c[0].cast("bigint")).alias("a"), F.abs(c[1].cast("bigint")).alias("b"))
    kind = "struct<a:bigint,b:bigint>"
    step = lambda p, _: F.struct(F.when(p.b == 0, p.a).otherwise(p.b).alias("a"), F.when(p.b == 0, p.b).otherwise(p.a % F.when(p.b == 0, F.lit(1)).otherwise(p.b)).alias("b")).cast(kind)
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), pair.cast(kind), step, lambda p: p.a)


def _lcm(c: list[Column]) -> Column:
    g = _gcd(c)
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise((F.abs(c[0]) / g).cast("bigint") * F.abs(c[1]))


def _round(c: list[Column], type_of: TypeOf) -> Column:
    kind = type_of(c[0])
    if len(c) == 2:
        return F.round(c[0].cast("decimal(38,18)"), c[1].cast("int")).cast("double")
    return F.bround(c[0]) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.round(c[0])


def _size(c: list[Column], type_of: TypeOf) -> Column:
    return (F.octet_length(c[0]) if isinstance(type_of(c[0]), T.StringType) else F.size(c[0])).cast("bigint")


def _keys(c: list[Column], type_of: TypeOf) -> Column:
    kind = type_of(c[0])
    if isinstance(kind, T.StructType):
        return F.array(*[F.lit(n) for n in sorted(kind.names)])
    return F.json_object_keys(c[0]) if isinstance(kind, T.StringType) else F.map_keys(c[0])


SIMPLE: dict[str, Callable[[list[Column]], Column]] = {
    "abs": lambda c: F.abs(c[0]),
    "acos": lambda c: F.acos(fail_unless(F.abs(c[0]) <= 1, c[0].cast("double"), "input is out of range")),
    "acosh": lambda c: F.acosh(fail_unless(c[0] >= 1, c[0].cast("double"), "input is out of range")),
    "asin": lambda c: F.asin(fail_unless(F.abs(c[0]) <= 1, c[0].cast("double"), "input is out of range")),
    "asinh": lambda c: F.asinh(c[0]),
    "atan": lambda c: F.atan(c[0]),
    "atan2": lambda c: F.atan2(c[1], c[0]),
    "atanh": lambda c: F.atanh(fail_unless(F.abs(c[0]) <= 1, c[0].cast("double"), "input is out of range")),
    "cbrt": lambda c: F.cbrt(c[0]),
    "ceil": lambda c: F.ceil(c[0]),
    "ceiling": lambda c: F.ceil(c[0]),
    "coalesce": lambda c: F.coalesce(*c),
    "cos": lambda c: F.cos(c[0]),
    "cosh": lambda c: F.cosh(c[0]),
    "cot": lambda c: F.cot(c[0]),
    "current_date": lambda c: F.current_date(),
    "current_timestamp": lambda c: F.current_timestamp(),
    "degrees": lambda c: F.degrees(c[0]),
    "e": lambda c: F.e(),
    "exp": lambda c: F.exp(c[0]),
    "factorial": lambda c: F.factorial(c[0].cast("int")),
    "floor": lambda c: F.floor(c[0]),
    "gcd": _gcd,
    "greatest": lambda c: F.greatest(*c),
    "head": lambda c: F.try_element_at(c[0], F.lit(1)),
    "initcap": _initcap,
    "last": lambda c: F.try_element_at(c[0], F.lit(-1)),
    "lcm": _lcm,
    "least": lambda c: F.least(*c),
    "left": _left,
    "localtimestamp": lambda c: F.localtimestamp(),
    "log": lambda c: F.ln(fail_unless(c[0] > 0, c[0].cast("double"), "cannot take logarithm of zero or a negative number")),
    "log10": lambda c: F.log10(fail_unless(c[0] > 0, c[0].cast("double"), "cannot take logarithm of zero or a negative number")),
    "ltrim": lambda c: F.ltrim(c[0]),
    "md5": lambda c: F.md5(c[0].cast("binary")),
    "now": lambda c: F.current_timestamp(),
    "nullif": lambda c: F.nullif(c[0], c[1]),
    "pi": lambda c: F.pi(),
    "radians": lambda c: F.radians(c[0]),
    "rand": lambda c: F.rand(),
    "range": _range,
    "replace": lambda c: F.replace(c[0], c[1], c[2]),
    "reverse": lambda c: F.reverse(c[0]),
    "right": _right,
    "rtrim": lambda c: F.rtrim(c[0]),
    "sign": lambda c: F.signum(c[0]),
    "sin": lambda c: F.sin(c[0]),
    "sinh": lambda c: F.sinh(c[0]),
    "split": lambda c: F.split(c[0], c[1]),
    "throw_error": lambda c: F.raise_error(c[0]),
    "build_vertex": lambda c: F.struct(c[0].alias("id"), c[1].alias("label"), c[2].alias("properties")),
    "build_edge": lambda c: F.struct(c[0].alias("id"), c[3].alias("label"), c[1].alias("start_id"), c[2].alias("end_id"), c[4].alias("properties")),
    "build_traversal": lambda c: F.struct(F.array(*c[::2]).alias("nodes"), F.array(*c[1::2]).alias("edges")),
    "build_variable_edge": lambda c: F.struct(F.array(*c[::2]).alias("edges"), F.array(*c[1::2]).alias("nodes")),
    "regexp_match": lambda c: F.regexp_extract_all(c[0], c[1], F.lit(0)),
    "sqrt": lambda c: F.sqrt(fail_unless(c[0] >= 0, c[0].cast("double"), "cannot take square root of a negative number")),
    "substring": _substring,
    "tan": lambda c: F.tan(c[0]),
    "tanh": lambda c: F.tanh(c[0]),
    "tolower": lambda c: F.lower(c[0]),
    "lower": lambda c: F.lower(c[0]),
    "toupper": lambda c: F.upper(c[0]),
    "upper": lambda c: F.upper(c[0]),
    "trim": lambda c: F.trim(c[0]),
    "unnest": lambda c: c[0],
} | {f"sha{n}": (lambda n: lambda c: F.sha2(c[0].cast("binary"), n))(n) for n in (224, 256, 384, 512)}
TYPED: dict[str, Callable[[list[Column], TypeOf], Column]] = {"round": _round, "size": _size, "keys": _keys}
#: to*() functions and the types that they cast to.
CONVERSIONS = {f"to{n}": n for n in "integer float boolean numeric string timestamp timestamptz date time timetz interval vector inet cidr macaddr macaddr8 bytea point box circle polygon path lseg line tsvector tsquery intrange numrange tsrange tstzrange daterange box2d box3d spheroid geometry intmultirange nummultirange tsmultirange tstzmultirange datemultirange".split()} | {"tostringlist": "string[]", "tofloatlist": "float[]", "tointegerlist": "int[]", "tobooleanlist": "bool[]"}
MODULES = (temporal, vectors, ranges, network, textsearch, geometry)


#: Names of functions that CREATE FUNCTION made in the session.
USER: set[str] = set()


def call(name: str, args: list[Column], type_of: TypeOf) -> Column:
    if name in SIMPLE:
        return SIMPLE[name](args)
    if name in TYPED:
        return TYPED[name](args, type_of)
    if name in CONVERSIONS:
        return cast(args[0], CONVERSIONS[name], type_of)
    for m in MODULES:
        if name in m.FUNCTIONS:
            return m.FUNCTIONS[name](args, type_of)
    if name in USER:
        return F.call_function(name, *args)
    raise ValueError(f"function {name} does not exist")


def names() -> list[str]:
    """All functions that a query can call."""
    return sorted({*SIMPLE, *TYPED, *CONVERSIONS, *AGGREGATES, *WINDOWS, *(n for m in MODULES for n in m.FUNCTIONS)})


# -- operators --


def unary(op: str, x: Column, type_of: TypeOf) -> Column:
    if op == "not":
        return ~x
    if op == "-":
        return -x
    if op == "+":
        return x
    for m in MODULES:
        if op in m.PREFIX:
            return m.PREFIX[op](x, type_of)
    raise ValueError(f"operator {op} does not exist for one operand")


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_vector(t: T.DataType, literal: bool = False) -> bool:
    return isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)) and not literal


COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b, "distinct": lambda a, b: ~a.eqNullSafe(b)}
STRINGS = {
    "starts": lambda a, b: F.startswith(a, b), "ends": lambda a, b: F.endswith(a, b), "contains": lambda a, b: F.contains(a, b),
    "~~~": lambda a, b: F.like(a, b), "!~~": lambda a, b: ~F.like(a, b), "~~*": lambda a, b: F.ilike(a, b), "!~~*": lambda a, b: ~F.ilike(a, b),
    "=~": lambda a, b: F.rlike(a, b), "~": lambda a, b: F.rlike(a, b), "~*": lambda a, b: F.rlike(a, F.concat(F.lit("(?i)"), b)), "!~": lambda a, b: ~F.rlike(a, b), "!~*": lambda a, b: ~F.rlike(a, F.concat(F.lit("(?i)"), b)),
}


def binary(op: str, a: Column, b: Column, type_of: TypeOf, lists: tuple[bool, bool] = (False, False)) -> Column:
    if op in COMPARE:
        if op not in ("and", "or"):
            ta, tb = type_of(a), type_of(b)
            if not dynamic.comparable(ta, tb):
                a, b = dynamic.sort_key(a, ta), dynamic.sort_key(b, tb)
        return COMPARE[op](a, b)
    if op == "xor":
        return (a | b) & ~(a & b)
    if op in STRINGS and (op != "~" or isinstance(type_of(a), T.StringType)):
        return STRINGS[op](a, b)
    ta, tb = type_of(a), type_of(b)
    if op in ("<->", "<#>", "<=>"):
        if is_vector(ta) or isinstance(ta, T.ArrayType):
            return {"<->": vectors.l2, "<#>": vectors.negative_inner, "<=>": vectors.cosine}[op](a, b)
    for m in MODULES:
        if (got := m.operator(op, a, b, ta, tb)) is not None:
            return got
    if op == "+":
        if isinstance(ta, T.ArrayType) and isinstance(tb, T.ArrayType):
            if dynamic.mixed([ta.elementType, tb.elementType]):
                return F.concat(F.transform(a, lambda x: dynamic.encode(x, ta.elementType)), F.transform(b, lambda x: dynamic.encode(x, tb.elementType)))
            return F.zip_with(a, b, lambda x, y: x + y) if is_vector(ta, lists[0]) and is_vector(tb, lists[1]) else F.concat(a, b)
        if isinstance(ta, T.ArrayType):
            return F.concat(a, F.array(b.cast(ta.elementType)))
        if isinstance(tb, T.ArrayType):
            return F.concat(F.array(a.cast(tb.elementType)), b)
        if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
            return F.concat(a.cast("string"), b.cast("string"))
        return a + b
    if op == "-":
        return F.zip_with(a, b, lambda x, y: x - y) if is_vector(ta) and is_vector(tb) else a - b
    if op == "*":
        if is_vector(ta) and is_vector(tb):
            return F.zip_with(a, b, lambda x, y: x * y)
        if is_vector(ta) and is_number(tb):
            return F.transform(a, lambda x: x * b)
        return F.transform(b, lambda x: x * a) if is_vector(tb) and is_number(ta) else a * b
    if op == "/":
        return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(_div(a, b)) if isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType) else a / b
    if op == "%":
        return a % b
    if op == "^":
        return F.pow(a, b)
    if op == "||":
        return F.concat(a, b)
    if op == "@=":
        if isinstance(tb, T.ArrayType) and (dynamic.is_dynamic(tb.elementType) or not dynamic.same_tag(ta, tb.elementType)):
            key = dynamic.sort_key(a, ta)
            return F.when(a.isNotNull() & b.isNotNull(), F.exists(b, lambda x: F.coalesce(dynamic.sort_key(x, tb.elementType) == key, F.lit(False))))
        return F.array_contains(F.array_compact(b), a)
    if op in ("->", "->>"):
        return field(a, ta, b, op == "->>")
    if op in ("@>", "<@"):
        return contains(a, ta, b, tb) if op == "@>" else contains(b, tb, a, ta)
    if op in ("?", "?|", "?&"):
        keys = F.json_object_keys(a) if isinstance(ta, T.StringType) else F.array(*[F.lit(n) for n in ta.names]) if isinstance(ta, T.StructType) else F.map_keys(a) if isinstance(ta, T.MapType) else a
        return F.array_contains(keys, b) if op == "?" else F.arrays_overlap(keys, b) if op == "?|" else F.size(F.array_except(b, keys)) == 0
    if op in ("&", "|"):
        return a.bitwiseAND(b) if op == "&" else a.bitwiseOR(b)
    raise ValueError(f"operator {op} does not exist for {ta.simpleString()} and {tb.simpleString()}")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient, toward zero."""
    return ((a - a % b) / b).cast("bigint")


def field(a: Column, ta: T.DataType, key: Column, text: bool) -> Column:
    if isinstance(ta, T.ArrayType):
        i = key.cast("int")
        out = F.try_element_at(a, F.when(i >= 0, i + 1).otherwise(i))
    elif isinstance(ta, T.MapType):
        out = F.try_element_at(a, key)
    elif isinstance(ta, T.StructType):
        out = None
        for n in ta.names:
            out = F.when(key == n, a.getField(n).cast("string")) if out is None else out.when(key == n, a.getField(n).cast("string"))
        return out
    else:
        return F.call_function("get_json_object", a, F.concat(F.lit("$."), key.cast("string")))
    return out.cast("string") if text else out


def contains(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Whether a has all that b has: fields of equal values, elements of a list."""
    if isinstance(ta, T.StructType) and isinstance(tb, T.StructType):
        out = F.lit(True)
        for f in tb.fields:
            if f.name not in ta.names:
                return F.lit(False)
            out = out & contains(a.getField(f.name), ta[f.name].dataType, b.getField(f.name), f.dataType)
        return out
    if isinstance(ta, T.ArrayType):
        return F.size(F.array_except(b, a)) == 0 if isinstance(tb, T.ArrayType) else F.array_contains(a, b)
    if is_number(ta) and is_number(tb) and isinstance(ta, T.IntegralType) != isinstance(tb, T.IntegralType):
        return F.lit(False)
    return F.coalesce(a == b, F.lit(False))


# -- casts --

CASTS = {"int": "bigint", "integer": "bigint", "float": "double", "numeric": "decimal(38,10)", "bool": "boolean", "boolean": "boolean", "string": "string", "text": "string", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "date": "date", "bytea": "binary"}


def cast(x: Column, name: str, type_of: TypeOf) -> Column:
    if name.endswith("[]"):
        kind = type_of(x)
        return F.transform(x, lambda v: cast(v, name[:-2], lambda _: kind.elementType))
    kind = type_of(x)
    if dynamic.is_dynamic(kind):
        # A text loses its quotes.
        x, kind = F.when(x.getField("sort").getField("rank") == 2, x.getField("sort").getField("text")).otherwise(x.getField("json")), T.StringType()
    if name in ("int", "integer"):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.bround(x).cast("bigint")
        return (F.round(x) if isinstance(kind, T.DecimalType) else x).cast("bigint")
    if name == "timestamp" and isinstance(kind, T.IntegralType):
        # Microseconds since 2000-01-01.
        return F.timestamp_micros(x + 946684800000000).cast("timestamp_ntz")
    if isinstance(kind, T.StringType) and name in ("timestamp", "timestamptz", "date"):
        return temporal.parse(x, CASTS[name])
    if name in CASTS:
        return x.cast(CASTS[name])
    for m in MODULES:
        if name in m.CASTS:
            return m.CASTS[name](x, kind)
    raise ValueError(f"type {name} does not exist")


def needs_showing(t: T.DataType) -> bool:
    return isinstance(t, T.CalendarIntervalType) or textsearch.is_query(t)


def shown(x: Column, t: T.DataType) -> Column:
    """Results that users cannot read as they are: intervals as months, days and microseconds, text queries as text."""
    return temporal.parts(x, t) if isinstance(t, T.CalendarIntervalType) else x.getField("query")


# -- aggregates and windows --


def aggregate(name: str, c: list[Column], opts: dict) -> Column:
    distinct = opts.get("distinct")
    if name == "count":
        return F.count(F.lit(1)) if opts.get("star") or not c else F.count_distinct(*c) if distinct else F.count(c[0])
    if name == "sum":
        return F.sum_distinct(c[0]) if distinct else F.sum(c[0])
    if name == "avg":
        return F.sum_distinct(c[0]) / F.count_distinct(c[0]) if distinct else F.avg(c[0])
    if name in ("collect", "array_agg"):
        found = F.collect_set(c[0]) if distinct else F.collect_list(c[0])
        return F.slice(found, F.lit(1), c[1].cast("int")) if len(c) == 2 else found
    if name in ("percentilecont", "percentiledisc"):
        return _percentile(name.replace("percentile", "percentile_"), c[0].cast("double"), c[1])
    if name in ("percentile_cont", "percentile_disc"):
        return _percentile(name, c[0], c[1])
    simple = {"min": F.min, "max": F.max, "stdev": F.stddev_samp, "stdevp": F.stddev_pop, "grouping": F.grouping, "bool_and": F.bool_and, "every": F.bool_and, "bool_or": F.bool_or}
    if name in simple:
        return simple[name](c[0])
    if name == "string_agg":
        return F.listagg(c[0], c[1])
    return getattr(F, name)(c[0], c[1])


def _percentile(kind: str, x: Column, p: Column) -> Column:
    if kind == "percentile_cont":
        return F.percentile(x, p)
    # The smallest value whose share of rows reaches p.
    ordered = F.array_sort(F.collect_list(x))
    return F.try_element_at(ordered, F.greatest(F.ceil(p * F.size(ordered)).cast("int"), F.lit(1)))


WINDOWS: dict[str, Callable[[list[Column]], Column]] = {
    "row_number": lambda c: F.row_number(), "rank": lambda c: F.rank(), "dense_rank": lambda c: F.dense_rank(), "percent_rank": lambda c: F.percent_rank(), "cume_dist": lambda c: F.cume_dist(),
    "first_value": lambda c: F.first_value(c[0]), "last_value": lambda c: F.last_value(c[0]),
}


def constant(c: Column) -> int:
    """A whole number written in the query."""
    text = c._jc.toString() if hasattr(c, "_jc") else str(c)
    digits = "".join(ch for ch in text.replace("CAST(", "").split(" ")[0] if ch.isdigit() or ch == "-")
    return int(digits)


def window(name: str, c: list[Column], opts: dict) -> Column:
    if name in WINDOWS:
        return WINDOWS[name](c)
    if name in ("lag", "lead"):
        f = F.lag if name == "lag" else F.lead
        return f(c[0], constant(c[1]) if len(c) > 1 else 1) if len(c) < 3 else F.coalesce(f(c[0], constant(c[1])), c[2])
    if name == "ntile":
        return F.ntile(constant(c[0]))
    if name == "nth_value":
        return F.nth_value(c[0], constant(c[1]))
    if name in AGGREGATES:
        return aggregate(name, c, opts)
    raise ValueError(f"window function {name} does not exist")


def excluding(name: str, c: list[Column], w, peers, what: str) -> Column:
    """count, sum or avg over a frame (which holds the current row and its peers) without the current row, its group, or the group but itself."""
    value = c[0] if c else F.lit(1)
    own_n, own = F.when(value.isNotNull(), 1).otherwise(0), F.coalesce(value, F.lit(0))
    less_n = own_n if what == "current" else F.count(value).over(peers) - (own_n if what == "ties" else 0)
    less = own if what == "current" else F.coalesce(F.sum(value).over(peers), F.lit(0)) - (own if what == "ties" else 0)
    n, total = F.count(value).over(w) - less_n, F.sum(value).over(w) - less
    return n if name == "count" else F.when(n > 0, total if name == "sum" else total / n)


def excluding_rows(name: str, c: list[Column], w, row: Column, group: Column, what: str) -> Column:
    """Other aggregates, and frames by rows: the frame's rows as a list of (row, group, value), less those that are excluded."""
    value = c[0] if c else F.lit(1)
    frame = F.collect_list(F.struct(row.alias("row"), group.alias("group"), value.alias("value"))).over(w)
    kept = {"current": lambda x: x["row"] != row, "group": lambda x: x["group"] != group, "ties": lambda x: (x["group"] != group) | (x["row"] == row)}[what]
    found = F.filter(F.transform(F.filter(frame, kept), lambda x: x["value"]), lambda v: v.isNotNull())
    if name in ("collect", "array_agg"):
        return found
    if name == "count":
        return F.size(found).cast("bigint")
    if name in ("min", "max"):
        return F.array_min(found) if name == "min" else F.array_max(found)
    if name in ("sum", "avg"):
        total = F.aggregate(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), F.get(found, F.lit(0)), lambda a, v: a + v)
        return F.when(F.size(found) > 0, total if name == "sum" else total / F.size(found))
    if name in ("first_value", "last_value"):
        return F.get(found, F.lit(0)) if name == "first_value" else F.try_element_at(found, F.lit(-1))
    raise ValueError(f"EXCLUDE is not supported for {name}")
