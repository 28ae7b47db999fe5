"""Dates, times and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400_000_000


def micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def literal(x: Column) -> str:
    """A text written in the query."""
    return x._jc.toString() if hasattr(x, "_jc") else str(x)


#: Forms of dates and times besides the standard one.
FORMS = ("EEE MMM d HH:mm:ss[.SSS][.SS] yyyy[X]", "EEE MMM d yyyy", "MM/dd/yyyy HH:mm:ss[.SSS][.SS][X]", "MM/dd/yyyy")


def parse(x: Column, kind: str) -> Column:
    """From text in the standard form or one of FORMS; anything else is an error."""
    plain = F.regexp_replace(F.trim(x), r"^[A-Za-z]{3} (?=[A-Za-z]{3} )", "")
    forms = [F.try_to_timestamp(plain, F.lit(f.removeprefix("EEE "))) for f in FORMS]
    return F.when(F.rlike(x, F.lit(r"^\s*\d{4}-")) | x.isNull(), x.cast(kind)).otherwise(F.coalesce(*forms, x.cast("timestamp")).cast(kind))


def interval(x: Column, kind: T.DataType) -> Column:
    """From text such as "3 days 2 hours"; "ago" at the end turns it round."""
    if not isinstance(kind, T.StringType):
        return x.cast("interval")
    t = F.lower(F.trim(x))
    for short, whole in (("mons?", "months"), ("yrs?", "years"), ("hrs?", "hours"), ("mins?", "minutes"), ("secs?", "seconds")):
        t = F.regexp_replace(t, rf"(?<=\d) *{short}\b", f" {whole}")
    back = F.regexp_replace(F.regexp_replace(t, r"\s*ago$", ""), r"(?<![\d.-])(\d)", "-$1")
    return F.when(t.endswith("ago"), back.cast("interval")).otherwise(t.cast("interval"))


def extract(c, type_of) -> Column:
    """A field of a date or timestamp; the field may be a text column's constant."""
    field, x = literal(c[0]).strip("'\"").lower(), c[1]
    composed = {
        "epoch": lambda: micros(x) / 1_000_000.0,
        "century": lambda: F.ceil(F.year(x) / 100.0), "millennium": lambda: F.ceil(F.year(x) / 1000.0), "decade": lambda: F.floor(F.year(x) / 10.0),
        "dow": lambda: F.dayofweek(x) - 1, "isodow": lambda: F.weekday(x) + 1, "doy": lambda: F.dayofyear(x), "isoyear": lambda: F.date_part(F.lit("yearofweek"), x),
        "milliseconds": lambda: F.date_part(F.lit("seconds"), x) * 1000, "microseconds": lambda: F.date_part(F.lit("seconds"), x) * 1_000_000,
    }
    return (composed[field]() if field in composed else F.date_part(F.lit(field), x)).cast("double")


def date_bin(c, type_of) -> Column:
    """The start of the stride that holds a timestamp, counted from an origin."""
    stride = interval_micros(c[0], type_of(c[0]))
    at, origin = micros(c[1]), micros(c[2])
    return F.timestamp_micros(origin + F.floor((at - origin) / stride) * stride).cast(type_of(c[1]))


def interval_micros(x: Column, kind: T.DataType) -> Column:
    """Length of an interval without months."""
    if isinstance(kind, T.StringType):
        x = x.cast("interval")
    zero = F.lit("2000-01-01 00:00:00").cast("timestamp")
    return F.unix_micros(zero + x) - F.unix_micros(zero)


def date_trunc(c, type_of) -> Column:
    kind = type_of(c[1])
    if len(c) == 3:
        return F.to_utc_timestamp(F.date_trunc(literal(c[0]).strip("'\""), F.from_utc_timestamp(c[1], c[2])), c[2])
    out = F.date_trunc(literal(c[0]).strip("'\""), c[1])
    return out.cast(kind) if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) else out


def overlaps(c, type_of) -> Column:
    s1, e1, s2, e2 = F.least(c[0], c[1]), F.greatest(c[0], c[1]), F.least(c[2], c[3]), F.greatest(c[2], c[3])
    return ((s1 < e2) & (s2 < e1)) | (s1 == s2)


def age(c, type_of) -> Column:
    """Years, months, days and microseconds between two times, as a struct."""
    a, b = (c[0], c[1]) if len(c) == 2 else (F.current_date(), c[0])
    a, b = a.cast("timestamp"), b.cast("timestamp")
    months = F.floor(F.abs(F.months_between(a, b, roundOff=False)) + F.lit(1e-9)).cast("int")
    sign = F.when(a < b, -1).otherwise(1)
    late, early = F.greatest(a, b), F.least(a, b)
    rest = F.unix_micros(late) - F.unix_micros(early + F.make_interval(months=months))
    return F.struct((sign * months).alias("months"), (sign * F.floor(rest / DAY)).cast("int").alias("days"), (sign * (rest % DAY)).alias("micros"))


def parts(x: Column, kind: T.DataType) -> Column:
    """months, days, micros of an interval given as text or struct."""
    if isinstance(kind, T.StructType):
        return x
    iv = x.cast("interval") if isinstance(kind, T.StringType) else x
    get = lambda f: F.date_part(F.lit(f), iv)
    seconds = get("seconds").cast("decimal(20,6)") * 1_000_000
    return F.struct((get("years") * 12 + get("months")).cast("int").alias("months"), get("days").cast("int").alias("days"), (get("hours").cast("bigint") * 3_600_000_000 + get("minutes").cast("bigint") * 60_000_000 + seconds.cast("bigint")).alias("micros"))


def _justify(days: bool, hours: bool):
    def f(c, type_of) -> Column:
        p = parts(c[0], type_of(c[0]))
        m, d, u = p.getField("months"), p.getField("days"), p.getField("micros")
        if hours:
            more = (u / DAY).cast("bigint")
            d, u = (d + more).cast("int"), u - more * DAY
        if days:
            more = (d / 30).cast("int")
            m, d = m + more, d - more * 30
        return F.struct(m.alias("months"), d.alias("days"), u.alias("micros"))

    return f


def make_timestamp(c, type_of, zoned: bool = False) -> Column:
    v = [x.cast("int") for x in c[:5]]
    if not zoned:
        return F.make_timestamp_ntz(*v, c[5].cast("decimal(16,6)"))
    return F.make_timestamp_ltz(*v, c[5].cast("decimal(16,6)"), *c[6:7])


FUNCTIONS = {
    "extract": extract, "date_part": extract, "date_bin": date_bin, "date_trunc": date_trunc, "overlaps": overlaps, "age": age,
    "isfinite": lambda c, t: c[0].isNotNull(), "justify_hours": _justify(False, True), "justify_days": _justify(True, False), "justify_interval": _justify(True, True),
    "make_date": lambda c, t: F.make_date(*[x.cast("int") for x in c]), "make_timestamp": make_timestamp, "make_timestamptz": lambda c, t: make_timestamp(c, t, True),
    "make_time": lambda c, t: F.concat_ws(":", *[F.lpad(x.cast("int").cast("string"), 2, "0") for x in c[:2]], F.format_string("%09.6f", c[2].cast("double"))),
}
PREFIX: dict = {}
CASTS = {"interval": interval, "time": lambda x, k: F.date_format(x.cast("timestamp"), "HH:mm:ss.SSSSSS"), "timetz": lambda x, k: F.date_format(x.cast("timestamp"), "HH:mm:ss.SSSSSSxxx")}


def operator(op, a, b, ta, tb):
    if isinstance(ta, T.StringType) and isinstance(tb, T.CalendarIntervalType) and op in ("+", "-"):
        # A time of day is a text; it wraps at midnight.
        at = F.concat(F.lit("2000-01-02 "), a).cast("timestamp")
        return F.date_format(at + b if op == "+" else at - b, "HH:mm:ss.SSSSSS")
    return None
