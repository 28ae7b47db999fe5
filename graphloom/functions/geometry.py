"""Plane and space geometry.

Points are structs (x, y), boxes (x1, y1, x2, y2) with the upper corner first, circles (x, y, r), segments and paths and polygons
arrays of points. Geometries read from text such as LINESTRING(0 0, 1 2) are structs kind, points with x, y, z, m. Functions are
expressions over these, so they run in generated code and their bounding-box tests can be pushed down as plain comparisons.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
POINT, BOX, CIRCLE = ("x", "y"), ("x1", "y1", "x2", "y2"), ("x", "y", "r")
GEOMETRY = ("kind", "points")
XYZM = "struct<x:double,y:double,z:double,m:double>"


def shaped(t: T.DataType, names: tuple) -> bool:
    return isinstance(t, T.StructType) and tuple(t.names) == names


def is_geometry(t: T.DataType) -> bool:
    return shaped(t, GEOMETRY)


def is_points(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) and shaped(t.elementType, POINT)


def numbers(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(f"({NUMBER})"), F.lit(1)), lambda v: v.cast("double"))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _parse(names: tuple):
    def f(x: Column, kind: T.DataType) -> Column:
        if not isinstance(kind, T.StringType):
            return x
        n = numbers(x)
        if names == BOX:
            a, b, c, d = (F.get(n, i) for i in range(4))
            return F.struct(F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"), F.least(a, c).alias("x2"), F.least(b, d).alias("y2"))
        return F.struct(*[F.get(n, i).alias(a) for i, a in enumerate(names)])

    return f


def _points(x: Column, kind: T.DataType) -> Column:
    if not isinstance(kind, T.StringType):
        return x
    n = numbers(x)
    return F.transform(F.sequence(F.lit(0), (F.size(n) / 2).cast("int") - 1), lambda i: point(F.get(n, 2 * i), F.get(n, 2 * i + 1)))


def parse_geometry(x: Column, kind: T.DataType) -> Column:
    """From text: a kind, and coordinates of two to four numbers each (M after the kind makes the third one m)."""
    if not isinstance(kind, T.StringType):
        return x
    name = F.upper(F.regexp_extract(x, r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1))
    # A name like POINTM or POINT M.
    only_m = F.rlike(F.upper(x), F.lit(r"^\s*(SRID=\d+;)?\s*[A-Z]+\s*M\s*\(|^\s*(SRID=\d+;)?\s*(POINT|LINESTRING|POLYGON|MULTIPOINT)M"))
    name = F.regexp_replace(name, r"(?<=T|G|N)(ZM|Z|M)$", "")
    body = F.regexp_extract(x, r"\((.*)\)", 1)
    pts = F.transform(F.split(F.regexp_replace(body, r"[()]", ""), ","), lambda t: numbers(t))
    made = F.transform(pts, lambda n: F.struct(F.get(n, 0).alias("x"), F.get(n, 1).alias("y"), F.when(~only_m, F.get(n, 2)).alias("z"), F.when(only_m, F.get(n, 2)).otherwise(F.get(n, 3)).alias("m")))
    return F.struct(name.alias("kind"), made.alias("points"))


def _pts(g: Column, t: T.DataType | None = None) -> Column:
    return g.getField("points")


def _first(g: Column, f: str) -> Column:
    return F.get(_pts(g), 0).getField(f)


def bound(f: str, most: bool):
    agg = F.array_max if most else F.array_min
    return lambda c, t: agg(F.transform(as_points(c[0], t(c[0])), lambda p: p.getField(f)))


def as_points(x: Column, t: T.DataType) -> Column:
    """Corner or vertex points of any shape."""
    if is_geometry(t):
        return _pts(x)
    if shaped(t, BOX):
        return F.array(point(x.getField("x1"), x.getField("y1")), point(x.getField("x2"), x.getField("y2")))
    if shaped(t, CIRCLE):
        r = x.getField("r")
        return F.array(point(x.getField("x") - r, x.getField("y") - r), point(x.getField("x") + r, x.getField("y") + r))
    return F.array(x) if shaped(t, POINT) else x


def bbox(x: Column, t: T.DataType) -> dict[str, Column]:
    p = as_points(x, t)
    get = lambda f, agg: agg(F.transform(p, lambda q: q.getField(f)))
    return {"xmin": get("x", F.array_min), "xmax": get("x", F.array_max), "ymin": get("y", F.array_min), "ymax": get("y", F.array_max)}


def _length(points: Column, dims: tuple = ("x", "y")) -> Column:
    """Sum of the distances of neighbours."""
    pairs = F.sequence(F.lit(1), F.size(points) - 1)
    step = lambda i: F.sqrt(sum(((F.coalesce(F.get(points, i).getField(d), F.lit(0.0)) - F.coalesce(F.get(points, i - 1).getField(d), F.lit(0.0))) ** 2 for d in dims), F.lit(0.0)))
    return F.when(F.size(points) > 1, F.aggregate(F.transform(pairs, step), F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)


def _area2(points: Column) -> Column:
    """Twice the signed area: positive counter-clockwise."""
    n = F.size(points)
    at = lambda i: F.get(points, i % n)
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i).getField("x") * at(i + 1).getField("y") - at(i + 1).getField("x") * at(i).getField("y")), F.lit(0.0), lambda s, v: s + v)


def moved(g: Column, f) -> Column:
    """The geometry with each point changed; f gives x, y, z of a point."""
    def one(p):
        x, y, z = f(p)
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), p.getField("m").alias("m"))

    return F.struct(g.getField("kind").alias("kind"), F.transform(_pts(g), one).alias("points"))


def _z(p: Column) -> Column:
    return p.getField("z")


def affine(c, t) -> Column:
    g, v = c[0], [x.cast("double") for x in c[1:]]
    if len(v) == 6:
        a, b, d, e, xo, yo = v
        return moved(g, lambda p: (a * p.x + b * p.y + xo, d * p.x + e * p.y + yo, _z(p)))
    a, b, cc, d, e, f, gg, h, i, xo, yo, zo = v
    return moved(g, lambda p: (a * p.x + b * p.y + cc * _z(p) + xo, d * p.x + e * p.y + f * _z(p) + yo, gg * p.x + h * p.y + i * _z(p) + zo))


def rotate(axis: str):
    def f(c, t) -> Column:
        g, w = c[0], c[1].cast("double")
        cos, sin = F.cos(w), F.sin(w)
        ox, oy = (c[2].cast("double"), c[3].cast("double")) if len(c) == 4 else (_first(c[2], "x"), _first(c[2], "y")) if len(c) == 3 else (F.lit(0.0), F.lit(0.0))
        turn = {
            "z": lambda p: (ox + (p.x - ox) * cos - (p.y - oy) * sin, oy + (p.x - ox) * sin + (p.y - oy) * cos, _z(p)),
            "x": lambda p: (p.x, p.y * cos - _z(p) * sin, p.y * sin + _z(p) * cos),
            "y": lambda p: (p.x * cos + _z(p) * sin, p.y, -p.x * sin + _z(p) * cos),
        }
        return moved(g, turn[axis])

    return f


def translate(c, t) -> Column:
    d = [x.cast("double") for x in c[1:]]
    return moved(c[0], lambda p: (p.x + d[0], p.y + d[1], _z(p) + d[2] if len(d) > 2 else _z(p)))


def scale(c, t) -> Column:
    d = [x.cast("double") for x in c[1:]] if len(c) > 2 else [_first(c[1], "x"), _first(c[1], "y"), F.coalesce(_first(c[1], "z"), F.lit(1.0))]
    return moved(c[0], lambda p: (p.x * d[0], p.y * d[1], _z(p) * d[2] if len(d) > 2 else _z(p)))


def snap(c, t) -> Column:
    d = [x.cast("double") for x in c[1:]]
    ox, oy, sx, sy = (0.0, 0.0, d[0], d[0]) if len(d) == 1 else (0.0, 0.0, d[0], d[1]) if len(d) == 2 else d[:4]
    ox, oy = (F.lit(o) if isinstance(o, float) else o for o in (ox, oy))
    r = lambda v, o, s: F.when(s == 0, v).otherwise(o + F.bround((v - o) / s) * s)
    return moved(c[0], lambda p: (r(p.x, ox, sx), r(p.y, oy, sy), _z(p)))


def force(dims: str):
    def f(c, t) -> Column:
        fill = [x.cast("double") for x in c[1:]] + [F.lit(0.0), F.lit(0.0)]
        null = F.lit(None).cast("double")
        z = lambda p: F.coalesce(_z(p), fill[0]) if "z" in dims else null
        m = lambda p: F.coalesce(p.getField("m"), fill[1 if "z" in dims else 0]) if "m" in dims else null
        return F.struct(c[0].getField("kind").alias("kind"), F.transform(_pts(c[0]), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), z(p).alias("z"), m(p).alias("m"))).alias("points"))

    return f


def make_point(c, t, measured: bool = False) -> Column:
    v = [x.cast("double") for x in c] + [F.lit(None).cast("double")] * 2
    z, m = (F.lit(None).cast("double"), v[2]) if measured else (v[2], v[3])
    return F.struct(F.lit("POINT").alias("kind"), F.array(F.struct(v[0].alias("x"), v[1].alias("y"), z.alias("z"), m.alias("m"))).alias("points"))


def ewkt(c, t) -> Column:
    num = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    one = lambda p: F.concat_ws(" ", num(p.x), num(p.y), num(_z(p)), num(p.getField("m")))
    body = F.array_join(F.transform(_pts(c[0]), one), ",")
    only_m = _first(c[0], "z").isNull() & _first(c[0], "m").isNotNull()
    kind = c[0].getField("kind")
    return F.concat(kind, F.when(only_m, "M").otherwise(""), F.when(kind == "POLYGON", "((").otherwise("("), body, F.when(kind == "POLYGON", "))").otherwise(")"))


def azimuth(c, t) -> Column:
    dx, dy = _first(c[1], "x") - _first(c[0], "x"), _first(c[1], "y") - _first(c[0], "y")
    a = F.atan2(dx, dy)
    return F.when((dx == 0) & (dy == 0), None).otherwise(F.when(a < 0, a + 2 * math.pi).otherwise(a))


def _batch(kind: str, f, geometries: int, extra: int = 0):
    """f over lists of (x, y, z, m) of the geometries and further numbers, in Arrow batches."""

    def build(c, t) -> Column:
        n = min(len(c), geometries + extra)

        @F.pandas_udf(kind)
        def run(*cols: pd.Series) -> pd.Series:
            out = []
            for row in zip(*cols, strict=True):
                if any(v is None for v in row):
                    out.append(None)
                    continue
                shapes = [[(p["x"], p["y"], p["z"], p["m"]) for p in g] for g in row[:geometries]]
                out.append(f(*shapes, *[float(v) for v in row[geometries:]]))
            return pd.Series(out)

        return run(*[_pts(x) for x in c[:geometries]], *c[geometries:n])

    return build


def hull(points):
    """Andrew's monotone chain, counter-clockwise and closed."""
    p = sorted({(a[0], a[1]) for a in points})
    if len(p) < 3:
        return p

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = half(p) + half(reversed(p))
    return [*ring, ring[0]]


def simplify(points, tolerance):
    """Keeps the ends and, again and again, the point farthest from its chord."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        best, at = 0.0, None
        (ax, ay), (bx, by) = points[a][:2], points[b][:2]
        n = math.hypot(bx - ax, by - ay)
        for i in range(a + 1, b):
            x, y = points[i][:2]
            d = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / n if n else math.hypot(x - ax, y - ay)
            if d > best:
                best, at = d, i
        if at is not None and best > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def _dist(p, q):
    return math.hypot(p[0] - q[0], p[1] - q[1])


def hausdorff(a, b):
    return max(max(min(_dist(p, q) for q in b) for p in a), max(min(_dist(p, q) for q in a) for p in b))


def frechet(a, b):
    """The discrete coupling distance, row by row."""
    row: list[float] = []
    for i, p in enumerate(a):
        new: list[float] = []
        for j, q in enumerate(b):
            d = _dist(p, q)
            if i and j:
                d = max(d, min(row[j], row[j - 1], new[j - 1]))
            elif i or j:
                d = max(d, row[j] if i else new[j - 1])
            new.append(d)
        row = new
    return row[-1]


def spheroid_distance(a, b, major=6378137.0, flat=1 / 298.257223563):
    """Inverse geodesic on an ellipsoid, by iteration; degrees in, metres out."""
    (l1, p1), (l2, p2) = (tuple(map(math.radians, q[0][:2])) for q in (a, b))
    minor, diff = major * (1 - flat), l2 - l1
    u1, u2 = (math.atan((1 - flat) * math.tan(p)) for p in (p1, p2))
    lam = diff
    for _ in range(200):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma, alpha = math.atan2(s, c), math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        cos2 = 1 - alpha**2
        mid = c - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        k = flat / 16 * cos2 * (4 + flat * (4 - 3 * cos2))
        before, lam = lam, diff + (1 - k) * flat * alpha * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
        if abs(lam - before) < 1e-12:
            break
    v = cos2 * (major**2 - minor**2) / minor**2
    big = 1 + v / 16384 * (4096 + v * (v * (320 - 175 * v) - 768))
    small = v / 1024 * (256 + v * (v * (74 - 47 * v) - 128))
    fix = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
    return minor * big * (sigma - fix)


def clip(subject, window):
    """Points of the intersection of a polygon with a convex one, edge by edge."""
    out = [p[:2] for p in subject[:-1]]
    ring = [p[:2] for p in window[:-1]]
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) < 0:
        ring.reverse()
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                w = sp / (sp - sq)
                out.append((p[0] + w * (q[0] - p[0]), p[1] + w * (q[1] - p[1])))
    return [*out, out[0]] if out else []


def _half(ring, a, b, inside: bool):
    """The part of a convex ring on one side of the line from a to b."""
    side = lambda p: ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) * (1 if inside else -1)
    out = []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        sp, sq = side(p), side(q)
        if sp >= 0:
            out.append(p)
        if sp * sq < 0:
            w = sp / (sp - sq)
            out.append((p[0] + w * (q[0] - p[0]), p[1] + w * (q[1] - p[1])))
    return out if len(out) > 2 else []


def _minus(a, b):
    """Convex pieces of convex ring a outside convex ring b: one for each edge of b."""
    rest, pieces = a, []
    for p, q in zip(b, b[1:] + b[:1], strict=True):
        if not rest:
            break
        if outside := _half(rest, p, q, False):
            pieces.append(outside)
        rest = _half(rest, p, q, True)
    return pieces


def symmetric_difference(a, b):
    """Of two convex polygons: closed rings of convex pieces, one after the other."""
    rings = []
    for g in (a, b):
        r = [p[:2] for p in g[:-1]]
        rings.append(r if sum(x[0] * y[1] - y[0] * x[1] for x, y in zip(r, r[1:] + r[:1], strict=True)) > 0 else r[::-1])
    return [p for piece in _minus(*rings) + _minus(*rings[::-1]) for p in [*piece, piece[0]]]


def scatter(polygon, n, seed=0):
    """n points inside a polygon, by trial within its bounding box."""
    rng, ring = random.Random(int(seed)), [p[:2] for p in polygon]
    (x1, x2), (y1, y2) = ((min(v), max(v)) for v in zip(*ring, strict=True))
    out = []
    while len(out) < int(n) and x1 < x2 and y1 < y2:
        x, y = rng.uniform(x1, x2), rng.uniform(y1, y2)
        crossings = sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:], strict=False))
        if crossings % 2:
            out.append((x, y))
    return out


def spheroid(x: Column, kind: T.DataType) -> Column:
    """From text such as SPHEROID["name",major axis,inverse flattening]."""
    n = numbers(F.regexp_extract(x, r'",(.*)', 1))
    return F.struct(F.regexp_extract(x, r'"([^"]*)"', 1).alias("name"), F.get(n, 0).alias("major"), F.get(n, 1).alias("inverse"))


def on_spheroid(f, geometries: int):
    """A measure that may be given a spheroid as its last argument."""
    plain = _batch("double", f, geometries, 2)

    def build(c, t):
        more = [c[geometries].getField("major"), F.lit(1.0) / c[geometries].getField("inverse")] if len(c) > geometries else []
        return plain([*c[:geometries], *more], t)

    return build


def _approach(a, b):
    """Time and distance of the closest approach of two moving points (m is time)."""
    times = sorted({p[3] for p in a} | {p[3] for p in b})
    lo, hi = max(a[0][3], b[0][3]), min(a[-1][3], b[-1][3])
    times = [t for t in times if lo <= t <= hi]
    if not times:
        return None

    def at(path, t):
        for p, q in zip(path, path[1:], strict=False):
            if p[3] <= t <= q[3]:
                w = (t - p[3]) / (q[3] - p[3])
                return p[0] + w * (q[0] - p[0]), p[1] + w * (q[1] - p[1])
        return path[-1][:2]

    best = min((_dist(at(a, t), at(b, t)), t) for t in times)
    for s, e in zip(times, times[1:], strict=False):
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = at(a, s), at(b, s), at(a, e), at(b, e)
        px, py, vx, vy = bx - ax, by - ay, (dx - cx) - (bx - ax), (dy - cy) - (by - ay)
        vv = vx * vx + vy * vy
        w = min(1.0, max(0.0, -(px * vx + py * vy) / vv)) if vv else 0.0
        best = min(best, (math.hypot(px + w * vx, py + w * vy), s + w * (e - s)))
    return best


SHAPE = f"array<{XYZM}>"


def _shape(kind: str, f, geometries: int = 1, extra: int = 0):
    inner = _batch(SHAPE, lambda *a: [{"x": p[0], "y": p[1], "z": p[2] if len(p) > 2 else None, "m": p[3] if len(p) > 3 else None} for p in f(*a)], geometries, extra)
    return lambda c, t: F.struct((c[0].getField("kind") if kind == "same" else F.lit(kind)).alias("kind"), inner(c, t).alias("points"))


def _plane_distance(a: Column, b: Column) -> Column:
    return F.sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)


def center(x: Column, t: T.DataType) -> Column:
    if shaped(t, CIRCLE):
        return point(x.getField("x"), x.getField("y"))
    b = bbox(x, t)
    return point((b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2)


def crossing(a: Column, b: Column) -> Column:
    """Where two segments meet, or null."""
    p, q, r, s = F.get(a, 0), F.get(a, 1), F.get(b, 0), F.get(b, 1)
    d = (q.x - p.x) * (s.y - r.y) - (q.y - p.y) * (s.x - r.x)
    safe = F.when(d == 0, 1.0).otherwise(d)
    w = ((r.x - p.x) * (s.y - r.y) - (r.y - p.y) * (s.x - r.x)) / safe
    v = ((r.x - p.x) * (q.y - p.y) - (r.y - p.y) * (q.x - p.x)) / safe
    return F.when((d != 0) & w.between(0, 1) & v.between(0, 1), point(p.x + w * (q.x - p.x), p.y + w * (q.y - p.y)))


def nearest(a: Column, b: Column) -> Column:
    """The point of segment b that is nearest to point a."""
    p, q = F.get(b, 0), F.get(b, 1)
    n = (q.x - p.x) ** 2 + (q.y - p.y) ** 2
    w = F.greatest(F.least(((a.x - p.x) * (q.x - p.x) + (a.y - p.y) * (q.y - p.y)) / F.when(n == 0, 1.0).otherwise(n), F.lit(1.0)), F.lit(0.0))
    return point(p.x + w * (q.x - p.x), p.y + w * (q.y - p.y))


def _slope(s: Column) -> tuple[Column, Column]:
    return F.get(s, 1).x - F.get(s, 0).x, F.get(s, 1).y - F.get(s, 0).y


FUNCTIONS = {
    "st_x": lambda c, t: _first(c[0], "x"), "st_y": lambda c, t: _first(c[0], "y"), "st_z": lambda c, t: _first(c[0], "z"), "st_m": lambda c, t: _first(c[0], "m"),
    "x": lambda c, t: _first(c[0], "x"), "y": lambda c, t: _first(c[0], "y"), "z": lambda c, t: _first(c[0], "z"), "m": lambda c, t: _first(c[0], "m"),
    "st_xmin": bound("x", False), "st_xmax": bound("x", True), "st_ymin": bound("y", False), "st_ymax": bound("y", True), "st_zmin": bound("z", False), "st_zmax": bound("z", True),
    "st_makepoint": make_point, "st_makepointm": lambda c, t: make_point(c, t, True), "st_asewkt": ewkt, "asewkt": ewkt,
    "st_length": lambda c, t: _length(_pts(c[0])), "st_length2d": lambda c, t: _length(_pts(c[0])), "st_3dlength": lambda c, t: _length(_pts(c[0]), ("x", "y", "z")),
    "st_ispolygoncw": lambda c, t: _area2(_pts(c[0])) < 0, "st_ispolygonccw": lambda c, t: _area2(_pts(c[0])) > 0, "st_azimuth": azimuth,
    "st_affine": affine, "st_rotate": rotate("z"), "st_rotatez": rotate("z"), "st_rotatex": rotate("x"), "st_rotatey": rotate("y"), "st_translate": translate, "st_scale": scale, "st_snaptogrid": snap,
    "st_force2d": force(""), "st_force3dz": force("z"), "st_force3dm": force("m"), "st_force4d": force("zm"),
    "st_forcecollection": lambda c, t: F.struct(F.lit("GEOMETRYCOLLECTION").alias("kind"), _pts(c[0]).alias("points")),
    "st_multi": lambda c, t: F.struct(F.when(F.startswith(c[0].getField("kind"), F.lit("MULTI")), c[0].getField("kind")).otherwise(F.concat(F.lit("MULTI"), c[0].getField("kind"))).alias("kind"), _pts(c[0]).alias("points")),
    **dict.fromkeys(("addbbox", "postgis_addbbox", "dropbbox", "postgis_dropbbox"), lambda c, t: c[0]),
    "st_convexhull": _shape("POLYGON", hull), "st_simplify": _shape("same", lambda p, d: simplify(p, d), 1, 1), "st_intersection": _shape("POLYGON", clip, 2),
    "st_hausdorffdistance": _batch("double", hausdorff, 2), "st_frechetdistance": _batch("double", frechet, 2), "st_distancespheroid": on_spheroid(spheroid_distance, 2),
    "st_lengthspheroid": on_spheroid(lambda p, *s: sum(spheroid_distance([a], [b], *s) for a, b in zip(p, p[1:], strict=False)), 1),
    "st_symdifference": _shape("MULTIPOLYGON", symmetric_difference, 2), "st_generatepoints": _shape("MULTIPOINT", scatter, 1, 2),
    "st_closestpointofapproach": _batch("double", lambda a, b: (_approach(a, b) or (None, None))[1], 2), "st_distancecpa": _batch("double", lambda a, b: (_approach(a, b) or (None,))[0], 2),
    "st_cpawithin": _batch("boolean", lambda a, b, d: (r := _approach(a, b)) is not None and r[0] <= d, 2, 1), "st_isvalidtrajectory": _batch("boolean", lambda p: all(a[3] < b[3] for a, b in zip(p, p[1:], strict=False)), 1),
    "height": lambda c, t: c[0].getField("y1") - c[0].getField("y2"), "width": lambda c, t: c[0].getField("x1") - c[0].getField("x2"),
    "bound_box": lambda c, t: F.struct(F.greatest(c[0].x1, c[1].x1).alias("x1"), F.greatest(c[0].y1, c[1].y1).alias("y1"), F.least(c[0].x2, c[1].x2).alias("x2"), F.least(c[0].y2, c[1].y2).alias("y2")),
    "center": lambda c, t: center(c[0], t(c[0])), "intersection_point": lambda c, t: crossing(c[0], c[1]), "box": lambda c, t: _parse(BOX)(c[0], t(c[0])), "point": lambda c, t: point(*c) if len(c) == 2 else center(c[0], t(c[0])),
}
PREFIX = {
    "@@": lambda x, t: center(x, t(x)), "@-@": lambda x, t: _length(x) if is_points(t(x)) else F.size(x.getField("edges")).cast("bigint"),
    "?|": lambda x, t: _slope(x)[0] == 0, "?-": lambda x, t: _slope(x)[1] == 0,
}
CASTS = {"point": _parse(POINT), "box": _parse(BOX), "box2d": _parse(BOX), "circle": _parse(CIRCLE), "lseg": _points, "path": _points, "polygon": _points, "line": lambda x, k: numbers(x), "geometry": parse_geometry, "box3d": lambda x, k: numbers(x), "spheroid": spheroid}
#: Comparisons of bounding boxes a and b.
BOXES = {
    "&&": lambda a, b: (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"]),
    "~": lambda a, b: (a["xmin"] <= b["xmin"]) & (a["xmax"] >= b["xmax"]) & (a["ymin"] <= b["ymin"]) & (a["ymax"] >= b["ymax"]),
    "~=": lambda a, b: (a["xmin"] == b["xmin"]) & (a["xmax"] == b["xmax"]) & (a["ymin"] == b["ymin"]) & (a["ymax"] == b["ymax"]),
    "<<": lambda a, b: a["xmax"] < b["xmin"], ">>": lambda a, b: a["xmin"] > b["xmax"], "&<": lambda a, b: a["xmax"] <= b["xmax"], "&>": lambda a, b: a["xmin"] >= b["xmin"],
    "<<|": lambda a, b: a["ymax"] < b["ymin"], "|>>": lambda a, b: a["ymin"] > b["ymax"], "&<|": lambda a, b: a["ymax"] <= b["ymax"], "|&>": lambda a, b: a["ymin"] >= b["ymin"],
}
BOXES["@"] = BOXES["<@"] = lambda a, b: BOXES["~"](b, a)
BOXES["@>"] = BOXES["~"]
BOXES["&&&"] = BOXES["&&"]
BOXES["~~="] = BOXES["~="]


def is_shape(t: T.DataType) -> bool:
    return is_geometry(t) or is_points(t) or any(shaped(t, n) for n in (POINT, BOX, CIRCLE))


def operator(op, a, b, ta, tb):
    if not is_shape(ta) or not is_shape(tb):
        return None
    if op == "<->":
        return _plane_distance(center(a, ta), center(b, tb))
    if shaped(tb, POINT) and op in ("+", "-", "*"):
        sign = 1 if op == "+" else -1
        if op == "*":
            return point(a.x * b.x - a.y * b.y, a.x * b.y + a.y * b.x) if shaped(ta, POINT) else None
        if shaped(ta, POINT):
            return point(a.x + sign * b.x, a.y + sign * b.y)
        if shaped(ta, CIRCLE):
            return F.struct((a.x + sign * b.x).alias("x"), (a.y + sign * b.y).alias("y"), a.r.alias("r"))
        if shaped(ta, BOX):
            return F.struct(*[(a.getField(n) + sign * b.getField(n[0])).alias(n) for n in BOX])
        return F.transform(a, lambda p: point(p.x + sign * b.x, p.y + sign * b.y))
    if shaped(ta, CIRCLE) and shaped(tb, POINT) and op in ("@>", "~"):
        return _plane_distance(a, b) <= a.r
    if shaped(ta, CIRCLE) and shaped(tb, CIRCLE) and op == "&&":
        return _plane_distance(a, b) <= a.r + b.r
    if is_points(ta) and is_points(tb):
        if op == "#":
            return crossing(a, b)
        (ax, ay), (bx, by) = _slope(a), _slope(b)
        if op == "?-|":
            return ax * bx + ay * by == 0
        if op == "?||":
            return ax * by - ay * bx == 0
        if op == "?#":
            return crossing(a, b).isNotNull()
    if op == "##" and shaped(ta, POINT) and is_points(tb):
        return nearest(a, b)
    if op in BOXES:
        return BOXES[op](bbox(a, ta), bbox(b, tb))
    return None
