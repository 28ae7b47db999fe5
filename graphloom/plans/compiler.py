"""From clauses to DataFrames.

A row holds a value variable in a column of its name and an entity variable in one column for each property, "var@property", with
"var@_id" and "var@_label". Entities become structs only where a query returns them, so Catalyst sees plain columns: it prunes
them, pushes filters on them into the scans, and picks the joins.

Patterns are equi-joins of edges and vertices on ids. Vertices that nothing constrains or reads are not joined; undirected edges
are the union of both directions, not an OR; existence tests are semi and anti joins, quantifiers aggregates of the subquery.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dynamic
from ..functions import registry as functions
from ..operators import trails
from ..sources.catalog import Graph, union_all
from . import factors
from .parser import EdgePattern, NodePattern, Path, Projection


#: Operators that read an entity's properties, and on which side.
ENTITY_OPERATORS = {"@>": (0,), "<@": (1,), "?": (0,), "?|": (0,), "?&": (0,), "->": (0,), "->>": (0,)}


class Fault(ValueError):
    """What is wrong with a statement's meaning."""


@dataclass(frozen=True)
class Var:
    kind: str  # "node", "edge", "trail", "path", "value"
    props: tuple[str, ...] = ()
    label: str | None = None
    parts: tuple[str, ...] = ()


@dataclass
class Rows:
    df: DataFrame | None
    vars: dict[str, Var]

    def columns(self, name: str) -> list[str]:
        v = self.vars[name]
        if v.kind in ("node", "edge"):
            return [f"{name}@{p}" for p in v.props]
        return [name] if v.kind != "path" else []


def walk(e):
    """All expression tuples in e, queries of subqueries not entered."""
    if isinstance(e, tuple):
        if e and isinstance(e[0], str):
            yield e
            if e[0] in ("exists",):
                return
        for x in e:
            yield from walk(x)
    elif isinstance(e, list):
        for x in e:
            yield from walk(x)
    elif isinstance(e, dict):
        for x in e.values():
            yield from walk(x)


def is_aggregate(e) -> bool:
    return any(x[0] == "call" and x[1] in functions.AGGREGATES and "over" not in x[3] for x in walk(e))


def conjuncts(e) -> list:
    return conjuncts(e[2]) + conjuncts(e[3]) if e[0] == "bin" and e[1] == "and" else [e]


def names_in(x, out: set[str] | None = None) -> set[str]:
    """Names of all variables that any part of a statement mentions in expressions."""
    out = set() if out is None else out
    if isinstance(x, tuple):
        if len(x) == 2 and x[0] == "var":
            out.add(x[1])
        for y in x:
            names_in(y, out)
    elif isinstance(x, list):
        for y in x:
            names_in(y, out)
    elif isinstance(x, dict):
        names_in(list(x.values()), out)
    elif isinstance(x, Projection):
        if "*" in x.items:
            out.add("*")
        names_in([x.items, x.where, x.group, x.having, x.windows, x.order, x.skip, x.limit], out)
    elif isinstance(x, Path):
        if x.var:
            out.update(p.var for p in x.parts if p.var)
        for p in x.parts:
            names_in(p.props, out)
    return out


class Compiler:
    def __init__(self, graph: Graph | None, params: dict | None = None, spark=None):
        self.graph, self.params, self.spark = graph, params or {}, spark
        self.fresh = (f"_{i}" for i in itertools.count())
        self.used: set[str] = set()
        self.windows: dict = {}
        self.rows: Rows | None = None
        self.later: list[tuple] = []

    # -- queries --
    def query(self, q: tuple, outer: Rows | None = None) -> Rows:
        if q[0] == "set":
            return self.set_query(q, outer)
        self.used = self.used | names_in(q[1])
        rows, done = (None if outer else factors.grouped(self, q[1])) or (outer or Rows(None, {}), 0)
        for k, c in enumerate(q[1][done:], done):
            rows = self.clause(c, rows, first=k == 0)
        return rows

    def clause(self, c: tuple, rows: Rows, first: bool) -> Rows:
        kind = c[0]
        if kind == "match":
            _, paths, where, order, optional = c
            if optional and rows.df is not None:
                return self.optional(rows, paths, where)
            for p in paths:
                rows = self.path(rows, p)
            rows = self.where(rows, where)
            return self.sort(rows, order)
        if kind in ("with", "return"):
            return self.project(rows, c[1])
        if kind == "unwind":
            return self.unwind(rows, c[1], c[2])
        if kind == "call_query":
            if rows.df is not None:
                raise Fault("CALL {} must be the first clause")
            return self.query(c[1])
        if kind == "call_fn":
            rows = self.unwind(rows, c[1], c[2], lax=True)
            return self.where(rows, c[3])
        raise Fault(f"{kind.upper().replace('_', ' ')} changes a graph: run it with Engine.update")

    def set_query(self, q: tuple, outer: Rows | None) -> Rows:
        _, kind, every, left, right = q
        a, b = self.returned(self.query(left, outer)), self.returned(self.query(right, outer))
        if len(a.columns) != len(b.columns):
            raise Fault(f"each {kind.upper()} query must have the same number of columns")
        for k, (x, y) in enumerate(zip(a.schema, b.schema, strict=True)):
            entity = [isinstance(t.dataType, T.StructType) and t.dataType.names[:2] == ["id", "label"] for t in (x, y)]
            if not any(entity) and dynamic.mixed([x.dataType, y.dataType]):
                a, b = (d.select(*[dynamic.encode(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if i == k else F.col(f"`{f.name}`") for i, f in enumerate(d.schema)]) for d in (a, b))
                continue
            if isinstance(x.dataType, T.StructType) != isinstance(y.dataType, T.StructType):
                raise Fault(f"{kind.upper()} types of column {x.name} cannot be matched")
        b = b.toDF(*a.columns)
        if kind == "union":
            df = a.unionByName(b)
            df = df if every else df.distinct()
        elif kind == "intersect":
            df = a.intersectAll(b) if every else a.intersect(b)
        else:
            df = a.exceptAll(b) if every else a.subtract(b)
        return Rows(df, {c: Var("value") for c in df.columns})

    def returned(self, rows: Rows) -> DataFrame:
        """The rows as users see them: entities as structs."""
        df = rows.df.select(*[self.entity(rows, n).alias(n) for n in rows.vars])
        # Intervals and text queries show their parts.
        odd = {f.name: functions.shown(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if functions.needs_showing(f.dataType)}
        return df.select(*[odd[c].alias(c) if c in odd else F.col(f"`{c}`") for c in df.columns]) if odd else df

    # -- patterns --
    def scan_node(self, n: NodePattern, name: str) -> Rows:
        if self.graph is None:
            raise Fault("no graph is in use")
        family = self.graph.family(n.label, "v")
        if not family:
            raise Fault(f"vertex label {n.label} does not exist")
        df = union_all([x.df.select("_id", F.lit(x.name).alias("_label"), *x.props) for x in family])
        return Rows(df.select(*[F.col(c).alias(f"{name}@{c}") for c in df.columns]), {name: Var("node", tuple(df.columns), n.label)})

    def constrain(self, rows: Rows, name: str, props) -> Rows:
        if props is None:
            return rows
        if props[0] == "param":
            props = ("map", [(k, ("lit", v)) for k, v in self.params[props[1]].items()])
        for key, value in props[1]:
            if names_in(value) - set(rows.vars):
                # It reads variables of the rows that the pattern is joined with.
                self.later.append((name, key, value))
                continue
            if value == ("lit", None):
                cond = F.lit(False)
            elif key not in rows.vars[name].props:
                cond = F.lit(False)
            else:
                held, self.rows = self.rows, rows
                cond = self.held(F.col(f"{name}@{key}"), self.expr(rows, value))
                self.rows = held
            rows = Rows(rows.df.filter(cond), rows.vars)
        return rows

    def held(self, prop: Column, value: Column) -> Column:
        """Whether a property meets a pattern's value: it is equal, or a list or map that contains the value's."""
        a, b = self.type_of(prop), self.type_of(value)
        nested = (isinstance(a, T.StructType) and isinstance(b, T.StructType) and not functions.dynamic.is_dynamic(a) and not functions.dynamic.is_dynamic(b)) or (isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType) and a.elementType == b.elementType)
        return functions.contains(prop, a, value, b) if nested else functions.binary("=", prop, value, self.type_of)

    def idle(self, n: NodePattern, implied: str | None) -> bool:
        """Whether a vertex needs no table: nothing reads it, and its label follows from the edge."""
        return n.props is None and (n.label is None or n.label == implied) and (not n.named or (n.var not in self.used and "*" not in self.used))

    def scan_edge(self, e: EdgePattern, name: str) -> tuple[DataFrame, Var, dict[str, str | None]]:
        """Columns near, far, name@...; what is known of the labels at both ends; "carried" tells which end's vertex the rows hold."""
        if self.graph is None:
            raise Fault("no graph is in use")
        family = self.graph.family(e.label, "e")
        if not family:
            raise Fault(f"edge label {e.label} does not exist")
        one = family[0] if len(family) == 1 else None
        cols = [] if one is None else [c for c in one.df.columns if c[0] == "^"]
        df = union_all([x.df.select("_id", F.lit(x.name).alias("_label"), "_start", "_end", *x.props, *cols) for x in family])
        props = tuple(c for c in df.columns if c[0] != "^")
        flat = [F.col(c).alias(f"{name}@{c}") for c in props]
        out = df.select(*flat, F.col("_start").alias("near"), F.col("_end").alias("far"), *cols)
        info = {"near": one and one.start, "far": one and one.end, "carried": one and one.carries and ("near" if one.carries == "start" else "far")}
        if e.direction == "in":
            out = df.select(*flat, F.col("_end").alias("near"), F.col("_start").alias("far"), *cols)
            info = {"near": info["far"], "far": info["near"], "carried": {"near": "far", "far": "near"}.get(info["carried"])}
        elif e.direction == "both":
            # A loop is one edge in either direction.
            back = df.where("_start <> _end").select(*flat, F.col("_end").alias("near"), F.col("_start").alias("far"), *cols)
            out = out.unionByName(back).drop(*cols)
            info = {"near": None, "far": None, "carried": None}
        return out, Var("edge", props, e.label), info

    def path(self, rows: Rows, path: Path) -> Rows:
        parts = [replace(p, var=p.var or next(self.fresh)) for p in path.parts]
        for p in parts:
            known = rows.vars.get(p.var)
            if known and isinstance(p, NodePattern) != (known.kind == "node"):
                raise Fault(f"variable {p.var} is already an {known.kind}")
            if known and p.label and known.label and p.label != known.label:
                raise Fault(f"variable {p.var} already has label {known.label}")
        bound = [i for i in range(0, len(parts), 2) if parts[i].var in rows.vars]
        start = bound[0] if bound else 0
        if not bound:
            first = parts[0]
            lone = len(parts) == 1
            fresh = None
            if not lone and not parts[1].hops:
                fresh = self.hop(Rows(None, {}), first, parts[1], parts[2], rows)
                skip = 2
            else:
                fresh, skip = self.constrain(self.scan_node(first, first.var), first.var, first.props), 0
            if rows.df is not None:
                shared = [v for v in fresh.vars if v in rows.vars]
                rows = self.joined(rows, fresh, shared)
            else:
                rows = fresh
            todo = range(skip, len(parts) - 2, 2)
        else:
            rows = self.constrain(rows, parts[start].var, parts[start].props)
            todo = range(start, len(parts) - 2, 2)
        for i in todo:
            rows = self.hop(rows, parts[i], parts[i + 1], parts[i + 2], rows)
        for i in range(start, 0, -2):
            e = parts[i - 1]
            turned = replace(e, direction={"in": "out", "out": "in"}.get(e.direction, e.direction))
            rows = self.hop(rows, parts[i], turned, parts[i - 2], rows)
        held, self.later = self.later, []
        for name, key, value in held:
            rows = self.constrain(rows, name, ("map", [(key, value)]))
        if self.later:
            raise Fault(f"variable {sorted(names_in(self.later[0][2]) - set(rows.vars))[0]} does not exist")
        rows = self.unique_edges(rows, [p.var for p in parts[1::2]])
        if path.var:
            rows = Rows(rows.df, rows.vars | {path.var: Var("path", parts=tuple(p.var for p in parts))})
        return rows

    def joined(self, left: Rows, right: Rows, shared: list[str]) -> Rows:
        keys = {f"{v}@_id": f"{v}@_other" for v in shared}
        r = right.df.select(*[F.col(c).alias(keys[c]) if c in keys else F.col(c) for c in right.df.columns if c in keys or c.split("@")[0] not in shared])
        cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(o) for k, o in keys.items()]) if keys else None
        df = (left.df.join(r, cond) if keys else left.df.crossJoin(r)).drop(*keys.values())
        return Rows(df, right.vars | left.vars)

    def hop(self, rows: Rows, near: NodePattern, e: EdgePattern, far: NodePattern, scope: Rows) -> Rows:
        """rows extended by an edge and the vertex behind it. Without rows, the edge's table starts them."""
        if e.hops:
            return self.trail(rows, near, e, far)
        if e.var in rows.vars:
            raise Fault(f"edge variable {e.var} is bound twice")
        edges, var, info = self.scan_edge(e, e.var)
        edges = self.constrain(Rows(edges, {e.var: var}), e.var, e.props).df
        edges = edges.withColumnsRenamed({"near": f"{e.var}@near", "far": f"{e.var}@far"})
        here, there = f"{e.var}@near", f"{e.var}@far"
        held = [c for c in edges.columns if c[0] == "^"]

        def unpack(df: DataFrame, n: NodePattern, end: str) -> Rows:
            props = ("_id", "_label", *[c[1:] for c in held])
            label = info["near" if end == here else "far"]
            df = df.withColumns({f"{n.var}@_id": F.col(end), f"{n.var}@_label": F.lit(label)} | {f"{n.var}@{c[1:]}": F.col(c) for c in held}).drop(*held)
            return Rows(df, {n.var: Var("node", props, label)})

        def carried(n: NodePattern, end: str) -> bool:
            return info["carried"] == end and n.label in (None, info[end]) and n.var not in rows.vars

        if rows.df is None:
            if carried(near, "near"):
                got = unpack(edges, near, here)
                out = Rows(got.df, {e.var: var} | got.vars)
                out = self.constrain(out, near.var, near.props)
                held = []
            elif self.idle(near, info["near"]):
                out = Rows(edges.withColumn(f"{near.var}@_id", F.col(here)), {e.var: var, near.var: Var("node", ("_id",), near.label)})
            else:
                n = self.constrain(self.scan_node(near, near.var), near.var, near.props)
                out = Rows(n.df.join(edges, F.col(f"{near.var}@_id") == F.col(here)), n.vars | {e.var: var})
        else:
            cond = F.col(f"{near.var}@_id") == F.col(here)
            if far.var in rows.vars:
                cond = cond & (F.col(f"{far.var}@_id") == F.col(there))
            out = Rows(rows.df.join(edges, cond), rows.vars | {e.var: var})
        if far.var in out.vars:
            if rows.df is None or far.var not in rows.vars:
                out = Rows(out.df.filter(F.col(f"{far.var}@_id") == F.col(there)), out.vars)
            out = self.constrain(out, far.var, far.props)
        elif held and carried(far, "far"):
            got = unpack(out.df, far, there)
            out = self.constrain(Rows(got.df, out.vars | got.vars), far.var, far.props)
        elif self.idle(far, info["far"]):
            out = Rows(out.df.withColumn(f"{far.var}@_id", F.col(there)), out.vars | {far.var: Var("node", ("_id",), far.label)})
        else:
            n = self.constrain(self.scan_node(far, far.var), far.var, far.props)
            out = Rows(out.df.join(n.df, F.col(there) == F.col(f"{far.var}@_id")), out.vars | n.vars)
        return Rows(out.df.drop(here, there, *[c for c in out.df.columns if c[0] == "^"]), out.vars)

    def trail(self, rows: Rows, near: NodePattern, e: EdgePattern, far: NodePattern) -> Rows:
        """A variable-length hop: trails without repeated edges from the bound vertices on, then the vertex at their ends."""
        if rows.df is None:
            rows = self.constrain(self.scan_node(near, near.var), near.var, near.props)
        one = replace(e, hops=None)
        edges, var, _ = self.scan_edge(one, "hop")
        edges = self.constrain(Rows(edges, {"hop": var}), "hop", e.props).df
        edges = edges.select("near", "far", F.col("hop@_id").alias("edge"), F.col("hop@_label").alias("label"), F.col("hop@_start").alias("start_id"), F.col("hop@_end").alias("end_id"))
        low, high = e.hops
        starts = rows.df.select(F.col(f"{near.var}@_id").alias("from")).distinct()
        found = trails.expand(starts, edges, low, high)
        found = found.select(F.col("from").alias(f"{e.var}@from"), F.col("to").alias(f"{e.var}@to"), F.col("trail").alias(e.var))
        df = rows.df.join(found, F.col(f"{near.var}@_id") == F.col(f"{e.var}@from"))
        there, vars_ = F.col(f"{e.var}@to"), rows.vars | {e.var: Var("trail")}
        if far.var in rows.vars:
            out = self.constrain(Rows(df.filter(F.col(f"{far.var}@_id") == there), vars_), far.var, far.props)
        elif self.idle(far, None):
            out = Rows(df.withColumn(f"{far.var}@_id", there), vars_ | {far.var: Var("node", ("_id",))})
        else:
            n = self.constrain(self.scan_node(far, far.var), far.var, far.props)
            out = Rows(df.join(n.df, there == F.col(f"{far.var}@_id")), vars_ | n.vars)
        return Rows(out.df.drop(f"{e.var}@from", f"{e.var}@to"), out.vars)

    def unique_edges(self, rows: Rows, names: list[str]) -> Rows:
        """No edge occurs twice in one path."""
        df = rows.df
        single = [n for n in names if rows.vars[n].kind == "edge"]
        long = [n for n in names if rows.vars[n].kind == "trail"]
        for a, b in itertools.combinations(single, 2):
            # Ids of two labels differ anyway.
            if not (rows.vars[a].label and rows.vars[b].label and rows.vars[a].label != rows.vars[b].label):
                df = df.filter(F.col(f"{a}@_id") != F.col(f"{b}@_id"))
        for t in long:
            for s in single:
                df = df.filter(~F.array_contains(F.col(f"{t}.edges.id"), F.col(f"{s}@_id")))
        for a, b in itertools.combinations(long, 2):
            df = df.filter(~F.arrays_overlap(F.col(f"{a}.edges.id"), F.col(f"{b}.edges.id")))
        return Rows(df, rows.vars)

    def optional(self, rows: Rows, paths: list[Path], where) -> Rows:
        """A left join with the pattern, which WHERE is part of."""
        right, shared = self.apart(rows, paths)
        both, other = self.beside(rows, right, shared)
        cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(o) for k, o in other.items()]) if other else F.lit(True)
        if where is not None:
            cond = cond & self.across(rows, right, both, where)
        df = rows.df.join(right.df, cond, "left").drop(*other.values())
        return Rows(df, both.vars)

    def apart(self, rows: Rows, paths: list[Path]) -> tuple[Rows, list[str]]:
        """A pattern compiled by itself, and the variables that it shares with rows (only their ids are read in it)."""
        shared = sorted({p.var for path in paths for p in path.parts if p.var in rows.vars})
        held, self.used = self.used, self.used - set(shared)
        mine = [Path(p.var, [replace(x, label=x.label or rows.vars[x.var].label) if x.var in shared and isinstance(x, NodePattern) else x for x in p.parts]) for p in paths]
        right = Rows(None, {})
        for p in mine:
            right = self.path(right, p)
        self.used = held
        return right, shared

    def beside(self, rows: Rows, right: Rows, shared: list[str]) -> tuple[Rows, dict[str, str]]:
        """Renames the shared ids on the right; variables of both sides."""
        other = {f"{v}@_id": f"{v}@_right" for v in shared}
        drop = [c for c in right.df.columns if c.split("@")[0] in shared and c not in other]
        right.df = right.df.drop(*drop).withColumnsRenamed(other)
        return Rows(None, {n: v for n, v in right.vars.items() if n not in rows.vars} | rows.vars), other

    def across(self, rows: Rows, right: Rows, both: Rows, e) -> Column:
        """An expression over columns of both sides of a join that is about to be made."""
        held, self.rows = self.rows, Rows(rows.df.crossJoin(right.df), both.vars)
        col = self.expr(self.rows, e)
        self.rows = held
        return col

    # -- filters and subqueries --
    def where(self, rows: Rows, e) -> Rows:
        if e is None:
            return rows
        for c in conjuncts(e):
            negate = c[0] == "un" and c[1] == "not"
            inner = c[2] if negate else c
            if inner[0] == "exists":
                right, cond = self.subquery(rows, inner[1])
                rows = Rows(rows.df.join(right, cond, "left_anti" if negate else "left_semi"), rows.vars)
            elif inner[0] == "in_query" and not negate:
                right, cond = self.subquery(rows, inner[2], self.expr(rows, inner[1]))
                rows = Rows(rows.df.join(right, cond, "left_semi"), rows.vars)
            elif c[0] == "quant" and c[1] == "=" and c[2] == "any":
                right, cond = self.subquery(rows, c[4], self.expr(rows, c[3]))
                rows = Rows(rows.df.join(right, cond, "left_semi"), rows.vars)
            else:
                self.rows = rows
                cond = self.expr(rows, c)
                rows = Rows(self.rows.df.filter(cond), rows.vars)
                self.rows = None
        return rows

    def subquery(self, rows: Rows, q: tuple, equal_to: Column | None = None) -> tuple[DataFrame, Column]:
        """The subquery's rows and the condition under which one belongs to an outer row: equal ids of shared variables, an inner WHERE that reads outer ones, and the value asked for."""
        clauses = q[1] if q[0] == "query" else None
        conds: list[Column] = []
        matches = [c for c in clauses or [] if c[0] == "match" and not c[4]]
        rest = [c for c in clauses or [] if c not in matches]
        if matches and all(c[0] == "return" and not is_aggregate(c[1].items) for c in rest):
            paths = [p for c in matches for p in c[1]]
            where = reduce(lambda a, b: ("bin", "and", a, b), [c[2] for c in matches if c[2] is not None]) if any(c[2] is not None for c in matches) else None
            self.used = self.used | names_in(clauses)
            right, shared = self.apart(rows, paths)
            both, other = self.beside(rows, right, shared)
            outer = {n for n in names_in(where) if n in rows.vars} if where is not None else set()
            if where is not None and not outer:
                right = self.where(right, where)
            elif where is not None:
                conds.append(self.across(rows, right, both, where))
            conds += [F.col(k) == F.col(o) for k, o in other.items()]
            if equal_to is not None:
                item = rest[0][1].items[0][0]
                conds.append(equal_to == self.across(rows, right, both, item))
            df = right.df
        else:
            got = Compiler(self.graph, self.params, self.spark).query(q)
            df = self.returned(got)
            value = f"{next(self.fresh)}@value"
            df = df.select(F.col(f"`{df.columns[0]}`").alias(value))
            if equal_to is not None:
                conds.append(equal_to == F.col(value))
        return df, reduce(lambda a, b: a & b, conds) if conds else F.lit(True)

    def flag(self, rows: Rows, q: tuple, equal_to: Column | None = None) -> Column:
        """Existence as a column: a left join with the distinct keys that have a match."""
        name = f"{next(self.fresh)}@flag"
        base = self.rows.df
        right, cond = self.subquery(rows, q, equal_to)
        inner = right.columns
        keys = [c for c in inner if c.endswith("@_right")]
        if keys and equal_to is None and not any(c[0] == "match" and c[2] is not None and names_in(c[2]) & set(rows.vars) for c in q[1]):
            right = right.select(*keys).distinct().withColumn(name, F.lit(True))
            self.rows.df = base.join(right, cond, "left").drop(*keys)
        else:
            # The condition reads more than keys: ask once for each distinct outer row.
            hit = base.join(right, cond, "left_semi").distinct().withColumn(name, F.lit(True))
            same = reduce(lambda a, b: a & b, [base[c].eqNullSafe(hit[c]) for c in base.columns])
            self.rows.df = base.join(hit, same, "left").select(*[base[c] for c in base.columns], hit[name])
        return F.coalesce(F.col(name), F.lit(False))

    def quantified(self, rows: Rows, e: tuple) -> Column:
        """x op ANY/ALL (query) from the query's least and greatest value, its count and its nulls: one row."""
        _, op, how, left, q = e
        x = self.expr(rows, left)
        df = self.returned(Compiler(self.graph, self.params, self.spark).query(q))
        v, p = F.col(f"`{df.columns[0]}`"), next(self.fresh)
        agg = df.agg(F.min(v).alias(f"{p}@lo"), F.max(v).alias(f"{p}@hi"), F.count("*").alias(f"{p}@n"), F.count_if(v.isNull()).alias(f"{p}@nulls"))
        self.rows.df = self.rows.df.crossJoin(F.broadcast(agg))
        lo, hi, n, nulls = (F.col(f"{p}@{c}") for c in ("lo", "hi", "n", "nulls"))
        if how == "any":
            sure = {"<": x < hi, "<=": x <= hi, ">": x > lo, ">=": x >= lo, "<>": (lo != hi) | (x != lo)}.get(op)
            if op == "=":
                return self.flag(rows, q, x)
            return F.when(n == 0, False).when(sure, True).when((nulls > 0) | x.isNull(), None).otherwise(False)
        if op == "<>":
            hit = self.flag(rows, q, x)
            return F.when(n == 0, True).when(hit, False).when((nulls > 0) | x.isNull(), None).otherwise(True)
        sure = {"<": x < lo, "<=": x <= lo, ">": x > hi, ">=": x >= hi, "=": (x == lo) & (x == hi)}[op]
        return F.when(n == 0, True).when(~sure, False).when((nulls > 0) | x.isNull(), None).otherwise(True)

    # -- projections --
    def unwind(self, rows: Rows, e: tuple, name: str, lax: bool = False) -> Rows:
        if name in rows.vars:
            raise Fault(f"variable {name} exists")
        base = rows.df if rows.df is not None else self.spark.range(1).select()
        self.rows = Rows(base, rows.vars)
        col = self.expr(self.rows, e)
        base = self.rows.df
        kind = self.type_of(col)
        if not isinstance(kind, T.ArrayType):
            if lax:
                return Rows(base.withColumn(name, col), rows.vars | {name: Var("value")})
            raise Fault("UNWIND needs a list")
        item = kind.elementType
        if isinstance(item, T.StructType) and item.names[:2] == ["id", "label"]:
            return self.unpacked(base.select("*", F.explode(col).alias("@entity")), rows, name, item)
        return Rows(base.select("*", F.explode(col).alias(name)), rows.vars | {name: Var("value")})

    def unpacked(self, df: DataFrame, rows: Rows, name: str, kind: T.StructType) -> Rows:
        """An entity that came out of a list is one again: its columns from the struct's fields."""
        edge = "start_id" in kind.names
        cols = {"_id": "id", "_label": "label"} | ({"_start": "start_id", "_end": "end_id"} if edge else {})
        made = {f"{name}@{c}": F.col("@entity").getField(f) for c, f in cols.items()}
        props = kind["properties"].dataType.names if "properties" in kind.names else []
        made |= {f"{name}@{p}": F.col("@entity").getField("properties").getField(p) for p in props}
        return Rows(df.withColumns(made).drop("@entity"), rows.vars | {name: Var("edge" if edge else "node", (*cols, *props))})

    def sort(self, rows: Rows, order: list) -> Rows:
        if not order:
            return rows
        return Rows(rows.df.orderBy(*[self.ordering(self.expr(rows, e), desc, nulls) for e, desc, nulls in order]), rows.vars)

    @staticmethod
    def ordering(col: Column, desc: bool, nulls: str) -> Column:
        return {(False, "last"): col.asc_nulls_last, (False, "first"): col.asc_nulls_first, (True, "first"): col.desc_nulls_first, (True, "last"): col.desc_nulls_last}[desc, nulls]()

    def project(self, rows: Rows, p: Projection) -> Rows:
        if rows.df is None:
            rows = Rows(self.spark.range(1).select(), {})
        known = set(rows.vars)
        items = []
        for it in p.items:
            items += [(("var", n), n) for n, v in rows.vars.items() if not n.startswith("_")] if it == "*" else [it]
        aliases = dict((a, e) for e, a in items)
        if p.where is not None:
            # WHERE reads the input; a name that is no variable there may be an alias.
            where = self.substitute(p.where, {a: e for a, e in aliases.items() if a not in known})
            if is_aggregate(where):
                p = replace(p, having=where if p.having is None else ("bin", "and", where, p.having))
            else:
                rows = self.where(rows, where)
        self.windows = p.windows
        self.rows = Rows(rows.df, rows.vars)
        having = self.substitute(p.having, {a: e for a, e in aliases.items() if a not in known}) if p.having is not None else None
        order = [(self.substitute(e, aliases), d, n) for e, d, n in p.order]
        grouped = p.group is not None or any(is_aggregate(e) for e, _ in items) or (having is not None and is_aggregate(having))
        out_vars: dict[str, Var] = {}
        cols: list[Column] = []
        keys: list[Column] = []
        for e, alias in items:
            if alias in out_vars:
                raise Fault(f"column {alias} is named twice")
            v = rows.vars.get(e[1]) if e[0] == "var" else None
            if v and v.kind in ("node", "edge"):
                out_vars[alias] = v
                for c in v.props:
                    source = F.col(f"{e[1]}@{c}")
                    keep = source if not grouped or c == "_id" else F.first(source)
                    (keys if grouped and c == "_id" else cols).append(keep.alias(f"{alias}@{c}"))
            else:
                out_vars[alias] = Var("trail") if v and v.kind == "trail" else Var("value")
                col = self.entity(rows, e[1]) if v else self.expr(rows, e)
                (keys if grouped and not is_aggregate(e) else cols).append(col.alias(alias))
        hidden = {f"{next(self.fresh)}@sort": (self.expr(rows, e), d, n) for e, d, n in order}
        if grouped:
            df = self.grouped(rows, p, items, keys, cols, {k: v[0] for k, v in hidden.items()}, having)
        else:
            df = self.rows.df
            if having is not None:
                df = df.filter(self.expr(rows, having))
            df = df.select(*cols, *[c.alias(k) for k, (c, _, _) in hidden.items()])
        if p.distinct:
            df = df.distinct()
        if hidden:
            df = df.orderBy(*[self.ordering(F.col(k), d, n) for k, (_, d, n) in hidden.items()])
        if p.skip is not None:
            df = df.offset(self.number(p.skip))
        if p.limit is not None:
            df = df.limit(self.number(p.limit))
        self.rows = None
        return Rows(df.drop(*hidden), out_vars)

    def grouped(self, rows: Rows, p: Projection, items, keys, cols, hidden: dict[str, Column], having) -> DataFrame:
        df = self.rows.df
        kind, exprs = p.group or ("plain", None)
        extra = [c.alias(k) for k, c in hidden.items()]
        keep = f"{next(self.fresh)}@having"
        if having is not None:
            extra.append(self.expr(rows, having).alias(keep))
        if kind == "plain":
            by = list(keys)
            if exprs is not None:
                given = [self.expr(rows, e) for e in exprs if not any(e == x for x, _ in items)]
                by += [c.alias(f"{next(self.fresh)}@key") for c in given]
            aggs = cols + extra
            if aggs:
                out = df.groupBy(*by).agg(*aggs)
            else:
                out = df.select(*by).distinct()
        else:
            sets = exprs if kind == "sets" else [[e] for e in exprs]
            flat: list = []
            for s in sets:
                flat += [e for e in s if e not in flat]
            named = {str(e): f"{next(self.fresh)}@key" for e in flat}
            # Keys get columns of their own, so that aggregates of the same columns read the ungrouped values.
            df = df.withColumns({named[str(e)]: self.expr(rows, e) for e in flat})
            by = [F.col(named[str(e)]) for e in flat]
            if kind == "sets":
                g = df.groupingSets([[F.col(named[str(e)]) for e in s] for s in sets], *by)
            else:
                g = getattr(df, kind)(*by)
            order = [named[str(e)] if str(e) in named else None for e, _ in items]
            pick = iter(cols)
            aggs = [next(pick) for e, _ in items if str(e) not in named]
            out = g.agg(*aggs, *extra) if aggs or extra else g.count().drop("count")
            names = [a for _, a in items]
            out = out.select(*[F.col(k).alias(n) if k else F.col(f"`{n}`") for k, n in zip(order, names, strict=True)], *hidden, *([keep] if having is not None else []))
        if having is not None:
            out = out.filter(F.col(keep)).drop(keep)
        return out.drop(*[c for c in out.columns if c.endswith("@key")])

    def number(self, e: tuple) -> int:
        if e[0] == "param":
            return int(self.params[e[1]])
        if e[0] != "lit":
            return int(self.spark.range(1).select(self.expr(Rows(None, {}), e).alias("n")).first()[0])
        return int(e[1])

    @staticmethod
    def substitute(e, names: dict):
        """e with variables of the given names replaced."""
        if isinstance(e, tuple):
            if len(e) == 2 and e[0] == "var" and e[1] in names:
                return names[e[1]]
            return tuple(Compiler.substitute(x, names) for x in e)
        if isinstance(e, list):
            return [Compiler.substitute(x, names) for x in e]
        if isinstance(e, dict):
            return {k: Compiler.substitute(x, names) for k, x in e.items()}
        return e

    # -- values --
    def type_of(self, col: Column) -> T.DataType:
        df = self.rows.df if self.rows is not None and self.rows.df is not None else self.spark.range(1)
        return df.select(col.alias("x")).schema[0].dataType

    def entity(self, rows: Rows, name: str) -> Column:
        v = rows.vars[name]
        if v.kind == "node":
            props = [F.col(f"{name}@{p}").alias(p) for p in v.props if p[0] != "_"]
            label = F.col(f"{name}@_label") if "_label" in v.props else F.lit(v.label)
            return F.when(F.col(f"{name}@_id").isNotNull(), F.struct(F.col(f"{name}@_id").alias("id"), label.alias("label"), *([F.struct(*props).alias("properties")] if props else [])))
        if v.kind == "edge":
            props = [F.col(f"{name}@{p}").alias(p) for p in v.props if p[0] != "_"]
            return F.when(F.col(f"{name}@_id").isNotNull(), F.struct(*[F.col(f"{name}@{p}").alias(a) for p, a in (("_id", "id"), ("_label", "label"), ("_start", "start_id"), ("_end", "end_id"))], *([F.struct(*props).alias("properties")] if props else [])))
        if v.kind == "path":
            return F.struct(self.path_nodes(rows, v).alias("nodes"), self.path_edges(rows, v).alias("edges"))
        return F.col(f"`{name}`")

    def path_nodes(self, rows: Rows, v: Var) -> Column:
        """Ids of the path's vertices, those inside trails included."""
        parts = []
        for k, n in enumerate(v.parts):
            if k % 2 == 0:
                parts.append(F.array(F.col(f"{n}@_id")))
            elif rows.vars[n].kind == "trail":
                parts.append(F.col(f"{n}.nodes"))
        return F.concat(*parts)

    def path_edges(self, rows: Rows, v: Var) -> Column:
        """Edges (id, label, start_id, end_id) of the path."""
        parts = []
        for n in v.parts[1::2]:
            if rows.vars[n].kind == "trail":
                parts.append(F.col(f"{n}.edges"))
            else:
                parts.append(F.array(F.struct(*[F.col(f"{n}@{p}").alias(a) for p, a in (("_id", "id"), ("_label", "label"), ("_start", "start_id"), ("_end", "end_id"))])))
        return F.concat(*parts) if parts else F.array().cast("array<struct<id:bigint,label:string,start_id:bigint,end_id:bigint>>")

    def expr(self, rows: Rows, e: tuple) -> Column:
        return getattr(self, f"_{e[0]}")(rows, e)

    def _lit(self, rows, e):
        v = e[1]
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("bigint")
        return F.lit(v)

    def _param(self, rows, e):
        if e[1] not in self.params:
            raise Fault(f"parameter ${e[1]} has no value")
        v = self.params[e[1]]
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else self._lit(rows, ("lit", v))

    def _var(self, rows, e):
        if e[1] not in rows.vars:
            raise Fault(f"variable {e[1]} does not exist")
        v = rows.vars[e[1]]
        return F.col(f"{e[1]}@_id") if v.kind in ("node", "edge") else self.entity(rows, e[1])

    def _prop(self, rows, e):
        base = e[1]
        if base[0] == "var" and base[1] in rows.vars and rows.vars[base[1]].kind in ("node", "edge"):
            return F.col(f"{base[1]}@{e[2]}") if e[2] in rows.vars[base[1]].props else F.lit(None)
        col = self.expr(rows, base)
        kind = self.type_of(col)
        if isinstance(kind, T.StructType):
            return col.getField(e[2]) if e[2] in kind.names else F.lit(None)
        if isinstance(kind, T.MapType):
            return F.try_element_at(col, F.lit(e[2]))
        if isinstance(kind, T.StringType):
            # JSON text: its fields are strings.
            return F.get_json_object(col, f"$.{e[2]}")
        return F.lit(None)

    def _index(self, rows, e):
        col, kind = self.typed(rows, e[1])
        if isinstance(kind, T.StructType) and e[2][0] == "lit":
            return col.getField(e[2][1]) if e[2][1] in kind.names else F.lit(None)
        i = self.expr(rows, e[2])
        if isinstance(kind, T.MapType):
            return F.try_element_at(col, i)
        if not isinstance(kind, T.ArrayType):
            return F.lit(None)
        i = i.cast("int")
        return F.try_element_at(col, F.when(i >= 0, i + 1).otherwise(F.when(i < -F.size(col), F.size(col) + 1).otherwise(i)))

    def _slice(self, rows, e):
        col = self.expr(rows, e[1])
        n = F.size(col)
        norm = lambda x: F.when(x < 0, F.greatest(x + n, F.lit(0))).otherwise(F.least(x, n))
        a = norm(self.expr(rows, e[2]).cast("int")) if e[2] is not None else F.lit(0)
        b = norm(self.expr(rows, e[3]).cast("int")) if e[3] is not None else n
        return F.slice(col, a + 1, F.greatest(b - a, F.lit(0)))

    def _list(self, rows, e):
        cols = [self.expr(rows, x) for x in e[1]]
        if len({x[0] for x in e[1]} - {"lit"}) == 0 and len({type(x[1]) for x in e[1] if x[1] is not None} ) < 2:
            return F.array(*cols)
        types = [self.type_of(c) for c in cols]
        return F.array(*[dynamic.encode(c, t) for c, t in zip(cols, types, strict=True)]) if dynamic.mixed(types) else F.array(*cols)

    def _map(self, rows, e):
        return F.struct(*[self.expr(rows, v).alias(k) for k, v in sorted(e[1])]) if e[1] else F.create_map()

    def _cast(self, rows, e):
        return functions.cast(self.expr(rows, e[1]), e[2], self.type_of)

    def _isnull(self, rows, e):
        col = self.expr(rows, e[1])
        return col.isNotNull() if e[2] else col.isNull()

    def _case(self, rows, e):
        _, operand, whens, other = e
        out = None
        for cond, value in whens:
            c = self.expr(rows, cond) if operand is None else self.expr(rows, operand) == self.expr(rows, cond)
            v = self.expr(rows, value)
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(self.expr(rows, other)) if other is not None else out

    def _exists(self, rows, e):
        return self.flag(rows, e[1])

    def _in_query(self, rows, e):
        return self.flag(rows, e[2], self.expr(rows, e[1]))

    def _quant(self, rows, e):
        return self.quantified(rows, e)

    def typed(self, rows, e) -> tuple[Column, T.DataType]:
        col = self.expr(rows, e)
        return col, self.type_of(col)

    def _un(self, rows, e):
        return functions.unary(e[1], self.expr(rows, e[2]), self.type_of)

    def _bin(self, rows, e):
        _, op, left, right = e
        trail = self.trail_operator(rows, op, left, right)
        if trail is not None:
            return trail
        if op in ENTITY_OPERATORS:
            left, right = (("call", "properties", [x], {}) if x[0] == "var" and x[1] in rows.vars and rows.vars[x[1]].kind in ("node", "edge") and k in ENTITY_OPERATORS[op] else x for k, x in enumerate((left, right)))
        if op == "@=" and right[0] == "list":
            col, kind = self.typed(rows, left)
            items = [self.expr(rows, x) for x in right[1] if x != ("lit", None)]
            items = [x for x in items if dynamic.same_tag(kind, self.type_of(x))]
            return F.when(col.isNotNull(), col.isin(*items) if items else F.lit(False))
        return functions.binary(op, self.expr(rows, left), self.expr(rows, right), self.type_of, lists=(left[0] == "list", right[0] == "list"))

    def trail_operator(self, rows: Rows, op: str, left, right) -> Column | None:
        """Containment and overlap of trails."""
        kind = lambda x: rows.vars[x[1]].kind if x[0] == "var" and x[1] in rows.vars else None
        a, b = kind(left), kind(right)
        if op == "&&" and a == b == "trail":
            return F.arrays_overlap(F.col(f"{left[1]}.edges.id"), F.col(f"{right[1]}.edges.id"))
        if op in ("@>", "<@") and {a, b} == {"trail", "edge"}:
            trail, edge = (left[1], right[1]) if a == "trail" else (right[1], left[1])
            return F.array_contains(F.col(f"{trail}.edges.id"), F.col(f"{edge}@_id"))
        if op in ("=", "<>", "<", ">", "<=", ">=") and a == b and a in ("trail", "path"):
            ids = lambda x: F.col(f"{x[1]}.edges.id") if a == "trail" else F.concat(self.path_nodes(rows, rows.vars[x[1]]), self.path_edges(rows, rows.vars[x[1]]).getField("id"))
            return functions.COMPARE[op](ids(left), ids(right))
        return None

    def _call(self, rows, e):
        _, name, args, opts = e
        if "over" in opts:
            return self.windowed(rows, e)
        if name in functions.AGGREGATES:
            cols = [self.entity(rows, a[1]) if name == "collect" and a[0] == "var" and a[1] in rows.vars else self.expr(rows, a) for a in args]
            if "filter" in opts and cols:
                cond = self.expr(rows, opts["filter"])
                cols[0] = F.when(cond, cols[0])
            elif "filter" in opts:
                cols, opts = [F.when(self.expr(rows, opts["filter"]), F.lit(1))], opts | {"star": False}
            within = [self.expr(rows, x[0]) for x in opts.get("within", [])]
            return functions.aggregate(name, within + cols if within else cols, opts)
        if args and args[0][0] == "var" and args[0][1] in rows.vars and (got := self.graph_function(rows, name, args[0][1])) is not None:
            return got
        return functions.call(name, [self.expr(rows, a) for a in args], self.type_of)

    def graph_function(self, rows: Rows, name: str, var: str) -> Column | None:
        """Functions of entities, trails and paths."""
        v = rows.vars[var]
        at = lambda p: F.col(f"{var}@{p}")
        if v.kind in ("node", "edge"):
            table = {"id": "_id", "start_id": "_start", "end_id": "_end", "startnode": "_start", "endnode": "_end"}
            if name in table and table[name] in v.props:
                return at(table[name])
            if name in ("label", "type"):
                return at("_label") if "_label" in v.props else F.lit(v.label)
            props = [p for p in v.props if p[0] != "_"]
            if name in ("properties", "age_properties"):
                return F.struct(*[at(p).alias(p) for p in props])
            if name == "keys":
                return F.array_compact(F.array(*[F.when(at(p).isNotNull(), F.lit(p)) for p in sorted(props)]))
        if v.kind == "trail":
            if name in ("relationships", "edges"):
                return F.col(f"{var}.edges")
            if name == "nodes":
                return F.col(f"{var}.nodes")
            if name == "length":
                return F.size(F.col(f"{var}.edges")).cast("bigint")
        if v.kind == "path":
            if name in ("relationships", "edges"):
                return self.path_edges(rows, v)
            if name == "nodes":
                return self.path_nodes(rows, v)
            if name == "length":
                return F.size(self.path_edges(rows, v)).cast("bigint")
            if name == "size":
                return (F.size(self.path_edges(rows, v)) + F.size(self.path_nodes(rows, v))).cast("bigint")
        return None

    def windowed(self, rows: Rows, e) -> Column:
        _, name, args, opts = e
        spec = opts["over"]
        spec = {"partition": [], "order": [], "frame": None, "base": spec} if isinstance(spec, str) else spec
        while spec["base"]:
            if spec["base"] not in self.windows:
                raise Fault(f"window {spec['base']} does not exist")
            base = self.windows[spec["base"]]
            spec = {"partition": spec["partition"] or base["partition"], "order": spec["order"] or base["order"], "frame": spec["frame"] or base["frame"], "base": base["base"]}
        part = [self.expr(rows, x) for x in spec["partition"]]
        order = [self.ordering(self.expr(rows, x), d, n) for x, d, n in spec["order"]]
        w = Window.partitionBy(*part).orderBy(*order) if order else Window.partitionBy(*part)
        frame = spec["frame"]
        exclude = None
        if frame:
            kind, low, high, exclude = frame
            lo = Window.unboundedPreceding if low is None else low
            hi = Window.unboundedFollowing if high == "after" else high
            if kind == "groups":
                # Peers get numbers; a range over these counts groups.
                n = f"{next(self.fresh)}@peers"
                self.rows.df = self.rows.df.withColumn(n, F.dense_rank().over(w))
                w = Window.partitionBy(*part).orderBy(n).rangeBetween(lo, hi)
            else:
                w = w.rowsBetween(lo, hi) if kind == "rows" else w.rangeBetween(lo, hi)
        cols = [self.expr(rows, a) for a in args]
        if "filter" in opts:
            cond = self.expr(rows, opts["filter"])
            cols = [F.when(cond, c) for c in cols] or [F.when(cond, F.lit(1))]
            opts = opts | {"star": False}
        if exclude in ("current", "group", "ties"):
            if name not in ("count", "sum", "avg") or (exclude != "current" and kind == "rows"):
                row, group = f"{next(self.fresh)}@row", f"{next(self.fresh)}@group"
                base = Window.partitionBy(*part).orderBy(*(order or [F.lit(1)]))
                self.rows.df = self.rows.df.withColumns({row: F.row_number().over(base), group: F.dense_rank().over(base)})
                if kind == "rows":
                    # The frame counts rows in the order that numbered them.
                    w = Window.partitionBy(*part).orderBy(row).rowsBetween(lo, hi)
                return functions.excluding_rows(name, cols, w, F.col(row), F.col(group), exclude)
            peers = Window.partitionBy(*part).orderBy(*order).rangeBetween(Window.currentRow, Window.currentRow) if order else Window.partitionBy(*part)
            return functions.excluding(name, cols, w, peers, exclude)
        return functions.window(name, cols, opts).over(w)
