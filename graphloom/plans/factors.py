"""Aggregates over patterns whose parts share one vertex, without the pairs of the parts' rows.

MATCH (c)-[:A]->(n), (s)-[:B]->(n) has as many rows as pairs of c and s at each n: the product of two tables if few n exist. Where
the aggregates allow it, each part is computed by itself:

* Aggregates that repeated rows don't change (DISTINCT, min, max) read one part each; of the others only matters that they have a row.
* count(*) multiplies the rows of one part by the counts of the others at the same vertex. One comparison between two parts is a
  running count over the other part's values.
"""

from __future__ import annotations

import itertools
from dataclasses import replace
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import registry as functions
from .parser import EdgePattern, NodePattern, Path, Projection

FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
ORDERED = (T.IntegralType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType)


class Part:
    """Paths that share no variable with other parts but the vertex where all meet, and the conditions that read them alone."""

    def __init__(self, paths: list[Path]):
        self.paths, self.where = paths, []
        self.vars = {p.var for path in paths for p in path.parts}

    def rows(self, compiler, hidden: set[str] = frozenset()):
        from .compiler import Rows

        held, compiler.used = compiler.used, compiler.used - hidden
        rows = Rows(None, {})
        for p in self.paths:
            rows = compiler.path(rows, p)
        for c in self.where:
            rows = compiler.where(rows, c)
        compiler.used = held
        return rows

    def ids(self, compiler, at: str):
        """The vertex of each row. Its properties are read only if a condition needs them."""
        from .compiler import names_in

        return self.rows(compiler, set() if at in names_in(self.where) else {at}).df.select(F.col(f"{at}@_id").alias("@at"))


def pieces(compiler, paths: list[Path], at: str) -> list[Path] | None:
    """The paths, cut where they pass the vertex; None if the edges of two pieces of one path might be the same."""
    out = []
    for path in paths:
        cuts = [0, *(k for k in range(2, len(path.parts) - 1, 2) if path.parts[k].var == at), len(path.parts) - 1]
        cut = [Path(None, path.parts[a : b + 1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if len(path.parts) > 1 else [path]
        if len(cut) > 1:
            edges = [p.parts[1::2] for p in cut]
            if any(e.hops or e.label is None for es in edges for e in es):
                return None
            names = [{x.name for e in es for x in compiler.graph.family(e.label, "e")} for es in edges]
            if any(a & b for a, b in itertools.combinations(names, 2)):
                return None
        out += cut
    return out if all(any(p.var == at for p in path.parts) for path in out) else None


def parts(compiler, paths: list[Path], at: str) -> list[Part] | None:
    cut = pieces(compiler, paths, at)
    groups: list[list[Path]] = []
    for p in cut or []:
        mine = {x.var for x in p.parts} - {at}
        near = [g for g in groups if mine & {x.var for q in g for x in q.parts}]
        groups = [g for g in groups if g not in near] + [[q for g in near for q in g] + [p]]
    # A piece that is the vertex alone holds its conditions; it goes with the first other.
    lone = [g for g in groups if all(len(p.parts) == 1 for p in g)]
    rest = [g for g in groups if g not in lone]
    if len(rest) < 2:
        return None
    return [Part([p for g in lone for p in g] * (k == 0) + g) for k, g in enumerate(rest)]


def named(compiler, paths: list[Path]) -> list[Path] | None:
    """The paths with a name for each vertex and edge, and one label for each vertex wherever it occurs."""
    labels: dict[str, str] = {}
    for x in (x for p in paths for x in p.parts if isinstance(x, NodePattern) and x.var and x.label):
        if labels.setdefault(x.var, x.label) != x.label:
            return None
    edges = [x.var for p in paths for x in p.parts if isinstance(x, EdgePattern) and x.var]
    if len(set(edges)) < len(edges) or any(p.var for p in paths):
        return None
    return [Path(None, [replace(x, var=x.var or next(compiler.fresh), label=x.label or labels.get(x.var)) for x in p.parts]) for p in paths]


def grouped(compiler, clauses: list):
    """Rows of MATCH clauses and a projection that groups them, and how many clauses that is; None if the rows themselves are needed."""
    from .compiler import conjuncts, is_aggregate, names_in, walk

    n = next((k for k, c in enumerate(clauses) if c[0] != "match" or c[3] or c[4]), len(clauses))
    if not n or n == len(clauses) or clauses[n][0] not in ("with", "return") or compiler.graph is None:
        return None
    p = clauses[n][1]
    items = list(p.items)
    if p.where or p.group or p.having or p.windows or "*" in items or len({a for _, a in items}) < len(items) or not all(e[0] == "var" and e[1] in {a for _, a in items} for e, _, _ in p.order):
        return None
    aggs = [x for x in items if is_aggregate(x[0])]
    keys = [x for x in items if x not in aggs]
    if not aggs or not all(e[0] == "call" and e[1] in functions.AGGREGATES and not {"over", "filter", "within"} & set(e[3]) for e, _ in aggs):
        return None
    paths = named(compiler, [path for c in clauses[:n] for path in c[1]])
    wheres = [c for m in clauses[:n] if m[2] is not None for c in conjuncts(m[2])]
    asked = [e for e, _ in items] + wheres
    if paths is None or any(e[0] == "var" for e, _ in keys) or any(x[0] in ("exists", "in_query", "quant") for e in asked for x in walk(e)):
        return None
    nodes = [x.var for path in paths for x in path.parts if isinstance(x, NodePattern)]
    all_vars = {x.var for path in paths for x in path.parts}
    if names_in(asked) - all_vars:
        return None
    ends = [x for path in paths for x in (path.parts[0].var, path.parts[-1].var)]
    for at in dict.fromkeys(nodes):
        met = nodes.count(at) > 1 or (at not in ends)
        found = parts(compiler, paths, at) if met else None
        if not found or any(names_in(x.props) - part.vars for part in found for path in part.paths for x in path.parts):
            continue
        cross = []
        for c in wheres:
            mine = [part for part in found if names_in(c) <= part.vars]
            if mine:
                mine[0].where.append(c)
            else:
                cross.append(c)
        rows = separate(compiler, found, at, keys, aggs, cross) or counted(compiler, found, at, keys, aggs, cross)
        if rows is not None:
            last = Projection([(("var", a), a) for _, a in items], p.distinct, order=p.order, skip=p.skip, limit=p.limit)
            return compiler.project(rows, last), n + 1
    return None


def separate(compiler, found: list[Part], at: str, keys, aggs, cross):
    """Aggregates that repeated rows don't change: a query for each part, and a join of their groups."""
    from .compiler import Rows, Var, names_in

    steady = lambda e: e[1] in ("min", "max", "bool_and", "bool_or", "every") or (e[1] in ("count", "sum", "avg") and e[3].get("distinct") and e[2])
    home = [next((part for part in found if names_in(e[2]) <= part.vars), None) for e, _ in aggs]
    if cross or names_in([e for e, _ in keys]) - {at} or None in home or not all(steady(e) for e, _ in aggs):
        return None
    out = None
    for part in found:
        mine = [x for x, h in zip(aggs, home, strict=True) if h is part]
        if not mine:
            continue
        rows = part.rows(compiler)
        for other in found:
            if other is not part:
                have = other.ids(compiler, at).distinct()
                rows = Rows(rows.df.join(have, F.col(f"{at}@_id") == F.col("@at"), "left_semi"), rows.vars)
        df = compiler.project(rows, Projection(keys + mine)).df
        if out is not None:
            df = df.withColumnsRenamed({a: f"{a}@other" for _, a in keys})
            same = reduce(lambda x, y: x & y, [out[f"`{a}`"].eqNullSafe(df[f"`{a}@other`"]) for _, a in keys]) if keys else None
            df = (out.join(df, same) if keys else out.crossJoin(df)).drop(*[f"{a}@other" for _, a in keys])
        out = df
    return Rows(out, {a: Var("value") for _, a in keys + aggs})


def counted(compiler, found: list[Part], at: str, keys, aggs, cross):
    """count(*): rows of the part that has the keys, times the others' counts."""
    from .compiler import Rows, Var, names_in

    base = next((part for part in found if names_in([e for e, _ in keys]) <= part.vars), None)
    if base is None or len(cross) > 1 or not all(e[1] == "count" and (e[3].get("star") or not e[2]) and not e[3].get("distinct") for e, _ in aggs):
        return None
    weights, others = [], [part for part in found if part is not base]
    if cross:
        _, op, x, y = cross[0] if len(cross[0]) == 4 else (None,) * 4
        if len(others) > 1 or cross[0][0] != "bin" or op not in FLIPPED:
            return None
        if names_in(x) <= base.vars and names_in(y) <= others[0].vars:
            op, x, y = FLIPPED[op], y, x
        if not (names_in(x) <= others[0].vars and names_in(y) <= base.vars):
            return None
    rows = base.rows(compiler)
    if cross:
        theirs = others[0].rows(compiler)
        compiler.rows = theirs
        tx, col = compiler.type_of(compiler.expr(theirs, x)), compiler.expr(theirs, x)
        right = theirs.df.select(F.col(f"{at}@_id").alias("@at"), col.alias("@value"))
        compiler.rows = rows
        mine = compiler.expr(rows, y)
        if tx != compiler.type_of(mine) or not isinstance(tx, ORDERED):
            compiler.rows = None
            return None
        rows = Rows(rows.df.withColumn("@mine", mine), rows.vars)
        compiler.rows = None
        left = rows.df.select(F.col(f"{at}@_id").alias("@at"), F.col("@mine").alias("@value"))
        both = right.withColumn("@n", F.lit(1)).unionAll(left.withColumn("@n", F.lit(0))).where("`@value` IS NOT NULL").groupBy("@at", "@value").agg(F.sum("@n").alias("@n"))
        order = F.col("@value").asc() if op[0] == "<" else F.col("@value").desc()
        upto = F.sum("@n").over(Window.partitionBy("@at").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = both.select("@at", "@value", (upto if op[1:] else upto - F.col("@n")).alias("@n0")).where("`@n0` > 0")
        rows.df = rows.df.join(counts, (F.col(f"{at}@_id") == F.col("@at")) & (F.col("@mine") == F.col("@value"))).drop("@at", "@value", "@mine")
        weights = ["@n0"]
    else:
        for k, part in enumerate(others):
            counts = part.ids(compiler, at).groupBy("@at").agg(F.count("*").alias(f"@n{k}"))
            rows = Rows(rows.df.join(counts, F.col(f"{at}@_id") == F.col("@at")).drop("@at"), rows.vars)
            weights.append(f"@n{k}")
    weight = next(compiler.fresh)
    df = rows.df.withColumn(weight, reduce(lambda a, b: a * b, [F.col(w) for w in weights])).drop(*weights)
    total = ("call", "coalesce", [("call", "sum", [("var", weight)], {}), ("lit", 0)], {})
    return compiler.project(Rows(df, rows.vars | {weight: Var("value")}), Projection(keys + [(total, a) for _, a in aggs]))
