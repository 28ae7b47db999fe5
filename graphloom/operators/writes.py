"""CREATE, SET, REMOVE, DELETE and MERGE as new versions of label tables.

Nothing is changed in place: an updating clause computes the label tables that it touches anew, keeps them (see trails.keep), and
swaps them into the graph, so that later clauses read what earlier ones did. If a statement fails, the graph has its old tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dynamic
from ..sources.catalog import Label, entity_id, union_all
from .trails import keep


def apply(compiler, clause: tuple, rows):
    kind = clause[0]
    if rows.df is None and kind in ("create", "merge"):
        rows = type(rows)(compiler.spark.range(1).select(), {})
    if kind == "create":
        for path in clause[1]:
            rows = create(compiler, rows, path)
        return rows
    if kind == "merge":
        return merge(compiler, rows, clause[1])
    return set_props(compiler, rows, clause[1]) if kind == "set_props" else delete(compiler, rows, clause[1], clause[2])


def _grow(graph, name: str, kind: str, new: DataFrame) -> None:
    """Adds rows (with _id) to a label, which is made if it is new."""
    old = graph.labels.get(name)
    df = keep(union_all([old.df.drop(*[c for c in old.df.columns if c[0] == "^"]), new]) if old else new)
    number = old.number if old else graph.next_number()
    graph.replace(Label(name, number, kind, df, parents=old.parents if old else (), start=None, end=None))


def _next_ids(graph, name: str, kind: str, df: DataFrame, column: str) -> DataFrame:
    """df with fresh ids of a label. Numbers are given within partitions and shifted by how many rows come before, so no task sees all rows."""
    old = graph.labels.get(name)
    number = old.number if old else graph.next_number()
    if old and old.kind != kind:
        raise ValueError(f"label {name} is not a {'vertex' if kind == 'v' else 'edge'} label")
    top = (old.df.agg(F.max(F.col("_id").bitwiseAND(F.lit((1 << 48) - 1)))).first()[0] if old else 0) or 0
    df = keep(df.withColumn("@part", F.spark_partition_id()).withColumn("@seq", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in df.groupBy("@part").count().collect()}
    before, total = {}, top
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    shift = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else None
    entry = F.row_number().over(Window.partitionBy("@part").orderBy("@seq")) + (F.element_at(shift, F.col("@part")) if before else F.lit(0))
    return df.withColumn(column, entity_id(number, entry)).drop("@part", "@seq")


def create(compiler, rows, path):
    """Each path once for each input row; variables that are bound are used, others made."""
    from ..plans.compiler import Rows, Var

    graph = compiler.graph
    for k, p in enumerate(path.parts):
        if k % 2 == 0:
            p.var = p.var or next(compiler.fresh)
            if p.var in rows.vars:
                if p.label or p.props:
                    raise ValueError(f"variable {p.var} exists: it cannot get a label or properties")
                continue
            rows = _make(compiler, rows, p, "v", p.label or "vertex", {})
    for k in range(1, len(path.parts), 2):
        e, a, b = path.parts[k], path.parts[k - 1], path.parts[k + 1]
        if e.direction == "both":
            raise ValueError("CREATE needs a direction for each edge")
        if e.hops:
            raise ValueError("CREATE cannot make paths of variable length")
        e.var = e.var or next(compiler.fresh)
        start, end = (a, b) if e.direction == "out" else (b, a)
        rows = _make(compiler, rows, e, "e", e.label or "edge", {"_start": F.col(f"{start.var}@_id"), "_end": F.col(f"{end.var}@_id")})
    if path.var:
        rows = Rows(rows.df, rows.vars | {path.var: Var("path", parts=tuple(p.var for p in path.parts))})
    return rows


def _make(compiler, rows, p, kind: str, label: str, ends: dict):
    from ..plans.compiler import Rows, Var

    graph, props = compiler.graph, p.props[1] if p.props and p.props[0] == "map" else [(k, ("lit", v)) for k, v in compiler.params[p.props[1]].items()] if p.props else []
    compiler.rows = rows
    values = {k: compiler.expr(rows, v) for k, v in props if v != ("lit", None)}
    df = rows.df.withColumns({f"{p.var}@{k}": v for k, v in (ends | values).items()} | {f"{p.var}@_label": F.lit(label)})
    df = keep(_next_ids(graph, label, kind, df, f"{p.var}@_id"))
    cols = ["_id", *ends, *values]
    _grow(graph, label, kind, df.select(*[F.col(f"{p.var}@{c}").alias(c) for c in cols]))
    return Rows(df, rows.vars | {p.var: Var("node" if kind == "v" else "edge", ("_id", "_label", *ends, *values), label)})


def _plain(label: Label, df: DataFrame) -> Label:
    """The label with another table, which carries nothing."""
    return Label(label.name, label.number, label.kind, df.drop(*[c for c in df.columns if c[0] == "^"]), label.start, label.end, None, label.parents)


def _labels(graph, var) -> list[Label]:
    kind = "v" if var.kind == "node" else "e"
    return graph.family(var.label, kind)


def _detach(graph) -> None:
    """Edges stop carrying vertices, whose columns may change."""
    for name, x in list(graph.labels.items()):
        if x.carries:
            graph.replace(_plain(x, x.df))


def set_props(compiler, rows, items: list):
    """New values of properties; null removes one. Of several values for one entity, that of the last row wins."""
    from ..plans.compiler import Rows, Var

    graph = compiler.graph
    rows = Rows(keep(rows.df), rows.vars)
    for var, prop, value in items:
        if var not in rows.vars or rows.vars[var].kind not in ("node", "edge"):
            raise ValueError(f"SET needs an entity: {var}")
        v = rows.vars[var]
        compiler.rows = rows
        new = compiler.expr(rows, value)
        changed = rows.df.where(F.col(f"{var}@_id").isNotNull()).select(F.col(f"{var}@_id").alias("@id"), new.alias("@new"), F.monotonically_increasing_id().alias("@seq")).groupBy("@id").agg(F.max_by("@new", "@seq").alias("@new"))
        changed = keep(changed)
        _detach(graph)
        for label in _labels(graph, v):
            kind = label.df.schema[prop].dataType if prop in label.props else changed.schema["@new"].dataType
            old = F.col(prop) if prop in label.props else F.lit(None)
            if str(kind) == "NullType()" or kind.typeName() == "void":
                if prop not in label.props:
                    continue
            df, fresh = label.df.join(changed, F.col("_id") == F.col("@id"), "left"), changed.schema["@new"].dataType
            if dynamic.mixed([kind, fresh]):
                here, before = dynamic.encode(F.col("@new"), fresh), dynamic.encode(old, kind)
            else:
                here, before = F.col("@new").cast(kind), old.cast(kind)
            df = df.withColumn(prop, F.when(F.col("@id").isNotNull(), here).otherwise(before)).drop("@id", "@new")
            graph.replace(_plain(label, keep(df)))
        rows = Rows(rows.df.withColumn(f"{var}@{prop}", new), rows.vars | {var: Var(v.kind, tuple(dict.fromkeys([*v.props, prop])), v.label)})
    return rows


def delete(compiler, rows, names: list[str], detach: bool):
    """Entities go; a vertex with edges only with DETACH, and then with them."""
    from ..plans.compiler import Rows

    graph = compiler.graph
    rows = Rows(keep(rows.df), rows.vars)
    gone = {"node": [], "edge": []}
    for n in names:
        if n not in rows.vars or rows.vars[n].kind not in gone:
            raise ValueError(f"DELETE needs an entity: {n}")
        gone[rows.vars[n].kind].append(rows.df.where(F.col(f"{n}@_id").isNotNull()).select(F.col(f"{n}@_id").alias("@gone")))
    ids = {k: keep(reduce(DataFrame.unionByName, v).distinct()) for k, v in gone.items() if v}
    _detach(graph)
    for name, label in list(graph.labels.items()):
        kind = "node" if label.kind == "v" else "edge"
        df = label.df
        if kind in ids:
            df = df.join(ids[kind], F.col("_id") == F.col("@gone"), "left_anti")
        if kind == "edge" and "node" in ids:
            touched = lambda c, d=df: d.join(ids["node"], F.col(c) == F.col("@gone"), "left_semi")
            if not detach:
                if not touched("_start").isEmpty() or not touched("_end").isEmpty():
                    raise ValueError("a vertex has edges: DETACH DELETE deletes them with it")
            else:
                for c in ("_start", "_end"):
                    df = df.join(ids["node"], F.col(c) == F.col("@gone"), "left_anti")
        if df is not label.df:
            graph.replace(_plain(label, keep(df)))
    return rows


def merge(compiler, rows, path):
    """Matches the whole path, and makes it for input rows without a match, once for equal values."""
    from ..plans.compiler import Rows

    graph = compiler.graph
    for k, p in enumerate(path.parts):
        p.var = p.var or next(compiler.fresh)
        name = p.label or ("vertex" if k % 2 == 0 else "edge")
        if p.var not in rows.vars and name not in graph.labels:
            # A new label matches nothing: its table starts empty.
            props = p.props[1] if p.props else []
            compiler.rows = rows
            typed = rows.df.select(*[compiler.expr(rows, v).alias(n) for n, v in props]).limit(0)
            ids = ["_id"] if k % 2 == 0 else ["_id", "_start", "_end"]
            empty = typed.select(*[F.lit(0).cast("bigint").alias(i) for i in ids], "*")
            graph.replace(Label(name, graph.next_number(), "v" if k % 2 == 0 else "e", empty))
        p.label = p.label if p.var in rows.vars else name
    tagged = Rows(keep(rows.df.withColumn("@row", F.monotonically_increasing_id())), rows.vars)
    matched = compiler.path(tagged, path)
    matched = Rows(keep(matched.df), matched.vars)
    missing = tagged.df.join(matched.df.select("@row").distinct(), "@row", "left_anti")
    if missing.isEmpty():
        return Rows(matched.df.drop("@row"), matched.vars)
    # Rows that would make the same path make it once.
    keys, k = {}, 0
    for p in path.parts:
        if p.var in tagged.vars:
            keys[f"@k{k}"] = F.col(f"{p.var}@_id")
            k += 1
        for _, v in p.props[1] if p.props else []:
            keys[f"@k{k}"] = compiler.expr(tagged, v)
            k += 1
    missing = keep(missing.withColumns(keys))
    firsts = missing.dropDuplicates(list(keys)) if keys else missing.limit(1)
    new = type(path)(path.var, [type(p)(**{**p.__dict__, "label": None if p.var in tagged.vars else p.label, "props": None if p.var in tagged.vars else p.props}) for p in path.parts])
    made = create(compiler, Rows(firsts, tagged.vars), new)
    added = [c for c in made.df.columns if c not in missing.columns]
    if keys:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}r")) for c in keys])
        back = missing.join(made.df.select(*[F.col(c).alias(f"{c}r") for c in keys], *added), same)
    else:
        back = missing.crossJoin(made.df.select(*added))
    both = matched.df.select("*").unionByName(back.drop(*[f"{c}r" for c in keys]), allowMissingColumns=True)
    return Rows(both.drop("@row", *keys), made.vars | matched.vars)
