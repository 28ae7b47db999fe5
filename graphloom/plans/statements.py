"""Statements around queries: prepared ones, cursors, COPY, label DDL, and changes of relational tables.

A relational table that is changed is a view of the session; its new version replaces the view once it is computed (see
operators.trails.keep), as with graphs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry as functions
from ..operators.trails import keep
from ..sources import tables
from . import sqltext

TYPES = {"int": "int", "integer": "int", "int8": "bigint", "text": "string", "varchar": "string", "float8": "double", "numeric": "decimal(38,10)"}
_TEXT = r"'((?:[^']|'')*)'"


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks outside of brackets and texts."""
    out, depth, quoted, at = [], 0, False, 0
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted:
            depth += (ch in "([{") - (ch in ")]}")
            if ch == mark and not depth:
                out.append(text[at:i].strip())
                at = i + 1
    return [*out, text[at:].strip()]


class Statements:
    """What an engine keeps between statements, and the statements that use it."""

    def __init__(self, engine):
        self.engine, self.spark = engine, engine.spark
        self.prepared: dict[str, str] = {}
        self.cursors: dict[str, Iterator] = {}
        self.cursor_schema: dict = {}
        self.table: list[tuple[re.Pattern, Callable]] = [
            (re.compile(p + r"\s*;?\s*$", re.I | re.S), f)
            for p, f in (
                (r"\s*prepare\s+(\w+)(?:\s*\([^)]*\))?\s+as\s+(.+?)", self.prepare),
                (r"\s*execute\s+(\w+)\s*(?:\((.*)\))?", self.execute),
                (r"\s*deallocate\s+(?:prepare\s+)?(\w+)", self.deallocate),
                (r"\s*declare\s+(\w+)\s+(?:no\s+scroll\s+)?cursor\s+(?:with(?:out)?\s+hold\s+)?for\s+(.+?)", self.declare),
                (r"\s*fetch\s+(?:forward\s+)?(\d+|next|all)\s+(?:from|in)\s+(\w+)", self.fetch),
                (r"\s*close\s+(\w+)", self.close),
                (rf"\s*copy\s+(\w+|\(.+\))\s+(from|to)\s+{_TEXT}(?:\s*(?:with\s*)?\((.*)\))?", self.copy),
                (rf"\s*select\s+(create_graph|drop_graph|create_vlabel|create_elabel|drop_label|alter_graph|create_property_index|create_unique_properties_constraint|create_ivfflat_l2_ops_index|create_ivfflat_ip_ops_index)\s*\((.*)\)", self.ddl),
                (r"\s*insert\s+into\s+(\w+)\s*(?:\(([^)]*)\)\s*)?((?:values|select|with|table)\b.+?)(?:\s+on\s+conflict\s*\(([^)]*)\)\s+do\s+(nothing|update\s+set\s+.+?))?(?:\s+returning\s+(.+?))?", self.insert),
                (r"\s*update\s+(\w+)\s+set\s+(.+?)(?:\s+where\s+(.+?))?(?:\s+returning\s+(.+?))?", self.update),
                (r"\s*delete\s+from\s+(\w+)(?:\s+where\s+(.+?))?(?:\s+returning\s+(.+?))?", self.delete),
                (r"\s*truncate\s+(?:table\s+)?(\w+)", self.truncate),
                (r"\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?(?:table|(?:materialized\s+)?view)\s+(?:if\s+not\s+exists\s+)?(\w+)\s+as\s+(.+?)", self.create_as),
                (r"\s*create\s+(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?(\w+)\s*\((.+)\)", self.create_table),
                (r"\s*drop\s+(?:table|(?:materialized\s+)?view)\s+(?:if\s+exists\s+)?(\w+)(?:\s+cascade)?", self.drop),
                (r"\s*create\s+(?:or\s+replace\s+)?function\s+(\w+)\s*\((.*?)\)\s*returns\s+(\w+(?:\[\])?)\s+(?:language\s+'?sql'?\s+)?(?:immutable\s+|stable\s+|strict\s+)*(?:as\s+(?:'(.+)'|\$\$(.+)\$\$)|return\s+(.+?))(?:\s*language\s+'?sql'?)?", self.create_function),
                (r"\s*drop\s+function\s+(?:if\s+exists\s+)?(\w+)(?:\s*\(.*\))?", self.drop_function),
                (r"\s*(analyze|vacuum)\b.*?", self.nothing),
                (r"\s*explain\s+(?:analyze\s+|verbose\s+)*(?=match|optional|unwind|return|call|cypher)(.+?)", self.explain),
            )
        ]

    def run(self, text: str) -> tuple[bool, DataFrame | None]:
        """Whether the text is such a statement, and its result."""
        for pattern, f in self.table:
            if m := pattern.match(text):
                return True, f(*m.groups())
        return False, None

    # -- prepared statements and cursors --
    def prepare(self, name, text):
        if name in self.prepared:
            raise ValueError(f"prepared statement {name} exists")
        self.prepared[name] = text

    def execute(self, name, args):
        if name not in self.prepared:
            raise ValueError(f"prepared statement {name} does not exist")
        text = self.prepared[name]
        for k, a in reversed(list(enumerate(split_top(args) if args else [], 1))):
            text = re.sub(rf"\${k}\b", lambda _, a=a: a, text)
        return self.engine.run(text)

    def deallocate(self, name):
        if name.lower() == "all":
            self.prepared.clear()
        else:
            del self.prepared[name]

    def declare(self, name, text):
        df = self.engine.run(text)
        self.cursor_schema[name] = df.schema
        # One partition at a time comes to the driver.
        self.cursors[name] = df.toLocalIterator()

    def fetch(self, many, name):
        if name not in self.cursors:
            raise ValueError(f"cursor {name} does not exist")
        n = {"next": 1, "all": None}.get(many.lower(), int(many) if many.isdigit() else None)
        rows = []
        while n is None or len(rows) < n:
            row = next(self.cursors[name], None)
            if row is None:
                break
            rows.append(row)
        return self.spark.createDataFrame(rows, self.cursor_schema[name])

    def close(self, name):
        del self.cursors[name], self.cursor_schema[name]

    def explain(self, text):
        plan = self.engine.run(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(plan,)], "plan string")

    # -- files --
    def copy(self, what, direction, path, options):
        found = {k.lower(): v.strip("'") for k, _, v in (o.partition(" ") for o in split_top(options))} if options else {}
        kind = found.pop("format", "csv").lower()
        found = {{"delimiter": "sep", "null": "nullValue"}.get(k, k): (v or "true") for k, v in found.items()}
        if direction.lower() == "to":
            df = self.engine.run(what[1:-1]) if what.startswith("(") else self.spark.table(what)
            return tables.write(df, path, kind, "overwrite", **found)
        old = self.spark.table(what)
        new = tables.read(self.spark, path, kind, None if kind in ("parquet", "orc") else old.schema.simpleString()[7:-1].replace(":", " "), **found)
        keep(old.unionByName(new)).createOrReplaceTempView(what)

    # -- graphs --
    def ddl(self, name, args):
        catalog = self.engine.catalog
        v = [a.strip("'") for a in split_top(args)]
        name = name.lower()
        if name == "create_graph":
            catalog.create(v[0])
        elif name == "drop_graph":
            catalog.drop(v[0])
        elif name == "alter_graph":
            g = catalog.graphs.pop(v[0])
            g.name = v[-1]
            catalog.graphs[v[-1]] = g
            catalog.used = v[-1] if catalog.used == v[0] else catalog.used
        elif name in ("create_vlabel", "create_elabel"):
            catalog.graphs[v[0]].add_empty(v[1], name[7], self.spark, tuple(v[2:]))
        elif name == "drop_label":
            catalog.graphs[v[0]].drop(v[1])
        elif name == "create_unique_properties_constraint":
            catalog.graphs[v[0]].require_unique(v[1], v[2])
        elif name.startswith("create_ivfflat"):
            catalog.graphs[v[0]].index(v[1], v[2], int(v[4]) if len(v) > 4 else 100, "l2" if "_l2_" in name else "ip")
        return self.spark.createDataFrame([(name,)], "done string")

    # -- relational tables --
    def swap(self, name: str, df: DataFrame) -> None:
        keep(df).createOrReplaceTempView(name)

    def insert(self, name, columns, source, conflict, action, returning):
        old = self.spark.table(name)
        names = [c.strip() for c in columns.split(",")] if columns else old.columns
        new = self.engine.run(source)
        new = new.toDF(*names[: len(new.columns)])
        new = new.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        if conflict:
            keys = [c.strip() for c in conflict.split(",")]
            new = keep(new.dropDuplicates(keys))
            if action.lower() != "nothing":
                sets = dict((a.strip(), b.strip()) for a, _, b in (x.partition("=") for x in split_top(re.sub(r"(?i)^update\s+set\s+", "", action))))
                excluded = new.select(*[F.col(c).alias(f"excluded@{c}") for c in new.columns])
                hit = old.join(excluded, [old[k].eqNullSafe(F.col(f"excluded@{k}")) for k in keys], "left")
                here = F.col(f"excluded@{keys[0]}").isNotNull()
                made = {c: F.when(here, F.expr(re.sub(r"(?i)\bexcluded\.(\w+)", r"`excluded@\1`", sets[c])).cast(old.schema[c].dataType)).otherwise(F.col(c)) if c in sets else F.col(c) for c in old.columns}
                updated = hit.select(*[v.alias(c) for c, v in made.items()])
                fresh = new.join(old.select(*keys), keys, "left_anti").select(*old.columns)
                self.swap(name, updated.unionByName(fresh))
                return fresh.selectExpr(*split_top(returning)) if returning else None
            new = new.join(old.select(*keys), keys, "left_anti").select(*old.columns)
        new = keep(new)
        self.swap(name, old.unionByName(new))
        return new.selectExpr(*split_top(returning)) if returning else None

    def update(self, name, sets, where, returning):
        old = self.spark.table(name)
        cond = F.expr(where) if where else F.lit(True)
        made = dict((a.strip(), b.strip()) for a, _, b in (x.partition("=") for x in split_top(sets)))
        for c in made:
            if c not in old.columns:
                raise ValueError(f"column {c} does not exist")
        new = keep(old.withColumn("@hit", F.coalesce(cond, F.lit(False))).select("@hit", *[F.when(F.col("@hit"), F.expr(made[c]).cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in old.columns]))
        new.drop("@hit").createOrReplaceTempView(name)
        return new.where("`@hit`").drop("@hit").selectExpr(*split_top(returning)) if returning else None

    def delete(self, name, where, returning):
        old = self.spark.table(name)
        cond = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        gone = keep(old.where(cond)) if returning else None
        self.swap(name, old.where(~cond))
        return gone.selectExpr(*split_top(returning)) if returning else None

    def truncate(self, name):
        self.swap(name, self.spark.table(name).limit(0))

    def create_as(self, name, text):
        self.engine.run(text).createOrReplaceTempView(name)

    def create_table(self, name, columns):
        cols = []
        for c in split_top(columns):
            n, kind = re.match(r"(\w+)\s+([\w]+(?:\([^)]*\))?)", c).groups()
            cols.append(f"{n} {TYPES.get(kind.lower(), kind)}")
        self.spark.createDataFrame([], ", ".join(cols)).createOrReplaceTempView(name)

    def drop(self, name):
        self.spark.catalog.dropTempView(name)

    # -- functions and maintenance --
    def create_function(self, name, args, returns, quoted, dollars, expression):
        """A function of one SQL expression, for both languages; arguments go by name or $1, $2."""
        body = expression or re.sub(r"(?is)^\s*select\s+(.*?)\s*;?\s*$", r"\1", (quoted or "").replace("''", "'") or dollars)
        given = []
        for k, a in enumerate(split_top(args) if args.strip() else [], 1):
            n, _, kind = a.rpartition(" ")
            n = n.strip() or f"arg{k}"
            given.append(f"{n} {TYPES.get(kind.lower(), kind)}")
            body = re.sub(rf"\${k}\b", n, body)
        kind = TYPES.get(returns.removesuffix("[]").lower(), returns.removesuffix("[]"))
        kind = f"array<{kind}>" if returns.endswith("[]") else kind
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(given)}) RETURNS {kind} RETURN {sqltext.rewrite(body)}")
        functions.USER.add(name.lower())

    def drop_function(self, name):
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        functions.USER.discard(name.lower())

    def nothing(self, what):
        """Statistics and space are Spark's own business."""
        return self.spark.createDataFrame([(what.lower(),)], "done string")
