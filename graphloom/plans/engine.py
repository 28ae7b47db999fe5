"""Sessions: graph statements and SQL over one catalog."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators import writes
from ..sources.catalog import Catalog
from . import sqltext
from .compiler import Compiler, Rows, names_in
from .parser import parse
from .statements import Statements

UPDATES = {"create", "merge", "set_props", "delete"}
SQL = re.compile(r"\s*(select|table|values|explain|from|insert|show|describe)\b|\s*with\s+(recursive\s+)?\w+\s*(\([^)]*\)\s*)?as\s*(not\s+materialized\s*|materialized\s*)?\(", re.I)


class Engine:
    """Runs statements of either language. Graph statements go to the graph in use."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.catalog = spark, catalog or Catalog(spark)
        self.statements = Statements(self)

    def run(self, text: str, params: dict | None = None) -> DataFrame | None:
        """The result of a statement; None if it only changes the catalog or a graph."""
        done, result = self.statements.run(text)
        if done:
            return result
        if SQL.match(text):
            return self.spark.sql(sqltext.rewrite(sqltext.distinct_parts(text, self.columns)), args=params or None)
        return self.cypher(text, params)

    def columns(self, table: str) -> list[str] | None:
        return self.spark.table(table).columns if self.spark.catalog.tableExists(table) else None

    def cypher(self, text: str, params: dict | None = None) -> DataFrame | None:
        tree = parse(text)
        if tree[0] == "use":
            self.catalog.use(tree[1])
        elif tree[0] == "create_graph":
            self.catalog.create(tree[1])
        elif tree[0] == "drop_graph":
            self.catalog.drop(tree[1])
        elif tree[0] == "query" and any(c[0] in UPDATES for c in tree[1]):
            return self.update(tree, params)
        else:
            compiler = Compiler(self.catalog.graph if self.catalog.used else None, params, self.spark)
            return compiler.returned(compiler.query(tree))
        return None

    def update(self, tree: tuple, params: dict | None = None) -> DataFrame | None:
        """Runs clauses in order; each updating one replaces labels of the graph before the next reads them."""
        graph = self.catalog.graph
        before = dict(graph.labels)
        compiler = Compiler(graph, params, self.spark)
        compiler.used = names_in(tree[1]) | {"*"}
        rows = Rows(None, {})
        try:
            for k, c in enumerate(tree[1]):
                rows = writes.apply(compiler, c, rows) if c[0] in UPDATES else compiler.clause(c, rows, k == 0)
        except Exception:
            graph.labels = before
            raise
        return compiler.returned(rows) if tree[1][-1][0] == "return" else None
