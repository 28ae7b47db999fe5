"""Graphs over DataFrames: labels, entity ids, and where a label's rows come from.

An entity id is a long: the label's number shifted left by 48 bits, or'ed with the entry, which starts at 1. A label's table may
be given as a function, which is called when a query first needs it: a graph of many labels costs nothing for those unused. The
table is a lazy DataFrame, so scans read only the columns that a query uses and push its filters into the files.

Edges that come from a vertex table's foreign key carry that vertex: the edge row has the vertex's columns too, so a pattern
that visits both reads the table once instead of joining it with itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dynamic

ENTRY_BITS = 48


def entity_id(label_id: int, entry: Column) -> Column:
    return F.lit(label_id << ENTRY_BITS).bitwiseOR(entry.cast("bigint"))


def label_of(entity: Column) -> Column:
    return F.shiftrightunsigned(entity, ENTRY_BITS)


Source = DataFrame | Callable[[], DataFrame]


class Label:
    """A vertex or edge label. Its table has _id (edges also _start and _end), the properties, and what an edge carries under names with ^."""

    def __init__(self, name: str, number: int, kind: str, source: Source, start: str | None = None, end: str | None = None, carries: str | None = None, parents: tuple[str, ...] = ()):
        self.name, self.number, self.kind, self.start, self.end, self.carries, self.parents = name, number, kind, start, end, carries, parents
        self._source = source

    @property
    def df(self) -> DataFrame:
        if callable(self._source):
            self._source = self._source()
        return self._source

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c[0] not in "_^"]


@dataclass
class Graph:
    name: str
    labels: dict[str, Label] = field(default_factory=dict)
    unique: set[tuple[str, str]] = field(default_factory=set)
    indexes: dict[tuple[str, str], object] = field(default_factory=dict)

    def next_number(self) -> int:
        return max((x.number for x in self.labels.values()), default=0) + 1

    def add_vertices(self, label: str, source: Source, key: str | Column, parents: tuple[str, ...] = ()) -> Label:
        """Registers a table's rows as vertices; key + 1 is the entry, so keys start at 0."""
        number = self.next_number()

        def table() -> DataFrame:
            df = source() if callable(source) else source
            at = F.col(key) if isinstance(key, str) else key
            return df.select(entity_id(number, at.cast("bigint") + 1).alias("_id"), *df.columns)

        self.labels[label] = Label(label, number, "v", table, parents=parents)
        return self.labels[label]

    def add_edges(self, label: str, source: Source, key: str | Column, start: tuple[str, str], end: tuple[str, str], props: list[str] | None = None, carries: str | None = None) -> Label:
        """Registers a table's rows as edges between the vertices that the key columns of start and end (label, column) name. carries: "start" or "end" if it is that vertex label's own table."""
        number = self.next_number()
        numbers = [self.labels[x].number for x, _ in (start, end)]
        held_by = self.labels[(start if carries == "start" else end)[0]] if carries else None

        def table() -> DataFrame:
            df = source() if callable(source) else source
            at = F.col(key) if isinstance(key, str) else key
            ends = [entity_id(n, F.col(c).cast("bigint") + 1) for n, (_, c) in zip(numbers, (start, end), strict=True)]
            held = [F.col(c).alias(f"^{c}") for c in held_by.props] if held_by else []
            return df.select(entity_id(number, at.cast("bigint") + 1).alias("_id"), ends[0].alias("_start"), ends[1].alias("_end"), *(df.columns if props is None else props), *held)

        self.labels[label] = Label(label, number, "e", table, start[0], end[0], carries)
        return self.labels[label]

    def add_empty(self, label: str, kind: str, spark: SparkSession, parents: tuple[str, ...] = ()) -> Label:
        """A label without rows."""
        if label in self.labels:
            raise ValueError(f"label {label} exists")
        schema = "_id long" + (", _start long, _end long" if kind == "e" else "")
        self.labels[label] = Label(label, self.next_number(), kind, spark.createDataFrame([], schema), parents=parents)
        return self.labels[label]

    def replace(self, label: Label) -> None:
        for name, prop in self.unique:
            if name == label.name and prop in label.props:
                self._check_unique(label, prop)
        self.labels[label.name] = label

    @staticmethod
    def _check_unique(label: Label, prop: str) -> None:
        if not label.df.where(F.col(prop).isNotNull()).groupBy(prop).count().where("count > 1").isEmpty():
            raise ValueError(f"two entities of {label.name} have the same {prop}")

    def require_unique(self, label: str, prop: str) -> None:
        """From now on, a statement that gives two entities of a label the same value of a property fails."""
        if prop in self.labels[label].props:
            self._check_unique(self.labels[label], prop)
        self.unique.add((label, prop))

    def index(self, label: str, prop: str, lists: int = 100, metric: str = "l2"):
        """Builds an inverted-file index of a label's vectors; see operators.nearest.IvfIndex."""
        from ..operators.nearest import IvfIndex

        self.indexes[label, prop] = IvfIndex(self.labels[label].df, prop, lists, metric)
        return self.indexes[label, prop]

    def drop(self, label: str) -> None:
        if self.labels[label].kind == "v" and any(label in (x.start, x.end) for x in self.labels.values()):
            raise ValueError(f"edge labels use vertex label {label}")
        del self.labels[label]

    def family(self, name: str | None, kind: str) -> list[Label]:
        """The labels of a kind that a pattern's label stands for: itself and its descendants, or all."""
        if name is None:
            return [x for x in self.labels.values() if x.kind == kind]
        if name in self.labels and self.labels[name].kind != kind:
            raise ValueError(f"label {name} is not a {'vertex' if kind == 'v' else 'edge'} label")
        names = {name}
        while more := {x.name for x in self.labels.values() if set(x.parents) & names} - names:
            names |= more
        return [x for x in self.labels.values() if x.name in names and x.kind == kind]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames; a column of types that do not fit together becomes one of dynamic values."""
    types: dict[str, list] = {}
    for f in frames:
        for x in f.schema:
            types.setdefault(x.name, []).append(x.dataType)
    odd = [c for c, t in types.items() if dynamic.mixed(t)]
    if odd:
        frames = [f.withColumns({c: dynamic.encode(F.col(c), f.schema[c].dataType) for c in odd if c in f.columns}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Catalog:
    """Graphs of a session; one is in use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.graphs, self.used = spark, {}, None

    def create(self, name: str) -> Graph:
        if name in self.graphs:
            raise ValueError(f"graph {name} exists")
        self.graphs[name] = Graph(name)
        self.used = self.used or name
        return self.graphs[name]

    def use(self, name: str) -> Graph:
        if name not in self.graphs:
            raise ValueError(f"graph {name} does not exist")
        self.used = name
        return self.graphs[name]

    def drop(self, name: str) -> None:
        self.graphs.pop(name)
        if self.used == name:
            self.used = None

    @property
    def graph(self) -> Graph:
        if self.used is None:
            raise ValueError("no graph is in use")
        return self.graphs[self.used]


def trade_graph(catalog: Catalog, read) -> Graph:
    """The trade tables as a graph; read(name) gives a table."""
    g = catalog.create("trade") if "trade" not in catalog.graphs else Graph("trade")
    catalog.graphs["trade"] = g
    catalog.use("trade")
    late = lambda table: lambda: read(table)
    for label, table, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Orders", "orders", "o_orderkey"), ("Event", "events", "event_id"), ("Document", "documents", "doc_id"), ("Vec", "embeddings", "vec_id")):
        g.add_vertices(label, late(table), key)
    g.add_edges("IN_REGION", late("nation"), "n_nationkey", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), [], "start")
    g.add_edges("LIVES_IN", late("customer"), "c_custkey", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), [], "start")
    g.add_edges("BASED_IN", late("supplier"), "s_suppkey", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), [], "start")
    g.add_edges("PLACED", late("orders"), "o_orderkey", ("Customer", "o_custkey"), ("Orders", "o_orderkey"), [], "end")
    # Four columns name a line; the hash keeps an id of 48 bits without a global sort.
    line = F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), F.lit((1 << ENTRY_BITS) - 2))
    g.add_edges("CONTAINS", late("lineitem"), line, ("Orders", "l_orderkey"), ("Part", "l_partkey"))
    g.add_edges("FULFILLED_BY", late("lineitem"), line, ("Orders", "l_orderkey"), ("Supplier", "l_suppkey"))
    after = "lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id"
    g.add_edges("NEXT", lambda: read("events").selectExpr("event_id", after, "user_id").where("next_id IS NOT NULL"), "event_id", ("Event", "event_id"), ("Event", "next_id"), ["user_id"])
    return g
