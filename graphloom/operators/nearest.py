"""Nearest vectors: exact top-k, and an inverted-file index of clusters that a query probes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from .trails import shared_folder

DISTANCES = {"l2": vectors.l2, "ip": vectors.negative_inner, "cosine": vectors.cosine, "l1": vectors.l1}
#: Rows that train centroids, as a floor and for each list.
SAMPLE, PER_LIST = 10_000, 50
#: Queries and rows that meet in a task, and pairs of them whose distances are held at once.
QUERY_BLOCK, VECTOR_BLOCK, PAIRS = 8192, 16384, 1 << 22


def top_k(df: DataFrame, column: str, query: list[float], k: int, metric: str = "l2", key: str = "vec_id") -> DataFrame:
    """The k nearest rows with their distance; ties go to the smaller key."""
    d = DISTANCES[metric](F.col(column), F.array(*[F.lit(float(x)) for x in query]))
    return df.withColumn("distance", d).orderBy("distance", key).limit(k)


def _exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a and b, added up component by component as the functions of vectors do, so that ties stay ties."""

    def fold(x, y, f):
        s = np.zeros(len(x))
        for d in range(x.shape[1]):
            s += f(x[:, d], y[:, d])
        return s

    inner = lambda x, y: fold(x, y, np.multiply)
    if metric == "l1":
        return fold(a, b, lambda x, y: np.abs(x - y))
    if metric == "l2":
        return np.sqrt(fold(a, b, lambda x, y: (x - y) * (x - y)))
    return -inner(a, b) if metric == "ip" else 1.0 - inner(a, b) / (np.sqrt(inner(a, a)) * np.sqrt(inner(b, b)))


def _nearest_pairs(metric: str, q: np.ndarray, v: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q its k nearest of v: rows of q, rows of v, distances. Ties go to the smaller place. Products of matrices leave few pairs, with a margin for their rounding; these are computed exactly."""
    out = []
    vn, step = (v * v).sum(axis=1), max(1, PAIRS // len(v))
    for s in range(0, len(q), step):
        part = q[s : s + step]
        pn = (part * part).sum(axis=1)
        if len(v) <= k:
            near = np.ones((len(part), len(v)), bool)
        else:
            if metric == "l1":
                d, slack = np.zeros((len(part), len(v))), np.zeros(len(part))
                for c in range(v.shape[1]):
                    d += np.abs(part[:, c, None] - v[None, :, c])
            elif metric == "l2":
                d, slack = pn[:, None] + vn[None] - 2 * part @ v.T, 1e-9 * (pn + vn.max())
            elif metric == "ip":
                d, slack = -part @ v.T, 1e-9 * np.sqrt(pn * vn.max())
            else:
                d, slack = 1 - part @ v.T / np.sqrt(pn[:, None] * vn[None]), np.full(len(part), 1e-9)
            # What is no number is kept: it comes last.
            near = ~(d > (np.partition(d, k - 1, axis=1)[:, k - 1] + slack)[:, None])
        rows, cols = np.nonzero(near)
        exact = np.concatenate([_exact(metric, part[rows[x : x + PAIRS // 16]], v[cols[x : x + PAIRS // 16]]) for x in range(0, len(rows), PAIRS // 16)] or [np.zeros(0)])
        order = np.lexsort((place[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out.append((rows[keep] + s, cols[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cell(metric: str, k: int, names: list[str]):
    """A function of a block of queries and a block of vectors, as Arrow tables."""

    def matrix(t: pa.Table, column: str) -> np.ndarray:
        return np.array(t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(t), -1)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, keys = asked.column("query_id"), held.column("key")
        if not len(asked) or not len(held):
            return pa.table([ids.slice(0, 0), keys.slice(0, 0), pa.array([], pa.float64())], names=names)
        place = np.empty(len(held), np.int64)
        place[pc.sort_indices(keys).to_numpy()] = np.arange(len(held))
        rows, cols, found = _nearest_pairs(metric, matrix(asked, "query"), matrix(held, "vector"), place, k)
        return pa.table([ids.take(pa.array(rows)), keys.take(pa.array(cols)), pa.array(found)], names=names)

    return run


class IvfIndex:
    """Rows by their nearest of `lists` centroids. Rows are assigned once and written in one folder for each list; a search reads the folders of the nearest `probes` centroids."""

    def __init__(self, df: DataFrame, column: str, lists: int = 100, metric: str = "l2", seed: int = 1, rounds: int = 10, path: str | None = None):
        if not 1 <= lists <= 32768:
            raise ValueError("lists must be between 1 and 32768")
        self.column, self.metric, self.path = column, metric, path or shared_folder(df.sparkSession)
        want = max(SAMPLE, PER_LIST * lists)
        n = df.count()
        # A bounded sample trains the centroids; every row is indexed.
        rows = df.select(column).where(F.col(column).isNotNull()).sample(min(1.0, 1.2 * want / max(n, 1)), seed).limit(want).toPandas()[column]
        x = np.array(rows.tolist(), np.float64)
        self.centroids = self._train(self._unit(x), lists, seed, rounds) if len(x) else np.zeros((0, 1))
        # At most 32768 centroids, whatever the input. Rows without a vector are in no list.
        df.where(F.col(column).isNotNull()).withColumn("list", self._nearest(1)(F.col(column))[0]).write.mode("overwrite").partitionBy("list").parquet(self.path)
        self.df = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("list", T.IntegerType())])).parquet(self.path)

    def _nearest(self, probes: int):
        """A function of vectors that gives the numbers of their nearest centroids."""
        table, lengths = self.centroids, self.metric in ("l2", "l1")

        @F.pandas_udf("array<int>")
        def near(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), np.float64).reshape(len(v), -1)
            x = x if lengths else x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            out = []
            for s in range(0, len(x), 1024):
                d = (table**2).sum(axis=1)[None] - 2 * x[s : s + 1024] @ table.T
                out += np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32).tolist()
            return pd.Series(out)

        return near

    def _unit(self, x: np.ndarray) -> np.ndarray:
        """Directions only, where the metric has no lengths."""
        return x if self.metric in ("l2", "l1") else x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def _train(self, x: np.ndarray, lists: int, seed: int, rounds: int) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(seed))
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            at = np.concatenate([((c**2).sum(1)[None] - 2 * x[s : s + 4096] @ c.T).argmin(axis=1) for s in range(0, len(x), 4096)])
            many = np.bincount(at, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            c = self._unit(np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], c))
        return c

    def search(self, query: list[float], k: int, probes: int = 1, key: str = "vec_id") -> DataFrame:
        q = self._unit(np.array(query, np.float64))
        near = np.argsort(((self.centroids - q) ** 2).sum(axis=1))[:probes].tolist()
        return top_k(self.df.where(F.col("list").isin(near)), self.column, query, k, self.metric, key)

    def search_all(self, queries: DataFrame, k: int, probes: int = 1, key: str = "vec_id") -> DataFrame:
        """query_id, rank, key, distance for each row of queries(query_id, query): each meets the rows of its lists only. A block of queries meets a block of a list's rows in one task, whatever the sizes, and leaves the k nearest of that block."""
        nq = F.lit(max(1, -(-queries.count() // QUERY_BLOCK))).cast("bigint")
        sizes = self.df.groupBy("list").agg(F.ceil(F.count("*") / VECTOR_BLOCK).alias("blocks"))
        part = lambda of, n: F.pmod(F.xxhash64(of), n)
        asked = queries.select("query_id", "query", F.explode(self._nearest(probes)(F.col("query"))).alias("list")).join(F.broadcast(sizes), "list")
        asked = asked.select("list", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("vb"), part("query_id", nq).alias("qb"), "query_id", "query")
        held = self.df.join(F.broadcast(sizes), "list").select("list", part(key, F.col("blocks")).alias("vb"), F.explode(F.sequence(F.lit(0).cast("bigint"), nq - 1)).alias("qb"), F.col(key).alias("key"), F.col(self.column).alias("vector"))
        kinds = {"query_id": queries.schema["query_id"].dataType, key: self.df.schema[key].dataType, "distance": T.DoubleType()}
        schema = T.StructType([T.StructField(n, kind) for n, kind in kinds.items()])
        met = asked.groupBy("list", "vb", "qb").cogroup(held.groupBy("list", "vb", "qb")).applyInArrow(_cell(self.metric, k, list(kinds)), schema)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
        return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "distance")
