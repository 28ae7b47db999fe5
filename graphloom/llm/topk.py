"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors are dealt into blocks and queries into blocks; each pair of blocks is one task's unit, so memory is bounded whatever
the sizes. A block's index is built once for as many queries as vectors; tables within one block of queries build each index once. In a block each dimension has its postings (vector, value) sorted by value and cut into segments of one quantised
value. For a query, segments of all dimensions are taken by descending impact (the query's component times the segment's
limit, above the dimension's floor). Each unseen posting of a dimension adds at most that of the dimension's next segment, so
floor + what a vector has + the sum of these limits bounds its score. Processing stops when the vectors whose bound reaches the
k-th best assured score are few (or nothing is left); these are scored again exactly. No vector is left out without that proof.

Vectors that are null, or hold null or non-finite components, take no part, as a vector of no components. Vectors meet only
vectors with as many components. A vec_id that occurs more than once counts as several candidates, and once as a query: that with the
smallest vector. Columns other than vec_id and vector are ignored; an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Quantised values of a dimension.
LEVELS = 16
#: A query's processing looks for proof after each such share of all segments, and stops when at most this many vectors (or a fiftieth) may belong to the result.
LOOKS, FEW = 24, 256


class Block:
    """Impact-ordered postings of one block of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, dims = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        dim, lo, hi, docs, vals = [], [], [], [], []
        for d in range(dims):
            v = vectors[order[:, d], d]
            step = max(1, -(-(int(v[-1]) - int(v[0]) + 1) // LEVELS))
            level = (v - v[0]) // step
            cuts = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1], [True])))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                dim.append(d)
                lo.append(v[s])
                hi.append(v[e - 1])
                docs.append(order[s:e, d])
                vals.append(v[s:e])
        self.dim, self.lo, self.hi, self.docs, self.vals = np.array(dim), np.array(lo), np.array(hi), docs, vals
        self.first = np.flatnonzero(np.concatenate(([True], self.dim[1:] != self.dim[:-1])))
        self.least, self.most = vectors.min(axis=0), vectors.max(axis=0)

    def search(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best (ties all kept), without the rows of skip."""
        n = len(self.vectors)
        q = query[self.dim]
        floor_by_dim = np.where(query >= 0, query * self.least, query * self.most)
        floor = int(floor_by_dim.sum())
        impact = np.where(q >= 0, q * self.hi, q * self.lo) - floor_by_dim[self.dim]
        order = np.argsort(-impact, kind="stable")
        # What is left of a dimension after its segments so far: the impact of its next one.
        by_dim = np.lexsort((-impact, self.dim))
        after = np.zeros(len(impact), np.int64)
        same = self.dim[by_dim[1:]] == self.dim[by_dim[:-1]]
        after[by_dim[:-1][same]] = impact[by_dim[1:][same]]
        rest = int(impact[by_dim[self.first]].sum()) if len(self.first) else 0
        have = np.zeros(n, np.int64)
        have[skip] = -(1 << 60)
        look = max(1, len(order) // LOOKS)
        few = max(FEW, n // 50)
        may = None
        for at, s in enumerate(order):
            have[self.docs[s]] += q[s] * self.vals[s] - floor_by_dim[self.dim[s]]
            rest += int(after[s] - impact[s])
            if at % look == look - 1 and at > len(order) // 4 and n > k:
                assured = np.partition(have, n - k)[n - k]
                may = np.flatnonzero(have + rest >= assured)
                if len(may) <= few:
                    break
                may = None
        if may is None:
            may = np.arange(n)
            scores = have + floor
        else:
            scores = self.vectors[may] @ query
        ok = ~np.isin(may, skip)
        may, scores = may[ok], scores[ok]
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            may, scores = may[scores >= least], scores[scores >= least]
        return may, scores


def top_k(vectors: DataFrame, is_query, k: int = 10, vector_block: int = 16384, query_block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors(vec_id, vector array<long>) that is_query marks, against all others; ties go to the smaller vec_id."""
    spark = vectors.sparkSession
    prepare(spark)
    table = materialize(vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "vector", F.size("vector").alias("dims"), is_query.alias("q")))
    n, nq = table.agg(F.count("*"), F.count_if("q")).first()
    nv, nq = max(1, -(-n // vector_block)), max(1, -(-nq // query_block))
    vb, qb = F.pmod(F.xxhash64("vec_id"), F.lit(nv)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(nq)).cast("int")
    stored = table.select(F.lit(False).alias("q"), vb.alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), "dims", "vec_id", "vector")
    asked = table.where("q").groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector")).select(F.lit(True).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"), qb.alias("qb"), "dims", "vec_id", "vector")

    def cell(t: pa.Table) -> pa.Table:
        q = t.column("q").to_numpy()
        ids = t.column("vec_id").to_numpy()
        dims = t.column("dims")[0].as_py()
        flat = t.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        if q.any() and not q.all():
            block, own = Block(flat[~q]), ids[~q]
            for qid, query in zip(ids[q], flat[q], strict=True):
                rows, scores = block.search(query, k, np.flatnonzero(own == qid))
                best = np.lexsort((own[rows], -scores))[:k]
                for o, x in zip(out, (np.full(len(best), qid), own[rows][best], scores[best]), strict=True):
                    o.append(x)
        return pa.table([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    found = stored.unionByName(asked).groupBy("vb", "qb", "dims").applyInArrow(cell, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, vector: floor(scale * x) of each component; null for vectors that take no part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.select("vec_id", F.when(~bad, F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))).alias("vector"))
