"""Helpers that the operators of this package share: scratch tables, groups of text, and word hashing in numpy."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one group of documents holds; a Python worker keeps a few times as much.
GROUP_BYTES = 8 << 20
#: Bytes that are hashed at once.
STRIDE = 1 << 20
#: Bytes of a batch in which a group's result goes back.
BATCH_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """doc_id, or for a null doc_id a long from 2**62 on by the text's hash."""
    hashed = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col("doc_id").cast("long"), hashed)


def text_key() -> Column:
    """A struct of two longs that tells rows of different doc_ids or texts apart, null doc_ids included."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("t"))


#: What is sent to every executor has at most so many bytes.
BROADCAST_BYTES = 48 << 20


def fits_broadcast(rows: int, width: int) -> bool:
    """Whether a table of so many rows of `width` bytes (as a hash table in memory) may be sent to every executor."""
    return rows * width <= BROADCAST_BYTES


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if a few files give fewer; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes too, and lets local workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    if spark.sparkContext.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names; a temporary one only for a local session that names none. What is left of them goes when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    run = f"{base.rstrip('/')}/graphloom/{spark.sparkContext.applicationId}"
    if run not in _runs:
        _runs.add(run)
        atexit.register(_delete_if_running, spark, run)
    return f"{run}/{uuid.uuid4().hex}"


_runs: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _delete_if_running(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        _delete(spark, path)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows depends on files, not on executors."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def discard(df: DataFrame | None) -> None:
    """Deletes what materialize wrote, once nothing reads it any more; other tables are left alone."""
    if (path := getattr(df, "_written", None)) is not None:
        _delete(df.sparkSession, path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.select(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0


def group_count(spark: SparkSession, size: int, group_bytes: int = GROUP_BYTES) -> int:
    """Groups of about group_bytes each; of small inputs, enough groups for the cores, of a megabyte at least."""
    return max(1, -(-size // group_bytes), min(spark.sparkContext.defaultParallelism, size >> 20))


def _spark_hash(k: np.ndarray) -> np.ndarray:
    """Spark's hash() of an int column: Murmur3 of four bytes, seed 42."""
    turn = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    h = turn(k.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(h ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def group_keys(n: int) -> list[int]:
    """For each of n partitions an integer that hash partitioning into n sends there, so that one group fills one partition."""
    found, start, step = np.full(n, -1, np.int64), 0, 16 * n + 64
    while (found < 0).any():
        k = np.arange(start, start + step)
        p, first = np.unique(_spark_hash(k).astype(np.int64) % n, return_index=True)
        found[p] = np.where(found[p] < 0, k[first], found[p])
        start += step
    return found.tolist()


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """docs with an int column grp, dealt out so that each group is whole in one partition. A group is a set of documents of bounded size, chosen by a hash of doc_id and text; a document is never split."""
    keys = group_keys(groups)
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(groups)).cast("int")
    return docs.withColumn("grp", F.array(*[F.lit(k) for k in keys])[at] if groups <= 4096 else at).repartition(groups, "grp")


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: After a call of release() memory is given back once more at each of these times, in seconds: workers idle between tasks.
LATER = (0.5, 1.5, 4.0)
_pending: list[threading.Timer] = []


def release() -> None:
    """Gives memory that earlier groups of a worker left unused back to the system, now and when the worker is idle."""
    _trim()
    _pending[:] = [t for t in _pending if t.is_alive()]
    if not _pending:
        for seconds in LATER:
            timer = threading.Timer(seconds, _trim)
            timer.daemon = True
            timer.start()
            _pending.append(timer)


def in_batches(t: pa.Table) -> pa.Table:
    """t in chunks of about BATCH_BYTES: a result goes back chunk by chunk, and the JVM holds one at a time."""
    return pa.Table.from_batches(t.to_batches(max_chunksize=max(1, t.num_rows * BATCH_BYTES // max(1, t.nbytes))), t.schema)


def per_partition(fn: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function that calls fn for each group in the partition."""

    def run(batches):
        whole = list(batches)
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        grp = table.column("grp").to_numpy()
        for g in np.unique(grp):
            yield from fn(table if (same := grp == g).all() else table.filter(pa.array(same)))
            release()

    return run


# ---- words and their hashes, without Python objects for words ----

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: The multiplier is odd, so it has an inverse modulo 2**64.
R = 0x9E3779B97F4A7C15
R_INV = pow(R, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for r in (R, R_INV):
            x = np.full(max(n, 1 << 20), r, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and row offsets of a string column, some rows at a time; null counts as empty."""
    for a in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(a):
            continue
        a = a.cast(pa.large_string()) if a.type != pa.large_string() else a
        if a.null_count:
            a = a.fill_null("")
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
        data = np.frombuffer(a.buffers()[2], np.uint8) if off[-1] > off[0] else np.zeros(0, np.uint8)
        at = 0
        while at < len(a):
            # Rows of about a megabyte together: what is computed for each byte stays small.
            to = max(at + 1, int(np.searchsorted(off, off[at] + STRIDE, side="right")) - 1)
            yield data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+, and the number of words of each row; a row's end also ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, off))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes."""
    pw, inv = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * pw[:-1], out=total[1:])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


def words_of(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column in order, and the number of words of each row."""
    ids, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for data, off in text_buffers(column):
        data = LOWER[data] if lower else data
        start, end, n = spans(data, off)
        ids.append(word_hashes(data, start, end))
        counts.append(n)
    return np.concatenate(ids), np.concatenate(counts)


def words_with_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words_of, and the words' bytes: word i is data[at[i] : at[i + 1] - 1], with one space after each word."""
    ids, counts, parts, ats, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], 0
    for data, off in text_buffers(column):
        start, end, n = spans(data, off)
        ids.append(word_hashes(data, start, end))
        counts.append(n)
        size = end - start + 1
        at = np.cumsum(size) - size
        flat = np.full(int(size.sum()), 0x20, np.uint8)
        inside = np.ones(len(flat), bool)
        inside[at + size - 1] = False
        keep = ~SPACE[data]
        flat[inside] = data[keep]
        parts.append(flat)
        ats.append(at + base)
        base += len(flat)
    ats.append(np.array([base]))
    return np.concatenate(ids), np.concatenate(counts), np.concatenate(parts), np.concatenate(ats)


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive ids."""
    n = max(0, len(ids) - k + 1)
    h = np.zeros(n, np.uint64)
    m = 1
    for j in range(k):
        m = m * R % (1 << 64)
        h += ids[j : j + n] * np.uint64(m)
    return mix(h)


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
