"""Sums of counts by key, asked for by groups of documents.

Tables of n-gram counts grow with the corpus and fit in no worker, and a row for each token of each document would cost many
times the text. Here a group of documents asks once for each distinct key it has. Its sorted keys travel as packed rows, one for
each range of keys (bucket); the bucket's task adds up what all groups sent and answers each group with the totals of its own
keys in the same order. Both sides find the order again by sorting, so it need not travel. A key costs about five bytes, and
equal keys of a group were added up before, so no key is frequent in a bucket.

A key has 64 bits (kind "wide", all of them travel) or 46 (kind "short": 4 bytes and a count for each 14-bit head).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches, release

SHORT_BITS = 46
HEAD_BITS = SHORT_BITS - 32
ASK = "grp int, bucket int, kind string, heads binary, keys binary, small binary, large binary"
ANSWER = "grp int, bucket int, kind string, small binary, large binary"
_ASK = pa.schema([("grp", pa.int32()), ("bucket", pa.int32()), ("kind", pa.string()), ("heads", pa.binary()), ("keys", pa.binary()), ("small", pa.binary()), ("large", pa.binary())])
_ANSWER = pa.schema([("grp", pa.int32()), ("bucket", pa.int32()), ("kind", pa.string()), ("small", pa.binary()), ("large", pa.binary())])


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - SHORT_BITS)


def pack_counts(n: np.ndarray) -> tuple[bytes, bytes]:
    """A byte for each count below 255; the others follow as longs."""
    return np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype("<i8").tobytes()


def unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    n = np.frombuffer(small, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(large, "<i8")
    return n


def ask(grp: int, kind: str, keys: np.ndarray, counts: np.ndarray, buckets: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows for sorted distinct keys; buckets names each range of keys."""
    bits = 64 if kind == "wide" else SHORT_BITS
    # Ranges are of equal width; the numbers below are exact for up to 2**24 buckets.
    of = ((keys >> np.uint64(bits - 40)) * np.uint64(len(buckets)) >> np.uint64(40)).astype(np.int64)
    ends = np.searchsorted(of, np.arange(len(buckets) + 1))
    rows = []
    for b, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if s == e:
            continue
        part = keys[s:e]
        if kind == "wide":
            heads, low = b"", part.astype("<u8").tobytes()
        else:
            head = (part >> np.uint64(32)).astype(np.int64)
            heads = np.concatenate(([head[0]], np.bincount(head - head[0]))).astype("<u4").tobytes()
            low = part.astype("<u4").tobytes()
        rows.append((grp, buckets[b], kind, heads, low, *pack_counts(counts[s:e])))
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 64], strict=True), _ASK, strict=True)], schema=_ASK)


def _keys(kind: str, heads: bytes, low: bytes) -> np.ndarray:
    if kind == "wide":
        return np.frombuffer(low, "<u8")
    h = np.frombuffer(heads, "<u4").astype(np.uint64)
    return np.repeat(np.arange(h[0], int(h[0]) + len(h) - 1, dtype=np.uint64), h[1:].astype(np.int64)) << np.uint64(32) | np.frombuffer(low, "<u4").astype(np.uint64)


def _answer(t: pa.Table) -> pa.Table:
    release()
    out = []
    names = ("grp", "bucket", "kind", "heads", "keys", "small", "large")
    rows = list(zip(*(t.column(n).to_pylist() for n in names), strict=True))
    for kind in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == kind]
        keys = [_keys(kind, r[3], r[4]) for r in own]
        counts = np.concatenate([unpack_counts(r[5], r[6]) for r in own])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)[at]
        s = 0
        for r, k in zip(own, keys, strict=True):
            out.append((r[0], r[1], kind, *pack_counts(total[s : s + len(k)])))
            s += len(k)
    return in_batches(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ANSWER, strict=True)], schema=_ANSWER))


def answers(asked: DataFrame, buckets: int) -> DataFrame:
    """One row of totals for each row asked."""
    return asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer, ANSWER)


def totals(t: pa.Table, kind: str, buckets: list[int]) -> np.ndarray:
    """From the answers to one group: the totals of its keys of a kind, in the order of the sorted distinct keys."""
    place = {b: i for i, b in enumerate(buckets)}
    rows = [(place[b], s, g) for b, k, s, g in zip(*(t.column(n).to_pylist() for n in ("bucket", "kind", "small", "large")), strict=True) if k == kind]
    rows.sort(key=lambda r: r[0])
    return np.concatenate([unpack_counts(s, g) for _, s, g in rows]) if rows else np.zeros(0, np.int64)
