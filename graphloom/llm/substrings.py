"""Removal of repeated passages by prefix-partitioned suffix trees.

Word sequences of all documents are suffixes of one long text. A window of `window` words repeats if it ends on or below an internal
node of that depth in the text's suffix tree; the node's leaves name the documents. The tree is never built whole:

1. Suffixes are sampled and dealt by prefix. Each window has an anchor, the `prefix` consecutive words in it with the smallest
   hash, the same wherever the window occurs. Groups of documents ask how many groups have each anchor (exchange.py, about five
   bytes each); a window whose anchor no other group has can only repeat inside its group, where it is found directly.
2. For the others, a record of the anchor and the words around it (all windows that have it as their anchor) goes to the subtrees of
   its bucket. Prefixes have one of two lengths: where more than `heavy` groups share an anchor it is too short a prefix, and each
   window is dealt by all of its words. Before that a group keeps only the smallest doc_id of each window.
3. Windows dealt by all their words pass two levels: parts of the groups, as many as the root of the groups that share the anchor,
   keep the smallest document of each window, and these meet. So no task reads a record from every group that has a passage.
4. A bucket's subtrees are built top down, word by word: the suffixes of a node are split by the next words, and nodes of one suffix
   are left alone. Internal nodes of depth `window` remain; the smallest doc_id below one covers the windows of its other leaves.

Records carry the words themselves, compared as 64-bit hashes.

Null texts have no words; texts of any length are read whole. A row with a null doc_id covers no other and is covered by all. Rows that
repeat a doc_id are judged each on its own and do not cover each other (no smaller doc_id). Columns other than doc_id, text and those
of `keep` are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_count, group_keys, grouped, in_batches, mix, per_partition, prepare, ramp, release, text_bytes, window_hashes, words_of, words_with_bytes
from .exchange import ASK, answers, ask, short, totals

WINDOW, PREFIX, HEAVY = 13, 5, 64
RECORD = "bucket int, key long, doc_id long, grp int, row int, at int, mask long, words binary"
_RECORD = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("grp", pa.int32()), ("row", pa.int32()), ("at", pa.int32()), ("mask", pa.int64()), ("words", pa.binary())])


class Windows:
    """The windows of a group's documents, in order of doc_id (rows that are equal in it in order of their texts' hashes)."""

    def __init__(self, t: pa.Table, window: int, prefix: int, bytes_: bool = False):
        if bytes_:
            ids, n, self.data, at = words_with_bytes(t.column("text"))
        else:
            ids, n = words_of(t.column("text"))
        # A null doc_id stands after all others.
        doc = t.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
        # A row is known by its place in this order, which does not hang on the order of arrival.
        ends = np.cumsum(n)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(ids * (np.uint64(2) * np.arange(len(ids), dtype=np.uint64) + np.uint64(1)))))
        self.order = np.lexsort((sums[ends] - sums[ends - n], n, doc))
        self.n, self.doc = n[self.order], doc[self.order]
        of = np.repeat((ends - n)[self.order], self.n) + ramp(self.n)
        self.ids = ids[of]
        del ids, sums
        if bytes_:
            self.byte, self.size = at[of].astype(np.int32), np.diff(at)[of].astype(np.int32)
            del at
        del of
        self.first = np.cumsum(self.n) - self.n
        self.window, self.prefix = window, prefix
        many = np.maximum(self.n - window + 1, 0)
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), many)
        self.at = ramp(many).astype(np.int32)
        self.start = (self.first[self.row] + self.at).astype(np.int32)
        grams = short(window_hashes(self.ids, prefix))
        span = window - prefix + 1
        total = max(0, len(self.ids) - window + 1)
        least, where = grams[:total].copy(), np.zeros(total, np.int8)
        for j in range(1, span):
            less = grams[j : j + total] < least
            least[less] = grams[j : j + total][less]
            where[less] = j
        del grams
        self.anchor, self.offset = least[self.start], where[self.start]
        del least, where
        self.hash = window_hashes(self.ids, window)[self.start]

    def first_in_group(self) -> np.ndarray:
        """For each window, the window of the same words that comes first in the group."""
        order = np.argsort(self.hash, kind="stable").astype(np.int32)
        of = self.hash[order]
        new = np.concatenate(([True], of[1:] != of[:-1]))
        other = np.empty(len(order), np.int32)
        del of
        number = np.cumsum(new, dtype=np.int32)
        number -= 1
        other[order] = order[new][number]
        del order, new, number
        differ = np.flatnonzero(other != np.arange(len(other)))
        same = np.ones(len(differ), bool)
        for j in range(self.window):
            same &= self.ids[self.start[differ] + j] == self.ids[self.start[other[differ]] + j]
        for w in differ[~same]:
            # Two sequences with one hash: compare with all windows that have it.
            all_ = np.flatnonzero(self.hash == self.hash[w])
            mine = self.ids[self.start[w] : self.start[w] + self.window]
            other[w] = next(x for x in all_ if (self.ids[self.start[x] : self.start[x] + self.window] == mine).all())
        return other


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys, ascending."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _asks(buckets, window, prefix):
    def run(t: pa.Table):
        grp, a = t.column("grp")[0].as_py(), _distinct(Windows(t, window, prefix).anchor)
        yield from ask(grp, "short", a, np.ones(len(a), np.int64), buckets)

    return per_partition(run)


def _runs(row: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first, last + 1) of runs of consecutive window starts."""
    if not len(row):
        return []
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1))))
    last = np.concatenate((cut[1:], [len(row)])) - 1
    return [row[cut], at[cut], at[last] + 1]


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[start : start + size] of each row, as binary; some rows at a time, so that no index of all bytes is made."""
    off = np.concatenate(([0], np.cumsum(size)))
    if off[-1] >= 1 << 31:
        raise ValueError("a group's records exceed 2 GB: use smaller groups")
    out = np.empty(off[-1], np.uint8)
    for s in range(0, len(start), 8192):
        n = size[s : s + 8192]
        out[off[s] : off[min(s + 8192, len(start))]] = data[np.repeat(start[s : s + 8192], n) + ramp(n)]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(out)])


def _bucket(key: np.ndarray, buckets: list[int]) -> np.ndarray:
    return np.array(buckets)[((key.astype(np.uint64) * np.uint64(R32)) >> np.uint64(40)).astype(np.int64) % len(buckets)]


def _covers(grp: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, buckets: list[int]) -> pa.Table:
    """Runs of covered window starts as records without words (doc_id holds their ends); they pass through any subtree's task."""
    none = np.zeros(len(row), np.int64)
    place = np.array(buckets)[grp % len(buckets)]
    return pa.Table.from_arrays([pa.array(place, pa.int32()), pa.array(none), pa.array(hi.astype(np.int64)), pa.array(grp, pa.int32()), pa.array(row, pa.int32()), pa.array(lo, pa.int32()), pa.array(none), pa.nulls(len(row), pa.binary())], schema=_RECORD)


def _records(buckets, window, prefix, heavy):
    def run(t: pa.Table, got: pa.Table) -> pa.Table:
        release()
        if not t.num_rows:
            return _RECORD.empty_table()
        grp = t.column("grp")[0].as_py()
        w = Windows(t, window, prefix, True)
        distinct = _distinct(w.anchor)
        groups = totals(got, "short", buckets).astype(np.int32)
        shared = np.zeros(len(w.anchor), np.int32)
        for s in range(0, len(shared), 1 << 18):
            shared[s : s + (1 << 18)] = groups[np.searchsorted(distinct, w.anchor[s : s + (1 << 18)])]
        del distinct, groups
        first = w.first_in_group() if len(shared) else np.zeros(0, np.int64)
        local = w.doc[w.row[first]] < w.doc[w.row]
        del first
        row, lo, hi = _runs(w.row[local], w.at[local]) or (np.zeros(0, np.int64),) * 3
        parts = [_covers(np.full(len(row), grp), row, lo, hi, buckets)]
        # A window that a document repeats is asked for at each place, since each is to go.
        ask_for = np.flatnonzero((shared > 1) & ~local).astype(np.int32)
        if not (shared[ask_for] > heavy).any():
            w.hash = None
        for deep in (False, True):
            own = ask_for[(shared[ask_for] > heavy) == deep]
            if not len(own):
                continue
            if deep:
                start, row, at_, mask, key = w.start[own], w.row[own], w.at[own], np.ones(len(own), np.int64), w.hash[own] | DEEP
                have = np.full(len(own), window)
                # The parts of a window's first level; a smaller document of the same part is enough to cover it.
                part = grp * 2654435761 % (1 << 32) % np.ceil(np.sqrt(shared[own])).astype(np.int64)
                place = _bucket(mix(key + part.astype(np.uint64)), buckets)
            else:
                spot = w.start[own] + w.offset[own]
                new = np.concatenate(([True], spot[1:] != spot[:-1]))
                lead = np.flatnonzero(new)
                # Windows of one anchor follow each other; bit j stands for the window that starts j words after the first.
                of = np.cumsum(new, dtype=np.int32) - 1
                start, row, at_ = w.start[own][lead], w.row[own][lead], w.at[own][lead]
                mask = np.zeros(len(lead), np.int64)
                np.bitwise_or.at(mask, of, np.int64(1) << (w.start[own] - start[of]))
                have = np.maximum.reduceat(w.start[own], lead) - start + window
                key = w.anchor[own][lead]
                place = _bucket(key, buckets)
            last = start + have - 1
            blob = _slices(w.data, w.byte[start], w.byte[last] + w.size[last] - 1 - w.byte[start])
            parts.append(pa.Table.from_arrays([pa.array(place, pa.int32()), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(w.doc[row]), pa.array(np.full(len(row), grp), pa.int32()), pa.array(row, pa.int32()), pa.array(at_, pa.int32()), pa.array(mask), blob], schema=_RECORD))
        return in_batches(pa.concat_tables(parts))

    return run


R32 = 0x9E3779B97F4A7C15
#: Marks keys of windows that are dealt by all their words.
DEEP = np.uint64(1 << 63)


def deep_nodes(ids: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The internal nodes at a depth of the tree of the suffixes of ids that start at `start`: their suffixes, node by node in the order of their words, and the number of each one's node.

    Nodes are split top down by one or two words at a time, as many as fit into one number with the node's; suffixes alone in a node end in a leaf above the depth.
    """
    words = np.unique(ids)
    bits = max(1, int(len(words)).bit_length())
    rank = np.empty(len(ids), np.uint32)
    for s in range(0, len(ids), 1 << 19):
        rank[s : s + (1 << 19)] = np.searchsorted(words, ids[s : s + (1 << 19)])
    live, node, at = np.arange(len(start)), np.zeros(len(start), np.uint64), 0
    while at < depth and len(live):
        key = node << np.uint64(bits) | rank[start[live] + at].astype(np.uint64)
        at += 1
        if at < depth and int(node[-1]).bit_length() + 2 * bits <= 64:
            key = key << np.uint64(bits) | rank[start[live] + at].astype(np.uint64)
            at += 1
        order = np.argsort(key)
        key, live = key[order], live[order]
        number = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        more = np.bincount(number)[number] > 1
        live, node = live[more], number[more]
        node = np.cumsum(np.concatenate(([False], node[1:] != node[:-1]))).astype(np.uint64) if len(node) else node
    return live, node.astype(np.int64)


def _subtrees(window, buckets, level):
    """The subtrees of a bucket's records: nodes of depth `window`, and what their smallest documents cover. On level 1 the smallest documents of windows that are dealt by all their words go on to level 2."""

    def run(t: pa.Table) -> pa.Table:
        release()
        done = pc.is_null(t.column("words"))
        out = [t.filter(done)]
        t = t.filter(pc.invert(done))
        if not t.num_rows:
            return in_batches(out[0])
        ids, n = words_of(t.column("words"))
        begin = np.cumsum(n) - n
        record, shift = np.nonzero((t.column("mask").to_numpy()[:, None] >> np.arange(window)) & 1)
        doc = t.column("doc_id").to_numpy()[record]
        live, node = deep_nodes(ids, begin[record] + shift, window)
        least = doc.copy()
        if len(live):
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            least[live] = np.minimum.reduceat(doc[live], first)[node]
        covered = least < doc
        grp, row, at = (t.column(c).to_numpy()[record[covered]] for c in ("grp", "row", "at"))
        at = at + shift[covered]
        # Runs within a group's row: both in one number.
        r, lo, hi = _runs(grp.astype(np.int64) << 32 | row, at) or (np.zeros(0, np.int64),) * 3
        out.append(_covers(r >> 32, r & 0xFFFFFFFF, lo, hi, buckets))
        if level == 1:
            go = np.flatnonzero((t.column("key").to_numpy().view(np.uint64)[record] >= DEEP) & ~covered)
            rest = t.take(pa.array(record[go]))
            out.append(rest.set_column(0, _RECORD.field("bucket"), pa.array(_bucket(rest.column("key").to_numpy().view(np.uint64), buckets), pa.int32())))
        return in_batches(pa.concat_tables(out))

    return run


def _kept(window, prefix, original, schema):
    """Each document with the words that no covered window holds."""

    def run(t: pa.Table, got: pa.Table) -> pa.Table:
        release()
        if not t.num_rows:
            return schema.empty_table()
        w = Windows(t, window, prefix)
        gone = np.zeros(len(w.ids) + 1, np.int32)
        row, lo, hi = (got.column(n).to_numpy() for n in ("row", "lo", "hi"))
        np.add.at(gone, w.first[row] + lo, 1)
        np.add.at(gone, w.first[row] + hi + window - 1, -1)
        gone = np.cumsum(gone)[:-1] > 0
        texts = t.column("text").cast(pa.large_binary()).to_pylist()
        kept, removed = [], []
        for k, i in enumerate(w.order):
            s = w.first[k]
            out = gone[s : s + w.n[k]]
            removed.append(int(out.sum()))
            if original and not removed[-1]:
                kept.append(texts[i])
                continue
            parts = (texts[i] or b"").split()
            kept.append(b" ".join([p for p, g in zip(parts, out.tolist(), strict=True) if not g]) if removed[-1] else b" ".join(parts))
        back = np.argsort(w.order)
        cols = {"n_words": w.n[back].astype(np.int64), "n_removed": np.array(removed, np.int64)[back]}
        kept = [kept[i] for i in back]
        arrays = []
        for f in schema:
            if f.name in cols:
                arrays.append(pa.array(cols[f.name]))
            elif f.name == "kept_sha256":
                arrays.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept]))
            elif f.name == "kept_text":
                arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
            else:
                arrays.append(t.column(f.name).combine_chunks().cast(f.type))
        return in_batches(pa.Table.from_arrays(arrays, schema=schema))

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, heavy: int = HEAVY, keep: tuple[str, ...] = (), texts: bool = True, original: bool = False) -> DataFrame:
    """doc_id, the columns of keep, n_words, n_removed, and kept_text (or kept_sha256 if not texts) for each row. original: a text that loses nothing stays as it is, white space included."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    groups = group_count(spark, text_bytes(docs))
    # One exchange of the texts, which the plan uses three times.
    text = grouped(docs, groups)
    buckets = group_keys(groups)
    got = answers(text.mapInArrow(_asks(buckets, window, prefix), ASK), groups).repartition(groups, "grp")
    records = text.groupBy("grp").cogroup(got.groupBy("grp")).applyInArrow(_records(buckets, window, prefix, heavy), RECORD)
    for level in (1, 2):
        records = records.repartition(groups, "bucket").groupBy("bucket").applyInArrow(_subtrees(window, buckets, level), RECORD)
    covers = records.select("grp", "row", F.col("at").alias("lo"), F.col("doc_id").cast("int").alias("hi")).repartition(groups, "grp")
    fields = [("doc_id", pa.int64())] + [(c, _arrow(docs.schema[c].dataType)) for c in keep] + [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text" if texts else "kept_sha256", pa.string())]
    names = [n for n, _ in fields]
    types = {"n_words": "long", "n_removed": "long", "kept_text": "string", "kept_sha256": "string", "doc_id": "long"}
    ddl = ", ".join(f"`{n}` {types.get(n) or docs.schema[n].dataType.simpleString()}" for n in names)
    return text.groupBy("grp").cogroup(covers.groupBy("grp")).applyInArrow(_kept(window, prefix, original, pa.schema(fields)), ddl)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
