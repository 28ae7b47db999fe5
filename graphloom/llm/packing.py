"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents are tokenised in parallel; a document longer than a sequence is cut so that its first piece may be shorter and all
others fill a sequence. What the assignment needs is how many pieces have each length: at most `size` numbers, counted by
Spark. On these numbers the driver runs best-fit decreasing with a segment tree over remaining capacities: all pieces of one
length that meet the same tightest capacity move together, with the result that placing them one by one gives, so the plan's
size depends on `size`, not on the number of documents. Each piece finds its place by its length and its rank among pieces of
that length; ranks come from counts by (length, salt), so no length is gathered in one task: full pieces have as many salts as
their number asks for.

Null texts count as empty (one piece, the end id only); texts of any length are read whole. Repeated rows, and rows with a null doc_id,
are packed each on its own. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, release

SIZE = 2048
#: Parts in which pieces of one length are ranked, at least, and full pieces of one part at most.
SALTS, PART = 64, 500_000
#: How byte-level BPE vocabularies of this kind split a text before merging, for texts of Latin letters; other texts go whole to the tokenizer.
PLAIN = re.compile(r"[\x00-\x7f\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9]+| ?[^\sA-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9]+|\s+(?!\S)|\s+")
#: Byte-level vocabularies write a byte that prints as its character, and the others as those from 256 on, in order.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = dict(zip([b for b in range(256) if b not in _PRINTS], range(256, 512), strict=False))
#: Entries of a worker's table of known splits; it is emptied when full, which changes no result.
KNOWN = 300_000


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. The ids of a split are asked of the tokenizer once and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        # Splits are merged one by one only where the vocabulary works on bytes and changes nothing before.
        self.bytewise = parts["normalizer"] is None and parts["model"]["type"] == "BPE" and (parts["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not parts["pre_tokenizer"]["add_prefix_space"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, splits: list[str]) -> None:
        """Adds splits to the table: the vocabulary's model merges each by itself."""
        merge = self.tokenizer.model.tokenize
        for w in splits:
            self.known[w] = array("I", [t.id for t in merge(w.encode().decode("latin-1").translate(BYTES))]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.bytewise and PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        split = [PIECES.findall(t) if p else None for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > KNOWN:
            self.known.clear()
        self.learn(list(set().union(*[s for s in split if s]).difference(self.known)))
        rest = iter(self.whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) if s is not None else next(rest) for s in split]


def encoder(path: str) -> Encoder:
    """One for each worker and path; workers outlive tasks."""
    kept = sys.modules[__name__].__dict__.setdefault("_encoders", {})
    return kept.setdefault(path, None) or kept.__setitem__(path, Encoder(path)) or kept[path]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first is n modulo size unless that is zero."""
    head = n % size or size
    return [(0, head), *((at, size) for at in range(head, n, size))] if n > size else [(0, n)]


class Capacities:
    """A segment tree over remaining capacities 0..size that counts open bins; finds the tightest that holds a length."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.tree = [0] * (2 * self.n)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.n
        while i:
            self.tree[i] += bins
            i //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least length with open bins."""
        i = length + self.n
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def best_fit(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts[length] pieces. Returns moves (length, first rank, first bin, pieces in each bin, offset of the first) and the number of bins."""
    tree, held, moves, bins = Capacities(size), {}, [], 0
    for length in sorted((x for x in counts if x > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = size, size // length
                need = -(-left // each)
                first, bins = bins, bins + need
                taken = [(first, need)]
            else:
                each = room // length
                need, taken = -(-left // each), []
                while need and held.get(room):
                    first, n = held[room].pop()
                    if n > need:
                        held[room].append((first + need, n - need))
                        n = need
                    taken.append((first, n))
                    need -= n
                tree.add(room, -sum(n for _, n in taken))
            for first, n in taken:
                put = min(left, n * each)
                moves.append((length, rank, first, each, size - room))
                rank, left = rank + put, left - put
                full, over = divmod(put, each)
                for start, many, used in ((first, full, each), (first + full, 1 if over else 0, over)):
                    if many:
                        rest = room - used * length
                        held.setdefault(rest, []).append((start, many))
                        tree.add(rest, many)
    return moves, bins


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 for each piece of each document."""
    tail = np.array([end], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        enc = encoder(path)
        try:
            yield from cut_all(enc, batches)
        finally:
            # Workers outlive tasks, and an idle one is not to hold a table.
            enc.known.clear()
            release()

    def cut_all(enc, batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = []
            for doc, coded in zip(ids, enc.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                coded += tail
                for k, (at, n) in enumerate(cut(len(coded) // 4, size)):
                    crc = zlib.crc32(coded[4 * at : 4 * (at + n)])
                    rows.append((doc, k, at, n, crc))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of at most size ids; each sequence is gapless from 0."""
    spark = docs.sparkSession
    prepare(spark)
    parts = materialize(pieces(docs, path, size, end))
    full = max(SALTS, -(-parts.where(F.col("length") == size).count() // PART))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.when(F.col("length") == size, F.lit(full)).otherwise(F.lit(SALTS))).cast("int"))
    counted = parts.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # At most size x SALTS rows, and one for each PART full pieces.
    known = [(r["length"], r["salt"], r["n"]) for r in counted.collect()]
    counts: dict[int, int] = {}
    before = []
    for length, salt, n in sorted(known):
        before.append((length, salt, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    moves, _ = best_fit(counts, size)
    moves.sort()
    first = spark.createDataFrame(before or [(0, 0, 0)], "length long, salt int, before long")
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))).join(F.broadcast(first), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r") - 1).alias("rank"))
    plan = np.array(moves or [(0, 0, 0, 1, 0)], np.int64).T.copy()

    def place(batches):
        key = plan[0] << 44 | plan[1]
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            bin_, slot = np.divmod(rank - plan[1][at], plan[3][at])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(plan[2][at] + bin_), pa.array(plan[4][at] + slot * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: its length and the number of pieces."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count("*").alias("pieces"))
