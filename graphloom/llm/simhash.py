"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has a 1 where over half its shingle hashes have one. Two fingerprints that differ in `distance` <= 3
bits differ in at most one bit of one 32-bit half. So each fingerprint enters a table under both halves, and asks the table for
every half within one bit of its own: itself, or with one bit set that it lacks (the pair that lacks it the other way round is
found from the other side). What is fetched is compared over all 64 bits.

Equal fingerprints are joined first, under the smallest doc_id that has them; only different ones enter the table. Halves that
more than `block` fingerprints share are dealt as blocks of askers against blocks of entries, so that no task holds more than
two blocks of one half. A task returns a spanning forest of the links that it finds, not all pairs, which keeps every
component whole.

Null texts count as empty; texts without words have fingerprint zero. Repeated rows with one doc_id each get a row. A null doc_id
names no component: such a row gets that of an equal text that has one, else null. Texts of any length are read whole. Columns other than
doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, powers, prepare, ramp, release, text_buffers, window_hashes, words_of
from .components import components

SEED = 42
#: Pairs that are compared at once in memory.
PAIRS = 1 << 21
#: Pairs of sets that are compared by size and place at once.
MEETS = 1 << 18
#: Bytes of text that are sketched at once, and words whose bits are counted at once (some 1,500 bytes each).
SLICE_BYTES, BLOCK = 1 << 19, 2000


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `words` words of a text, A-Z lower-cased, joined by one space; of all words if there are fewer."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    one = xxhash.xxh64_intdigest
    return np.fromiter([one(joined[s:e], seed) for s, e in zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64, len(parts) - words + 1)


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> int:
    h = shingle_hashes(text, words, seed)
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            text = b.column("text").cast(pa.large_binary()).to_pylist()
            fp = np.fromiter((fingerprint(t or b"", words) for t in text), np.uint64, len(text)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node with the smallest of its component, for links (a, b)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _entries(fps: DataFrame, bits: int, ball: bool = True) -> DataFrame:
    """From rep, fp and parts (a fingerprint's segments): rows key, fp, rep. key holds the segment's number, its value, and in the last bit 0 for the table's entry or 1 for a question."""

    def run(batches):
        for b in batches:
            rep, fp = (b.column(n).to_numpy() for n in ("rep", "fp"))
            parts = np.frombuffer(b"".join(b.column("parts").to_pylist()), "<u4").reshape(len(rep), -1)
            for seg in range(parts.shape[1]):
                value = parts[:, seg].astype(np.int64)
                for flip in range(-1, bits if ball else 0):
                    asks = np.ones(len(rep), bool) if flip < 0 else value >> flip & 1 == 0
                    key = (seg << bits | (value if flip < 0 else value | 1 << flip)) << 1 | (flip >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(key[asks]), pa.array(fp[asks]), pa.array(rep[asks])], names=["key", "fp", "rep"])

    return fps.select("rep", "fp", "parts").mapInArrow(run, "key long, fp long, rep long")


def _linked(run: np.ndarray, entry: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int):
    """Links between the askers and the entries of each run (equal numbers in `run`, which ascends)."""
    order = np.lexsort((~entry, run))
    run, entry, fp, rep = run[order], entry[order], fp[order], rep[order]
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    size = np.diff(np.concatenate((first, [len(run)])))
    of = np.repeat(np.arange(len(first)), size)
    entries = np.add.reduceat(entry.astype(np.int64), first)
    # An entry meets the entries before it in its run, another asker all of them.
    meets = np.where(entry, np.arange(len(run)) - first[of], entries[of])
    ends = np.cumsum(meets)
    at = 0
    while at < len(run):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = meets[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = first[of[i]] + ramp(n)
        near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= distance
        if near.any():
            yield forest(rep[i[near]], rep[j[near]])
        at = to


def halves(fps: DataFrame) -> DataFrame:
    """rep, fp with parts: both 32-bit halves of the fingerprint."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().astype("<i8").view("<u4").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("fp"), pa.array([x.tobytes() for x in fp], pa.binary())], names=["rep", "fp", "parts"])

    return fps.select("rep", "fp").mapInArrow(run, "rep long, fp long, parts binary")


def links(fps: DataFrame, distance: int = 3, bits: int = 32, block: int = 4096) -> DataFrame:
    """a, b: links between rep's of rows (rep, fp, parts) that are within one bit in one part of `bits` bits and within `distance` in fp; a set with the components that all such links have."""
    spark: SparkSession = fps.sparkSession
    prepare(spark)
    heavy = _entries(fps, bits, ball=False).groupBy("key").count().where(F.col("count") > block)
    asked = _entries(fps, bits)
    if (many := heavy.count()) > 0:
        flips = F.array(F.lit(0), *[F.lit(2 << i) for i in range(bits)])
        # A value is asked for by the fingerprints that have it and by those one bit away.
        near = heavy.select("count", F.explode(F.transform(flips, lambda x: F.col("key").bitwiseXOR(x.cast("long")))).alias("key"))
        near = near.groupBy("key").agg(F.sum("count").alias("askers")).join(heavy.select("key", F.col("count").alias("entries")), "key", "left")
        near = materialize(near.select(F.shiftright("key", 1).alias("k"), F.ceil(F.col("askers") / block).cast("int").alias("na"), F.ceil(F.coalesce("entries", F.lit(block)) / block).cast("int").alias("ne")))
        asked = asked.withColumn("k", F.shiftright("key", 1)).join(F.broadcast(near) if many <= 2000 else near, "k", "left")
        is_entry = F.col("key").bitwiseAND(F.lit(1)) == 0
        na, ne = F.coalesce("na", F.lit(1)), F.coalesce("ne", F.lit(1))
        row, column = F.pmod(F.xxhash64("rep"), na), F.pmod(F.xxhash64("rep", F.lit(1)), ne)
        as_asker = F.transform(F.sequence(F.lit(0), ne - 1), lambda e: F.struct((row * ne + e).cast("int").alias("cell"), F.lit(True).alias("asks"), (is_entry & (e == column)).alias("held")))
        as_entry = F.transform(F.sequence(F.lit(0), na - 1), lambda r: F.struct((r * ne + column).cast("int").alias("cell"), (r == row).alias("asks"), F.lit(True).alias("held")))
        both = F.when(is_entry, F.array_distinct(F.concat(as_asker, as_entry))).otherwise(as_asker)
        asked = asked.select("key", "fp", "rep", F.explode(both).alias("c")).select("key", F.col("c.cell").alias("cell"), "fp", "rep", F.col("c.asks").alias("asks"), F.col("c.held").alias("held"))
    else:
        asked = asked.select("key", F.lit(0).alias("cell"), "fp", "rep")

    salted = many > 0

    def run(batches):
        left: pa.Table | None = None

        def found(t: pa.Table):
            key, cell, fp, rep = (t.column(n).to_numpy() for n in ("key", "cell", "fp", "rep"))
            entry, key = key & 1 == 0, key >> 1
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
            number = np.cumsum(new) - 1
            asks = None
            if salted:
                asks, entry = t.column("asks").to_numpy(), t.column("held").to_numpy()
            size, held = np.bincount(number), np.bincount(number, weights=entry)
            keep = (size > 1)[number] & (held > 0)[number]
            if keep.any():
                yield from _cells(number[keep], entry[keep], None if asks is None else asks[keep], fp[keep], rep[keep], distance)

        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            key, cell = t.column("key").to_numpy() >> 1, t.column("cell").to_numpy()
            last = int(np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))[-1]) if len(key) else 0
            left = t.slice(last)
            if last:
                for a, c in found(t.slice(0, last)):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])
        if left is not None and len(left):
            for a, c in found(left):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])

    k = F.shiftright("key", 1)
    return asked.repartition(k, "cell").sortWithinPartitions(k, "cell").mapInArrow(run, "a long, b long").distinct()


def _cells(number, entry, asks, fp, rep, distance):
    """In a cell of a divided half, rows that ask meet rows that are held there; elsewhere every row asks."""
    if asks is None:
        yield from _linked(number, entry, fp, rep, distance)
        return
    plain = np.bincount(number, weights=~asks)[number] == 0
    if plain.any():
        yield from _linked(number[plain], entry[plain], fp[plain], rep[plain], distance)
    for n in np.unique(number[~plain]):
        of = number == n
        p, t = np.flatnonzero(of & asks), np.flatnonzero(of & entry)
        step = max(1, PAIRS // max(1, len(t)))
        for s in range(0, len(p), step):
            i, j = np.repeat(p[s : s + step], len(t)), np.tile(t, len(p[s : s + step]))
            near = (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= distance) & (rep[i] != rep[j])
            if near.any():
                yield forest(rep[i[near]], rep[j[near]])


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, block: int = 4096) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach from the document's fingerprint."""
    if not 0 <= distance <= 3:
        raise ValueError("one half within one bit is certain only for distances up to 3")
    own = materialize(fingerprints(docs, words))
    reps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    part = components(links(halves(reps.where("rep IS NOT NULL")), distance, 32, block))
    named = materialize(reps.join(part, reps["rep"] == part["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def hexed(fp):
    """A fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- groups of texts with a shingle similarity of a threshold or more, found by the same index ----

PARTS, PART_BITS, LOOSE = 8, 24, 14
SMALL_BYTES, SMALL_COUNT = 4 << 20, 1024


#: Of one document in so many, at least of HOT_DOCS documents, shingles are counted; at most HOT_MOST frequent ones go last in the order of shingles.
HOT_EVERY, HOT_DOCS, HOT_LEAST, HOT_MOST = 16, 10_000, 4, 500_000


def _shingles(column, words: int, hot: np.ndarray | None = None, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their rows, in the order of (rank of a hot shingle, else 0; hash), and how many a row has. Fewer words than a shingle has: the whole sequence is one."""
    ids, n = words_of(column, lower=True)
    grams, many = window_hashes(ids, words), np.maximum(n - words + 1, 0)
    start = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), many)
    grams = grams[start[row] + ramp(many)]
    for i in np.flatnonzero((n > 0) & (n < words)):
        grams, row = np.append(grams, mix(np.array([hash(tuple(ids[start[i] : start[i] + n[i]].tolist())) % (1 << 64)], np.uint64))), np.append(row, i)
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        order = np.lexsort((grams, np.where(hot[at] == grams, rank[at], 0).astype(np.uint8), row))
    else:
        order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    one = np.concatenate(([True], (grams[1:] != grams[:-1]) | (row[1:] != row[:-1]))) if len(grams) else np.zeros(0, bool)
    grams, row = grams[one], row[one]
    return grams, row, np.bincount(row, minlength=len(n))


def slices(batches):
    """The same rows in order, in batches of at most SLICE_BYTES of text or of one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield b.slice(at, to - at)
            at = to


def hot_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, ascending, and their ranks: the logarithm of the number of sampled documents. Any choice keeps the index exact; a good one keeps common passages out of it."""
    prepare(docs.sparkSession)
    every = max(1, min(HOT_EVERY, docs.count() // HOT_DOCS))

    def run(batches):
        for b in slices(batches):
            h, n = np.unique(_shingles(b.column("text"), words)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(every)) == 0).select("text").mapInArrow(run, "h long, n long")
    top = some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "h").limit(HOT_MOST).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], np.log2(np.maximum(n[order], 2)).astype(np.uint8)


def _overlap(a, b, threshold: float):
    """The least number of common shingles of sets of a and b shingles with a similarity of threshold."""
    return np.ceil(threshold * (a + b) / (1 + threshold) - 1e-6).astype(np.int64)


def sketches(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, s1, s2 (128 bits for the sequence of words, A-Z lower-cased), size, fp and parts: a 64-bit and a 192-bit SimHash of the set of words.

    Also of the set of shingles: their number, prefix (the first ones in the order, of which two sets with the similarity have
    one in common) and parity (a bit for each remainder of hashes, set if an odd number of shingles has it).
    """
    prepare(docs.sparkSession)
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, words))

    def run(batches):
        release()
        for b in slices(batches):
            yield _sketch(b, words, threshold, *hot.value)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, s1 long, s2 long, size long, fp long, parts binary, shingles long, prefix binary, parity binary")


def _sketch(b: pa.RecordBatch, words: int, threshold: float, hot: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """The rows of sketches() for a batch of doc_id and text."""
    ids, n = words_of(b.column("text"), lower=True)
    row = np.repeat(np.arange(len(n)), n)
    at = ramp(n)
    pw = powers(int(n.max()) + 1 if len(n) else 1)
    sums = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
    have = n > 0
    first = (np.cumsum(n) - n)[have]
    for k in range(2):
        sums[k][have] = np.add.reduceat(mix(ids + np.uint64(k)) * pw[k][at], first) if have.any() else 0
    order = np.lexsort((ids, row))
    ids, row = ids[order], row[order]
    one = np.concatenate(([True], (ids[1:] != ids[:-1]) | (row[1:] != row[:-1]))) if len(ids) else np.zeros(0, bool)
    ids, row = ids[one], row[one]
    m = np.bincount(row, minlength=len(n))
    counts = np.zeros((len(n), 256), np.int32)
    for s in range(0, len(ids), BLOCK):
        part, of = ids[s : s + BLOCK], row[s : s + BLOCK]
        wide = np.stack([mix(part + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) for k in range(1, 5)], axis=1)
        ones = np.unpackbits(wide.view(np.uint8).reshape(len(part), 32), axis=1, bitorder="little")
        start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        counts[of[start]] += np.add.reduceat(ones, start, axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > m[:, None], axis=1, bitorder="little")
    triples = bits[:, 8:].reshape(len(n), PARTS, 3).astype("<u4")
    parts = (triples[:, :, 0] | triples[:, :, 1] << 8 | triples[:, :, 2] << 16).astype("<u4")
    size = np.concatenate([np.diff(off) for _, off in text_buffers(b.column("text"))]) if len(n) else np.zeros(0, np.int64)
    grams, _, many = _shingles(b.column("text"), words, hot, rank)
    first = np.cumsum(many) - many
    head = np.where(many > 0, many - np.ceil(threshold * many - 1e-6).astype(np.int64) + 1, 0)
    # Texts shorter than a shingle are similar to equal ones only.
    head[n < words] = 0
    prefix = [grams[s : s + k].tobytes() for s, k in zip(first.tolist(), head.tolist(), strict=True)]
    parity = [_parity(grams[s : s + k]) for s, k in zip(first.tolist(), many.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(size), pa.array(bits[:, :8].copy().view("<i8").ravel()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(many), pa.array(prefix, pa.binary()), pa.array(parity, pa.binary())], names=["doc_id", "s1", "s2", "size", "fp", "parts", "shingles", "prefix", "parity"])


def _parity(grams: np.ndarray) -> bytes:
    width = max(64, 1 << int(len(grams) - 1).bit_length()) if len(grams) else 64
    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _met(threshold: float):
    """From rows h, node, component, shingles, place, sorted by h: pairs of nodes of different components that share h and can have the similarity by their sizes and the places of h."""

    def found(t: pa.Table):
        h, node, part, size, place = (t.column(c).to_numpy() for c in ("h", "node", "component", "shingles", "place"))
        number = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        mixed = np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first)
        keep = mixed[number]
        if not keep.any():
            return
        number, node, part, size, place = (x[keep] for x in (number, node, part, size, place))
        order = np.lexsort((size, number))
        number, node, part, size, place = (x[order] for x in (number, node, part, size, place))
        # Each row meets those after it in its run that are not too large.
        key = number << 32 | size
        meets = np.searchsorted(key, number << 32 | np.floor(size / threshold + 1e-6).astype(np.int64), side="right") - np.arange(len(key)) - 1
        ends, at = np.cumsum(meets), 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETS, side="right")))
            n = meets[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = i + 1 + ramp(n)
            near = (part[i] != part[j]) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= _overlap(size[i], size[j], threshold))
            if near.any():
                x, y = node[i[near]], node[j[near]]
                two = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], names=["a", "b"])
            at = to

    def run(batches):
        left: pa.Table | None = None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            h = t.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))
            left = t.slice(last)
            if last:
                yield from found(t.slice(0, last))
        if left is not None:
            yield from found(left)

    return run


def missed(own: DataFrame, reps: DataFrame, coarse: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of different components of `coarse` that may have the similarity; no pair that has it is missing.

    Sets with the similarity share a shingle of their prefixes; of pairs that do, those stay whose parities differ in no more
    bits than the sets may differ in shingles.
    """
    named = reps.join(coarse, reps["rep"] == coarse["node"], "left").select("rep", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    heads = own.join(named, (own["doc_id"] == named["rep"]) & (own["s1"] == named["s1"]) & (own["s2"] == named["s2"])).groupBy("rep", own["s1"], own["s2"]).agg(F.first("component").alias("component"), F.first("shingles").alias("shingles"), F.first("prefix").alias("prefix"))

    def deal(batches):
        for b in batches:
            prefix = b.column("prefix").to_pylist()
            n = np.fromiter((len(x) // 8 for x in prefix), np.int64, len(prefix))
            h = np.frombuffer(b"".join(prefix), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("rep", "component", "shingles")), pa.array(ramp(n))], names=["h", "node", "component", "shingles", "place"])

    schema = "h long, node long, component long, shingles long, place long"
    heads = heads.select("rep", "component", "shingles", "prefix").mapInArrow(deal, schema)
    pairs = materialize(heads.repartition("h").sortWithinPartitions("h").mapInArrow(_met(threshold), "a long, b long").distinct())
    bits = own.join(reps.select("rep", "s1", "s2"), ["s1", "s2"]).where("doc_id = rep").select("rep", "shingles", "parity")
    both = pairs.join(bits.toDF("a", "na", "pa"), "a").join(bits.toDF("b", "nb", "pb"), "b")

    def check(batches):
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            most = na + nb - 2 * _overlap(na, nb, threshold)
            ok = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b.column("pa").to_pylist(), b.column("pb").to_pylist(), strict=True)):
                x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
                # A wider one folds onto the narrower: remainders of powers of two.
                ok[i] = np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum() <= most[i]
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(check, "a long, b long").distinct()


def _similar(words: int, threshold: float):
    """In each cluster of the group: a spanning forest of the pairs with a Jaccard similarity of shingle sets of at least threshold."""

    def run(t: pa.Table) -> pa.Table:
        release()
        node, cluster = t.column("node").to_numpy(), t.column("component").to_numpy()
        grams, row, size = _shingles(t.column("text"), words)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        by = np.argsort(cluster, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(cluster[by]) != 0, [True])))
        begin = np.searchsorted(row, np.arange(len(size) + 1))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            own = by[s:e]
            if len(own) < 2:
                continue
            where = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in own])
            _, col, seen = np.unique(grams[where], return_inverse=True, return_counts=True)
            who = np.repeat(np.arange(len(own)), size[own])
            shared = seen[col] > 1
            _, col = np.unique(col[shared], return_inverse=True)
            who = who[shared]
            both = np.zeros((len(own), len(own)), np.float32)
            by_col = np.argsort(col, kind="stable")
            col, who = col[by_col], who[by_col]
            for c in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
                lo, hi = np.searchsorted(col, (c, c + 4096))
                x = np.zeros((len(own), 4096), np.float32)
                x[who[lo:hi], col[lo:hi] - c] = 1
                both += x @ x.T
            union = size[own][:, None] + size[own][None, :] - both
            i, j = np.nonzero(np.triu((both >= threshold * union - 1e-6) & (union > 0), 1))
            if len(i):
                x, y = forest(node[own[i]], node[own[j]])
                a.append(x)
                b.append(y)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def similar_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, block: int = 4096) -> DataFrame:
    """doc_id, group_id: the smallest doc_id that is reached over pairs of texts whose sets of word shingles have a Jaccard similarity of at least threshold.

    The index finds most candidates: texts whose SimHashes of word sets agree within one bit in one of eight 24-bit parts and in
    all but 14 of 64 further bits. Prefixes of the shingle sets then find every pair across its components that it may have missed
    (`missed`). Texts in one component of candidates are compared exactly, components of many or long texts in blocks against
    blocks. Texts with the same words are one text here, as are texts without words.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = materialize(sketches(docs, words, threshold))
    reps = materialize(own.groupBy("s1", "s2").agg(F.min_by(F.struct("doc_id", "size", "fp", "parts"), "doc_id").alias("r")).select("s1", "s2", F.col("r.doc_id").alias("rep"), F.col("r.size").alias("size"), F.col("r.fp").alias("fp"), F.col("r.parts").alias("parts")))
    coarse = components(links(reps.where("rep IS NOT NULL"), LOOSE, PART_BITS, block))
    more = materialize(missed(own, reps.where("rep IS NOT NULL").select("rep", "s1", "s2"), coarse, threshold))
    if not more.isEmpty():
        coarse = components(coarse.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    member = materialize(coarse.join(reps.select(F.col("rep").alias("node"), "size"), "node"))
    sums = member.groupBy("component").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    blocks = F.greatest(F.ceil(F.col("bytes") / (SMALL_BYTES // 2)), F.ceil(F.col("n") / (SMALL_COUNT // 2))).cast("int")
    sums = materialize(sums.withColumn("blocks", F.when((F.col("bytes") > SMALL_BYTES) | (F.col("n") > SMALL_COUNT), blocks).otherwise(F.lit(1))))
    total, members = sums.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bundles = max(1, -(-total // (2 * SMALL_BYTES)), min(spark.sparkContext.defaultParallelism, total >> 18))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine))
    dealt = member.join(sums.select("component", "blocks"), "component").select("node", "component", F.when(F.col("blocks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(bundles))).alias("g1"), F.when(F.col("blocks") > 1, cells).otherwise(F.array(F.lit(0))).alias("cells"))
    dealt = materialize(dealt)
    # 40 bytes a member at most in the small case.
    texts = docs.join(F.broadcast(dealt) if members <= 500_000 else dealt, F.col("doc_id") == F.col("node"))
    found = texts.select("node", "component", "text", "g1", F.explode("cells").alias("g2")).groupBy("g1", "g2").applyInArrow(_similar(words, threshold), "a long, b long")
    part = components(found.distinct())
    named = materialize(reps.join(part, reps["rep"] == part["node"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("group_id")))
    return own.select("doc_id", "s1", "s2").join(named, ["s1", "s2"]).select("doc_id", "group_id")
