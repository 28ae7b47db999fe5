"""Language-model scores by deleted interpolation.

A word's probability after the word before it mixes the bigram's and the word's maximum-likelihood estimates and a uniform
share of an open vocabulary: l2(b) c(u,w)/c(u) + l1(b) c(w)/N + l0(b) / (V+1). b is the bucket of c(u), by powers of two; its
weights are learned by expectation-maximisation on deleted counts: each training token is held out in turn, that is, counted
once less in the counts that predict it.

Counts cover every training document (see exchange.py for how groups of documents get at them). For each document the counts of
its tokens are kept as two packed lists, from which everything else follows without the text. What EM needs of them is a
histogram over bucket and the logarithms of both estimates, to a quarter and a half of a power of two, so it has a bounded
size; scores use exact counts.

A text's first word is predicted from a start context, whose count is the number of training texts and whose bucket learns like others.

Null texts count as empty: one token, the end; texts of any length are read whole. Repeated rows, and rows with a null doc_id, count and
are scored each on its own; a null held_out counts as false. Columns other than doc_id and text are ignored. An empty table gives an
empty result; without training texts every token has the share of an empty vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_count, group_keys, grouped, in_batches, materialize, mix, per_partition, prepare, release, text_bytes, words_of
from .exchange import ASK, answers, ask, pack_counts, short, totals, unpack_counts

START, STOP = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
BUCKETS = 40
ALPHA = 0.1


def _tokens(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens with each document's end, bigram keys (46 bits), and the number of tokens of each document."""
    words, n = words_of(t.column("text"), lower=True)
    n1 = n + 1
    last = np.cumsum(n1) - 1
    ids = np.empty(len(words) + len(n), np.uint64)
    inner = np.ones(len(ids), bool)
    inner[last] = False
    ids[inner] = words
    ids[last] = STOP
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    if len(ids):
        before[last - n] = START
    return ids, short(mix(before * np.uint64(0xD6E8FEB86659FD93) + ids * np.uint64(0xA0761D6478BD642F))), n1


def _asks(buckets: list[int]):
    def run(t: pa.Table):
        ids, pairs, n = _tokens(t)
        learn = np.repeat(~t.column("held_out").to_numpy(), n)
        grp = t.column("grp")[0].as_py()
        for kind, keys in (("wide", ids), ("short", pairs)):
            distinct, at = np.unique(keys, return_inverse=True)
            yield from ask(grp, kind, distinct, np.bincount(at, weights=learn, minlength=len(distinct)).astype(np.int64), buckets)

    return per_partition(run)


STATS = "doc_id long, held_out boolean, n_tokens long, words binary, words_large binary, pairs binary, pairs_large binary"
_STATS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("words", pa.binary()), ("words_large", pa.binary()), ("pairs", pa.binary()), ("pairs_large", pa.binary())])


def _stats(buckets: list[int]):
    def run(t: pa.Table, got: pa.Table) -> pa.Table:
        release()
        if not t.num_rows:
            return _STATS.empty_table()
        ids, pairs, n = _tokens(t)
        counts = []
        for kind, keys in (("wide", ids), ("short", pairs)):
            _, at = np.unique(keys, return_inverse=True)
            counts.append(totals(got, kind, buckets)[at])
        ends = np.cumsum(n)
        held = t.column("held_out").to_numpy()
        rows = []
        for k, (s, e) in enumerate(zip(ends - n, ends, strict=True)):
            rows.append((*pack_words(counts[0][s:e]), *pack_counts(counts[1][s:e])))
        cols = list(zip(*rows, strict=True))
        return in_batches(pa.Table.from_arrays([t.column("doc_id").combine_chunks(), pa.array(held), pa.array(n), *(pa.array(c, pa.binary()) for c in cols)], schema=_STATS))

    return run


def pack_words(n: np.ndarray) -> tuple[bytes, bytes]:
    """Two bytes for each count below 65535; the others follow as longs."""
    return np.minimum(n, 65535).astype("<u2").tobytes(), n[n >= 65535].astype("<i8").tobytes()


def unpack_words(small: bytes, large: bytes) -> np.ndarray:
    n = np.frombuffer(small, "<u2").astype(np.int64)
    n[n == 65535] = np.frombuffer(large, "<i8")
    return n


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2 c)."""
    return np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0)


def log_steps(p: np.ndarray, steps: int) -> np.ndarray:
    """log2 of p in so many steps a power of two; 255 below stands for zero."""
    return np.where(p > 0, np.round(steps * np.log2(np.maximum(p, 1e-30))), -255).astype(np.int64)


def learn_weights(hist: np.ndarray, total: int, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """EM over rows (bucket, log steps of the bigram estimate, log steps of the word count, tokens): weights l2, l1, l0 of each bucket."""
    weights = np.tile(np.array([0.3, 0.6, 0.1]), (BUCKETS, 1))
    weights[0] = (0.0, 0.9, 0.1)
    if not len(hist):
        return weights
    b, pair, word, many = (hist[:, i] for i in range(4))
    p = np.stack([np.where(pair > -255, 2.0 ** (pair / 4), 0.0), np.where(word > -255, 2.0 ** (word / 2), 0.0) / max(total - 1, 1), np.full(len(hist), 1.0 / (vocabulary + 1))], axis=1)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (many / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(b, weights=share[:, i], minlength=BUCKETS) for i in range(3)], axis=1)
        # A thousandth of a token for each part keeps every word possible.
        new += 1e-3
        new[0, 0] = 0.0
        seen = np.bincount(b, weights=many, minlength=BUCKETS) > 0
        weights[seen] = (new / new.sum(axis=1, keepdims=True))[seen]
    return weights


def score(docs: DataFrame, held_out, alpha: float = ALPHA) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; learns from those that held_out (a column) does not mark."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    groups = group_count(spark, text_bytes(docs))
    text = grouped(docs, groups)
    buckets = group_keys(groups)
    asked = text.mapInArrow(_asks(buckets), ASK)
    got = answers(asked, groups).repartition(groups, "grp")
    stats = materialize(text.groupBy("grp").cogroup(got.groupBy("grp")).applyInArrow(_stats(buckets), STATS))

    n_docs = stats.where("NOT held_out").count()

    # Each training token of a word with count c stands for 1/c of a distinct word, so V is the sum over training tokens.
    def summary(batches):
        for b in batches:
            tokens, kinds = 0, 0.0
            parts = []
            for held, w, wl, p, pl in zip(*(b.column(c).to_pylist() for c in ("held_out", "words", "words_large", "pairs", "pairs_large")), strict=True):
                if held:
                    continue
                word, pair = unpack_words(w, wl), unpack_counts(p, pl)
                tokens, kinds = tokens + len(word), kinds + (1.0 / word).sum()
                context = np.concatenate(([n_docs], word[:-1])) - 1
                parts.append((bucket_of(context) << 20) + ((log_steps((pair - 1) / np.maximum(context, 1), 4) + 255) << 10) + log_steps(word - 1, 2) + 255)
            codes, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
            # The code -1 carries the sums: tokens and distinct words.
            yield pa.RecordBatch.from_arrays([pa.array(np.append(codes, -1)), pa.array(np.append(n, tokens)), pa.array(np.append(np.zeros(len(n)), kinds))], names=["code", "n", "kinds"])

    found = stats.mapInArrow(summary, "code long, n long, kinds double").groupBy("code").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"))
    # At most BUCKETS x 120 x 120 rows.
    found = found.collect()
    tokens, kinds = next(((r["n"], round(r["kinds"])) for r in found if r["code"] == -1), (0, 0))
    code = np.array([(r["code"], r["n"]) for r in found if r["code"] >= 0], np.int64).reshape(-1, 2)
    rows = np.stack([code[:, 0] >> 20, (code[:, 0] >> 10 & 1023) - 255, (code[:, 0] & 1023) - 255, code[:, 1]], axis=1)
    weights = learn_weights(rows, tokens, kinds)

    def scored(batches):
        for b in batches:
            known, base, full = [], [], []
            for w, wl, p, pl in zip(*(b.column(c).to_pylist() for c in ("words", "words_large", "pairs", "pairs_large")), strict=True):
                word, pair = unpack_words(w, wl), unpack_counts(p, pl)
                context = np.concatenate(([n_docs], word[:-1]))
                l2, l1, l0 = weights[bucket_of(context)].T
                prob = l2 * np.where(context > 0, pair / np.maximum(context, 1), 0.0) + l1 * (word / max(tokens, 1)) + l0 / (kinds + 1)
                known.append(int((word > 0).sum()))
                base.append(float(np.log10((word + alpha) / (tokens + alpha * (kinds + 1))).sum()))
                full.append(float(np.log10(prob).sum()))
            n = len(known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), pa.array(known, pa.int64()), pa.array(np.full(n, tokens, np.int64)), pa.array(base, pa.float64()), pa.array(full, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return stats.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
