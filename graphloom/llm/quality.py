"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Units are runs of letters, of digits, or of other characters inside words; a unit that repeats the one or the unit two before it
counts as the unit "repeated". Each unit has a row (its hash modulo `rows`) and each row a sparse random index vector of +1 and
-1. A row's context vector is the sum of the index vectors of the units up to two places away, over all occurrences in all
documents; rows are counted in numpy, and each task sends its sums as blocks of fixed size, so the table has a fixed size
however large the corpus. A document is the mean of its units' vectors, centred and of unit length, with the log of its length.

The network learns from at most `per_class` labelled rows of each class, by smallest hash of doc_id; four fifths fit the
weights, the rest a temperature.

Null and empty texts are documents without units: the zero vector; texts of any length are read whole. Repeated rows, and rows with a null
doc_id (whose labels teach nothing), are scored each on its own. Columns other than doc_id and text are ignored. An empty table gives an
empty result. If a class has no
labelled rows, every score is the share of ones among the labels (one half without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, prepare, text_buffers, word_hashes
from .toxicity import sample

ROWS, DIMS, NONZERO, REACH = 8192, 64, 4, 2
BLOCK = 256
PER_CLASS = 4000
HIDDEN = 24
REPEATED = 0

_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[SPACE] = 0


def index_vectors(rows: int = ROWS, dims: int = DIMS, nonzero: int = NONZERO, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the places that are not zero, and their signs."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, dims, (rows, nonzero)), rng.integers(0, 2, (rows, nonzero)) * 2 - 1


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each unit, and the number of units of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    n = np.diff(np.searchsorted(start, off))
    h = word_hashes(data, start, end)
    row = (h % np.uint64(ROWS - 1)).astype(np.int64) + 1
    text = np.repeat(np.arange(len(n)), n)
    for back in (1, 2):
        same = (h[back:] == h[:-back]) & (text[back:] == text[:-back])
        row[back:][same] = REPEATED
    return row, n


def _context_sums(batches):
    """Of all texts of a task: for each row the sum of its neighbours' index vectors and, last, its number."""
    place, sign = index_vectors()
    width = DIMS + 1
    total = np.zeros(ROWS * width, np.int64)
    for b in batches:
        for data, off in text_buffers(b.column("text")):
            row, n = units(data, off)
            text = np.repeat(np.arange(len(n)), n)
            total += np.bincount(row * width + DIMS, minlength=len(total))
            for d in range(1, REACH + 1):
                near = text[d:] == text[:-d]
                a, c = row[d:][near], row[:-d][near]
                for x, y in ((a, c), (c, a)):
                    for k in range(NONZERO):
                        total += np.bincount(x * width + place[y, k], weights=sign[y, k], minlength=len(total)).astype(np.int64)
    for at in range(0, ROWS, BLOCK):
        part = total[at * width : (at + BLOCK) * width]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["block", "sums"])


def _add(t: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(x, "<i8") for x in t.column("sums").to_pylist())
    return pa.table({"block": t.column("block").slice(0, 1).combine_chunks(), "sums": pa.array([sums.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """rows x dims, each row centred and of unit length. The driver gets ROWS x (DIMS + 1) numbers, whatever the input."""
    prepare(docs.sparkSession)
    total = np.zeros((ROWS, DIMS + 1))
    for r in docs.select("text").mapInArrow(_context_sums, "block int, sums binary").groupBy("block").applyInArrow(_add, "block int, sums binary").collect():
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], "<i8").reshape(-1, DIMS + 1)
    many = total[:, DIMS:]
    vectors = total[:, :DIMS] / np.maximum(many, 1)
    seen = many[:, 0] > 0
    if seen.any():
        vectors[seen] -= np.average(vectors[seen], axis=0, weights=np.sqrt(many[seen, 0]))
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, x: each document's mean vector and the log of 1 + its units."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        table = shared.value
        for b in batches:
            out = []
            for data, off in text_buffers(b.column("text")):
                row, n = units(data, off)
                x = np.zeros((len(n), DIMS + 1), np.float32)
                have = n > 0
                if have.any():
                    first = (np.cumsum(n) - n)[have]
                    x[have, :DIMS] = np.add.reduceat(table[row], first, axis=0) / n[have, None]
                x[:, DIMS] = np.log1p(n) / 10
                out.append(x)
            x = np.concatenate(out) if out else np.zeros((0, DIMS + 1), np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIMS + 1).cast(pa.list_(pa.float32()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


class Network:
    """tanh(x W1 + b1) W2 + b2, divided by a temperature."""

    def __init__(self, dims: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.p = [rng.normal(0, dims**-0.5, (dims, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(dims), np.ones(dims), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4, seed: int = 6) -> None:
        """Adam on the weighted log loss."""
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), batch):
                i = order[at : at + batch]
                w1, b1, w2, b2 = self.p
                h = np.tanh(z[i] @ w1 + b1)
                d = weight[i] * (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - y[i]) / len(i)
                back = np.outer(d, w2) * (1 - h * h)
                grads = [z[i].T @ back + decay * w1, back.sum(axis=0), h.T @ d + decay * w2, np.array([d.sum()])]
                step += 1
                lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature with the smallest weighted log loss."""
        z = self.logits(x)
        best = None
        for t in np.exp(np.linspace(np.log(0.25), np.log(8), 61)):
            s = np.clip(z / t, -30, 30)
            loss = (weight * (np.logaddexp(0, s) - y * s)).sum()
            if best is None or loss < best[0]:
                best = loss, float(t)
        self.temperature = best[1] if best else 1.0


def fit(features: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | float:
    """Learns from features(doc_id, x) of the rows of labels(doc_id, quality); a constant if a class has no rows."""
    rows = sample(features.withColumnRenamed("x", "text"), labels, "quality", per_class).collect()
    share = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().where("quality IS NOT NULL").collect()}
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    y = np.array([r["label"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return share.get(1, 0) / max(1, share.get(0, 0) + share.get(1, 0)) if share else 0.5
    x = np.array([r["text"] for r in rows], np.float64)
    # Classes count by their shares among all labelled rows, so that probabilities are right for those.
    weight = np.where(y > 0, share[1] / y.sum(), share[0] / (1 - y).sum())
    weight /= weight.mean()
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    net = Network(x.shape[1])
    net.fit(x[~held], y[~held], weight[~held])
    if held.any():
        net.calibrate(x[held], y[held], weight[held])
    return net


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score, predicted of each row of docs; labels(doc_id, quality) are the rows to learn from."""
    prepare(docs.sparkSession)
    features = materialize(pooled(docs, word_vectors(docs)))
    net = fit(features, labels, per_class)

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float64)
            p = net.probability(x) if isinstance(net, Network) else np.full(b.num_rows, net)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return features.mapInArrow(run, "doc_id long, score double, predicted int")
