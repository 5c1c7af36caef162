"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters slide over the whole text in steps; their
rectified outputs are max-pooled over overlapping chunks that cover the document;
a small hidden layer describes each chunk; the chunks' descriptions are combined
by their maximum and mean into one logit.  Training is by back-propagation on a
bounded sample (``PER_CLASS`` documents of either label at most, whole texts).
Scoring takes every whole text, without a shuffle; a long text is worked on some
chunks at a time.

Defined results: a null or empty text is one chunk of padding, and gets what the
network says of that; without labels the network is untrained and says 1/2, so
that nothing is rejected; repeated rows are each scored; texts of any length are
scored whole; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from semspark.llm import common as C
from semspark.llm import samples

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Bound of the training sample, for either class.
PER_CLASS = 1200
#: Mini-batches of training, whatever the sample's size.
STEPS, BATCH = 450, 32
WIDTH, STEP, CHUNK, STRIDE = 12, 4, 512, 384
EMBED, FILTERS, HIDDEN = 8, 24, 16
_CELLS = (CHUNK - WIDTH) // STEP + 1
_SHAPES = {"embed": (257, EMBED), "conv": (WIDTH * EMBED, FILTERS), "conv_b": (FILTERS,), "hidden": (FILTERS, HIDDEN), "hidden_b": (HIDDEN,), "out": (2 * HIDDEN,), "out_b": (1,)}


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks (rows of byte codes, 256 pads) of all texts, and each one's text."""
    sizes = np.diff(at)
    count = np.maximum(1, -(-(sizes - (CHUNK - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = at[:-1][doc] + nth * STRIDE
    where = start[:, None] + np.arange(CHUNK)
    padded = np.append(data.astype(np.int16), 256)
    return padded[np.where(where < at[1:][doc][:, None], where, len(data))], doc


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(size=s) * (0.5 if k == "embed" else (2 / s[0]) ** 0.5)).astype(np.float32) if not k.endswith("_b") and k != "out" else np.zeros(s, np.float32) for k, s in _SHAPES.items()}

    def _windows(self, codes: np.ndarray) -> np.ndarray:
        """(chunks, cells, width * embed) views of the embedded bytes, copied."""
        x = self.p["embed"][codes].reshape(len(codes), CHUNK * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STEP * EMBED]
        return np.ascontiguousarray(view)

    def pool(self, codes: np.ndarray, where: bool = False):
        """Max-pooled filter outputs of each chunk, and the cell of each maximum."""
        out, best = np.empty((len(codes), FILTERS), np.float32), np.empty((len(codes), FILTERS), np.int64)
        for lo in range(0, len(codes), 64):
            windows = self._windows(codes[lo : lo + 64])
            z = (windows.reshape(-1, WIDTH * EMBED) @ self.p["conv"]).reshape(len(windows), _CELLS, FILTERS)
            if where:
                best[lo : lo + 64] = z.argmax(1)
            out[lo : lo + 64] = z.max(1)
        return np.maximum(out + self.p["conv_b"], 0), best

    def describe(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.p["hidden"] + self.p["hidden_b"], 0)

    def score(self, data: np.ndarray, at: np.ndarray, most: int = 1024) -> np.ndarray:
        """Probability of each text; at most ``most`` chunks are held at a time."""
        n = len(at) - 1
        top, total, count = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float64), np.zeros(n)
        piece = most * STRIDE
        for lo in range(0, n):  # long texts by themselves, piece by piece; the rest below
            if at[lo + 1] - at[lo] > piece:
                for a in range(int(at[lo]), int(at[lo + 1]), piece):
                    b = min(int(at[lo + 1]), a + piece + CHUNK - STRIDE)
                    codes, _ = chunks(data[a:b], np.array([0, b - a]))
                    h = self.describe(self.pool(codes)[0])
                    top[lo], total[lo], count[lo] = np.maximum(top[lo], h.max(0)), total[lo] + h.sum(0), count[lo] + len(h)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + piece, "right")) - 1)
            if last - first > 1 or at[last] - at[first] <= piece:
                codes, doc = chunks(data[at[first] : at[last]], at[first : last + 1] - at[first])
                h = self.describe(self.pool(codes)[0])
                heads = np.flatnonzero(np.diff(doc, prepend=-1))
                top[first:last], total[first:last], count[first:last] = np.maximum.reduceat(h, heads), np.add.reduceat(h, heads), np.bincount(doc)
            first = last
        z = np.concatenate([top, total / np.maximum(count, 1)[:, None]], 1) @ self.p["out"] + self.p["out_b"]
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def gradients(self, codes: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss; the maxima pass theirs to one cell or chunk each."""
        p, n = self.p, len(y)
        pooled, best = self.pool(codes, where=True)
        h = self.describe(pooled)
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        count = np.bincount(doc, minlength=n)
        top, mean = np.maximum.reduceat(h, heads), np.add.reduceat(h, heads) / count[:, None]
        z = np.concatenate([top, mean], 1) @ p["out"] + p["out_b"]
        dz = ((1 / (1 + np.exp(-z)) - y) * weight / n).astype(np.float32)
        g = {"out": np.concatenate([top, mean], 1).T @ dz, "out_b": dz.sum(keepdims=True)}
        dh = (dz / count)[doc][:, None] * p["out"][HIDDEN:]
        lead = (h == top[doc]) & (h > 0)
        share = np.maximum(np.add.reduceat(lead.astype(np.float32), heads), 1)
        dh = (dh + lead / share[doc] * dz[doc][:, None] * p["out"][:HIDDEN]) * (h > 0)
        g["hidden"], g["hidden_b"] = pooled.T @ dh, dh.sum(0)
        dp = (dh @ p["hidden"].T) * (pooled > 0)
        g["conv_b"] = dp.sum(0)
        g["conv"], g["embed"] = np.zeros_like(p["conv"]), np.zeros_like(p["embed"])
        for f in range(FILTERS):
            some = np.flatnonzero(dp[:, f])
            cells = best[some, f] * STEP
            seen = codes[some[:, None], cells[:, None] + np.arange(WIDTH)]
            d = dp[some, f].astype(np.float32)
            g["conv"][:, f] = d @ p["embed"][seen].reshape(len(some), WIDTH * EMBED)
            taps = p["conv"][:, f].reshape(WIDTH, EMBED)
            pull = np.stack([np.bincount(seen[:, j], d, 257) for j in range(WIDTH)], 1) if len(some) else np.zeros((257, WIDTH))
            g["embed"] += (pull @ taps).astype(np.float32)
        return g


def train(texts: list[bytes], labels: list[int], share: float | None = None, steps: int = STEPS, seed: int = 11) -> Network:
    """Adam on mini-batches of texts, weighed to ``share``, that of label 1 among all labelled rows."""
    net = Network(seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return net
    rng = np.random.default_rng(seed)
    weight = np.array(samples.balance(labels, share), np.float32)[y.astype(int)]
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    net.p["out"][:] = rng.normal(size=2 * HIDDEN) * 0.2
    t = 0
    while t < steps:
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            rate = 0.004 * max(0, 1 - t / steps) + 0.0005
            some = order[lo : lo + BATCH]
            at = np.cumsum([0, *(len(texts[i]) for i in some)])
            codes, doc = chunks(np.frombuffer(b"".join(texts[i] for i in some), np.uint8), at)
            t += 1
            for k, g in net.gradients(codes, doc, y[some], weight[some]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    drawn, share = samples.labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class)
    rows = sorted((r.y, r.text or "") for r in drawn.select("text", "y").toLocalIterator(prefetchPartitions=True))
    return train([t.encode() for _, t in rows], [y for y, _ in rows], share)


def _score(batches, net: Network):
    for batch, data, at in C.pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_fold"), pa.array(net.score(data, at), pa.float64())], ["doc_id", "_fold", "score"])


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Scores of all documents."""
    net = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class))
    return samples.scored(docs, lambda it: _score(it, net.value), FOLDS, HELD_OUT, THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    net = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class))
    C.bounded_batches(docs.sparkSession)

    def run(batches):
        for batch, data, at in C.pieces(batches, "text"):
            yield batch.filter(pa.array(net.value.score(data, at) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
