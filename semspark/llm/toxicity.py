"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in its
words and their beginnings (hashed, with weights of zero or more: the length of a
sentence speaks neither for nor against it); the document's is their noisy-or,
``1 - prod(1 - p)``.  Only documents are labelled: the gradient of the noisy-or
decides which sentences answer for a label.  The sentence probabilities then
locate the offending sentences.

Training takes a bounded sample (``PER_CLASS`` documents of either label at most),
turned into features by the executors; scoring takes every whole text, without a
shuffle.

Defined results: a null or empty text has no sentence and gets probability 0; rows
without labels, or with labels of one kind only, train a model that says what its
sample says; repeated rows are each scored; texts of any length are scored whole; no
rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from semspark.llm import common as C
from semspark.llm import samples
from semspark.llm.decontaminate import _LOWER, _WORD

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Bound of the training sample, for either class.
PER_CLASS = 3000
BUCKETS = 1 << 20
#: Beginnings of words, in bytes, that are features besides the whole word.
HEADS = (4, 6, 7)
#: Mini-batches of training at least; a large sample is gone through six times.
STEPS, BATCH, EPOCHS = 200, 128, 6

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


def featurise(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word (columns: the word, its beginnings), sentence of each word, document of each sentence, and the sentences' byte spans."""
    starts, ends, first = C.word_spans(data, at, _WORD)
    low = _LOWER[data]
    columns = [C.span_hashes(low, starts, ends)]
    for k in HEADS:  # a shorter word has itself as its beginning, which teaches nothing new
        columns.append(C.span_hashes(low, starts, np.minimum(ends, starts + k), seed=k))
    features = (np.stack(columns, 1) >> np.uint64(44)).astype(np.int64) if len(starts) else np.zeros((0, 1 + len(HEADS)), np.int64)
    doc = np.searchsorted(at, starts, "right") - 1
    breaks = np.cumsum(_BREAK[data])[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    again = ~new
    again[1:] &= columns[0][1:] == columns[0][:-1]
    features[again] = BUCKETS  # a word that repeats the one before says nothing more
    head = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    return features, sentence, doc[head], starts[head], ends[np.append(head[1:], len(starts)) - 1] if len(head) else ends


def logistic(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def sentences(self, features: np.ndarray, sentence: np.ndarray, count: int) -> np.ndarray:
        """Logit of each sentence."""
        return np.bincount(sentence, self.weights[features].sum(1), count) + self.bias

    def score(self, data: np.ndarray, at: np.ndarray):
        """Probability of each document; documents, spans and probabilities of the sentences."""
        features, sentence, doc, start, end = featurise(data, at)
        z = self.sentences(features, sentence, len(doc))
        total = np.bincount(doc, np.logaddexp(0, z), len(at) - 1)
        return -np.expm1(-total), doc, start, end, logistic(z)


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], share: float | None = None, steps: int = STEPS, seed: int = 7) -> Model:
    """Fit on (features by word, sentence of each word, label) of each document: Adagrad on the noisy-or's likelihood.

    ``share`` is the share of label 1 among all labelled rows; the sample is weighed to it.
    """
    balance = samples.balance([y for _, _, y in bags], share)
    rng = np.random.default_rng(seed)
    weights, gain, bias, bias_gain = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-3), -8.0, 1e-3
    seen = np.zeros(BUCKETS + 1, np.int32)
    for features, _, _ in bags:
        seen[np.unique(features)] += 1
    seen[BUCKETS] = 0
    known = seen >= 3  # what fewer documents hold cannot be told from chance
    bags = [b for b in bags if len(b[1])]
    for _ in range(max(EPOCHS, -(-steps * BATCH // len(bags))) if bags else 0):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            some = [bags[i] for i in order[lo : lo + BATCH]]
            sizes = [int(s[-1]) + 1 for _, s, _ in some]
            offset = np.cumsum([0, *sizes])
            features = np.concatenate([f for f, _, _ in some])
            sentence = np.concatenate([s + o for (_, s, _), o in zip(some, offset)])
            doc = np.repeat(np.arange(len(some)), sizes)
            y = np.array([y for _, _, y in some])
            z = np.bincount(sentence, weights[features].sum(1), offset[-1]) + bias
            total = np.bincount(doc, np.logaddexp(0, z), len(some))
            weight = np.where(y == 1, balance[1], balance[0])
            pull = np.where(y == 1, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-6), 1.0)
            g = pull[doc] * weight[doc] * logistic(z) / len(some) * 8
            full = np.bincount(features.ravel(), np.repeat(g[sentence], features.shape[1]), BUCKETS + 1)
            full = np.where(known, full + 1e-4 * weights, 0)
            gain += full * full
            weights = np.maximum(weights - 0.3 * full / np.sqrt(gain), 0)
            bias_gain += g.sum() ** 2
            bias -= 0.1 * g.sum() / np.sqrt(bias_gain)
    return Model(weights, bias)


def _packed(batches):
    for batch, data, at in C.pieces(batches, "text"):
        features, sentence, doc, _, _ = featurise(data, at)
        of_word = doc[sentence] if len(doc) else sentence
        cuts = np.searchsorted(of_word, np.arange(len(at)))
        first = np.searchsorted(doc, np.arange(len(at) - 1))
        rows = [(features[a:b].astype("<i4").tobytes(), (sentence[a:b] - s).astype("<i4").tobytes()) for a, b, s in zip(cuts, cuts[1:], first)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), batch.column("y")], ["features", "sentence", "y"])


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    C.bounded_batches(docs.sparkSession)
    drawn, share = samples.labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class)
    rows = drawn.select("text", "y").mapInArrow(_packed, "features binary, sentence binary, y int").toLocalIterator(prefetchPartitions=True)
    bags = [(np.frombuffer(r.features, "<i4").reshape(-1, 1 + len(HEADS)).astype(np.int64), np.frombuffer(r.sentence, "<i4").astype(np.int64), r.y) for r in rows]
    bags.sort(key=lambda b: (b[2], len(b[1]), b[0].sum()))
    return train(bags, share)


def _score(batches, model: Model, spans: bool):
    for batch, data, at in C.pieces(batches, "text"):
        score, doc, start, end, p = model.score(data, at)
        out = [batch.column("doc_id"), batch.column("_fold"), pa.array(score, pa.float64())]
        names = ["doc_id", "_fold", "score"]
        if spans:
            hot = np.flatnonzero(p >= THRESHOLD)
            cuts = np.searchsorted(doc[hot], np.arange(len(at)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            out.append(pa.array([[{"start": int(start[i] - at[d]), "end": int(end[i] - at[d]), "p": float(p[i])} for i in hot[cuts[d] : cuts[d + 1]]] for d in range(len(at) - 1)], kind))
            names.append("sentences")
        yield pa.RecordBatch.from_arrays(out, names)


def toxicity(docs: DataFrame, labels: DataFrame, spans: bool = True, per_class: int = PER_CLASS) -> DataFrame:
    """Scores of all documents; with ``spans`` also the byte spans of the sentences that offend, and their probabilities."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class))
    return samples.scored(docs, lambda it: _score(it, model.value, spans), FOLDS, HELD_OUT, THRESHOLD, ", sentences array<struct<start:long,end:long,p:double>>" * spans)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
