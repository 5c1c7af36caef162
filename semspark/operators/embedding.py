"""From texts to vectors: each distinct text is encoded once, and only if the cache lacks it."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.functions import arrays as A
from semspark.functions import text as X
from semspark.functions import vectors as V

DIMENSIONS = 384


def text_set(*columns: tuple[DataFrame, str]) -> DataFrame:
    """All texts that need a vector, repeats included."""
    out = None
    for df, name in columns:
        some = df.select(F.col(name).alias("text")).where(F.col(name).isNotNull())
        out = some if out is None else out.unionByName(some)
    return out


def digest(text: Column) -> Column:
    """128 bits that stand for a text as a key, so that no text is one."""
    return F.unhex(F.md5(text))


def _digested(texts: DataFrame) -> DataFrame:
    """Texts with ``digest`` and, against a second text of that digest, an unrelated hash as ``check``."""
    have = {"digest": digest(F.col("text")), "check": F.xxhash64("text")}
    return texts.withColumns({c: v for c, v in have.items() if c not in texts.columns})


def text_dedupe(texts: DataFrame) -> DataFrame:
    """Each exact, case-sensitive text once (of each of the table's other columns); texts meet by digest, and two of one digest would be an error."""
    others = [c for c in texts.columns if c not in ("text", "digest", "check")]
    found = texts.where(F.col("text").isNotNull()).groupBy(*others, digest(F.col("text")).alias("digest")).agg(F.min("text").alias("text"), F.max("text").alias("_last"))
    return found.select(*others, F.when(F.col("text") == F.col("_last"), F.col("text")).otherwise(F.raise_error(F.lit("two texts share a digest"))).alias("text"))


def cache_miss(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts that the cache does not have; by digest, and by ``model_id`` where both tables hold it.

    Of the cache only digests travel, none of its texts or vectors; two unrelated
    hashes, of 192 bits together, stand for its text.
    """
    keys = [c for c in ("model_id",) if c in texts.columns and c in cache.columns] + ["digest", "check"]
    return _digested(texts).join(_digested(cache).select(*keys), keys, "left_anti").select(*texts.columns)


def _bucket(token: Column) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % DIMENSIONS).cast("int")


def slot_counts(text: Column) -> Column:
    """(slot, n) of a text, in the order of slots: equal tokens are counted as runs of the sorted ones, and each distinct one is digested once."""
    one = lambda v, at, n: F.struct(_bucket(F.get(v, at)).alias("slot"), n.cast("double").alias("n"))
    tokens = A.runs(F.sort_array(X.words(F.lower(text))), lambda t: t, one)
    total = lambda v, at, n: F.aggregate(A.span(at, n), F.lit(0.0), lambda s, j: s + F.get(v, j)["n"])
    return A.runs(F.sort_array(tokens), lambda e: e["slot"], lambda v, at, n: F.struct(F.get(v, at)["slot"].alias("slot"), total(v, at, n).alias("n")))


_TOKEN = re.compile(f"[^{X.SPACE[1:-1]}]+")


@lru_cache(maxsize=1 << 16)
def slot(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % DIMENSIONS


#: Python's own white space is that of ``text.words`` but for these.
_OTHER = "\ufeff\x85\x1c\x1d\x1e\x1f"


def tokens(text: str) -> list[str]:
    """What ``text.words`` gives.  Texts without the characters that Python tells otherwise are split by it, which is much faster."""
    if "\ufeff" in text or "\x85" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return _TOKEN.findall(text)
    return text.split()


def strings(texts: pa.Array) -> list[str | None]:
    """The texts as Python has them, which is much slower text by text."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def splitter(texts: list[str]) -> Callable[[str], list[str]]:
    """``tokens`` for these texts: the characters are looked for in all of them at once."""
    every = "\n".join(texts)
    return tokens if any(c in every for c in _OTHER) else str.split


def slots(lowered: str) -> tuple[list[int], float]:
    """The slot of each token of a lower-cased text, and the length of its vector."""
    found = [slot(t) for t in tokens(lowered)]
    # where each slot has one token, the sum of the squares is their number
    squares = len(found) if len(set(found)) == len(found) else sum(n * n for n in Counter(found).values())
    return found, math.sqrt(squares)


def sparse(lowered: str) -> tuple[dict[int, int], float]:
    """A lower-cased text's slots with their counts, and the length of that vector."""
    found, length = slots(lowered)
    return dict(Counter(found)), length


def sparse_cosine(a: tuple[list[int], float], b: tuple[dict[int, int], float]) -> float | None:
    """Cosine of the vectors of ``slots`` and of ``sparse``, within [-1, 1]; null where either has no token."""
    length, other = a[1] * b[1], b[0]
    return min(1.0, max(-1.0, sum([other[k] for k in a[0] if k in other]) / length)) if length else None


def _cosines(texts: pa.Array, anchors: pa.Array) -> pa.Array:
    """Of each row's texts the cosines to its anchor."""
    rows = zip(texts.to_pylist(), anchors.to_pylist())
    aimed = ((some, sparse((anchor or "").lower())) for some, anchor in rows)
    return pa.array([None if some is None else [sparse_cosine(slots((t or "").lower()), aim) for t in some] for some, aim in aimed], pa.list_(pa.float64()))


def hash_similarities(texts: Column, anchor: Column) -> Column:
    """Cosines of the hash vectors of an array of texts to that of one text, made in the row.

    The arithmetic over the few tokens is a loop in the task, not one of array functions,
    which spend their time on each element.
    """
    return F.arrow_udf(_cosines, "array<double>")(F.transform(texts, F.make_valid_utf8), F.make_valid_utf8(anchor))


def hash_encode(texts: DataFrame) -> DataFrame:
    """(text, embedding, norm) of distinct texts: the mean of one-hot token vectors, of length 1.

    A deterministic stand-in for a model, made of columns alone and in the text's own
    row.  Texts without a token have no row.
    """
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))

    def dense(s: Column) -> Column:
        """Each value and the zeros up to the next one, so that a vector is written once from left to right."""
        length = F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, e: t + e["n"] * e["n"]))
        following = lambda i: F.coalesce(F.get(s, i + 1)["slot"], F.lit(DIMENSIONS))
        values = A.let(length, lambda z: F.transform(s, lambda e, i: F.concat(F.array(e["n"] / z), zeros(following(i) - e["slot"] - 1))))
        return F.concat(zeros(F.get(s, F.lit(0))["slot"]), F.flatten(values))

    vector = A.let(slot_counts(F.col("text")), lambda s: F.when(F.size(s) > 0, dense(s)))
    rows = A.settled(texts.select("text"), "embedding", vector).where(F.col("embedding").isNotNull())
    return rows.select("text", "embedding", V.norm(F.col("embedding")).alias("norm"))


def hash_model() -> Callable[[list[str]], np.ndarray | list[np.ndarray | None]]:
    """A model in numpy that gives what ``hash_encode`` gives; a stand-in for a caller's own."""
    known: dict[str, int] = {}

    def number(token: str) -> int:
        if token not in known:
            if len(known) >= 1 << 18:
                known.clear()
            known[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % DIMENSIONS
        return known[token]

    def run(texts: list[str]) -> np.ndarray | list[np.ndarray | None]:
        found = [[number(w) for w in tokens(t.lower())] for t in texts]
        n = np.fromiter(map(len, found), np.int64, len(found))
        places = np.repeat(np.arange(len(n)), n) * DIMENSIONS + np.fromiter(chain.from_iterable(found), np.int64, n.sum())
        counts = np.bincount(places, minlength=len(n) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(float)
        out = counts / np.maximum(np.sqrt((counts * counts).sum(axis=1)), 1.0)[:, None]
        return out if n.all() else [v if k else None for v, k in zip(out, n)]

    return run


#: Models that this Python worker has loaded, by their names.
_MODELS: dict[str, Callable[[list[str]], list[list[float]]]] = {}
BATCH_BYTES, BATCH_TEXTS = 1 << 20, 256


def _model(encoder: Callable[[], Callable], name: str | None) -> Callable:
    if name is None:
        return encoder()
    if name not in _MODELS:
        _MODELS[name] = encoder()
    return _MODELS[name]


def bounded(texts: list[str], most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes, or of one text, and of at most so many rows."""
    first = size = 0
    for k, t in enumerate(texts):
        n = len(t.encode())
        if k > first and (size + n > most or k - first == rows):
            yield first, k
            first, size = k, 0
        size += n
    if len(texts) > first:
        yield first, len(texts)


def encode(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], Sequence]], name: str | None = None, batch_bytes: int = BATCH_BYTES, batch_texts: int = BATCH_TEXTS, packed: bool = False) -> DataFrame:
    """(text, embedding, norm) by a caller's model, or (text, vector) ``packed``; what it gives a text must not depend on the others in its batch.

    The model is loaded once for each Python worker under its ``name``, or once a task
    if it has none, and is handed batches bounded in bytes and in texts.  It gives a
    vector, or None, for each text; a text that it gives None has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(encoder, name)
        for batch in batches:
            some = strings(batch.column("text"))
            for a, b in bounded(some, batch_bytes, batch_texts):
                own, vectors, norm = _listed(model(some[a:b]))
                columns = [pack(vectors, norm)] if packed else [vectors, pa.array(norm, pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column("text").slice(a, b - a).take(pa.array(own)), *columns], ["text", *names])

    names = ["vector"] if packed else ["embedding", "norm"]
    return texts.select("text").where(F.col("text").isNotNull()).mapInArrow(run, "text string, " + ("vector binary" if packed else "embedding array<double>, norm double"))


def _listed(vectors: Sequence) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of what a model gives: the places of those that are vectors, these, and their norms."""
    if isinstance(vectors, np.ndarray) and vectors.ndim == 2:
        some = vectors.astype(float, copy=False)
        ends = np.arange(len(some) + 1) * some.shape[1]
        return np.arange(len(some)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(some.ravel(), pa.float64())), np.sqrt((some * some).sum(axis=1))
    own = np.array([k for k, v in enumerate(vectors) if v is not None], np.int64)
    some = [np.asarray(vectors[k], float) for k in own]
    ends = np.cumsum([0, *map(len, some)])
    values = np.concatenate(some) if some else np.zeros(0)
    return own, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64())), np.array([np.linalg.norm(v) for v in some], float)


# --- packed vectors: the dimension and the norm, then the components that are not zero ---

_ENTRY = np.dtype([("at", "<u4"), ("value", "<f8")])


def pack(vectors: pa.Array, norms: np.ndarray) -> pa.Array:
    """Vectors with their norms as bytes, without loss: as many entries as there are components that are not zero, and one; null for null."""
    there = np.asarray(vectors.is_valid())
    size = np.where(there, np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)), 0)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    full = np.flatnonzero(values != 0)
    row = np.repeat(np.arange(len(size)), size)[full]
    n = np.bincount(row, minlength=len(size)) + there
    ends = np.cumsum(np.append(0, n))
    out = np.zeros(ends[-1], _ENTRY)
    heads = ends[:-1][there]
    out["at"][heads], out["value"][heads] = size[there], norms[there]
    rest = np.ones(len(out), bool)
    rest[heads] = False
    out["at"][rest], out["value"][rest] = full - (np.cumsum(size) - size)[row], values[full]
    made = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * _ENTRY.itemsize), pa.py_buffer(out.tobytes())])
    return pc.if_else(pa.array(there), made, None).cast(pa.binary())


def packed(vectors: DataFrame) -> DataFrame:
    """Vectors (text, embedding, norm) as (text, vector); those that are packed stay."""
    if "vector" in vectors.columns:
        return vectors
    both = F.arrow_udf(lambda v, norm: pack(v, np.asarray(norm.to_numpy(zero_copy_only=False), float)), "binary")("embedding", "norm")
    return vectors.select(*(c for c in vectors.columns if c not in ("embedding", "norm")), both.alias("vector"))


def packed_cosines(vectors: pa.Array, of: np.ndarray) -> np.ndarray:
    """Cosine of each packed vector to the one at the place that ``of`` names, in [-1, 1]; NaN where either is null.  Only places before a vector's own, or its own, are named."""
    there = np.asarray(vectors.is_valid())
    some = vectors.filter(pa.array(there)).cast(pa.large_binary())
    data, ends = some.buffers()[2], np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1] // _ENTRY.itemsize
    entries = np.frombuffer(data, _ENTRY, ends[-1])[ends[0] :] if len(some) and data is not None else np.zeros(0, _ENTRY)
    place, n, heads = np.flatnonzero(there), np.diff(ends), ends[:-1] - ends[0]
    size, norm = np.full(len(of), -1), np.full(len(of), np.nan)
    size[place], norm[place] = entries["at"][heads], entries["value"][heads]
    both = there & there[of]
    if (size != size[of])[both].any():
        raise ValueError("vectors differ in length")
    if (norm == 0)[both].any():
        raise ValueError("a zero vector has no cosine")
    rest = np.ones(len(entries), bool)
    rest[heads] = False
    own, at, value = np.repeat(place, n)[rest], entries["at"][rest].astype(np.int64), entries["value"][rest]
    width = int(size.max(initial=0)) + 1
    anchor = np.zeros(len(of), bool)
    anchor[of] = True
    kept = anchor[own]
    keys, values = own[kept] * width + at[kept], value[kept]  # in order, as places and components are
    wanted = of[own] * width + at
    found = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    product = np.where(keys[found] == wanted, values[found] * value, 0.0) if len(keys) else np.zeros(len(wanted))
    with np.errstate(invalid="ignore"):
        return np.where(both, np.clip(np.bincount(own, product, len(of)) / (norm * norm[of]), -1.0, 1.0), np.nan)


def mean_pool(tokens: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, embedding): token vectors averaged slot by slot."""
    slots = tokens.select(key, F.posexplode(vector).alias("slot", "v")).groupBy(key, "slot").agg(F.avg("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("slot", "v")))
    return slots.groupBy(key).agg(F.transform(ordered, lambda s: s["v"]).alias("embedding"))


def attach(rows: DataFrame, vectors: DataFrame, text: str, prefix: str) -> DataFrame:
    """Rows with ``<prefix>_vec`` and ``<prefix>_norm``, or ``<prefix>_vector`` of packed ones, of the text in that column (null where it has none).

    They meet by digest, and the whole texts are compared where they meet.  A text that
    very many rows have makes a skewed join, which Spark splits on the rows' side.
    """
    columns = (F.col(c).alias(f"{prefix}_{n}") for c, n in (("embedding", "vec"), ("norm", "norm"), ("vector", "vector")) if c in vectors.columns)
    found = _digested(vectors).select(F.col("digest").alias("_digest"), F.col("text").alias("_text"), *columns)
    mine = rows.withColumn("_mine", digest(F.col(text)))
    # equal by two prefix tests, as an equality would make the text a key of the exchange
    same = F.startswith(F.col(text), F.col("_text")) & F.startswith(F.col("_text"), F.col(text))
    return mine.join(found, (F.col("_mine") == F.col("_digest")) & same, "left").drop("_mine", "_digest", "_text")


def _products(a: pa.Array, b: pa.Array) -> pa.Array:
    """Dot products of the vectors of two columns, a batch at once; null where either is."""
    there = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    x, y = (v.filter(pa.array(there)) for v in (a, b))
    n, m = (np.asarray(v.value_lengths()) for v in (x, y))
    if (n != m).any():
        raise ValueError("vectors differ in length")
    p = x.flatten().to_numpy(zero_copy_only=False) * y.flatten().to_numpy(zero_copy_only=False)
    out = np.full(len(a), np.nan)
    if len(n) and (n == n[0]).all():
        out[there] = p.reshape(len(n), n[0]).sum(axis=1)
    else:
        out[there] = [some.sum() for some in np.split(p, np.cumsum(n)[:-1])] if len(n) else []
    return pa.array(out, pa.float64(), mask=~there)


def similarity(a: str, b: str, scale: int | None = None) -> Column:
    """Cosine of two attached texts; norms are those of the vectors, reckoned once a text."""
    product = F.arrow_udf(_products, "double")(F.col(f"{a}_vec"), F.col(f"{b}_vec"))
    value = V.cosine_of(product, F.col(f"{a}_norm"), F.col(f"{b}_norm"))
    return value if scale is None else F.round(value, scale)


# --- the cache: <path>/model_id=<model>/epoch=<epoch>/ ------------------------------

CACHE = "text string, digest binary, check long, embedding array<double>, norm double, model_id string, epoch string"
#: Digests, which no packing makes smaller, are made of the texts again when these are met.
PACKED_CACHE = "text string, vector binary, model_id string, epoch string"


def cached(spark: SparkSession, path: str, model_id: str | None = None, without: str | None = None, packed: bool = False) -> DataFrame:
    """The cache table, or one model's part of it; ``without`` leaves out what one epoch has written, as when that epoch is run again.  A cache holds vectors that are ``packed``, or such that are not."""
    schema = PACKED_CACHE if packed else CACHE
    spark.createDataFrame([], schema).drop("model_id", "epoch").write.mode("ignore").parquet(f"{path}/model_id=none/epoch=none")
    rows = spark.read.schema(schema).parquet(path).where("epoch <> 'none'")
    if model_id is not None:
        rows = rows.where(F.col("model_id") == model_id)
    return rows if without is None else rows.where(F.col("epoch") != without)


def cache_append(vectors: DataFrame, path: str, model_id: str, epoch: str) -> None:
    """Add vectors (text, embedding, norm; or text, vector) to the cache as one epoch; an epoch that is written again replaces its own rows and no others."""
    rows = vectors.select("text", "vector") if "vector" in vectors.columns else _digested(vectors).select("text", "digest", "check", "embedding", "norm")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/model_id={quote(model_id, safe='')}/epoch={quote(epoch, safe='')}")


def cache_add(texts: DataFrame, path: str, model_id: str, epoch: str, encode: Callable[[DataFrame], DataFrame] = hash_encode, packed: bool = False) -> None:
    """One chain: each text once, those that the cache lacks, their vectors, appended.

    What this epoch may have written before, in full or in part, counts as absent, so
    that running it again leaves the same rows.
    """
    lacking = cache_miss(text_dedupe(texts), cached(texts.sparkSession, path, model_id, without=epoch, packed=packed))
    cache_append(encode(lacking), path, model_id, epoch)
