"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semspark.llm import common as C


#: A training text is of so many bytes at most; longer ones are scored like all others, but not learned from.
TEXT_BYTES = 1 << 18


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, text_bytes: int = TEXT_BYTES) -> tuple[DataFrame, float]:
    """(text, y) of at most ``per_class`` labelled documents of either class, as a hash of the id orders them;
    and the share of label 1 among all that may be drawn.

    Ids whose crc32 modulo ``folds`` is ``held_out`` are never drawn.  The largest
    label counts where an id is labelled twice; nulls and other values are no
    labels.  Whole texts are taken, one for each id however many rows share it, and
    none of more than ``text_bytes``: so the sample is bounded in rows and in bytes.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (C.crc_bucket("doc_id", folds) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("_order", F.xxhash64("doc_id", F.lit(17)))
    share = rows.agg(F.avg("y")).first()[0]
    drawn = None
    for y in (0, 1):
        some = rows.where(F.col("y") == y).orderBy("_order", "doc_id").limit(per_class).select("doc_id", "y")
        drawn = some if drawn is None else drawn.unionByName(some)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.where(F.octet_length("text") <= text_bytes).join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), share


def balance(labels: list[int], share: float | None) -> tuple[float, float]:
    """Weights of labels 0 and 1 that give a sample the true share of label 1."""
    ones = sum(labels) / max(1, len(labels))
    share = ones if share is None else share
    return (1 - share) / max(1 - ones, 1e-9), share / max(ones, 1e-9)


def scored(docs: DataFrame, run, folds: int, held_out: int, threshold: float, extra: str = "") -> DataFrame:
    """doc_id, held_out, score, predicted (and what else ``run`` gives) of every document."""
    C.bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", C.crc_bucket("doc_id", folds).alias("_fold"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, _fold long, score double{extra}")
    more = [c for c in out.columns if c not in ("doc_id", "_fold", "score")]
    return out.select("doc_id", (F.col("_fold") == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)
