"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semspark.llm import common as C


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), of every id in them.

    A star step hangs a vertex's larger neighbours, or its smaller ones, on its
    smallest; only minima are gathered for a vertex, never its neighbours.  Each
    round's edges and minima are written to the shared folder: a hub's edges are then
    joined with its one minimum as plain exchanges, which Spark splits where a key is
    hot.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = C.stored(pairs, "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = C.stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = C.stored(large, "large")
        low = C.stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = C.stored(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        was, mark, now = mark, _mark(then), then
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
