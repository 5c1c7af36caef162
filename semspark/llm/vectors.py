"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits the vectors by random directions, at that one of the middle
quantiles of their projections where they lie thinnest; those within the spill
margin of the split go to both sides.  The margin is half of what the projections
of a pair at the threshold differ by.  Vectors are compared within the leaves, and
pairs of cosine at or above the threshold are verified links; connected components
unite them.

The upper splits are fitted on a bounded sample (``SAMPLE`` vectors); every vector
is indexed.  Leaves that hold more than ``LEAF_ROWS`` of all vectors are split on,
round by round, at quantiles that Spark computes over all their rows.  Where a
split would send too many vectors to both sides, as in a group of near copies, it
is not made: such a leaf is compared in blocks, every pair of blocks in a task of
its own, and so no pair is left out.

Equal vectors are one vector with a number of copies.  No pair leaves a task: a
pair that shares several leaves is counted in the first of them, so that counts
add up; of a leaf's links only each vector's smallest linked id goes on.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, and neither do vectors of different length; a row
without an id has no links, no component, and is not kept; vectors of one id that
differ have links of their own; repeated rows are copies of one another; no rows give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm import common as C
from semspark.llm.components import components

COSINE = 0.95
TREES = 8
#: Bound of the sample that the upper splits are fitted on.
SAMPLE = 16_384
#: Quantiles at which a split may be made.
QUANTILES = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]
#: A split that sends a larger share to both sides is not made.
MOST_SPILL = 0.4
LEAF_ROWS = 1024
ROUNDS = 40


def margin(cosine: float, dimensions: int) -> float:
    """Half the standard deviation of the difference of two unit vectors' projections, if they are at the threshold."""
    return 0.5 * (2 * (1 - cosine) / dimensions) ** 0.5


class Tree:
    """Split nodes as arrays: direction, bounds and children; a child below 0 is the leaf -1 - child."""

    def __init__(self, unit: np.ndarray, leaf: int, spill: float, rng: np.random.Generator):
        self.spill = spill
        self.directions, self.low, self.high, self.children = [], [], [], []
        self.leaves = 0
        self.root = self._grow(unit, np.arange(len(unit)), leaf, rng)
        self.directions = np.array(self.directions).reshape(len(self.low), unit.shape[1])
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, unit, rows, leaf, rng) -> int:
        if len(rows) > leaf:
            d = rng.normal(size=unit.shape[1])
            d /= np.linalg.norm(d)
            p = unit[rows] @ d
            cuts = np.quantile(p, QUANTILES)
            order = np.sort(p)
            near = np.searchsorted(order, cuts + self.spill, "right") - np.searchsorted(order, cuts - self.spill)
            if near.min() <= MOST_SPILL * len(rows):
                cut, me = cuts[near.argmin()], len(self.low)
                self.directions.append(d)
                self.low.append(cut - self.spill)
                self.high.append(cut + self.spill)
                self.children.append([0, 0])
                self.children[me] = [self._grow(unit, rows[p <= cut + self.spill], leaf, rng), self._grow(unit, rows[p >= cut - self.spill], leaf, rng)]
                return me
        self.leaves += 1
        return -self.leaves

    def leaves_of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all vectors; spilled ones come more than once."""
        rows, node, out = np.arange(len(unit)), np.full(len(unit), self.root), []
        while len(rows):
            end = node < 0
            out.append((rows[end], -1 - node[end]))
            rows, node = rows[~end], node[~end]
            p = np.einsum("ij,ij->i", unit[rows], self.directions[node]) if len(rows) else np.zeros(0)
            left, right = p <= self.high[node], p >= self.low[node]
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([self.children[node[left], 0], self.children[node[right], 1]])
        return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, kept as little-endian doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled to length 1, in two steps so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batches):
    """Batches of vectors of one length each."""
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column("vector").to_pylist()], np.int64)
        for size in np.unique(sizes):
            yield batch.take(pa.array(np.flatnonzero(sizes == size)))


def _pack(batches):
    """Arrays of floats as bytes."""
    for batch in batches:
        vectors = [np.array(v, "<f8").tobytes() for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(vectors, pa.binary())], batch.schema.names)


def _assign(batches, forest: dict[int, list[Tree]]):
    """(node, leaf) rows; a leaf's number holds its tree's, and vectors of a length that the sample lacks are in one leaf."""
    for batch in _by_length(batches):
        unit = _unit(_matrix(batch.column("vector")))
        node = batch.column("node").to_numpy()
        trees = forest.get(unit.shape[1])
        parts = [(np.arange(len(unit)), np.zeros(len(unit), np.int64))] if trees is None else [(r, (t + 1 << 32) + leaf) for t, tree in enumerate(trees) for r, leaf in [tree.leaves_of(unit)]]
        rows, leaves = (np.concatenate(x) for x in zip(*parts))
        yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(leaves + (unit.shape[1] << 44))], ["node", "leaf"])


def _project(batches, cosine: float):
    """Projection of each vector on its leaf's own direction, and the spill margin."""
    for batch in _by_length(batches):
        unit = _unit(_matrix(batch.column("vector")))
        leaf = batch.column("leaf").to_numpy()
        p = np.empty(len(unit))
        for k in np.unique(leaf):
            d = np.random.default_rng(int(k)).normal(size=unit.shape[1])
            p[leaf == k] = unit[leaf == k] @ (d / np.linalg.norm(d))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("leaf"), pa.array(p), pa.array(np.full(len(p), margin(cosine, unit.shape[1])))], ["node", "leaf", "p", "m"])


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable over pairs."""
    lab = np.arange(n)
    while True:
        was = lab.copy()
        low = np.minimum(lab[i], lab[j])
        np.minimum.at(lab, i, low)
        np.minimum.at(lab, j, low)
        lab = lab[lab]
        if (lab == was).all():
            return lab


def _compare(table: pa.Table, cosine: float) -> pa.Table:
    """Links inside a leaf, or between two blocks of it: each node's linked vectors counted here, and the smallest node that it is joined with."""
    leaf, left, right = (table.column(c)[0].as_py() for c in ("leaf", "left", "right"))
    node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
    order = np.lexsort((node, block))
    node, copies, block = node[order], copies[order], block[order]
    unit = _unit(_matrix(table.column("vector").combine_chunks()))[order]
    lists = [table.column("leaves")[int(k)].as_py() for k in order]
    width = max(map(len, lists))
    mine = np.full((len(node), width), -1, np.int64)
    for k, x in enumerate(lists):
        mine[k, : len(x)] = x
    links, pairs = np.zeros(len(node), np.int64), []
    split = len(node) if left == right else int(np.searchsorted(block, right))
    second = 0 if left == right else split
    for lo in range(0, split, 256):
        g = unit[lo : min(split, lo + 256)] @ unit[second:].T
        i, j = np.nonzero(g >= cosine)
        i, j = i + lo, j + second
        i, j = i[i < j], j[i < j]
        pairs.append((i, j))
        for a in range(0, len(i), 1 << 14):
            x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            same = ((mine[x][:, :, None] == mine[y][:, None, :]) & (mine[x] >= 0)[:, :, None]).any(2)
            here = mine[x, same.argmax(1)] == leaf
            np.add.at(links, x[here], copies[y[here]])
            np.add.at(links, y[here], copies[x[here]])
    i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int),) * 2
    lab = _labels(len(node), i, j)
    low = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(low, lab, node)
    some = np.unique(np.concatenate([i, j]))
    return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some]), "low": pa.array(low[lab[some]])})


def _forest(nodes: DataFrame, count: int, trees: int, sample: int, leaf_rows: int, cosine: float, seed: int) -> dict[int, list[Tree]]:
    drawn = nodes.orderBy(F.xxhash64("k1", "k2", F.lit(seed)), "k1", "k2").limit(sample).select("vector").toLocalIterator()
    by_length: dict[int, list[np.ndarray]] = {}
    for r in drawn:
        v = np.frombuffer(r.vector, "<f8")
        by_length.setdefault(len(v), []).append(v)
    leaf = max(24, leaf_rows // 4 * min(sample, count) // max(1, count))
    return {n: [Tree(_unit(np.array(vs)), leaf, margin(cosine, n), np.random.default_rng([seed, n, t])) for t in range(trees)] for n, vs in by_length.items()}


def _refined(placed: DataFrame, nodes: DataFrame, leaf_rows: int, rounds: int, cosine: float) -> DataFrame:
    """Split overfull leaves where all their rows lie thinnest, until none is overfull or can be split."""
    settled = None
    for _ in range(rounds):
        sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows)
        if sizes.isEmpty():
            break
        full = placed.join(sizes.select("leaf"), "leaf")
        p = C.stored(full.join(nodes.select("node", "vector"), "node").select("node", "leaf", "vector").mapInArrow(lambda it: _project(it, cosine), "node long, leaf long, p double, m double"), "projected")
        cuts = p.groupBy("leaf").agg(F.percentile_approx("p", QUANTILES, 1000).alias("q"))
        near = [F.struct(F.count_if(F.abs(F.col("p") - F.col("q")[i]) <= F.col("m")).alias("n"), F.first(F.col("q")[i]).alias("cut")) for i in range(len(QUANTILES))]
        best = p.join(cuts, "leaf").groupBy("leaf").agg(F.array_min(F.array(*near)).alias("best"), F.count("*").alias("n"))
        best = best.select("leaf", F.col("best.cut").alias("cut"), (F.col("best.n") <= MOST_SPILL * F.col("n")).alias("far"))
        moved = p.join(best, "leaf")
        sides = F.filter(F.array(F.when(F.col("p") <= F.col("cut") + F.col("m"), 0), F.when(F.col("p") >= F.col("cut") - F.col("m"), 1)), lambda s: s.isNotNull())
        split = moved.where("far").select("node", F.explode(sides).alias("side"), "leaf").select("node", F.xxhash64("leaf", "side").bitwiseAND(F.lit((1 << 62) - 1)).alias("leaf"))
        done = moved.where(~F.col("far")).select("node", "leaf")
        rest = placed.join(sizes.select("leaf"), "leaf", "left_anti").unionByName(done)
        settled = rest if settled is None else settled.unionByName(rest)
        settled, placed = C.stored(settled, "settled"), C.stored(split, "split")
        if placed.isEmpty():
            return settled
    return placed if settled is None else settled.unionByName(placed)


def linked(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE, trees: int = TREES, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, rounds: int = ROUNDS, seed: int = 5) -> DataFrame:
    """One row a vector: key, n_links, component_id, kept."""
    C.bounded_batches(vectors.sparkSession, 4096)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    fine = F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(fine, F.lit(False))
    same = [F.when(fine, F.xxhash64("vector")).alias("k1"), F.when(fine, F.xxhash64(F.lit(1), "vector")).alias("k2")]
    keyed = rows.where(fine).select("id", "vector", *same)
    # each distinct vector is a node with a number of its own, as vectors of one id may differ
    distinct = keyed.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    distinct = distinct.select("k1", "k2", "first", F.monotonically_increasing_id().alias("node"), "copies", "vector")
    nodes = C.stored(distinct.mapInArrow(_pack, "k1 long, k2 long, first long, node long, copies long, vector binary"), "nodes")
    forest = vectors.sparkSession.sparkContext.broadcast(_forest(nodes, nodes.count(), trees, sample, leaf_rows, cosine, seed))
    placed = C.stored(nodes.select("node", "vector").mapInArrow(lambda it: _assign(it, forest.value), "node long, leaf long").distinct(), "placed")
    placed = _refined(placed, nodes, leaf_rows, rounds, cosine)
    # leaves of one vector are of no use; those of many are compared in blocks
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("leaf", F.ceil(F.col("n") / leaf_rows).cast("int").alias("blocks"))
    used = placed.join(sizes, "leaf")
    lists = used.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"), F.collect_set(F.struct("leaf", "blocks")).alias("in"))
    dealt = nodes.select("node", "copies", "vector").join(lists, "node").select("node", "copies", "vector", "leaves", F.explode("in").alias("in")).select("node", "copies", "vector", "leaves", "in.*")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "leaf"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("*", other).select("node", "copies", "vector", "leaves", "leaf", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    found = C.stored(dealt.groupBy("leaf", "left", "right").applyInArrow(lambda t: _compare(t, cosine), "node long, links long, low long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    classes = whole.withColumnRenamed("id", "node")
    smallest = classes.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("smallest"))
    known = nodes.select("k1", "k2", "node", "first", "copies").join(links, "node", "left").join(classes.join(smallest, "component"), "node", "left")
    known = known.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("smallest", "first").alias("component"))
    out = rows.select("id", *same).join(known, ["k1", "k2"], "left")
    whole_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), whole_id.alias("component_id"), F.coalesce(F.col("id") == whole_id, F.lit(False)).alias("kept"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(C.table(spark, sf_dir, "embeddings"))


#: Every pair; right for any table, and quadratic.
OP4_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.r AS i, b.r AS j FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
n AS (SELECT i, count(*) AS n FROM pairs GROUP BY i),
reach AS (WITH RECURSIVE w(i, j) AS (SELECT i, i FROM n UNION SELECT w.i, p.j FROM w JOIN pairs p ON w.j = p.i) SELECT i, min(vec_id) AS c FROM w JOIN v ON v.r = w.j GROUP BY i)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.i = v.r LEFT JOIN reach ON reach.i = v.r
"""
