"""Hard-negative mining by threshold joins over an inverted index of dimensions.

Anchors look for their best rows of the same label (positives), and then, for each
positive, for the best rows of other labels inside its window of scores.  Both are
joins above a threshold that each anchor has for itself: it begins high, and those
whose windows are not yet full come again with a lower one, down to the window's end,
or for positives down to no threshold at all.  What a join above a threshold finds is
complete, so a window that it fills is exact.

A join deals rows and anchors out in blocks, each pair of blocks a task.  In a block the
dimensions are ordered by their weight.  A row is indexed in the leading ones only: the
trailing dimensions, whose norms bound what they can add below every threshold of the
task, are left out.  Partial scores add up from posting lists of a few dimensions at a
time; a row no anchor can still reach, by the norms of what is to come, leaves the lists.  What
passes the bound is scored exactly, in whole numbers.  A task returns no more than a few
rows for each anchor and window, however many reach the threshold, so that a group of
equal vectors stays small; these are ranked together in the end.

Components become floor(256 * x), and scores are inner products of these integers.

Defined results: rows take no part whose id, label or vector is null, or which hold a null
or non-finite component; nor those whose product with themselves is above 2**52, so
that every score is exact; vectors of different length are not compared; rows that agree
in id, label and vector are one row; an anchor is not compared with rows of its own id;
ties go to the smaller id; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semspark.llm import common as C

POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least so many hundredths of its positive, and at most all of it.
LEAST = 80
SCALE, BOUND = 256, float(1 << 52)
#: Thresholds: of an anchor's product with itself for positives (None: none), of a positive's score for negatives.
FOR_POSITIVES = (0.7, 0.35, 0.15, None)
FOR_NEGATIVES = (0.97, 0.9)
BLOCK_ROWS = 8192
#: Anchors that are scored at once, dimensions of a posting list, and pairs that are scored at once.
TOGETHER, DIMENSIONS, PAIRS = 256, 8, 1 << 16

_FOUND = "id long, mark long, place int, found long, score long"


def _quantised(batches):
    """(id, label, dim, vector, own) of fit rows; vectors as little-endian integers of 32 bits."""
    for batch in batches:
        column = batch.column("vector")
        at = column.offsets.to_numpy()
        x = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
        upto = np.append(0, np.cumsum(x * x))
        dims = np.diff(at)
        own = upto[at[1:]] - upto[at[:-1]]
        own = np.array([float(x[a:b] @ x[a:b]) for a, b in zip(at, at[1:])]) if not np.isfinite(upto[-1]) or upto[-1] > BOUND else own
        fit = own <= BOUND
        q = np.where(np.abs(x) < 2.0**31, x, 0).astype("<i4")
        keep = np.flatnonzero(fit)
        vectors = [q[a:b].tobytes() for a, b in zip(at[:-1][keep].tolist(), at[1:][keep].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep)), batch.column("label").take(pa.array(keep)), pa.array(dims[keep].astype(np.int32)), pa.array(vectors, pa.binary()), pa.array(own[keep].astype(np.int64))], ["id", "label", "dim", "vector", "own"])


def prepared(rows: DataFrame, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, dim, vector, own, mark) of the rows that take part, each once; ``own`` is a vector's product with itself, and the mark tells rows of one id apart."""
    wide = rows.select(F.col(key).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = wide.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    out = fit.mapInArrow(_quantised, "id long, label long, dim int, vector binary, own long").distinct()
    return out.withColumn("mark", F.xxhash64("label", "vector"))


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("vector").to_pylist()), "<i4").reshape(table.num_rows, dim).astype(np.float64)


def _tails(x: np.ndarray) -> np.ndarray:
    """Norm of what follows each dimension, the first column that of all."""
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum((x * x)[:, ::-1], 1))[:, ::-1]
    return out


def reaching(x: np.ndarray, y: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score is at least the anchor's threshold; all values are whole numbers."""
    dim = x.shape[1]
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if not len(x) or not len(y):
        return tuple(a[0] for a in out)
    heavy = np.argsort(-(y * y).sum(0), kind="stable")
    x, y = x[:, heavy], y[:, heavy]
    x_tail, y_tail = _tails(x), _tails(y)
    least = threshold.min()
    # a row is indexed up to the dimension from which on no anchor can gain the lowest threshold
    cut = (y_tail * x_tail.max(0) >= least - 0.5).sum(1)
    cut = np.minimum(-(-cut // DIMENSIONS) * DIMENSIONS, dim)
    order = np.argsort(-cut, kind="stable")  # so that each posting list is a leading part
    y, y_tail, cut = y[order], y_tail[order], cut[order]
    have = int((cut > 0).sum()) if dim else len(y)
    for lo in range(0, len(x), TOGETHER):
        some, need = x[lo : lo + TOGETHER], threshold[lo : lo + TOGETHER, None] - 0.5
        tail = x_tail[lo : lo + TOGETHER]
        rows = np.arange(have)
        total = np.zeros((len(some), have))
        for at in range(0, dim, DIMENSIONS):
            upto = int(np.searchsorted(-cut[rows], -at))
            if not upto:
                break
            # rows that this list holds; the others keep their sums and the bound of what they leave out
            total[:, :upto] += some[:, at : at + DIMENSIONS] @ y[rows[:upto], at : at + DIMENSIONS].T
            done = np.minimum(cut[rows], at + DIMENSIONS)
            if at // DIMENSIONS % 2 or at + DIMENSIONS >= dim:
                alive = (total + tail[:, done] * y_tail[rows, done] >= need).any(0)
                if alive.sum() < 0.8 * len(rows):
                    rows, total = rows[alive], total[:, alive]
        done = cut[rows] if dim else np.zeros(len(rows), np.int64)
        i, k = np.nonzero(total + tail[:, done] * y_tail[rows, done] >= need)
        for a in range(0, len(i), PAIRS):
            p, r = i[a : a + PAIRS], rows[k[a : a + PAIRS]]
            score = np.einsum("ij,ij->i", some[p], y[r])
            good = score >= need[p, 0]
            out[0].append(p[good] + lo)
            out[1].append(order[r[good]])
            out[2].append(score[good])
    return tuple(np.concatenate(a) for a in out)


def _firsts(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best of each group, ties by the smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < most]


def _joined(anchors: pa.Table, rows: pa.Table, same: bool, most: int) -> pa.Table:
    """The best rows of a block for the anchors of another: those of the same label, or of others for each window of scores."""
    out = [[] for _ in range(5)]
    if anchors.num_rows and rows.num_rows:
        dim = anchors.column("dim")[0].as_py()
        x, y = _matrix(anchors, dim), _matrix(rows, dim)
        a_id, a_label, mark, threshold = (anchors.column(c).to_numpy() for c in ("id", "label", "mark", "threshold"))
        r_id, r_label = (rows.column(c).to_numpy() for c in ("id", "label"))
        if same:  # a label at a time
            parts = []
            for label in np.intersect1d(a_label, r_label):
                a, r = np.flatnonzero(a_label == label), np.flatnonzero(r_label == label)
                i, k, s = reaching(x[a], y[r], threshold[a])
                parts.append((a[i], r[k], s))
            i, k, s = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            keep = a_id[i] != r_id[k]
        else:
            i, k, s = reaching(x, y, threshold)
            keep = (a_id[i] != r_id[k]) & (a_label[i] != r_label[k])
        i, k, s = i[keep], k[keep], s[keep].astype(np.int64)
        lists = [[(0, None)]] * anchors.num_rows if same else [[(w["place"], w["positive_score"]) for w in ws] for ws in anchors.column("windows").to_pylist()]
        width = max(map(len, lists))
        for w in range(width):
            place = np.array([x[w][0] if w < len(x) else -1 for x in lists])
            ok = place[i] >= 0
            if not same:
                top = np.array([x[w][1] if w < len(x) else 0 for x in lists], np.int64)[i]
                ok &= (s <= top) & (100 * s >= LEAST * top)
            at = np.flatnonzero(ok)
            at = at[_firsts(i[at], s[at], r_id[k[at]], most)]
            for c, v in zip(out, (a_id[i[at]], mark[i[at]], place[i[at]], r_id[k[at]], s[at])):
                c.append(v)
    kinds = (np.int64, np.int64, np.int32, np.int64, np.int64)
    return pa.table([pa.array(np.concatenate(c).astype(t) if c else np.zeros(0, t)) for c, t in zip(out, kinds)], ["id", "mark", "place", "found", "score"])


def _best(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each anchor and place, with their ``rank`` from 1."""
    window = Window.partitionBy("id", "mark", "place").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def _threshold_join(anchors: DataFrame, rows: DataFrame, blocks: int, many: int, same: bool, most: int) -> DataFrame:
    """Anchors (with their thresholds) against all rows, block by block."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id", "mark"), F.lit(n)).cast("int")
    left = anchors.withColumn("a", block(many)).withColumn("b", spread(blocks))
    right = rows.withColumn("b", block(blocks)).withColumn("a", spread(many)).select("dim", "a", "b", "id", "label", "vector")
    both = left.groupBy("dim", "a", "b").cogroup(right.groupBy("dim", "a", "b"))
    return _best(both.applyInArrow(lambda x, y: _joined(x, y, same, most), _FOUND), most)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows`` are ``prepared``, and ``anchors`` tells which of them ask."""
    rows = C.stored(rows, "vectors")
    asking = C.stored(rows.where(anchors), "anchors")
    n, a = rows.count(), asking.count()
    blocks, many = max(1, -(-n // block_rows)), max(1, -(-a // block_rows))
    left, pairs = asking, None
    for part in FOR_POSITIVES:
        least = F.lit(float("-inf")) if part is None else F.ceil(part * F.col("own")).cast("double")
        found = C.stored(_threshold_join(left.withColumn("threshold", least), rows, blocks, many, True, positives), "positives")
        full = found.groupBy("id", "mark").agg(F.count("*").alias("n"))
        full = full.where(F.lit(True) if part is None else F.col("n") >= positives).select("id", "mark")
        done = found.join(full, ["id", "mark"])
        pairs = done if pairs is None else pairs.unionByName(done)
        left = C.stored(left.join(full, ["id", "mark"], "left_anti"), "unfilled")
        if left.isEmpty():
            break
    pairs = C.stored(pairs.select("id", "mark", F.col("rank").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "pairs")
    # windows below zero hold nothing, as 80 hundredths of a negative number are above it
    open_, out = pairs.where("positive_score >= 0"), None
    for part in (*FOR_NEGATIVES, None):
        least = F.ceil(F.col("positive_score") * LEAST / 100 if part is None else part * F.col("positive_score")).cast("double")
        windows = open_.groupBy("id", "mark").agg(F.min(least).alias("threshold"), F.collect_list(F.struct("place", "positive_score")).alias("windows"))
        found = C.stored(_threshold_join(asking.join(windows, ["id", "mark"]), rows, blocks, many, False, negatives), "negatives")
        full = found.groupBy("id", "mark", "place").agg(F.count("*").alias("n")).where(F.lit(True) if part is None else F.col("n") >= negatives)
        done = found.join(full.select("id", "mark", "place"), ["id", "mark", "place"])
        out = done if out is None else out.unionByName(done)
        open_ = C.stored(open_.join(full, ["id", "mark", "place"], "left_anti"), "open")
        if open_.isEmpty():
            break
    both = out.join(pairs, ["id", "mark", "place"])
    return both.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepared(C.table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 100 == 0)


#: Every anchor with every row.
OP11_SQL = r"""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, a.q AS aq, b.vec_id, b.label = a.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id, own, aq ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND n.own = p.own AND n.aq = p.aq AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.own, p.aq, p.vec_id, p.score ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5
"""
