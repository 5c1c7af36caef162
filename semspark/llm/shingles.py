"""N-gram Jaccard join by a MinHash LSH forest.

Documents become sets of five-word shingles.  A signature has ``TRIES`` labels of
``DEPTH`` minhashes each.  The labels of a trie are dealt out by their first ``FLOOR``
minhashes and sorted there: a prefix trie, in which documents that share a prefix are
neighbours, and every pair has a longest common prefix.  Matching starts at whole
labels.  A pair of similarity s is matched at a prefix of ``length`` with probability
``1 - (1 - s**length)**tries``, so that each pair matched stands for one over that
many; while the share found of the pairs that this makes likely is below the target,
the prefix is shortened by one minhash in all tries.  Similarities are taken from the
sketches first.  Candidates are then verified exactly on their whole shingle sets, and
the recall is reckoned again with the true similarities: where it falls short, the
prefix is shortened further and what is new is verified.

Documents of equal shingle sets are one document with a number of copies.  In a
trie, candidates whose sketches are far apart are dropped (a sketch is off by
more than ``SLACK`` with odds of one in a billion), and those left are chained into
candidate groups, in large prefix runs by one edge a document; a group is verified in blocks, each pair
of blocks in a task of its own, which sends on counts and smallest ids only.  So no
bucket or group is capped, and no list of all pairs exists.

Defined results: words are runs of anything but ASCII white space, taken as they
are; fewer than five words are one shingle; a null text or one without words has
no shingles and links with nothing; texts of any length take part whole; a row without an id links with nothing and has
no class; rows are told apart by their shingle sets, so that rows of one id with
different texts have links and a class each; repeated rows are copies of one
another; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm import common as C
from semspark.llm.components import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9995
#: Tries, minhashes in a label, and the shortest prefix, at which a pair at the threshold is matched with 0.9998.
TRIES, DEPTH, FLOOR = 16, 8, 4
#: A pair's sketch similarity may be so much below the threshold; its standard deviation is 0.035.
SLACK = 0.22
BLOCK_ROWS, BUCKET_ROWS = 256, 4096


def _sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after another, and where each text's begin."""
    starts, ends, first = C.word_spans(data, at, C.SPACE_WORDS)
    words = C.span_hashes(data, starts, ends)
    hashes, start = [C.window_hashes(words, n)], [np.flatnonzero(C.window_starts(first, n))]
    hashes[0] = hashes[0][start[0]] if len(start[0]) else hashes[0][:0]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    for size in range(1, n):
        some = first[:-1][short[np.diff(first)[short] == size]]
        if len(some):
            start.append(some)
            hashes.append(C.window_hashes(words, size)[some])
    h, doc = np.concatenate(hashes), np.searchsorted(first, np.concatenate(start), "right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(at)))


def _signatures(h: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """(texts, count) minhashes of sets that are not empty, worked on as many texts at a time as a cache holds."""
    rng = np.random.default_rng(29)
    mult = rng.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.empty((len(at) - 1, count), np.uint32)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + 32_768, "right")) - 1)
        part, edges = h[at[first] : at[last]], at[first:last] - at[first]
        x = np.empty_like(part)
        for k in range(count):
            np.bitwise_xor(part, plus[k], out=x)
            x *= mult[k]
            out[first:last, k] = np.minimum.reduceat(x, edges) >> np.uint64(32)
        first = last
    return out


def _fold(x: np.ndarray) -> np.ndarray:
    """One 64-bit number of each row of 32-bit ones."""
    out = np.zeros(len(x), np.uint64)
    for c in x.T:
        out = C.mix(out * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1))
    return out


def _sketched(batches, n: int, tries: int, depth: int, floor: int):
    """Each text's set digest and size, sketch (its labels, a byte a minhash), and the place of its first ``floor`` minhashes in each trie; nulls where there are no shingles."""
    names = ["id", "mark", "k1", "k2", "size", "sketch", "buckets"]
    for batch, data, at in C.pieces(batches, "text"):
        h, cut = _sets(data, at, n)
        full, bare = np.flatnonzero(np.diff(cut)), np.flatnonzero(np.diff(cut) == 0)
        if len(bare):
            kinds = [*[pa.int64()] * 3, pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(bare)) for c in names[:2]), *(pa.nulls(len(bare), k) for k in kinds)], names)
        if not len(full):
            continue
        edges = np.append(cut[full], len(h))
        signature = _signatures(h, edges, tries * depth)
        labels = signature.reshape(len(full), tries, depth)
        buckets = np.stack([_fold(np.column_stack([np.full(len(full), t, np.uint32), labels[:, t, :floor]])) for t in range(tries)], 1)
        one = np.add.reduceat(C.mix(h ^ np.uint64(0xABCDEF)), edges[:-1]).view(np.int64)
        two = np.bitwise_xor.reduceat(C.mix(h + np.uint64(77)), edges[:-1]).view(np.int64)
        sketches = [x.tobytes() for x in signature.astype(np.uint8)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * tries, pa.int32()), pa.array(buckets.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(full)) for c in names[:2]), pa.array(one), pa.array(two), pa.array(np.diff(edges)), pa.array(sketches, pa.binary()), lists], names)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of labels (rows)."""
    return np.cumprod(x == y, 1).sum(1)


def _chained(table: pa.Table, least: float, tries: int) -> pa.Table:
    """Edges (a, b, length, agree) between documents of one trie whose sketches agree: the longest prefix that both have, and the minhashes in which they agree."""
    bucket, trie, node = (table.column(c).to_numpy() for c in ("bucket", "trie", "node"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
    depth = sketch.shape[1] // tries
    label = sketch.reshape(len(node), tries, depth)[np.arange(len(node)), trie]
    order = np.lexsort((node, *label.T[::-1], bucket))  # the sorted prefix trie
    bucket, node, sketch, label = bucket[order], node[order], sketch[order], label[order]
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(head, len(bucket)))
    need = least * sketch.shape[1]
    a, b = [], []
    most = 24
    for step in range(1, most):  # few documents: each with the one so many places on
        i = np.flatnonzero(np.repeat(size, size) <= most)
        i = i[i + step < len(bucket)]
        i = i[bucket[i] == bucket[i + step]]
        for lo in range(0, len(i), 1 << 16):
            x = i[lo : lo + (1 << 16)]
            x = x[(sketch[x] == sketch[x + step]).sum(1) >= need]
            a.append(x)
            b.append(x + step)
    for k in np.flatnonzero(size > most).tolist():
        x, y = _reached(sketch[head[k] : head[k] + size[k]], label[head[k] : head[k] + size[k]], need)
        a.append(x + head[k])
        b.append(y + head[k])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": pa.array(np.minimum(node[i], node[j])), "b": pa.array(np.maximum(node[i], node[j])), "length": pa.array(_common(label[i], label[j]), pa.int32()), "agree": pa.array((sketch[i] == sketch[j]).sum(1), pa.int32())})


def _reached(sketch: np.ndarray, label: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all documents of one sorted run that reach one another, longest prefixes first.

    At each length the runs that share a prefix are gone through: whoever was reached
    is compared with those not reached yet.  What is one group at a longer prefix is
    not compared again.
    """
    n, depth = label.shape
    group, a, b = np.arange(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in range(depth, -1, -1):
        cuts = np.flatnonzero(np.append(True, (label[1:, :length] != label[:-1, :length]).any(1)))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), n]):
            rest = np.arange(lo, hi)
            while len(rest) and (group[rest] != group[rest[0]]).any():
                mine = group[rest] == group[rest[0]]
                queue, rest, name = rest[mine].tolist(), rest[~mine], group[rest[0]]
                while queue and len(rest):
                    at = queue.pop()
                    near = (sketch[rest] == sketch[at]).sum(1) >= need
                    if near.any():
                        got = rest[near]
                        a.append(np.full(len(got), at))
                        b.append(got)
                        joined = np.isin(group[rest], group[got])
                        queue += rest[joined].tolist()
                        group[np.isin(group, group[got])] = name
                        rest = rest[~joined]
    return np.concatenate(a), np.concatenate(b)


def _verify(table: pa.Table, similarity: float, length: int, tries: int) -> pa.Table:
    """Exact links inside a block or between two: linked documents, the smallest one reached, pairs found here and pairs to be expected."""
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
    order = np.lexsort((node, block))
    node, copies, block = node[order], copies[order], block[order]
    raw = table.column("set").take(pa.array(order)).to_pylist()
    sets = [np.frombuffer(x, "<u8") for x in raw]
    size = np.array([len(s) for s in sets], np.int64)
    split = len(node) if left == right else int(np.searchsorted(block, right))
    second = 0 if left == right else split
    both = _overlaps(sets, size, split, second)
    i, j = np.nonzero(both)
    n = both[i, j]
    j = j + second
    keep = i < j
    i, j, n = i[keep], j[keep], n[keep].astype(np.int64)
    similar = n / (size[i] + size[j] - n)
    # in integers where the threshold has few digits: n / union >= p / q
    keep = n * 1000 >= np.int64(round(similarity * 1000)) * (size[i] + size[j] - n)
    i, j, similar = i[keep], j[keep], similar[keep]
    links = np.zeros(len(node), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    low = node.copy()
    while True:  # the neighbours' alone would lose a document whose only link is to one that has a smaller
        was, least = low.copy(), np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        if (low == was).all():
            break
    some = np.unique(np.concatenate([i, j]))
    found, expected = np.zeros(len(node), np.int64), np.zeros(len(node))
    np.add.at(found, i, 1)
    np.add.at(expected, i, 1 / matched(similar, length, tries))
    return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some]), "low": pa.array(low[some]), "pairs": pa.array(found[some]), "expected": pa.array(expected[some])})


def _overlaps(sets: list[np.ndarray], size: np.ndarray, split: int, second: int, most: int = 1 << 22) -> np.ndarray:
    """Shared shingles of each document of the first block with each of the second, by products of 0/1 matrices over slices of the shingles."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # a shingle of one document is shared with none
    keep = often[column]
    column, owner = column[keep], owner[keep]
    out = np.zeros((split, len(sets) - second), np.float32)
    width = max(1, most // max(1, len(sets)))
    cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + width, width)) if len(column) else np.zeros(1, np.int64)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], column[a:b] - k * width] = 1
        out += x[:split] @ x[second:].T
    return out


def matched(similarity: float, length: int, tries: int) -> float:
    """Probability that a pair shares a prefix of this length in one of the tries."""
    return 1 - (1 - similarity**length) ** tries


def measured_recall(found: list[tuple[int, float, int]], length: int, tries: int) -> float:
    """Share found at a prefix of ``length`` of the pairs that are to be expected; ``found`` has (longest prefix, similarity, pairs)."""
    some = [(s, n) for longest, s, n in found if longest >= length]
    return sum(n for _, n in some) / sum(n / matched(s, length, tries) for s, n in some) if some else 0.0


def shortened(found: list[tuple[int, float, int]], recall: float, tries: int, depth: int, floor: int) -> int:
    """The longest prefix at which the measured recall is the target; without it the shortest."""
    length = depth
    while length > floor and measured_recall(found, length, tries) < recall:
        length -= 1
    return length


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, mark, text): the mark tells apart the texts of one id; a row without an id brings no text."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.select("id", F.xxhash64("text").alias("mark"), F.when(F.col("id").isNotNull(), F.col("text")).alias("text"))


def _sketches(rows: DataFrame, shingle: int, tries: int, depth: int, floor: int) -> tuple[DataFrame, DataFrame]:
    """Each row's set digest; and of each distinct set its node (a number), first (smallest id and mark), copies, sketch and buckets."""
    kinds = "id long, mark long, k1 long, k2 long, size long, sketch binary, buckets array<long>"
    sketched = C.stored(rows.mapInArrow(lambda it: _sketched(it, shingle, tries, depth, floor), kinds), "sketched")
    first = F.min(F.struct("id", "mark")).alias("first")
    nodes = sketched.where("k1 IS NOT NULL").groupBy("k1", "k2", "size").agg(first, F.count("*").alias("copies"), F.min_by("sketch", "id").alias("sketch"), F.min_by("buckets", "id").alias("buckets"))
    return sketched.select("id", "mark", "k1", "k2", "size"), C.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _candidates(nodes: DataFrame, least: float, bucket_rows: int, tries: int) -> DataFrame:
    """(a, b, length, agree): edges between candidates, each with the longest prefix that any trie has of both."""
    placed = nodes.select("node", F.posexplode("buckets").alias("trie", "bucket"))
    shared = C.stored(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    total = shared.agg(F.sum("n")).first()[0] or 0
    parts = max(1, total // 20_000)
    blocks = F.ceil(F.col("n") / bucket_rows).cast("int")
    members = placed.join(shared.select("bucket", blocks.alias("blocks")), "bucket").join(nodes.select("node", "sketch"), "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    members = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # many small buckets make one task's table; the blocks of a large one are dealt out
    part = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(parts))).otherwise(F.col("bucket"))
    members = members.select(part.alias("part"), "bucket", "trie", "node", "sketch", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    edges = members.groupBy("part", "left", "right").applyInArrow(lambda t: _chained(t, least, tries), "a long, b long, length int, agree int")
    return C.stored(edges.groupBy("a", "b").agg(F.max("length").alias("length"), F.first("agree").alias("agree")), "candidates")


def _verified(rows: DataFrame, nodes: DataFrame, groups: DataFrame, shingle: int, similarity: float, length: int, tries: int, block_rows: int) -> DataFrame:
    sizes = C.stored(groups.groupBy("component").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "sizes")
    inside = groups.withColumnRenamed("id", "node").join(sizes, "component").join(nodes.select("node", "first.*", "copies"), "node")
    texts = C.once_a_task(rows, ["id", "mark"]).join(inside, ["id", "mark"]).dropDuplicates(["id", "mark"])
    whole = texts.select("node", "copies", "component", "blocks", "text").mapInArrow(lambda it: _shingled(it, shingle), "node long, copies long, component long, blocks int, set binary")
    whole = whole.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = whole.select("component", "node", "copies", "set", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    found = dealt.groupBy("component", "left", "right").applyInArrow(lambda t: _verify(t, similarity, length, tries), "node long, links long, low long, pairs long, expected double")
    return C.stored(found, "verified")


def _answered(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, tries: int = TRIES, depth: int = DEPTH, floor: int = FLOOR, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Each row's set digest; and of each distinct set its links and the first (id and mark) of its class."""
    C.bounded_batches(rows.sparkSession)
    sketched, nodes = _sketches(rows, shingle, tries, depth, floor)
    edges = _candidates(nodes, similarity - SLACK, bucket_rows, tries)
    kinds = edges.groupBy("length", "agree").agg(F.count("*").alias("n")).collect()  # as many rows as there are lengths and agreements
    likely = [(r.length, r.agree / (tries * depth), r.n) for r in kinds if r.agree / (tries * depth) >= similarity]
    length = shortened(likely, recall, tries, depth, floor)
    while True:
        groups = C.stored(components(edges.where(F.col("length") >= length).select("a", "b")), "groups")
        found = _verified(rows, nodes, groups, shingle, similarity, length, tries, block_rows)
        got = found.agg(F.sum("pairs").alias("pairs"), F.sum("expected").alias("expected")).first()
        if length <= floor or (got.pairs and got.pairs >= recall * got.expected):
            break
        length -= 1
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "node")
    firsts = classes.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("of_class"))
    known = nodes.join(links, "node", "left").join(classes.join(firsts, "component"), "node", "left")
    return sketched, known.select("k1", "k2", "size", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("of_class", "first").alias("first"))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row a document: key, n_links (other documents at or above the similarity), class_id (the smallest id reachable), kept."""
    sketched, known = _answered(_rows(docs, key, text), **options)
    some = sketched.join(known, ["k1", "k2", "size"]).select("id", "links", F.col("first.id").alias("component"))
    none = sketched.where("k1 IS NULL").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    own = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return some.unionByName(none).select(F.col("id").alias(key), F.col("links").cast("long").alias("n_links"), F.col("component").alias("class_id"), own.alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without their near-duplicates: of each class one row of the smallest id stays, and all rows without an id.

    Rows without shingles are copies only of those that share their id.  Of rows that
    agree in id and text a hash of the other columns chooses one.
    """
    sketched, known = _answered(_rows(docs, key, text), **options)
    bare = sketched.where("k1 IS NULL AND id IS NOT NULL").groupBy("id").agg(F.min("mark").alias("mark"))
    stay = known.select("first.*").unionByName(bare).distinct()
    others = [c for c in docs.columns if c not in (key, text)]
    order = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), order.cast("long").alias("order"), F.struct(*docs.columns).alias("row"))
    same = ["id", "mark", "order"]
    best = rows.join(stay, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.min("order").alias("order"))
    chosen = C.once_a_task(rows.where("id IS NOT NULL"), same).join(best, same, "left_semi").dropDuplicates(same)
    return chosen.select("row.*").unionByName(docs.where(F.col(key).isNull()))


def _shingled(batches, n: int):
    for batch, data, at in C.pieces(batches, "text"):
        h, cut = _sets(data, at, n)
        sets = [h[a:b].astype("<u8").tobytes() for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "copies", "component", "blocks")), pa.array(sets, pa.binary())], ["node", "copies", "component", "blocks", "set"])


def op3_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(C.table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0 AND doc_id IS NOT NULL)),
n AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS i, b.r AS j, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
pairs AS (SELECT i, j, x.doc_id AS di, y.doc_id AS dj FROM shared JOIN n x ON x.r = i JOIN n y ON y.r = j WHERE c * 1000 >= 800 * (x.n + y.n - c)),
k AS (SELECT i, count(*) AS k FROM pairs GROUP BY i),
reach AS (WITH RECURSIVE w(i, j) AS (SELECT r, r FROM n UNION SELECT w.i, p.j FROM w JOIN pairs p ON w.j = p.i) SELECT w.i, min(n.doc_id) AS c FROM w JOIN n ON n.r = w.j GROUP BY w.i)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(c, d.doc_id) AS class_id, coalesce(coalesce(c, d.doc_id) = d.doc_id, false) AS kept
FROM d LEFT JOIN k ON k.i = d.r LEFT JOIN reach ON reach.i = d.r
"""
