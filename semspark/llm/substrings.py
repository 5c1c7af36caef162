"""Substring dedup by level-wise doubling of repeated windows of words.

A window repeats only if the shorter windows inside it do.  So windows of 4 words that
several documents have come first; those alone are extended to twice their length
(less the word in which the two overlap), which is 7, and of these again those that repeat to
13, the length asked for.  On the way only the minimisers are looked at: the shorter
window of the smallest hash among those inside a window of full length is the same
wherever that window stands, so that one hash stands for many windows.  What has no
repeated minimiser left ends at that level.  A window that also starts in a document of a
smaller id is removed, that is, the words that it covers.

``longest_repeats`` doubles on from there: a window of 26 words is a candidate where
those of 13 at its beginning and its middle both repeat, then 52, and so on until no
candidate survives; all by the places of words, so that it is exact at each length.

Documents are dealt once into groups of bounded size, by their place in the table, and
every level reads that same exchange.  Between the levels only hashes travel: a
group sends each distinct hash once, so that a passage in a third of all documents
is one entry a group, to the bucket that the hash belongs to; the bucket answers
the groups.  Whole windows are matched by 64 bits of two hashes, beside those that the
bucket has of the first (of buckets there are as many as megabytes of text).

Defined results: words are runs of anything but ASCII white space, taken as they
are; a null or empty text has none, and keeps none; texts of any length take part
whole; a document without an id neither loses words nor causes losses; rows with equal
ids are no smaller than one another; repeated rows are each answered; no rows give no
rows; extra columns are kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semspark.llm import common as C

#: Words of a window, and of the windows that the doubling begins with, at most.
WINDOW, SHORTEST = 13, 4
GROUP_ROWS, GROUP_BYTES, BUCKET_BYTES = 512, 2 << 20, 1 << 20

_BUCKETED = "bucket int, home int, payload binary"


class Words:
    """Word hashes of a group of documents, in the order of their ids."""

    def __init__(self, table: pa.Table):
        ids = table.column("_id")
        order = pc.sort_indices(table, sort_keys=[("_id", "ascending")], null_placement="at_end")
        self.order = order.to_numpy()
        text = table.column("_text").take(order)
        self.ids = ids.take(order).to_pylist()
        self.data, self.at = C.text_bytes(text)
        starts, ends, self.first = C.word_spans(self.data, self.at, C.SPACE_WORDS)
        self.hashes = C.span_hashes(self.data, starts, ends)
        rank = np.zeros(len(self.ids), np.int64)  # equal ids have equal ranks
        for i in range(1, len(self.ids)):
            rank[i] = rank[i - 1] + (self.ids[i] != self.ids[i - 1])
        self.doc = np.repeat(rank, np.diff(self.first))
        self.known = np.repeat(np.array([x is not None for x in self.ids], bool), np.diff(self.first))

    def windows(self, n: int) -> np.ndarray:
        """Words that start a window of ``n`` words in a document with an id."""
        return np.flatnonzero(C.window_starts(self.first, n) & self.known)

    def minimisers(self, length: int, n: int, at: np.ndarray) -> np.ndarray:
        """Smallest hash of a window of ``length`` words inside each window of ``n`` that starts at ``at``."""
        low = C.window_hashes(self.hashes, length)
        have, many = 1, n - length + 1
        while have < many:  # shorter windows inside one of n
            step = min(have, many - have)
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
            have += step
        return low[at]

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return C.window_hashes(self.hashes, n), C.window_hashes(self.hashes, n, seed=1)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _emit(home: int, buckets: int, hashes: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows (bucket, home, payload) of entries sorted by hash; a payload is its columns one after another."""
    bucket = _bucket(hashes, buckets).astype(np.int32)
    cuts = np.append(np.flatnonzero(_runs(bucket)), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    rows = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts, cuts[1:])]
    return pa.table({"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "home": pa.array([home] * len(rows), pa.int32()), "payload": pa.array(rows, pa.binary())})


def _read(payloads: list[bytes], *kinds: str) -> list[np.ndarray]:
    size = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for p in payloads:
        n, at = len(p) // size, 0
        for out, k in zip(parts, kinds):
            out.append(np.frombuffer(p, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(parts, kinds)]


def levels(n: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths of the doubling up to ``n``: each is twice the one before it, less at most the words in which two of those overlap."""
    out = [n]
    while out[0] > shortest:
        out.insert(0, out[0] // 2 + 1)
    return out


def _places(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 31 more bits of each hash: what a minimiser is known by.  Two that agree in these make a candidate too many, no more."""
    return (_bucket(hashes, buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFE))


def _alive(words: Words, answers: pa.Table, length: int, n: int, at: np.ndarray, buckets: int) -> np.ndarray:
    """Those of the windows at ``at`` whose minimiser of ``length`` words repeats."""
    parts = [np.frombuffer(x, "<u4").astype(np.uint64) for x in answers.column("answer").to_pylist()]
    low = np.concatenate([(x[0] << np.uint64(32)) | x[1:] for x in parts])  # the first of an answer is its bucket
    return at[np.isin(_places(words.minimisers(length, n, at), buckets), low)]


def _minimisers(table: pa.Table, answers: pa.Table | None, before: int, length: int, n: int, buckets: int) -> pa.Table:
    """A group's part of a level: the distinct minimisers of the windows that are still candidates, and whether several of its documents have each."""
    if not table.num_rows or (answers is not None and not answers.num_rows):
        return _empty_bucketed()
    words = Words(table)
    at = words.windows(n)
    if answers is not None:
        at = _alive(words, answers, before, n, at, buckets)
    low, doc = words.minimisers(length, n, at), words.doc[at]
    if not len(low):
        return _empty_bucketed()
    new = _runs(low, doc)
    low, doc = low[new], doc[new]
    order = np.argsort(low, kind="stable")
    low, doc = low[order], doc[order]
    head = np.flatnonzero(_runs(low))
    tail = np.append(head[1:], len(low)) - 1
    low, several = low[head], doc[head] != doc[tail]
    return _emit(table.column("_home")[0].as_py(), buckets, low, ((low & np.uint64(0xFFFFFFFE)) | several.astype(np.uint64)).astype("<u4"))  # the last bit is for several


def _repeated(table: pa.Table) -> pa.Table:
    """A bucket's part of a level: to each group the minimisers that several documents have."""
    home_of = table.column("home").to_numpy()
    payloads = table.column("payload").to_pylist()
    (entry,) = _read(payloads, "<u4")
    low, several = entry & np.uint32(0xFFFFFFFE), entry & np.uint32(1)
    home = np.repeat(home_of, [len(p) // 4 for p in payloads])
    order = np.argsort(low, kind="stable")
    low, several, home = low[order], several[order], home[order]
    head = _runs(low) if len(low) else np.zeros(0, bool)
    run = np.cumsum(head) - 1
    keep = (np.bincount(run, several) + np.bincount(run) > 1)[run] if len(low) else head
    return _from_bucket(table, home[keep], low[keep].astype("<u4"))


def _from_bucket(table: pa.Table, home: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Answers to the groups, each led by the number of the bucket that gives it."""
    out = _answers(home, *columns)
    bucket = np.uint32(table.column("bucket")[0].as_py()).tobytes() if table.num_rows else b""
    return out.set_column(1, "answer", pa.array([bucket + x for x in out.column("answer").to_pylist()], pa.binary()))


def _repeating(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(bucket and 32 bits of the hash, 32 bits of the other hash) of the whole windows in answers."""
    parts = [np.frombuffer(x, "<u4") for x in answers.column("answer").to_pylist()]
    half = [len(x) // 2 for x in parts]
    places = [(np.uint64(x[0]) << np.uint64(32)) | x[1 : 1 + n].astype(np.uint64) for x, n in zip(parts, half)]
    return np.concatenate(places), np.concatenate([x[1 + n :] for x, n in zip(parts, half)])


def _found(h: np.ndarray, check: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """Which windows (64 bits of one hash, 32 of the other) the answers hold."""
    low, other = _repeating(answers)
    order = np.lexsort((other, low))
    low, other = low[order], other[order]
    mine = (_bucket(h, buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
    both = np.concatenate([np.stack([low, other.astype(np.uint64)], 1), np.stack([mine, check.astype(np.uint64)], 1)])
    order = np.lexsort((both[:, 1], both[:, 0]))  # stable: of equals the answers come first
    head = np.flatnonzero(_runs(both[order, 0], both[order, 1]))
    led = np.repeat(order[head], np.diff(np.append(head, len(order))))
    out = np.zeros(len(both), bool)
    out[order] = led < len(low)
    return out[len(low) :]


def _answers(home: np.ndarray, hashes: np.ndarray, *columns: np.ndarray) -> pa.Table:
    order = np.argsort(home, kind="stable")
    home = home[order]
    cuts = np.append(np.flatnonzero(_runs(home)), len(home)) if len(home) else np.zeros(1, np.int64)
    rows = [b"".join(c[order[a:b]].tobytes() for c in (hashes, *columns)) for a, b in zip(cuts, cuts[1:])]
    return pa.table({"home": pa.array(home[cuts[:-1]], pa.int32()), "answer": pa.array(rows, pa.binary())})


def _empty_bucketed() -> pa.Table:
    return pa.table({"bucket": pa.array([], pa.int32()), "home": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})


def _whole_windows(table: pa.Table, answers: pa.Table, length: int, n: int, buckets: int) -> pa.Table:
    """The last level, a group's part: windows whose minimiser repeats, each with the smallest id that has it here."""
    if not table.num_rows or not answers.num_rows:
        return _empty_bucketed()
    words = Words(table)
    at = _alive(words, answers, length, n, words.windows(n), buckets)
    h, check = (x[at] for x in words.whole(n))
    check = (check >> np.uint64(32)).astype("<u4")
    order = np.lexsort((check, h))  # stable: documents stay in the order of their ids
    h, check, at = h[order], check[order], at[order]
    head = np.flatnonzero(_runs(h, check)) if len(h) else np.zeros(0, np.int64)
    ids = np.array([x if x is not None else 0 for x in words.ids], np.int64)
    row = np.searchsorted(words.first, at[head], "right") - 1
    return _emit(table.column("_home")[0].as_py(), buckets, h[head], h[head].astype("<u4"), check[head], ids[row].astype("<i8"))


def _smaller_elsewhere(table: pa.Table) -> pa.Table:
    """The last level, a bucket's part: to each group the windows that a smaller id has in another group."""
    home_of = table.column("home").to_numpy()
    payloads = table.column("payload").to_pylist()
    h, check, ids = _read(payloads, "<u4", "<u4", "<i8")
    home = np.repeat(home_of, [len(p) // 16 for p in payloads])
    order = np.lexsort((ids, check, h))
    h, check, ids, home = h[order], check[order], ids[order], home[order]
    head = _runs(h, check) if len(h) else np.zeros(0, bool)
    smallest = ids[np.flatnonzero(head)][np.cumsum(head) - 1] if len(h) else ids
    keep = ids > smallest
    return _from_bucket(table, home[keep], h[keep], check[keep])


def _covered(words: Words, answers: pa.Table | None, n: int, buckets: int) -> np.ndarray:
    """Words of a group that are to go."""
    at = words.windows(n)
    h, check = (x[at] for x in words.whole(n))
    check = (check >> np.uint64(32)).astype("<u4")
    gone = np.zeros(len(at), bool)
    if answers is not None and answers.num_rows and len(at):
        gone = _found(h, check, answers, buckets)
    order = np.lexsort((check, h))
    if len(order):
        head = _runs(h[order], check[order])
        doc = words.doc[at[order]]
        gone[order] |= doc > doc[np.flatnonzero(head)][np.cumsum(head) - 1]
    step = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(step, at[gone], 1)
    np.add.at(step, at[gone] + n, -1)
    return np.cumsum(step[:-1]) > 0


def _kept(table: pa.Table, answers: pa.Table | None, n: int, buckets: int) -> pa.Table:
    """A group's rows with word counts and what is left of the text."""
    words = Words(table)
    gone = _covered(words, answers, n, buckets)
    raw = words.data.tobytes()
    left, total, removed, digest = [], [], [], []
    for i, (a, b) in enumerate(zip(words.at.tolist(), words.at[1:].tolist())):
        found = raw[a:b].split()
        mask = gone[words.first[i] : words.first[i + 1]]
        lost = int(mask.sum())
        if lost:
            found = [w for w, g in zip(found, mask.tolist()) if not g]
        joined = b" ".join(found)
        total.append(len(mask))
        removed.append(lost)
        digest.append(hashlib.sha256(joined).hexdigest())
        left.append((joined if lost else raw[a:b]).decode())
    out = table.drop(["_home", "_text"]).take(pa.array(words.order))
    for name, values, kind in (("_left", left, pa.string()), ("_total", total, pa.int64()), ("_removed", removed, pa.int64()), ("_digest", digest, pa.string())):
        out = out.append_column(name, pa.array(values, kind))
    return out


def _dealt(docs: DataFrame, rows: int, bytes_: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """The documents with their group (``_home``), and the number of buckets for hashes.

    Columns of the table other than the text are carried as c0, c1 and so on, so that no name can clash.
    """
    names = docs.columns
    docs = C.fixed(docs, "documents")
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    key, text = key.cast("long"), text.cast("string")
    size = flat.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    groups = max(1, -(-size.n // rows), -(-(size.bytes or 0) // bytes_)) | 1
    home = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    own = [f"c{i}" for i, c in enumerate(names) if c != "text"]
    return flat.select(*own, key.alias("_id"), text.alias("_text"), home.alias("_home")), max(1, (size.bytes or 0) // bucket_bytes)


def _with(f, *rest):
    return lambda table: f(table, *rest)


def _with_answers(f, *rest):
    return lambda table, answers: f(table, answers, *rest)


def _candidates(dealt: DataFrame, n: int, buckets: int) -> tuple[DataFrame, int]:
    """(home, answer) of the last level below ``n``, and that level's length: the minimisers that repeat."""
    alive, before = None, 0
    for length in levels(n)[:-1]:
        if alive is None:
            sent = dealt.groupBy("_home").applyInArrow(_with(_minimisers, None, 0, length, n, buckets), _BUCKETED)
        else:
            sent = dealt.groupBy("_home").cogroup(alive.groupBy("home")).applyInArrow(_with_answers(_minimisers, before, length, n, buckets), _BUCKETED)
        alive, before = sent.groupBy("bucket").applyInArrow(_repeated, "home int, answer binary"), length
    return alive, before


def deduplicated(docs: DataFrame, counts: str = "counts", n: int = WINDOW, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``text`` cut, and a struct ``counts`` of n_words, n_removed and kept_sha256.

    A text that loses nothing stays as it is; another is its kept words, joined by
    one space.  The struct's name must be free in the table (see ``common.free_name``).
    """
    dealt, buckets = _dealt(docs, group_rows, group_bytes, bucket_bytes)
    alive, length = _candidates(dealt, n, buckets)
    wholes = dealt.groupBy("_home").cogroup(alive.groupBy("home")).applyInArrow(lambda a, b: _whole_windows(a, b, length, n, buckets), _BUCKETED)
    repeats = wholes.groupBy("bucket").applyInArrow(_smaller_elsewhere, "home int, answer binary")
    kept = T.StructType([*(f for f in dealt.schema if f.name not in ("_text", "_home")), *(T.StructField(c, T.StringType()) for c in ("_left", "_digest")), *(T.StructField(c, T.LongType()) for c in ("_total", "_removed"))])
    out = dealt.groupBy("_home").cogroup(repeats.groupBy("home")).applyInArrow(lambda a, b: _kept(a, b, n, buckets).select(kept.names), kept)
    names = docs.columns
    own = F.struct(F.col("_total").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_digest").alias("kept_sha256"))
    return out.select(*(F.col("_left" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)), own.alias(counts))


def _doubled(words: Words, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of each window of ``length`` words, n times a power of two: made of its halves' again and again."""
    h, check = words.whole(n)
    while n < length:
        h, check = (C.window_hashes(np.stack([x[:-n], x[n:]], 1).ravel(), 2)[::2] if len(x) > n else x[:0] for x in (h, check))
        n *= 2
    return h, check


def _alive_windows(words: Words, answers: pa.Table, length: int, n: int, buckets: int) -> np.ndarray:
    """True at each word that starts a window of ``length`` words that several ids have."""
    out = np.zeros(len(words.hashes) + 1, bool)
    at = words.windows(length)
    if len(at) and answers.num_rows:
        h, own = (x[at] for x in _doubled(words, length, n))
        out[at] = _found(h, (own >> np.uint64(32)).astype("<u4"), answers, buckets)
    return out


def _extended(table: pa.Table, answers: pa.Table, length: int, n: int, buckets: int) -> pa.Table:
    """A group's part of a level beyond ``n``: windows of twice the length both halves of which repeat, with the least and the largest id that has each here."""
    if not table.num_rows or not answers.num_rows:
        return _empty_bucketed()
    words = Words(table)
    alive = _alive_windows(words, answers, length, n, buckets)
    at = words.windows(2 * length)
    at = at[alive[at] & alive[np.minimum(at + length, len(alive) - 1)]]
    return _with_ids(table, words, at, 2 * length, n, buckets)


def _with_ids(table: pa.Table, words: Words, at: np.ndarray, length: int, n: int, buckets: int) -> pa.Table:
    h, check = (x[at] for x in _doubled(words, length, n))
    check = (check >> np.uint64(32)).astype("<u4")
    order = np.lexsort((check, h))  # stable: documents stay in the order of their ids
    h, check, at = h[order], check[order], at[order]
    head = np.flatnonzero(_runs(h, check)) if len(h) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(h)) - 1 if len(h) else head
    ids = np.array([x if x is not None else 0 for x in words.ids], np.int64)
    low, high = (ids[np.searchsorted(words.first, at[k], "right") - 1].astype("<i8") for k in (head, tail))
    return _emit(table.column("_home")[0].as_py(), buckets, h[head], h[head].astype("<u4"), check[head], low, high)


def _of_several_ids(table: pa.Table) -> pa.Table:
    """A bucket's part of a level beyond: to each group the windows that documents of several ids have."""
    home_of, payloads = table.column("home").to_numpy(), table.column("payload").to_pylist()
    h, check, low, high = _read(payloads, "<u4", "<u4", "<i8", "<i8")
    home = np.repeat(home_of, [len(p) // 24 for p in payloads])
    order = np.lexsort((check, h))
    h, check, low, high, home = h[order], check[order], low[order], high[order], home[order]
    if not len(h):
        return _from_bucket(table, home, h, check)
    head = np.flatnonzero(_runs(h, check))
    run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
    keep = (np.minimum.reduceat(low, head) < np.maximum.reduceat(high, head))[run]
    return _from_bucket(table, home[keep], h[keep], check[keep])


def _having(table: pa.Table, answers: pa.Table, length: int, n: int, buckets: int) -> pa.Table:
    """(row, id, longest) of a group's documents in which a window of this length repeats."""
    found = np.zeros(0, np.int64)
    if table.num_rows and answers.num_rows:
        words = Words(table)
        found = np.unique(np.searchsorted(words.first, np.flatnonzero(_alive_windows(words, answers, length, n, buckets)), "right") - 1)
        table = table.take(pa.array(words.order[found]))
    else:
        table = table.slice(0, 0)
    return pa.table({"row": table.column("c1").cast(pa.int64()), "id": table.column("_id").cast(pa.int64()), "longest": pa.array(np.full(len(found), length, np.int64))})


def longest_repeats(docs: DataFrame, n: int = WINDOW, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, id, longest): the largest of n, 2n, 4n, ... words such that a window of so many starts in a document and in one of another id.

    ``row`` is ``row_key()``; documents without such a window have no row.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", row_key().alias("row"), F.col("text"))
    dealt, buckets = _dealt(rows, group_rows, group_bytes, bucket_bytes)
    low, short = _candidates(dealt, n, buckets)
    by_home = lambda answers: dealt.groupBy("_home").cogroup(answers.groupBy("home"))

    def first(t, a):
        if not t.num_rows or not a.num_rows:
            return _empty_bucketed()
        words = Words(t)
        return _with_ids(t, words, _alive(words, a, short, n, words.windows(n), buckets), n, n, buckets)

    sent, length, found = by_home(low).applyInArrow(first, _BUCKETED), n, None
    while True:
        alive = C.stored(sent.groupBy("bucket").applyInArrow(_of_several_ids, "home int, answer binary"), "alive")
        if alive.isEmpty():
            break
        longest = C.stored(by_home(alive).applyInArrow(_with_answers(_having, length, n, buckets), "row long, id long, longest long"), "longest")
        found = longest if found is None else found.unionByName(longest)
        sent, length = by_home(alive).applyInArrow(_with_answers(_extended, length, n, buckets), _BUCKETED), 2 * length
    if found is None:
        return docs.sparkSession.createDataFrame([], "row long, id long, longest long")
    return found.groupBy("row", "id").agg(F.max("longest").alias("longest"))


def row_key():
    """What tells apart the texts of one id."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(C.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "counts.*")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
low AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, k FROM (SELECT r, unnest(range(i, i + 13)) AS k FROM win JOIN low USING (s) WHERE doc_id > first)),
g AS (SELECT r, count(*) AS n, list(k) AS ks FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ks, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
