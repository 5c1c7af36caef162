"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items
(an item of fewer words, but not none, is one pattern).  They are searched in
every whole document: a block of two words at the end of the search window gives
a shift; positions of shift zero are looked up in the bucket of their suffix
hash, and the words themselves are then compared byte by byte.  All documents of
a batch advance together, each by its own shift.

A word is a run of bytes other than ASCII control, space and punctuation; A-Z
are lower-cased and nothing else is.

Defined results: a null or empty document has no words and no hits; a null or
wordless item has no pattern; repeated items give one pattern under each id; an
item without an id marks words but has no id to list; repeated rows are each
answered; texts of any length are searched whole; no documents give no rows, and
without items no document is hit; extra columns of either table are ignored.

The texts are never shuffled.  The patterns are dealt into blocks of at most
``block_words`` words by their hashes, and each block's tables are built in a task;
there is one pass over the documents for each block, and a pass is written to the
shared folder before the next one starts, so that one block is on the driver,
broadcast and in a worker at a time, whatever the benchmark's size.

Patterns that occur in the same items are of one kind.  A search tells kinds, and
their items are joined to them afterwards, once for each distinct set of kinds: no
list of a shared pattern's items is ever built or broadcast.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm import common as C

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: A block's tables are stored in parts of so many bytes.
PART_BYTES = 8 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _words(data: np.ndarray, at: np.ndarray):
    starts, ends, first = C.word_spans(data, at, _WORD)
    low = _LOWER[data]
    return low, starts, ends, first, C.span_hashes(low, starts, ends)


class Patterns:
    """Shift tables and suffix buckets for one block of benchmark windows, by length."""

    def __init__(self, windows: dict[tuple[bytes, ...], int]):
        by_length = defaultdict(list)
        for words, kind in windows.items():
            by_length[len(words)].append((words, kind))
        self.tables = [self._table(n, rows) for n, rows in sorted(by_length.items())]

    @staticmethod
    def _table(n: int, rows: list) -> dict:
        """For words in blocks of ``b``: how far a search window may move, and who ends here."""
        b = min(2, n)
        joined = [b" ".join(words) for words, _ in rows]
        flat = np.frombuffer(b" ".join(joined), np.uint8)
        starts, ends, _ = C.word_spans(flat, np.array([0, len(flat)]), _WORD)
        hashes = C.span_hashes(flat, starts, ends).reshape(len(rows), n)
        blocks = np.stack([C.window_hashes(row, b) for row in hashes])
        shift: dict[int, int] = {}
        for j in range(n - b, -1, -1):  # the rightmost place of a block wins: the smallest shift
            for h in blocks[:, n - b - j].tolist():
                shift[h] = j
        keys = np.array(sorted(shift), np.uint64)
        suffix: dict[int, list[int]] = defaultdict(list)
        for i, h in enumerate(C.window_hashes(row, n)[0] for row in hashes):
            suffix[int(h)].append(i)
        return {"n": n, "b": b, "keys": keys, "shift": np.array([shift[int(k)] for k in keys], np.int64), "ends": np.array(sorted(suffix), np.uint64), "suffix": dict(suffix), "bytes": joined, "kinds": [kind for _, kind in rows]}

    def search(self, low, starts, ends, first, hashes) -> tuple[np.ndarray, list[set]]:
        """Words hit, and the kinds of patterns that occur in each row."""
        hit = np.zeros(len(starts) + 1, np.int32)
        found: list[set] = [set() for _ in range(len(first) - 1)]
        for t in self.tables:
            for row, word, kind in self._occurrences(t, low, starts, ends, first, hashes):
                hit[word] += 1
                hit[word + t["n"]] -= 1
                found[row].add(kind)
        return np.cumsum(hit[:-1]) > 0, found

    @staticmethod
    def _occurrences(t, low, starts, ends, first, hashes):
        n, b, keys = t["n"], t["b"], t["keys"]
        blocks, whole = C.window_hashes(hashes, b), None
        lane = np.flatnonzero(np.diff(first) >= n)
        # a long row is cut into lanes that overlap by n - 1 words, so that no row is waited for
        span = 4096
        count = np.diff(first)[lane]
        cuts = -(-(count - n + 1) // span)
        owner = np.repeat(lane, cuts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = first[owner] + nth * span
        stop = np.minimum(first[owner + 1] - n + 1, at + span)
        while len(at):
            h = blocks[at + n - b]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            move = np.where(keys[k] == h, t["shift"][k], n - b + 1)
            stay = np.flatnonzero(move == 0)
            if len(stay):
                whole = C.window_hashes(hashes, n) if whole is None else whole
                h = whole[at[stay]]
                k = np.minimum(np.searchsorted(t["ends"], h), len(t["ends"]) - 1)
                for i in stay[t["ends"][k] == h].tolist():
                    word = int(at[i])
                    text = b" ".join(low[s:e].tobytes() for s, e in zip(starts[word : word + n].tolist(), ends[word : word + n].tolist()))
                    for p in t["suffix"][int(whole[word])]:
                        if t["bytes"][p] == text:
                            yield int(owner[i]), word, t["kinds"][p]
            at = at + np.maximum(move, 1)
            keep = at < stop
            at, stop, owner = at[keep], stop[keep], owner[keep]


def _item_windows(batches, window: int):
    """(item, words joined by spaces, their number) of each pattern."""
    for batch, data, at in C.pieces(batches, "text"):
        low, starts, ends, first, _ = _words(data, at)
        ids, out = batch.column("item").to_pylist(), ([], [], [])
        for row, item in enumerate(ids):
            words = [low[s:e].tobytes() for s, e in zip(starts[first[row] : first[row + 1]], ends[first[row] : first[row + 1]])]
            for j in range(max(1, len(words) - window + 1) if words else 0):
                out[0].append(item)
                out[1].append(b" ".join(words[j : j + window]))
                out[2].append(min(len(words), window))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())], ["item", "pattern", "size"])


def _built(table: pa.Table) -> pa.Table:
    """The tables of one block of patterns, in parts."""
    data = pickle.dumps(Patterns({tuple(p.split(b" ")): k for p, k in zip(table.column("pattern").to_pylist(), table.column("kind").to_pylist())}))
    parts = [data[a : a + PART_BYTES] for a in range(0, len(data), PART_BYTES)]
    return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "data": pa.array(parts, pa.binary())})


def _dealt(patterns: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """The patterns with a block each, and the number of blocks; none holds more than ``block_words`` words, or one pattern."""
    total, largest = patterns.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    ranges = 8 * max(1, -(-total // block_words))
    while True:
        place = F.pmod(F.xxhash64("pattern"), F.lit(ranges))
        words = dict(patterns.groupBy(place.alias("place")).agg(F.sum("size")).collect())  # as many rows as there are ranges of hashes
        if max(words.values(), default=0) <= max(block_words, largest):
            break
        ranges *= 2
    block, held, blocks = 0, 0, []
    for k in range(ranges):
        if held and held + words.get(k, 0) > block_words:
            block, held = block + 1, 0
        held += words.get(k, 0)
        blocks.append(block)
    return patterns.withColumn("block", F.element_at(F.lit(blocks), (place + 1).cast("int")).cast("int")), block + 1


def pattern_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[Iterator[Patterns], DataFrame]:
    """Blocks of the patterns, of which one is on the driver at a time; and the (kind, item) rows of the patterns' kinds.

    Items of one kind's patterns are the same set, which two sums of hashes and a count tell.
    """
    C.bounded_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    found = C.stored(rows.mapInArrow(lambda it: _item_windows(it, window), "item string, pattern binary, size int").distinct(), "item-windows")
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "item")).alias(name) for seed, name in ((0, "x"), (1, "y"))]
    patterns = C.stored(found.groupBy("pattern", "size").agg(*same, F.count("*").alias("n")), "patterns")
    kinds = C.stored(patterns.groupBy("x", "y", "n").agg(F.min("pattern").alias("one")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    items = C.stored(found.where("item IS NOT NULL").join(kinds.select(F.col("one").alias("pattern"), "kind"), "pattern").select("kind", "item"), "kind-items")
    placed, count = _dealt(patterns.join(kinds, ["x", "y", "n"]).select("pattern", "size", "kind"), block_words)
    built = C.stored(placed.groupBy("block").applyInArrow(_built, "block int, part int, data binary"), "blocks")

    def blocks():
        for k in range(count):
            parts = sorted(built.where(F.col("block") == k).select("part", "data").collect())
            yield pickle.loads(b"".join(bytes(r.data) for r in parts)) if parts else Patterns({})

    return blocks(), items


def _scan(batches, patterns: Patterns, more: bool):
    """Words, hit words (as bits) and kinds of each row, added to those of earlier blocks; the text goes along if blocks follow."""
    for batch, data, at in C.pieces(batches, "text"):
        low, starts, ends, first, hashes = _words(data, at)
        hit, found = patterns.search(low, starts, ends, first, hashes)
        bits = [np.packbits(hit[a:b]) for a, b in zip(first[:-1], first[1:])]
        if "bits" in batch.schema.names:
            bits = [a | np.frombuffer(b, np.uint8) for a, b in zip(bits, batch.column("bits").to_pylist())]
            found = [a | set(b) for a, b in zip(found, batch.column("kinds").to_pylist())]
        out = {"key": batch.column("key")} | ({"text": batch.column("text")} if more else {})
        out |= {"n": pa.array(np.diff(first), pa.int64()), "bits": pa.array([b.tobytes() for b in bits], pa.binary()), "kinds": pa.array([sorted(k) for k in found], pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def contaminated_words(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each document's key with ``n`` words, ``bits`` (one per word, set where hit) and the ``items`` that occur."""
    spark: SparkSession = docs.sparkSession
    C.bounded_batches(spark)
    out = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    kind = dict(out.dtypes)["key"]
    blocks, items = pattern_blocks(benchmark, window, block_words)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        more = following is not None
        shared = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(lambda it, s=shared, m=more: _scan(it, s.value, m), f"key {kind}, {'text string, ' * more}n long, bits binary, kinds array<long>")
        out = C.stored(out, "searched")
        shared.destroy()
        block = following
    hit = out.where(F.size("kinds") > 0)
    each = hit.select("kinds").distinct().select("kinds", F.explode("kinds").alias("kind")).join(items, "kind").groupBy("kinds").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.lit([]).cast("array<string>")
    known = hit.join(each, "kinds", "left").select("key", "n", "bits", F.coalesce("items", none).alias("items"))
    return known.unionByName(out.where(F.size("kinds") == 0).select("key", "n", "bits", none.alias("items"))).withColumnRenamed("key", key)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    C.bounded_batches(docs.sparkSession)

    def clean(batches, patterns: Patterns):
        for batch, data, at in C.pieces(batches, "text"):
            hit, _ = patterns.search(*_words(data, at))
            first = C.word_spans(data, at, _WORD)[2]
            total = np.append(0, np.cumsum(hit))
            yield batch.filter(pa.array(total[first[1:]] == total[first[:-1]]))

    out, (blocks, _) = docs, pattern_blocks(benchmark, window, block_words)
    block = next(blocks)
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(lambda it, s=shared: clean(it, s.value), docs.schema)
        block = next(blocks, None)
        if block is not None:
            out = C.stored(out, "searched")
            shared.destroy()
    return out


def _digest(batches, key: str):
    for batch in batches:
        items = batch.column("items").to_pylist()
        hits = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in batch.column("bits").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(key), batch.column("n"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([h > 0 for h in hits])],
            [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    found = contaminated_words(docs, benchmark, window=window, block_words=block_words)
    return found.mapInArrow(lambda it: _digest(it, "doc_id"), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


#: Item occurrences by equality of windows; the same rows by another road.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n)),
occ AS (SELECT r, n, i, item_id FROM win JOIN pat USING (n, s)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, n, i FROM occ)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM occ GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
