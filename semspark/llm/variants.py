"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Two words one edit apart agree before and behind the edit.  So each word goes to the list of
those that share its leading half and, for edits there, to that of those that share
its trailing half, once for either length that the shorter of a pair may have.  Where
such a list is too long its stretch of places for the edit is halved, so that words meet
by both ends, again and again until lists are short; at a single place the alphabet
bounds them.  Each pair of words has one place of edit, where they first differ, and so
meets in one list.

A list is sorted and walked as the tree of its prefixes: the rows of the edit matrix, cut to
the band of one edit, that belong to a prefix are reckoned once for all words that
share it (neighbours whose longest common prefix reaches so far), and a range of words
is skipped as soon as every entry of its prefix's row exceeds one edit.  All words of a
list, and all lists of a batch, take each step together as arrays.

A word then knows its number of near words and the most frequent of them; only that
leaves a list.  Forms are followed to their roots by doubling, with as many joins
as the logarithm of the longest chain, which ten times the frequency in each step keeps short.

Defined results: runs are of ASCII letters and U+00C0 to U+00FF; a null or empty text
has none, and a text of any length takes part whole; a null id counts as the empty
string in the crc; repeated rows count each; ties go to the smaller word by code
points; no rows, or no word often enough, give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm import common as C

LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant.
TIMES = 10
#: One in so many runs of a document, by crc32, loses a letter.
EVERY = 31
#: Longest list of words that is walked unhalved.
LIST_WORDS = 4096
#: Words that a task counts before it hands them on, and prefixes that are walked at once.
COUNTED, WALKED = 1 << 18, 1 << 16

_RUN = re.compile(rb"[A-Za-z\xc0-\xff]{%d,}+" % LEAST_LETTERS)


def _counted(batches, every: int):
    """(word, n): runs of enough letters after what is deleted, one byte a letter (Latin-1)."""
    counts: Counter[bytes] = Counter()

    def rows():
        got = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return got

    for batch in batches:
        for key, text in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist()):
            if not text:
                continue
            # letters outside the range become question marks, which end a run as they do
            found = Counter(_RUN.findall(text.encode("latin-1", "replace").lower()))
            start = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in found.items():
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                if h % every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LETTERS:
                        continue
                counts[run] += n
            if len(counts) > COUNTED:
                yield rows()
    yield rows()


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """(word, n) of all words that occur often enough."""
    rows = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).cast("string").alias("_text"))
    found = rows.mapInArrow(lambda it: _counted(it, every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- lists ----------------------------------------------------------------------


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the ``key`` of their list: the stretch of places ``lo`` to ``hi`` for the edit, the shorter word's length, and what is shared at both ends."""
    tail = F.col("short") - F.col("hi")  # letters shared behind an edit at any place of the stretch
    shared = F.when(tail > 0, F.expr("right(word, short - hi)")).otherwise("")
    return rows.withColumn("key", F.concat_ws("|", F.col("short").cast("string"), F.col("lo").cast("string"), F.col("hi").cast("string"), F.expr("left(word, lo)"), shared))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice, with either half of its stretch."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return rows.withColumn("half", F.explode(halves)).select("word", "n", "short", "half.lo", "half.hi")


def lists(vocabulary: DataFrame, most: int = LIST_WORDS) -> DataFrame:
    """(key, lo, hi, word, n): every word in each list in which it may meet a near word."""
    # the shorter of a pair has this word's length, or one letter less
    rows = vocabulary.withColumn("short", F.explode(F.array(F.length("word"), F.length("word") - 1))).where(F.col("short") >= LEAST_LETTERS)
    # an edit may stand at any place of the shorter word, or behind it
    rows = _keyed(_halved(rows.select("word", "n", "short", F.lit(0).alias("lo"), (F.col("short") + 1).alias("hi"))))
    done = None
    while True:
        rows = C.stored(rows, "lists")
        long = rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("n_words")).where(F.col("n_words") > most).select("key")
        long = C.stored(long, "long")
        if long.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fine = rows.join(long, "key", "left_anti").select(*rows.columns)
        done = fine if done is None else done.unionByName(fine)
        rows = _keyed(_halved(rows.join(long, "key", "left_semi")))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words as a table of bytes, 0 behind the last, and the words' lengths."""
    raw = [w.encode("latin-1") for w in words]
    size = np.array([len(w) for w in raw], np.int64)
    out = np.zeros((len(raw), int(size.max(initial=0)) + 2), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    return out, size


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix, row by row; a row ends at its first 0."""
    differ = (a != b) | (a == 0)
    return differ.argmax(1)


def near_pairs(group: np.ndarray, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all words one edit apart within each group; rows are sorted by group and then by letters, each word once a group."""
    count, wide = letters.shape
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = np.full(count, -1, np.int64)  # with the word before; -1 where a group begins
    same = group[1:] == group[:-1]
    shared[1:][same] = _common(letters[1:], letters[:-1])[same]
    out = [], []
    starts = np.flatnonzero(shared < 0)
    # a word begins with the range of its group, at the empty prefix: row (-, 0, 1) of the matrix
    query, node = np.arange(count), np.cumsum(shared < 0) - 1
    row = np.tile(np.array([2, 0, 1], np.int8), (count, 1))
    todo = [(0, starts, query, node, row)]
    while todo:
        depth, starts, query, node, row = todo.pop()
        while len(query):
            if len(query) > WALKED:  # the rest waits, so that memory stays bounded
                todo.append((depth, starts, query[WALKED:], node[WALKED:], row[WALKED:]))
                query, node, row = query[:WALKED], node[:WALKED], row[:WALKED]
            # ranges of one letter more: those of a range follow one another
            below = np.flatnonzero(shared < depth + 1)
            first = np.searchsorted(below, starts)
            fan = np.append(first[1:], len(below)) - first
            n = fan[node]
            owner = np.repeat(np.arange(len(query)), n)
            child = first[node][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            query, row = query[owner], row[owner]
            word = below[child]
            letter = letters[word, depth]
            # words that end here: the entry at the other's whole length tells their distance
            end = letter == 0
            at = size[query[end]] - depth + 1
            near = (at >= 0) & (at <= 2)
            near[near] = row[end][near, at[near]] == 1
            out[0].append(query[end][near])
            out[1].append(word[end][near])
            go = ~end
            query, row, child, letter = query[go], row[go], child[go], letter[go]
            # the next row of the band, from its left, middle and right entries
            mine = np.stack([letters[query, depth - 1] if depth else np.zeros(len(query), np.uint8), letters[query, depth], letters[query, np.minimum(depth + 1, wide - 1)]], 1)
            step = row + ((mine != letter[:, None]) | (mine == 0))
            then = np.empty_like(row)
            then[:, 0] = np.minimum(step[:, 0], row[:, 1] + 1)
            then[:, 1] = np.minimum(np.minimum(step[:, 1], row[:, 2] + 1), then[:, 0] + 1)
            then[:, 2] = np.minimum(step[:, 2], then[:, 1] + 1)
            then = np.minimum(then, 2)
            live = then.min(1) <= 1  # else the whole range is skipped
            query, node, row, starts, depth = query[live], child[live], then[live], below, depth + 1
    return np.concatenate(out[0]), np.concatenate(out[1])


def _walked(batches):
    """(word, n_near, near, near_n): how many near words each word has in a list, and the most frequent; lists come whole and one after another."""
    kept: list[pa.Table] = []

    def run(table: pa.Table) -> pa.RecordBatch:
        key, word, n = (table.column(c).combine_chunks() for c in ("key", "word", "n"))
        group = np.append(0, np.cumsum(pc.not_equal(key[1:], key[:-1]).to_numpy(False)))
        n = n.to_numpy()
        letters, size = _letters(word.to_pylist())
        i, j = near_pairs(group, letters, size)
        place = _common(letters[i], letters[j])  # of the edit: the pair belongs to the list whose stretch holds it
        lo, hi = (table.column(c).to_numpy() for c in ("lo", "hi"))
        short = table.column("short").to_numpy()
        mine = (lo[i] <= place) & (place < hi[i]) & (np.minimum(size[i], size[j]) == short[i])
        i, j = i[mine], j[mine]
        order = np.lexsort((j, -n[j], i))  # within a list the order of rows is that of words
        i, j = i[order], j[order]
        head = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        many = np.diff(np.append(head, len(i)))
        return pa.RecordBatch.from_arrays([word.take(pa.array(i[head])), pa.array(many, pa.int64()), word.take(pa.array(j[head])), pa.array(n[j[head]], pa.int64())], ["word", "n_near", "near", "near_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key = table.column("key").combine_chunks()
        other = np.flatnonzero(pc.not_equal(key, key[-1]).to_numpy(False))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last list may go on in the next batch
        if cut:
            yield run(pa.concat_tables([*kept, table.slice(0, cut)]))
            kept = []
        kept.append(table.slice(cut))
    if kept:
        yield run(pa.concat_tables(kept))


def near_words(vocabulary: DataFrame, most: int = LIST_WORDS, partitions: int | None = None) -> DataFrame:
    """(word, n_near, near, near_n): the number of words one edit apart and the most frequent of them, of words that have any."""
    rows = lists(vocabulary, most)
    dealt = rows.repartition(*([partitions] if partitions else []), "key").sortWithinPartitions("key", "word")
    found = dealt.select("key", "lo", "hi", "short", "word", "n").mapInArrow(_walked, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a ``form``: the last word that following forms leads to."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        roots = C.stored(roots, "roots")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = roots.join(on, "root", "left")
        if further.where(F.col("_next").isNotNull()).isEmpty():
            return roots
        roots = further.select("word", F.coalesce("_next", "root").alias("root"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, most: int = LIST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    vocabulary = C.stored(words(docs, key, text, every), "words")
    near = near_words(vocabulary, most)
    often = F.coalesce(F.col("near_n") >= TIMES * F.col("n"), F.lit(False))
    rows = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("near")).alias("form"), F.when(often, F.col("near_n")).alias("form_n"))
    rows = C.stored(rows, "forms")
    out = rows.join(rooted(rows.where(F.col("form").isNotNull())), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(C.table(spark, sf_dir, "documents"))
