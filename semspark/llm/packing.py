"""Best-fit packing of token sequences by patterns of few lengths.

Each text becomes token ids with an end id behind them, cut into pieces of ``size``
tokens where it is longer.  Pieces of equal length are alike for packing, so the plan
is made from the histogram of lengths alone, which has ``size`` entries whatever the
corpus:

1. patterns of two or three lengths that fill a sequence exactly are enumerated;
2. repeat counts are fitted to the histogram by non-negative least squares
   (accelerated projected gradient, sparse; long pieces weigh more, as they are hard to
   place later);
3. counts are rounded so that their running sums keep to the fit's, and held to what is
   left of each length;
4. what remains is packed by best fit, longest first, on the histogram.

A piece finds its place by its rank among those of its length: ranks are counted inside
blocks of rows of a stored table and moved by the blocks' sums, so that a length that a
third of all pieces have is spread over as many tasks as it has blocks.  The plan holds
one row for each pattern and length: at most three for each of ``PATTERNS`` and the
pairs in each round, and a few thousand for the rest.

Ids come from the ``tokenizers`` library, word by word: no token of this vocabulary
holds white space, and neither its normalisation nor its special strings reach across
any, so that a text's ids are those of its words.  A word is encoded once for each
task's table of words, which is emptied when it is full.

Defined results: a null or empty text has the end id alone; a text of any length takes
part whole; each row is answered by its own pieces, be it repeated, of a repeated id, or
of none; among pieces of one length any may take any place; no rows give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semspark.llm import common as C

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SIZE = 2048
END = 0
#: Bound of the patterns of three that are fitted; they are thinned evenly where there are more.
PATTERNS = 20_000
STEPS = 300
#: Fits that are tried, by the pieces to each pattern and the number of rounds; the one of the fewest sequences is kept.
FITS = ((32, 1), (8, 4), (128, 1), (1024, 1))
#: Words and bytes that a task remembers the ids of.
WORDS, WORD_BYTES = 1 << 20, 1 << 25
#: Rows that are ranked together.
BLOCK_ROWS = 1 << 16

_MARK = b"\n"  # stands for the end id among the words, none of which holds white space


class Coder:
    """Ids of whole texts, by way of their words."""

    def __init__(self, vocabulary: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(vocabulary), end
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark, self.mark_id = special[-1] if special else (None, None)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {_MARK: 0}
        self.bytes = 0
        self.flat, self.upto = np.array([self.end], "<u4"), np.array([0, 1])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and the number of each word's; a special string between them tells them apart."""
        ids, sizes = [], []
        for k in range(0, len(words), 1024):
            some = words[k : k + 1024]
            text = self.mark.join(some) if self.mark else ""
            if self.mark and text.count(self.mark[0]) == (len(some) - 1) * self.mark.count(self.mark[0]):
                got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                ends = np.append(np.flatnonzero(got == self.mark_id), len(got))
                ids.append(got[got != self.mark_id])
                sizes.append(np.diff(ends, prepend=-1) - 1)
            else:  # one of them holds what special strings begin with
                found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                ids.append(np.array(list(chain.from_iterable(found)), "<u4"))
                sizes.append(np.array([len(x) for x in found]))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, words: list[bytes]) -> None:
        first = self.mark[:1].encode() if self.mark else b""
        words.sort(key=lambda w: first in w)
        ids, sizes = self._encoded([w.decode(errors="replace") for w in words])
        self.flat, self.upto = np.concatenate([self.flat, ids]), np.concatenate([self.upto, self.upto[-1] + np.cumsum(sizes)])
        have = len(self.place)
        self.place.update(zip(words, range(have, have + len(words))))
        self.bytes += sum(map(len, words))

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id behind it, and where each text begins."""
        if len(self.place) > WORDS or self.bytes > WORD_BYTES:
            self._forget()
        words = [t.split() for t in texts]
        for w in words:
            w.append(_MARK)
        flat = list(chain.from_iterable(words))
        if new := set(flat).difference(self.place):
            self._learn(list(new))
        index = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        at, size = self.upto[index], np.diff(self.upto)[index]
        upto = np.append(0, np.cumsum(size))
        out = self.flat[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
        return out, upto[np.append(0, np.cumsum([len(w) for w in words]))]


_CODERS: dict[tuple[str, int], Coder] = {}


def _cut(batches, vocabulary: str, end: int, size: int, keep_ids: bool):
    if (vocabulary, end) not in _CODERS:
        _CODERS[vocabulary, end] = Coder(vocabulary, end)
    coder = _CODERS[vocabulary, end]
    for batch, data, at in C.pieces(batches, "_text"):
        raw = data.tobytes()
        ids, first = coder.ids([raw[a:b] for a, b in zip(at.tolist(), at[1:].tolist())])
        total = np.diff(first)
        n = -(-total // size)
        row = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * size
        length = np.minimum(size, total[row] - start)
        bounds = zip((first[row] + start).tolist(), (first[row] + start + length).tolist())
        bytes_ = [ids[a:b].tobytes() for a, b in bounds]
        crc = pa.array([zlib.crc32(b) for b in bytes_], pa.int64())
        columns = [batch.column("_key").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), crc, *([pa.array(bytes_, pa.binary())] if keep_ids else [])]
        yield pa.RecordBatch.from_arrays(columns, ["_key", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, vocabulary: str = VOCABULARY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32), and ``ids`` if asked for, of each piece of each text."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    out = rows.mapInArrow(lambda it: _cut(it, vocabulary, end, size, keep_ids), f"_key {kind}, piece int, start long, length long, ids_crc32 long{', ids binary' * keep_ids}")
    return out.withColumnRenamed("_key", key)


# --- the plan -----------------------------------------------------------------


def patterns(counts: np.ndarray, most: int = PATTERNS, turn: int = 0) -> np.ndarray:
    """Rows of three lengths, the largest first and 0 for none, that add up to the size and of which there are enough.

    Of those of three, ``most`` are taken, evenly in their order, others in each ``turn``.
    """
    size = len(counts) - 1
    lengths = np.flatnonzero(counts[:size] > 0)
    lengths = lengths[lengths > 0]
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    found = [np.zeros((0, 3), np.int64)]
    for a in lengths.tolist():
        b = lengths[(lengths <= a) & (lengths <= size - a)]
        c = size - a - b
        ok = (c <= b) & (have[c] | (c == 0))
        b, c = b[ok], c[ok]
        ok = (counts[a] >= 1 + (b == a).astype(int) + (c == a)) & (counts[b] >= 1 + (c == b))
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    out = np.concatenate(found)
    three = np.flatnonzero(out[:, 2])
    if len(three) > most:
        three = three[((np.arange(most) + 0.618 * turn % 1) * len(three) / most).astype(np.int64)]
    return out[np.sort(np.concatenate([np.flatnonzero(out[:, 2] == 0), three]))]


def fitted(some: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often each pattern is to be used: non-negative least squares against the histogram."""
    weight = np.arange(len(counts)) / (len(counts) - 1) + 0.02
    weight[0] = 0

    def slope(x):
        return (weight * np.bincount(some.ravel(), np.repeat(x, 3), len(counts)))[some].sum(1)

    v = np.ones(len(some))
    for _ in range(15):  # the largest eigenvalue bounds the step
        v = slope(v)
        top = np.linalg.norm(v)
        v /= top
    aim = (weight * counts)[some].sum(1)
    x = ahead = np.zeros(len(some))
    momentum = 1.0
    for _ in range(steps):
        then = np.maximum(0, ahead - (slope(ahead) - aim) / (1.05 * top))
        following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        ahead = then + (momentum - 1) / following * (then - x)
        x, momentum = then, following
    return x


def rounded(some: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole counts whose sums, over the patterns of one largest length and in the order of the second, stay within one half of the fit's."""
    upto = np.cumsum(x)
    first = np.searchsorted(some[:, 0], some[:, 0])
    before = np.append(0, upto)[first]
    whole = np.floor(upto - before + 0.5).astype(np.int64)
    return np.diff(whole, prepend=0) * (first != np.arange(len(x))) + whole * (first == np.arange(len(x)))


def best_fit(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how often, [(length, number of it)]) of sequences, each piece in the fullest that takes it, the longest first."""
    size = len(counts) - 1
    spaces: list[int] = []
    open_: dict[int, list] = {}

    def put(space: int, n: int, filling: list) -> None:
        if n:
            if space not in open_:
                insort(spaces, space)
                open_[space] = []
            open_[space].append((n, filling))

    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                space, n, filling = size, left, []
            else:
                space = spaces[k]
                n, filling = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[k]
            times = space // length
            whole = min(n, left // times)
            put(space - times * length, whole, [*filling, (length, times)])
            left, n = left - whole * times, n - whole
            if left and n and left < times:
                put(space - left * length, 1, [*filling, (length, left)])
                left, n = 0, n - 1
            if filling:
                put(space, n, filling)
    return [x for some in open_.values() for x in some]


def _chosen(counts: np.ndarray, each: int, rounds: int, steps: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how often, [(length, number of it)]) of all sequences, by fits to what is left and then by best fit."""
    left, out = counts.copy(), []
    for turn in range(rounds):
        some = patterns(left, min(PATTERNS, max(64, int(left.sum()) // each)), turn)
        if not len(some):
            break
        n = rounded(some, fitted(some, left, steps))
        for k in np.flatnonzero(n)[::-1].tolist():  # long pieces first
            lengths, times = np.unique(some[k][some[k] > 0], return_counts=True)
            often = min(int(n[k]), int((left[lengths] // times).min()))
            if often > 0:
                left[lengths] -= often * times
                out.append((often, list(zip(lengths.tolist()[::-1], times.tolist()[::-1]))))
    return out + best_fit(left)


def plan(counts: np.ndarray, fits: tuple[tuple[int, int], ...] = FITS, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Where the pieces go: of ``length``, the ranks from ``first`` on go to the sequences from ``base`` on, ``times`` to each, at ``offset``.

    ``counts[n]`` pieces are of length n; the last entry is that of a whole sequence.
    """
    counts = counts.astype(np.int64)
    tried = [_chosen(counts, each, rounds, steps) for each, rounds in fits]
    chosen = min(tried, key=lambda some: sum(n for n, _ in some))
    rows, next_rank, base = [], np.zeros(len(counts), np.int64), 0
    for n, filling in chosen:
        offset = 0
        for length, times in filling:
            rows.append((length, next_rank[length], base, times, offset))
            next_rank[length] += n * times
            offset += length * times
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "times", "offset"), table.T)) | {"sequences": base}


def _place(batches, where: dict[str, np.ndarray]):
    keys = (where["length"] << 48) + where["first"]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
        k = np.searchsorted(keys, (length << 48) + rank, "right") - 1
        nth = rank - where["first"][k]
        sequence = where["base"][k] + nth // where["times"][k]
        offset = where["offset"][k] + nth % where["times"][k] * length
        names = [c for c in batch.schema.names if c != "_rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def ranked(stored: DataFrame, by: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A stored table with ``_rank``: 0, 1, ... among the rows of equal ``by``; rows are known by their place in their file."""
    rows = stored.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.withColumn("_block", F.floor(F.col("_row") / block_rows))
    sizes = rows.groupBy(by, "_file", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.select(by, "_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(by, "_file", "_block").orderBy("_row")
    out = rows.withColumn("_nth", F.row_number().over(inside) - 1).join(sums, [by, "_file", "_block"])
    return out.select(*stored.columns, (F.col("_before") + F.col("_nth")).cast("long").alias("_rank"))


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, vocabulary: str = VOCABULARY, end: int = END, keep_ids: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pieces with ``sequence_id`` and their ``offset`` in that sequence; ``ids`` too if asked for."""
    cut = C.stored(pieces(docs, key, text, size, vocabulary, end, keep_ids), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # one row a length, so at most ``size``
        counts[r["length"]] = r["n"]
    where = plan(counts)
    kinds = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    return ranked(cut, "length", block_rows).mapInArrow(lambda it: _place(it, where), f"{kinds}, sequence_id long, offset long")


def sequences(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whole sequences of packed pieces (with ids): sequence_id, ids, and the pieces' keys and offsets in their order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(key).alias("key"), "piece", "ids")))
    out = rows.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return out.select("sequence_id", joined.alias("ids"), F.col("p.key").alias("keys"), F.col("p.piece").alias("pieces"), F.col("p.offset").alias("offsets"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(C.table(spark, sf_dir, "documents"))
