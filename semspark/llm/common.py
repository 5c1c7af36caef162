"""Helpers shared by the operators of this package.

Text work runs on the UTF-8 bytes of an Arrow column: a batch is a byte array
and the offsets of its rows.  Words are hashed, windows of words are hashes of
hashes, and everything below takes whole texts.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 512
BATCH_BYTES = 2 << 20
SLICE_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Keep Arrow batches small: texts are long, and a batch is held whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: short lineage, no lost blocks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fixed(df: DataFrame, name: str) -> DataFrame:
    """``df``, such that a row's place in it is the same whenever it is made: as it is if it is read from files row by row, else stored first.

    What comes out of an exchange or a sample lies differently when a lost executor's part is
    made again, and then no number of a row's place may be relied on.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    # a scan of files names its InMemoryFileIndex, which is no cache
    return stored(df, name) if re.search("Exchange|Sample|InMemoryTableScan|InMemoryRelation|TableCache", plan) else df


def once_a_task(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` without rows that repeat the (integer) keys of an earlier row of the same task; what repeats a great deal then goes on once from each task."""

    def first(batches):
        seen: set = set()
        for batch in batches:
            new = [k not in seen and not seen.add(k) for k in zip(*(batch.column(c).to_pylist() for c in keys))]
            yield batch.filter(pa.array(new, pa.bool_()))

    return df.mapInArrow(first, df.schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of the table bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(column: str, n: int):
    """crc32 of an id as text, modulo ``n``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


# --- text columns as bytes -------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    got = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return got, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut so that each holds about ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        data, at = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of them."""
    if len(_POWERS.get("up", ())) < n:
        n = 1 << max(20, int(n - 1).bit_length())
        for name, base in (("up", _MULT), ("down", _INV)):
            out = np.ones(n, np.uint64)
            have = 1
            step = base
            while have < n:  # doubling: the powers so far, times the next one
                out[have : 2 * have] = out[:have] * np.uint64(step)
                step = step * step % (1 << 64)
                have *= 2
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that ``is_word`` marks), and each row's first word.

    A word never crosses the end of a row.
    """
    n = len(data)
    mark = np.zeros(n + 1, bool)
    mark[:n] = is_word[data]
    begin = mark.copy()
    begin[1:] &= ~mark[:-1]
    inner = at[(at > 0) & (at < n)]
    begin[inner] = mark[inner]
    starts = np.flatnonzero(begin)
    end = np.zeros(n + 1, bool)
    end[1:] = mark[:-1] & ~mark[1:]
    end[inner] = mark[inner - 1]
    return starts, np.flatnonzero(end), np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, which are in order and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, "right")))
        lo, hi = int(starts[first]), int(ends[last - 1])
        up, down = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1 + seed)) * up[: hi - lo], out=total[1:])
        s, e = starts[first:last] - lo, ends[first:last] - lo
        out[first:last] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = last
    return mix(out)


def window_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes; rows are not told apart here."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    mult = np.uint64((_MULT * (2 * seed + 1) * 0x2545F4914F6CDD1D | 1) % (1 << 64))
    out = np.full(count, (n * 0x9FB21C651E98DF25 + seed) % (1 << 64), np.uint64)
    for j in range(n):
        out *= mult
        out += words[j : j + count]
    return mix(out)


def window_starts(first_word: np.ndarray, n: int) -> np.ndarray:
    """True at each word that starts a window of ``n`` words inside its row."""
    total = int(first_word[-1])
    ok = np.zeros(total, bool)
    sizes = np.diff(first_word)
    whole = sizes >= n
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, first_word[:-1][whole], 1)
    np.add.at(step, first_word[1:][whole] - n + 1, -1)
    ok[:] = np.cumsum(step[:-1]) > 0
    return ok


#: Words as runs of bytes other than ASCII white space.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
