"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into overlapping chunks of ``CHUNK_CHARS`` characters.  Each chunk is
pre-tokenised from its first character, wherever that falls; the first few pre-tokens
may be wrong.  Two neighbours agree from the first pre-token boundary that both have
inside their overlap: matching runs left to right without looking back, so equal
boundaries stay equal.  The overlap always reaches a place where black meets white,
which is a boundary for any start, so that such a place exists.  The stitched pieces
are encoded by the ranks.  Decoding concatenates the raw bytes of the ids.

The chunks of a usual text are stitched where it lies.  Texts of more than
``DEALT_CHARS`` are dealt out: runs of chunks become rows of their own, go to as many
tasks as the session shuffles into, and are stitched the same way by their text.

Defined results: a null text is an empty one, of no ids; its digests are those of
no bytes.  Repeated rows are each answered; no rows give no rows; extra columns are
ignored.  An id unknown to the vocabulary raises an error in decoding.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm import bpe
from semspark.llm import common as C

RANKS = "byte_bpe_50k.tiktoken"
CHUNK_CHARS, DEALT_CHARS = 1024, 1 << 16
#: Characters that a boundary must have behind it in its chunk: the pattern looks one ahead.
AHEAD = 2

_PLACE = re.compile(r"(?<=\S)[ \t\n\r]")


def _own_pattern() -> re.Pattern:
    """The pre-tokenizer's pattern with the classes that the standard module knows."""
    out = public_tokenizers.PATTERN
    for theirs, ours in ((r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d")):
        out = out.replace(theirs, ours)
    return re.compile(out)


def _stand_ins() -> dict[int, str]:
    """For each character that the standard module puts in another class than the library, one of the library's class."""
    table = bpe.class_table()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    own = np.zeros(0x110000, np.uint8)
    for kind, p in enumerate((r"[^\W\d_]", r"\d", r"\s"), 1):
        own[[ord(m) for m in re.findall(p, every)]] = kind
    return {c: "☃a1 "[table[c]] for c in np.flatnonzero(own != table).tolist() if not 0xD800 <= c < 0xE000}


class Codec:
    """Pre-tokenizer, ranks and caches of a worker."""

    def __init__(self, ranks: str = RANKS):
        self.ranks = bpe.ranks_of(ranks)
        self.merger = bpe.Merger.of_ranks(self.ranks)
        self.pattern = _own_pattern()
        self.stand_in = _stand_ins()
        # those beyond the basic plane are rare: any of them counts as odd
        self.odd = re.compile("[" + "".join(re.escape(chr(c)) for c in self.stand_in if c < 0x10000) + "\U00010000-\U0010ffff]")
        self.ids: dict[str, bytes] = {}
        size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for t, i in self.ranks.items():
            size[i] = len(t)
        self.known = size > 0
        self.size, self.start = size, np.cumsum(size) - size
        self.flat = np.empty(int(size.sum()), np.uint8)
        for t, i in self.ranks.items():
            self.flat[self.start[i] : self.start[i] + len(t)] = np.frombuffer(t, np.uint8)

    def pieces(self, text: str, chunk_chars: int = CHUNK_CHARS) -> list[str]:
        """Pre-tokens of a text, stitched from those of its chunks."""
        seen = text.translate(self.stand_in) if self.odd.search(text) else text
        spans = cut(seen, chunk_chars)
        out = stitched(spans, [self.pattern.findall(seen[a:b]) for a, b in spans])
        if seen is text:
            return out
        ends = np.cumsum([len(x) for x in out]).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each text's pieces, as little-endian unsigned 32-bit integers."""
        every = set().union(*texts)
        new = every.difference(self.ids)
        if len(self.ids) + len(new) > bpe.CACHE_ENTRIES:
            self.ids, new = {}, every
        raw = {p: p.encode() for p in new}
        own = [p for p in new if raw[p] not in self.ranks]
        self.ids.update((p, self.ranks[raw[p]].to_bytes(4, "little")) for p in new if raw[p] in self.ranks)
        self.ids.update(zip(own, self.merger.merge([raw[p] for p in own])))
        return [b"".join(map(self.ids.__getitem__, x)) for x in texts]

    def decode(self, texts: list[bytes]) -> pa.Array:
        """The raw bytes of each text's ids, one after another."""
        ids = np.frombuffer(b"".join(texts), "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(self.size) or not self.known[ids].all()):
            raise ValueError("an id that the vocabulary does not have")
        size = self.size[ids]
        total = np.append(0, np.cumsum(size))
        data = self.flat[np.repeat(self.start[ids] - total[:-1], size) + np.arange(total[-1])]
        cuts = total[np.cumsum([0, *(len(x) // 4 for x in texts)])].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])


_CODECS: dict[str, Codec] = {}


def codec(ranks: str) -> Codec:
    if ranks not in _CODECS:
        _CODECS[ranks] = Codec(ranks)
    return _CODECS[ranks]


def cut(text: str, chunk_chars: int) -> list[tuple[int, int]]:
    """Spans of overlapping chunks: each reaches past the next one's start to a sure boundary."""
    spans, start = [], 0
    while True:
        nxt = start + chunk_chars
        place = _PLACE.search(text, nxt) if nxt < len(text) else None
        if place is None or place.start() + AHEAD >= len(text):
            spans.append((start, len(text)))
            return spans
        spans.append((start, place.start() + AHEAD))
        # chunks may be longer than asked for where no white space comes; the next starts inside
        start = max(nxt, place.start() - chunk_chars)


def stitched(spans: list[tuple[int, int]], found: list[list[str]]) -> list[str]:
    """Pre-tokens of a text from those of its chunks: each neighbour's count from the first boundary that both have."""
    out, skip = [], 0
    for k in range(len(spans) - 1):
        here, start, end = found[k], spans[k + 1][0], spans[k][1]
        mine, i, at = {}, len(here), end
        while at > start:  # this chunk's boundaries in the overlap, from its end
            i -= 1
            at -= len(here[i])
            mine[at] = i
        at, j = start, 0
        while at not in mine or at > end - AHEAD:
            at += len(found[k + 1][j])
            j += 1
        out += here[skip : mine[at]]
        skip = j
    return out + found[-1][skip:]


def _whole(batches, ranks: str, chunk_chars: int):
    """Texts that stay where they are: ids, and the bytes decoded from them."""
    c = codec(ranks)
    for batch, _, _ in C.pieces(batches, "text", 1 << 20):
        ids = c.encode([c.pieces(x, chunk_chars) if x else [] for x in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary()), c.decode(ids)], ["key", "ids", "bytes"])


def _dealt(batches, run_chars: int):
    """Overlapping runs of a long text, one row each."""
    for batch, _, _ in C.pieces(batches, "text"):
        for key, row, text in zip(batch.column("key"), batch.column("row").to_pylist(), batch.column("text").to_pylist()):
            spans = cut(text, run_chars)
            for lo in range(0, len(spans), 16):
                some = spans[lo : lo + 16]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(some), batch.schema.field("key").type), pa.array([row] * len(some), pa.int64()), pa.array(range(lo, lo + len(some)), pa.int32()), pa.array([a for a, _ in some], pa.int64()), pa.array([text[a:b] for a, b in some])], ["key", "row", "chunk", "start", "text"]
                )


def _provisional(batches, ranks: str, chunk_chars: int):
    """Each run from its own first character: bounds, ids, and ids before each bound."""
    c = codec(ranks)
    for batch, _, _ in C.pieces(batches, "text"):
        bounds, ids, counts = [], [], []
        for start, text in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist()):
            found = c.pieces(text, chunk_chars)
            ids += c.encode([found])
            bounds.append((np.cumsum([0, *map(len, found)]) + start).astype("<i8").tobytes())
            counts.append(np.cumsum([0, *(len(c.ids[p]) // 4 for p in found)]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("key", "row", "chunk")), *(pa.array(x, pa.binary()) for x in (bounds, ids, counts))], ["key", "row", "chunk", "bounds", "ids", "counts"])


def _gathered(pdf: pd.DataFrame, ranks: str) -> pd.DataFrame:
    """Ids of one long text from its runs, and the bytes decoded from them."""
    pdf = pdf.sort_values("chunk")
    bounds = [np.frombuffer(b, "<i8") for b in pdf["bounds"]]
    counts = [np.frombuffer(n, "<i8") for n in pdf["counts"]]
    out, lo = [], int(bounds[0][0])
    for k, ids in enumerate(pdf["ids"]):
        hi = int(bounds[k][-1])
        if k + 1 < len(bounds):
            common = np.intersect1d(bounds[k][:-1], bounds[k + 1], assume_unique=True)
            hi = int(common[(common >= lo) & (common <= hi - AHEAD)][0])
        first, last = (counts[k][np.searchsorted(bounds[k], x)] for x in (lo, hi))
        out.append(ids[4 * first : 4 * last])
        lo = hi
    ids = b"".join(out)
    return pd.DataFrame({"key": pdf["key"].iloc[:1], "ids": [ids], "bytes": [codec(ranks).decode([ids])[0].as_py()]})


def coded(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, chunk_chars: int = CHUNK_CHARS, dealt_chars: int = DEALT_CHARS) -> DataFrame:
    """``key``, ``ids`` (each whole text's, little-endian, 32 bits each) and ``bytes`` (what the ids decode to)."""
    spark = docs.sparkSession
    C.bounded_batches(spark, 512)
    rows = C.fixed(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "texts")
    kind = dict(rows.dtypes)["key"]
    long = F.coalesce(F.length("text") > dealt_chars, F.lit(False))
    here = rows.where(~long).mapInArrow(lambda it: _whole(it, ranks, chunk_chars), f"key {kind}, ids binary, bytes binary")
    # a row is known by its place in the table, so that equal rows stay apart
    runs = rows.withColumn("row", F.monotonically_increasing_id()).where(long).mapInArrow(lambda it: _dealt(it, dealt_chars), f"key {kind}, row long, chunk int, start long, text string")
    runs = runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row", "chunk")
    parts = runs.mapInArrow(lambda it: _provisional(it, ranks, chunk_chars), f"key {kind}, row long, chunk int, bounds binary, ids binary, counts binary")
    gathered = parts.groupBy("row").applyInPandas(lambda pdf: _gathered(pdf, ranks), f"key {kind}, ids binary, bytes binary")
    return here.unionByName(gathered).withColumnRenamed("key", key)


def decoded(ids: DataFrame, key: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """``key``, ``ids`` and the raw ``bytes`` that they stand for."""

    def run(batches):
        c = codec(ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = c.decode([x or b"" for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("ids"), raw], ["key", "ids", "bytes"])

    rows = ids.select(F.col(key).alias("key"), "ids")
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, ids binary, bytes binary").withColumnRenamed("key", key)


def digest_columns() -> list[Column]:
    """Count and hashes of the ids, and the hash of the decoded bytes."""
    return [
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    ]


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(C.table(spark, sf_dir, "documents")).select("doc_id", *digest_columns())
