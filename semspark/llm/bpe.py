"""Byte-pair merging and the character classes that the public pre-tokenizers use."""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import numpy as np
import public_tokenizers

#: A cache of pre-tokens is emptied at this many entries; results do not depend on it.
CACHE_ENTRIES = 150_000
#: Pieces of at most so many bytes are merged side by side in arrays.
SHORT = 48
_NEVER = 1 << 60


@lru_cache(4)
def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that the .json vocabulary writes for bytes, by rule: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def ranks_of(name: str) -> dict[bytes, int]:
    """Rank file: bytes of each token and its id."""
    out = {}
    with open(public_tokenizers.path(name), "rb") as f:
        for line in f:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


@lru_cache(4)
def merges_of(name: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """.json vocabulary: the order of each merge, and the special strings."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        spec = json.load(f)
    raw = byte_alphabet()
    merges = {}
    for i, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges[bytes(raw[c] for c in left), bytes(raw[c] for c in right)] = i
    return merges, [t["content"] for t in spec["added_tokens"]]


def merged(piece: bytes, rank) -> list[bytes]:
    """Merge the pair of lowest rank, leftmost first, until none is left.

    ``rank(left, right)`` gives a number or None.  A heap over linked parts keeps
    long pieces at n log n.
    """
    n = len(piece)
    part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank(part[i], part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if part[i] != left or j >= n or part[j] != right:  # an older pair
            continue
        part[i], part[j] = left + right, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(part[i], part[k])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[k]))
        h = before[i]
        if h >= 0 and (r := rank(part[h], part[i])) is not None:
            heapq.heappush(heap, (r, h, part[h], part[i]))
    return [p for p in part if p is not None]


class Merger:
    """Byte-pair merging of many short pieces at once.

    ``pairs`` gives (left id, right id, order of their merge, id of the result),
    ``ids`` the id of each token; ``rank(left, right)`` is the order by bytes, for
    pieces that are too long for arrays.
    """

    def __init__(self, pairs, ids: dict[bytes, int], rank):
        self.ids, self.by_bytes = ids, rank
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        flat = np.fromiter((x for p in pairs for x in p), np.int64).reshape(-1, 4)
        keys = (flat[:, 0].astype(np.uint64) << np.uint64(32)) | flat[:, 1].astype(np.uint64)
        ranks = flat[:, 2].copy()
        self.result = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
        self.result[ranks] = flat[:, 3]
        self.bits = max(8, int(3 * len(flat)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, _NEVER, np.int64)
        left, slot = keys, self._slot(keys)
        while len(left):  # open addressing: one of those that meet in a free slot stays, the rest move on
            free = self.keys[slot] == np.uint64(2**64 - 1)
            first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)[1]
            first = first[free[first]]
            self.keys[slot[first]], self.ranks[slot[first]] = left[first], ranks[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, ranks, slot = left[rest], ranks[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    @classmethod
    def of_merges(cls, merges: dict[tuple[bytes, bytes], int]) -> Merger:
        """From a list of merges; ids are numbers of our own."""
        ids = {t: i for i, t in enumerate(dict.fromkeys([*(bytes([b]) for b in range(256)), *(a + b for a, b in merges)]))}
        return cls(((ids[a], ids[b], r, ids[a + b]) for (a, b), r in merges.items()), ids, lambda a, b: merges.get((a, b)))

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merger:
        """From ranks: any two tokens merge whose bytes joined are a token."""
        split = ((ranks[t[:i]], ranks[t[i:]], r, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        return cls(split, ranks, lambda a, b: ranks.get(a + b))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge order of each pair of ids; _NEVER for those that do not merge, or are none (-1)."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(key)
        out = np.full(len(key), _NEVER, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            held = self.keys[slot[todo]]
            same = held == key[todo]
            out[todo[same]] = self.ranks[slot[todo[same]]]
            todo = todo[~same & (held != np.uint64(2**64 - 1))]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for high in (4, 8, 12, 16, 24, 32, SHORT):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(some), 8192):
                self._merge(pieces, some[k : k + 8192], sizes, high, out)
            low = high
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = np.array([self.ids[t] for t in merged(pieces[i], self.by_bytes)], "<u4").tobytes()
        return out

    def _merge(self, pieces, some, sizes, width, out) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in some.tolist()), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[some][:, None], self.of_byte[raw], -1)
        ids = np.column_stack([ids, np.full(len(ids), -1)])
        order = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width)
        cols = np.arange(width)
        while len(some):
            at = order.argmin(1)
            rows = np.arange(len(some))
            best = order[rows, at]
            done = best == _NEVER
            if done.any():
                rows_done = ids[done]
                there = rows_done >= 0
                flat, ends = rows_done[there].astype("<u4").tobytes(), np.cumsum(4 * there.sum(1)).tolist()
                for i, a, b in zip(some[done].tolist(), [0, *ends], ends):
                    out[i] = flat[a:b]
                some, ids, order, at, best = some[~done], ids[~done], order[~done], at[~done], best[~done]
                rows = np.arange(len(some))
            if not len(some):
                break
            later = cols >= at[:, None] + 1
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[rows, at] = self.result[best]
            order[:, :-1] = np.where(later[:, 1:] | (cols[:-1] == at[:, None]), order[:, 1:], order[:, :-1])
            order[:, -1] = _NEVER
            order[rows, at] = self.rank(ids[rows, at], ids[rows, at + 1])
            inner = rows[at > 0]
            order[inner, at[inner] - 1] = self.rank(ids[inner, at[inner] - 1], ids[inner, at[inner]])


@lru_cache(1)
def class_table() -> np.ndarray:
    """For each code point 1 (letter), 2 (number), 3 (white space) or 0, as the tokenizer library's patterns see it."""
    from tokenizers import Regex, normalizers

    points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint8)
    for kind, (pattern, mark) in enumerate(((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", " ")), 1):
        seen = normalizers.Replace(Regex(pattern), mark).normalize_str(text)
        got = np.frombuffer(seen.encode("utf-32-le"), np.uint32)
        out[points[got == ord(mark)]] = kind
    out[[ord("a"), ord("1"), ord(" ")]] = 1, 2, 3
    return out
