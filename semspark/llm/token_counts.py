"""Token counts from compiled finite-state transducers.

The pre-tokenizer's pattern is compiled into a deterministic transducer over
character classes: each transition says which pre-token boundaries it emits
(before the current character, or one or two characters back, where the pattern
looks ahead).  The characters of a batch of texts are cut into short chunks; all
chunks run together, from every state at once, which gives each chunk's map from
state to state.  The maps compose associatively, and a parallel prefix scan gives
the state in which each chunk really starts; a second run emits the boundaries.

The merges are compiled into a second deterministic transducer, over bytes.  Its
state after a prefix of a pre-token is the end of that prefix which a token may still
reach over: the last token of the encoding up to each place in it, and how many tokens
follow that place.  A byte's transition leads to the next state and is annotated with
the tokens that it emits, less those that it takes back because a merge swallows them.
Transitions are compiled when a text first needs them.  All pre-tokens of a batch run
through it side by side, and a text's count is the sum over its transitions, plus one
for each special string in it.  A very long pre-token is cut into chunks, which run
together from a guessed state; the chunk maps are composed, and a chunk that was
entered in another state than guessed is run again.

Texts are never shuffled, joined or cut: a very long text only means more chunks,
and characters are worked on ``BLOCK`` at a time with the state carried over.

Defined results: a null text counts as an empty one, of no bytes and no tokens;
repeated rows are each answered; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm import bpe
from semspark.llm import common as C

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 128
WARM = 12
BLOCK = 1 << 20
#: A pre-token of more bytes runs in chunks of so many, each from so many bytes ahead of it.
PIECE, AHEAD = 256, 64
#: Compiled states that a worker keeps; beyond, compilation starts anew.  Results do not depend on it.
STATES = 400_000

# symbols of the input: a text's end, letters (those of contractions apart), numbers, space, other white space, apostrophe, others
END, LETTER, STMD, R, V, E, L, NUMBER, SPACE, BLANK, QUOTE, OTHER = range(12)
# states
(FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, SPACE_1, SPACE_N, BLANK_1, BLANK_N, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L) = range(12)
HERE, BACK_1 = 1, 2
_SIZE = 16


def compile_pretokenizer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted boundaries of each (state, symbol), as flat tables of 16 by 16.

    FRESH stands for the start of a text and for the end of a contraction: either
    way a boundary is due before whatever comes.
    """
    go, emit = np.zeros((_SIZE, _SIZE), np.uint8), np.zeros((_SIZE, _SIZE), np.uint8)
    letters = (LETTER, STMD, R, V, E, L)

    def begin(symbol: int) -> int:
        """State after a pre-token has started with this symbol."""
        if symbol in letters:
            return IN_LETTER
        return {END: FRESH, NUMBER: IN_NUMBER, SPACE: SPACE_1, BLANK: BLANK_1, QUOTE: QUOTED, OTHER: IN_OTHER}[symbol]

    for symbol in range(12):
        for state in range(12):
            go[state, symbol], emit[state, symbol] = begin(symbol), HERE
    for symbol in letters:
        go[IN_LETTER, symbol], emit[IN_LETTER, symbol] = IN_LETTER, 0
    go[IN_NUMBER, NUMBER], emit[IN_NUMBER, NUMBER] = IN_NUMBER, 0
    for state in (IN_OTHER, QUOTED):  # a quote inside a run of others starts no contraction
        for symbol in (QUOTE, OTHER):
            go[state, symbol], emit[state, symbol] = IN_OTHER, 0
    go[QUOTED, STMD], emit[QUOTED, STMD] = FRESH, 0
    for symbol, state, last in ((R, QUOTED_R, E), (V, QUOTED_V, E), (L, QUOTED_L, L)):
        go[QUOTED, symbol], emit[QUOTED, symbol] = state, 0
        for other in range(12):  # no contraction after all: the letter began a pre-token
            emit[state, other] = BACK_1 | HERE
        for other in letters:
            go[state, other], emit[state, other] = IN_LETTER, BACK_1
        go[state, last], emit[state, last] = FRESH, 0
    for state in (SPACE_1, SPACE_N, BLANK_1, BLANK_N):  # the last of several blanks goes its own way
        go[state, SPACE], emit[state, SPACE] = SPACE_N, 0
        go[state, BLANK], emit[state, BLANK] = BLANK_N, 0
        for symbol in (*letters, NUMBER, QUOTE, OTHER):
            spaced = state in (SPACE_1, SPACE_N)
            go[state, symbol] = IN_OTHER if spaced and symbol == QUOTE else begin(symbol)
            emit[state, symbol] = (0 if spaced else HERE) | (BACK_1 if state in (SPACE_N, BLANK_N) else 0)
    return go.ravel(), emit.ravel()


def symbol_table() -> np.ndarray:
    """Symbol of each code point; one more entry stands for the end of a text."""
    kind = bpe.class_table()
    out = np.array([OTHER, LETTER, NUMBER, BLANK], np.uint8)[kind]
    out[ord(" ")], out[ord("'")] = SPACE, QUOTE
    for chars, symbol in (("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", L)):
        out[[ord(c) for c in chars]] = symbol
    return np.append(out, np.uint8(END))


def run_chunks(symbols: np.ndarray, start: int, go: np.ndarray, emit: np.ndarray, chunk: int = CHUNK, warm: int = WARM) -> tuple[np.ndarray, int]:
    """Boundary flags before each symbol (and one before what follows), and the last state."""
    n = len(symbols)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, 15, np.uint8)  # a symbol that changes nothing pads the last chunk
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    # maps: the state after the chunk, for each state before it
    maps = np.broadcast_to(np.arange(_SIZE, dtype=np.uint8), (rows, _SIZE)).copy()
    for j in range(min(warm, chunk)):
        maps = go[(maps.astype(np.intp) << 4) | grid[j][:, None]]
    one = (maps == maps[:, :1]).all(1)  # most chunks have forgotten where they began
    for lanes, width in ((np.flatnonzero(one), 1), (np.flatnonzero(~one), _SIZE)):
        state = maps[lanes, :width].astype(np.intp)
        for j in range(warm, chunk):
            state = go[(state << 4) | grid[j][lanes][:, None]].astype(np.intp)
        maps[lanes] = state
    # prefix scan by doubling: maps[i] becomes the composition of chunks 0..i
    step = 1
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    first = np.empty(rows, np.intp)
    first[0], first[1:] = start, maps[:-1, start]
    out = np.zeros((chunk, rows), np.uint8)
    state = first
    for j in range(chunk):
        at = (state << 4) | grid[j]
        out[j] = emit[at]
        state = go[at].astype(np.intp)
    flags = out.T.ravel()[:n]
    edge = flags & HERE
    edge[:-1] |= (flags[1:] & BACK_1) >> 1
    return np.append(edge, (flags[:1] & BACK_1) >> 1), int(state[-1])


class Merges:
    """The merges as a deterministic transducer over bytes, compiled as far as texts need it.

    Two tokens stand side by side in an encoding exactly if merging their bytes gives
    them back, that is, if no merge across their border is due before both are whole.
    """

    _ZERO = 1 << 15

    def __init__(self, merges: dict[tuple[bytes, bytes], int]):
        self.order = merges
        self.made_of = {a + b: (a, b) for a, b in merges}
        if len(self.made_of) < len(merges):
            raise ValueError("two merges make the same token")
        self.parts: tuple[dict, dict] = ({}, {})
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        tokens = {bytes([b]) for b in range(256)}
        for a, b in merges:  # a token that other merges always break up is never emitted
            if a in tokens and b in tokens and self._whole(a, b):
                tokens.add(a + b)
        self.tokens = tokens
        self.open = {t[:k] for t in tokens for k in range(len(t))}
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first: nothing read, no token before."""
        self.states: list[tuple[bytes, tuple, tuple]] = [(b"", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self._table(16)

    def _border(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """Parts at a token's right (1) or left (0) border, from the byte up to the token, and when each becomes the next."""
        known = self.parts[side]
        if token not in known:
            out, part, due = [], token, float("inf")
            while True:
                out.append((part, due))
                if len(part) == 1:
                    break
                pair = self.made_of[part]
                part, due = pair[side], self.order[pair]
            known[token] = out[::-1]
        return known[token]

    def _whole(self, left: bytes, right: bytes) -> bool:
        """Whether both tokens become whole before a merge crosses their border; of equal merges the left one comes first."""
        a, b = self._border(left, 1), self._border(right, 0)
        i = j = 0
        while True:
            (x, due_x), (y, due_y) = a[i], b[j]
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            cross = self.order.get((x, y))
            if cross is not None and cross < due_x and cross <= due_y:
                return False
            if due_x <= due_y:
                i += 1
            else:
                j += 1

    def _follows(self, left: bytes | None, right: bytes) -> bool:
        """Whether ``right`` can come after ``left`` (None: at the start)."""
        if left is None:
            return True
        key = left, right
        if key not in self.beside:
            self.beside[key] = key not in self.order and self._whole(left, right)
        return self.beside[key]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state, and tokens emitted (less those taken back)."""
        seen, last, after = self.states[state]
        seen += bytes([byte])
        k = next(k for k in range(len(seen)) if seen[k:] in self.tokens and self._follows(last[k], seen[k:]))
        emitted = 1 - after[k]
        last, after = (*last, seen[k:]), (*(n + emitted for n in after), 0)
        m = next(m for m in range(len(seen) + 1) if seen[m:] in self.open)
        key = seen[m:], last[m:], after[m:]
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], emitted

    # transitions as a hash table of arrays: state and byte -> next state and emission

    def _table(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self._table(max(self.bits, int(4 * len(keys)).bit_length()))
        self.used += len(keys)
        slot = self._slot(keys)
        while len(keys):  # one of those that meet in a free slot stays, the rest move on
            free = self.keys[slot] < 0
            first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)[1]
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = self.values[slot]
        todo = np.flatnonzero(held != keys)
        if not len(todo):
            return out
        at, new = slot[todo], []
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            same = held == keys[todo]
            out[todo[same]] = self.values[at[same]]
            none = held < 0
            new.append(todo[none])
            left = ~same & ~none
            todo, at = todo[left], at[left]
        # a first slot that is free ends the search too
        missing = np.unique(keys[self.keys[slot] < 0]) if (self.keys[slot] < 0).any() else np.zeros(0, np.int64)
        missing = np.union1d(missing, keys[np.concatenate(new)]) if new else missing
        missing = missing[~self._has(missing)]
        if len(missing):
            steps = [self.step(int(k) >> 8, int(k) & 255) for k in missing]
            self._put(missing, np.array([(s << 16) | (n + self._ZERO) for s, n in steps], np.int64))
            return self._get(keys)
        return out

    def _has(self, keys: np.ndarray) -> np.ndarray:
        out, slot, todo = np.zeros(len(keys), bool), self._slot(keys), np.arange(len(keys))
        while len(todo):
            held = self.keys[slot[todo]]
            out[todo[held == keys[todo]]] = True
            todo = todo[(held != keys[todo]) & (held >= 0)]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return out

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens emitted by each span after its first ``skip`` bytes, the state there, and the last state; all spans advance together."""
        order = np.argsort(-size, kind="stable")
        at, sizes, now = start[order], size[order], state[order].astype(np.int64)
        ahead = None if skip is None else skip[order]
        total, entered = np.zeros(len(at), np.int64), now.copy()
        alive = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right") if len(sizes) else []
        for j, m in enumerate(alive):
            got = self._get((now[:m] << 8) | data[at[:m] + j])
            now[:m] = got >> 16
            total[:m] += (got & 0xFFFF) - self._ZERO
            if ahead is not None:
                here = np.flatnonzero(ahead[:m] == j + 1)
                total[here], entered[here] = 0, now[here]
        out = np.empty((3, len(at)), np.int64)
        out[:, order] = total, entered, now
        return out[0], out[1], out[2]

    def count(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        if len(self.states) > STATES:
            self.clear()
        size = stop - start
        out = np.zeros(len(start), np.int64)
        short = size <= 2 * PIECE
        out[short] = self.run(data, start[short], size[short], np.zeros(int(short.sum()), np.int64))[0]
        for k in np.flatnonzero(~short).tolist():
            out[k] = self._composed(data, int(start[k]), int(stop[k]))
        return out

    def _composed(self, data: np.ndarray, start: int, stop: int) -> int:
        """Tokens of one long pre-token: chunk maps, each known at the state that a run from shortly before gives, are composed."""
        cuts = np.arange(start, stop, PIECE)
        begin = np.maximum(cuts - AHEAD, start)
        ends = np.append(cuts[1:], stop)
        total, guess, leave = self.run(data, begin, ends - begin, np.zeros(len(cuts), np.int64), cuts - begin)
        for k in range(1, len(cuts)):
            if guess[k] != leave[k - 1]:
                total[k], guess[k], leave[k] = (x[0] for x in self.run(data, cuts[k : k + 1], ends[k : k + 1] - cuts[k : k + 1], leave[k - 1 : k]))
        return int(total.sum())


class Transducer:
    """Both transducers, compiled once for a worker."""

    def __init__(self, vocabulary: str = VOCABULARY, chunk: int = CHUNK):
        self.go, self.emit = compile_pretokenizer()
        self.go[np.arange(_SIZE) * _SIZE + 15] = np.arange(_SIZE)
        self.symbols = symbol_table()
        merges, self.special = bpe.merges_of(vocabulary)
        self.merges = Merges(merges)
        self.chunk = chunk

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        parts, owner = [], []
        for i, text in enumerate(texts):
            found = [text]
            for mark in self.special:
                found = [x for y in found for x in y.split(mark)]
            out[i] = len(found) - 1
            parts += found
            owner += [i] * len(found)
        whole = "\0".join(parts) + "\0" if parts else ""
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        edges = []
        state = FRESH
        for lo in range(0, len(points), BLOCK):
            part = self.symbols[points[lo : lo + BLOCK]]
            inside = ends[np.searchsorted(ends, lo) : np.searchsorted(ends, lo + len(part))] - lo
            part[inside] = END
            edge, state = run_chunks(part, state, self.go, self.emit, self.chunk)
            edges.append(np.flatnonzero(edge[:-1]) + lo)
            # a boundary one before the block was not known when that block ran
            if len(edges) > 1 and edge[-1]:
                edges[-2] = np.append(edges[-2], lo - 1)
        starts = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        if not len(starts):
            return out
        starts = starts[~np.isin(starts, ends, kind="sort")]
        which = np.searchsorted(ends, starts)
        stops = np.minimum(np.append(starts[1:], len(points)), ends[which]) if len(starts) else starts
        # from characters to bytes
        data = np.frombuffer(whole.encode(), np.uint8)
        width = np.ones(len(points) + 1, np.int64)
        width[0] = 0
        for low in (0x80, 0x800, 0x10000):
            width[1:] += points >= low
        place = np.cumsum(width, out=width)
        sizes = self.merges.count(data, place[starts], place[stops])
        total = np.bincount(which, sizes, len(parts)).astype(np.int64)
        for i, k in zip(owner, total.tolist()):
            out[i] += k
        return out


_COMPILED: dict[tuple[str, int], Transducer] = {}


def _count(batches, vocabulary: str, chunk: int):
    key = vocabulary, chunk
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(vocabulary, chunk)
    for batch, data, at in C.pieces(batches, "_text"):
        counts = _COMPILED[key].counts([x or "" for x in batch.column("_text").to_pylist()])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(np.diff(at), pa.int64()), pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, vocabulary: str = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """Bytes and tokens of each text."""
    C.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    out = rows.mapInArrow(lambda it: _count(it, vocabulary, chunk), f"_key {dict(rows.dtypes)['_key']}, n_bytes long, n_tokens long")
    return out.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.table(spark, sf_dir, "documents"))
