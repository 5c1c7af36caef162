"""The scoring of an answer in its own row, as one Arrow function: what ``scoring`` does with columns, by hash vectors.

An answer has a few short lines, on which array functions spend most of their time in
looking at one character or element each.  Here the lines of a whole Arrow batch are
worked on together in Spark's tasks, with a loop in Python only to lower and split
them; the rules and fixed values are those of ``text`` and ``labels``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from semspark.functions import text as X
from semspark.operators import embedding as E
from semspark.operators import labels as L

SCORED = "array<struct<ordinal:int,candidate:string,similarity:double,improvement:double,diversity:double,reason:string,is_valid:boolean>>"
RESULT = "struct<candidate_count:long,valid_count:long,best:struct<similarity:double,candidate:string,improvement:double,ordinal:int>>"
_FIELDS = {"ordinal": pa.int32(), "candidate": pa.string(), "similarity": pa.float64(), "improvement": pa.float64(), "diversity": pa.float64(), "reason": pa.string(), "is_valid": pa.bool_()}

# The patterns of ``text``, in this dialect: digits and letters of ASCII only.
_S = f"[{X.SPACES}]*"
_OPEN, _MARK, _NAME = rf"^```[A-Za-z]*{_S}", rf"^{_S}(?:[-*]|[0-9]+[).\]:-]){_S}", rf"^{_S}[Cc][Aa][Nn][Dd][Ii][Dd][Aa][Tt][Ee]{_S}(?:[0-9]+{_S})?[:.-]{_S}"
_REASONS = ("invalid_length", "literal_copy_current", "literal_copy_target", "duplicate_output", "semantic_copy_target", "insufficient_semantic_progress", "too_distant_from_current", "too_close_to_current", "valid")
_VALID = len(_REASONS) - 1


def _any(texts: pa.Array, part: str) -> bool:
    return bool(pc.any(pc.match_substring(texts, part)).as_py())


def _without(texts: pa.Array, *patterns: str) -> pa.Array:
    for pattern in patterns:
        texts = pc.replace_substring_regex(texts, pattern, "")
    return texts


def parse(raw: pa.Array, most: int | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What ``text.parse_candidates`` gives of all answers of a batch: the candidates, the row of each, and its ordinal there from 1."""
    if _any(raw, "```"):
        raw = pc.replace_substring(_without(raw, "```[A-Za-z]*\n?"), "```", "")
    body = pc.utf8_trim(raw, X.SPACES)
    lists = pc.split_pattern_regex(body, "\r?\n") if _any(body, "\r") else pc.split_pattern(body, "\n")
    lines, row = pc.utf8_trim(lists.flatten(), X.SPACES), np.asarray(pc.list_parent_indices(lists))
    if _any(lines, "```"):
        lines = _without(lines, _OPEN, "```$")
    lines = _without(pc.utf8_trim(_without(lines, _MARK, _NAME), "\"'`"), "^<|>$")
    lines = pc.utf8_trim(lines, X.SPACES)
    some = np.asarray(pc.not_equal(lines, ""))
    row = row[some]
    ordinal = np.arange(1, len(row) + 1) - np.searchsorted(row, row)
    few = slice(None) if most is None else ordinal <= most
    return lines.filter(pa.array(some)).filter(pa.array(np.ones(len(row), bool) if most is None else few)), row[few], ordinal[few]


@lru_cache(maxsize=1 << 16)
def _rounded(x: float, scale: int) -> float:
    """As Spark rounds: half up, of the shortest decimal that spells the number."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP))


def _at(values: np.ndarray, scale: int | None) -> np.ndarray:
    """All rounded; short texts give few numbers, each very often."""
    if scale is None:
        return values
    each, at = np.unique(values, return_inverse=True)
    return np.array([x if math.isnan(x) else _rounded(x, scale) for x in each.tolist()], float)[at]


#: A token between texts that are split together.
_GAP = "\0"


class _Slots(dict):
    """Slots of tokens that this worker has met, a bounded number of them."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[token] = found = -1 if token == _GAP else E.slot(token)
        return found


_SLOTS = _Slots()


def _vectors(lows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: the number of tokens of each, their slots one after another, and the lengths of the vectors."""
    n, slots = _together(lows) or _one_by_one(lows)
    keys, times = np.unique(np.repeat(np.arange(len(n)), n) * E.DIMENSIONS + slots, return_counts=True)
    return n, slots, np.sqrt(np.bincount(keys // E.DIMENSIONS, times * times, len(n)))


def _together(lows: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """The texts split at once, without a list for each; None where their characters forbid it."""
    split = E.splitter(lows)
    if split is E.tokens:
        return None
    found = split(f" {_GAP} ".join(lows))
    slots = np.fromiter(map(_SLOTS.__getitem__, found), np.int64, len(found))
    gaps = np.flatnonzero(slots < 0)
    if len(gaps) != len(lows) - 1:  # a text has such a token
        return None
    return np.diff(np.concatenate([[-1], gaps, [len(found)]])) - 1, slots[slots >= 0]


def _one_by_one(lows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [E.tokens(t) for t in lows]
    n = np.fromiter(map(len, found), np.int64, len(found))
    return n, np.fromiter(map(E.slot, chain.from_iterable(found)), np.int64, n.sum())


def _lowered(texts: list[str]) -> list[str]:
    """All lower-cased at once; what a letter becomes depends on no text but its own, as there is a space on either side."""
    every = f" {_GAP} ".join(texts)
    return every.lower().split(f" {_GAP} ") if every.count(_GAP) == len(texts) - 1 else [t.lower() for t in texts]


def _similarities(n: np.ndarray, slots: np.ndarray, length: np.ndarray, of: np.ndarray, aims: list[str]) -> np.ndarray:
    """Cosine of each text to the aim that ``of`` names, within [-1, 1]; NaN where either has no token."""
    aim_n, aim_slots, aim_length = _vectors(aims)
    keys, times = np.unique(np.repeat(np.arange(len(aims)), aim_n) * E.DIMENSIONS + aim_slots, return_counts=True)
    mine = np.repeat(np.arange(len(n)), n)
    wanted = of[mine] * E.DIMENSIONS + slots
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    met = np.where(keys[at] == wanted, times[at], 0) if len(keys) else np.zeros(len(wanted), np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(np.bincount(mine, met, len(n)) / (length * aim_length[of]), -1.0, 1.0)


def baseline(current: Column, target: Column, scale: int | None = None) -> Column:
    """Cosine of the hash vectors of two texts, a batch at once; null where either has no token."""

    def run(current: pa.Array, target: pa.Array) -> pa.Array:
        of, now, then = _sides(current, target)
        s = _at(_similarities(*_vectors([x or "" for x in now]), np.arange(len(now)), [x or "" for x in then]), scale)[of]
        return pa.array(s, pa.float64(), mask=np.isnan(s))

    return F.arrow_udf(run, "double")(F.make_valid_utf8(current), F.make_valid_utf8(target))


def _sides(current: pa.Array, target: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that candidates are held against, lower-cased, once for rows that lie side by side and have the same; and which of them each row has."""
    if not len(current):
        return np.zeros(0, np.int64), np.array([], object), np.array([], object)
    a, b = (np.asarray(x.dictionary_encode(null_encoding="encode").indices) for x in (current, target))
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    now, then = (np.array([x and x.lower() for x in E.strings(some.filter(pa.array(new)))], object) for some in (current, target))
    return np.cumsum(new) - 1, now, then


def _labels(operator: str, scale: int | None, limits: dict):
    """Of candidates, lower-cased and with their numbers of words, rows and similarities: what they gain, how far they are, and which of ``_REASONS`` they have."""
    influence = operator == "influence"
    names = {"copy": L.COPY_THRESHOLD, "margin": L.MARGIN} if influence else {"far": L.FAR, "near": L.NEAR}
    if unknown := set(limits) - set(names):
        raise TypeError(f"no such limits: {', '.join(sorted(unknown))}")
    bounds = tuple((names | limits).values())

    def label(lows: list[str], n: np.ndarray, row: np.ndarray, of: np.ndarray, now: np.ndarray, then: np.ndarray, s: np.ndarray, baseline: np.ndarray):
        none = np.full(len(s), np.nan)
        gain = _at(s - baseline[row], scale) if influence else none
        apart = none if influence else _at(1 - s, scale)
        # one number for each lower-cased text, those of candidates and of the texts they are held against together
        codes = np.asarray(pa.array(chain(lows, now, then), pa.string()).dictionary_encode(null_encoding="encode").indices, np.int64)
        mine, its_now, its_then = codes[: len(lows)], codes[len(lows) : len(lows) + len(now)][of], codes[len(lows) + len(now) :][of]
        false = np.zeros(len(s), bool)
        rules = [(n < L.MIN_WORDS) | (n > L.MAX_WORDS), mine == its_now]
        rules += [(then.astype(bool)[of] & (mine == its_then)) if influence else false, _repeated(row * (len(codes) + 1) + mine)]
        rules += [s >= bounds[0], ~(gain > bounds[1]), false, false] if influence else [false, false, s < bounds[0], s > bounds[1]]
        reason = np.full(len(s), len(rules))
        for k in range(len(rules) - 1, -1, -1):  # the first that holds decides
            reason[rules[k]] = k
        return gain, apart, reason

    return label


def _judge(operator: str, expected: int | None, scale: int | None, limits: dict):
    """Of a batch's rows: their candidates, the row and the ordinal of each, its numbers, and which of ``_REASONS`` it has."""
    label = _labels(operator, scale, limits)

    def judge(raw: pa.Array, current: pa.Array, target: pa.Array, baseline: pa.Array):
        found, row, ordinal = parse(raw, expected)
        side, now, then = _sides(current, target)
        of = side[row]
        lows = _lowered(E.strings(found))
        n, slots, length = _vectors(lows)
        s = _at(_similarities(n, slots, length, of, [x or "" for x in (then if operator == "influence" else now)]), scale)
        return found, row, ordinal, s, *label(lows, n, row, of, now, then, s, _floats(baseline))

    return judge


def _floats(x: pa.Array) -> np.ndarray:
    return np.asarray(x.cast(pa.float64()).to_numpy(zero_copy_only=False))


def _listed(rows: int, absent: np.ndarray, row: np.ndarray, values: pa.Array) -> pa.Array:
    """The values of each row as a list; null for an absent one."""
    ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(absent, False)), values)


def _entries(found: pa.Array, ordinal: np.ndarray, s: np.ndarray, gain: np.ndarray, apart: np.ndarray, reason: np.ndarray) -> pa.Array:
    columns = [pa.array(ordinal, pa.int32()), found, _number(s), _number(gain), _number(apart), pa.array(_REASONS, pa.string()).take(pa.array(reason)), pa.array(reason == _VALID)]
    return pa.StructArray.from_arrays(columns, list(_FIELDS))


def lines(raw: Column, expected: int | None = None) -> Column:
    """What ``text.parse_candidates`` gives, a batch at once; null where ``raw`` is."""

    def run(raw: pa.Array) -> pa.Array:
        found, row, _ = parse(raw, expected)
        return _listed(len(raw), ~np.asarray(raw.is_valid()), row, found)

    return F.arrow_udf(run, "array<string>")(F.make_valid_utf8(raw))


def by_vectors(operator: str, scale: int | None = None, **limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows scored by packed vectors, of their texts in the order of rows and ordinals (_ordinal, _text, _vector, _row).

    The text of ordinal 0 is that which a row's candidates are held against, and bears
    the row; what an Arrow batch has of its last row waits for the next batch.
    """
    label = _labels(operator, scale, limits)

    def score(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        ordinal = np.asarray(table["_ordinal"])
        own = ordinal == 0
        row, its, some = np.cumsum(own) - 1, np.flatnonzero(own), np.flatnonzero(~own)
        borne = _flat(table["_row"].take(pa.array(its)))
        columns = dict(zip((f.name for f in borne.type), borne.flatten()))
        s = _at(E.packed_cosines(_flat(table["_vector"]), its[row])[some], scale)
        found, row = _flat(table["_text"].take(pa.array(some))), row[some]
        side, now, then = _sides(_valid(columns["current"]), _valid(columns["target"]) if operator == "influence" else pa.nulls(len(its), pa.string()))
        lows = _lowered(E.strings(found))
        split = E.splitter(lows)
        n = np.fromiter((len(split(t)) for t in lows), np.int64, len(lows))
        gain, apart, reason = label(lows, n, row, side[row], now, then, s, _floats(columns["baseline"]))
        scored = _listed(len(its), ~np.asarray(columns.pop("_asked")), row, _entries(found, ordinal[some], s, gain, apart, reason))
        return pa.RecordBatch.from_arrays([*columns.values(), scored], [*columns, "scored"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(np.asarray(batch.column("_ordinal")) == 0)
            if len(begins):
                if waiting or begins[-1]:
                    yield score([*waiting, batch.slice(0, begins[-1])])
                waiting, batch = [], batch.slice(begins[-1])
            waiting.append(batch)
        if waiting:
            yield score(waiting)

    return run


def _flat(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _valid(texts: pa.Array) -> pa.Array:
    """Texts with a replacement for what is not UTF-8."""
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([x and x.decode(errors="replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
    return texts


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the numbers stand there more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.append(same, False) | np.append(False, same) if len(keys) else False
    return out


def _called(run, kind: str, operator: str) -> Column:
    raw = F.make_valid_utf8(F.col("raw"))
    # an answer without a character has no candidate, which is held against nothing
    text = lambda c: F.when(raw != "", F.make_valid_utf8(F.col(c)))
    target = text("target") if operator == "influence" else F.lit(None).cast("string")
    baseline = F.col("baseline") if operator == "influence" else F.lit(None).cast("double")
    return F.arrow_udf(run, kind)(raw, text("current"), target, baseline)


def _number(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=np.isnan(x))


def scored(operator: str, expected: int | None = None, scale: int | None = None, **limits) -> Column:
    """``scored`` of rows (raw, current, target, baseline); null where ``raw`` is."""
    judge = _judge(operator, expected, scale, limits)

    def run(raw: pa.Array, current: pa.Array, target: pa.Array, baseline: pa.Array) -> pa.Array:
        found, row, ordinal, s, gain, apart, reason = judge(raw, current, target, baseline)
        return _listed(len(raw), ~np.asarray(raw.is_valid()), row, _entries(found, ordinal, s, gain, apart, reason))

    return _called(run, SCORED, operator)


def result(operator: str, expected: int | None = None, scale: int | None = None, **limits) -> Column:
    """Of the same rows what ``scoring`` counts in ``scored`` and chooses from it, without the array: the numbers of candidates and of valid ones, and the best of these."""
    judge = _judge(operator, expected, scale, limits)

    def run(raw: pa.Array, current: pa.Array, target: pa.Array, baseline: pa.Array) -> pa.Array:
        found, row, ordinal, s, gain, _, reason = judge(raw, current, target, baseline)
        good = np.flatnonzero(reason == _VALID)
        # by row, then the highest similarity, null last, then the earliest
        good = good[np.lexsort((ordinal[good], -np.where(np.isnan(s[good]), -np.inf, s[good]), row[good]))]
        good = good[np.append(True, row[good][1:] != row[good][:-1])] if len(good) else good
        at = np.full(len(raw), -1)
        at[row[good]] = good
        none = at < 0
        pick = pa.array(at, pa.int64(), mask=none)
        best = [_number(s).take(pick), found.take(pick), _number(gain).take(pick), pa.array(ordinal, pa.int32()).take(pick)]
        best = pa.StructArray.from_arrays(best, ["similarity", "candidate", "improvement", "ordinal"], mask=pa.array(none))
        counts = [pa.array(np.bincount(some, minlength=len(raw)), pa.int64()) for some in (row, row[reason == _VALID])]
        return pa.StructArray.from_arrays([*counts, best], ["candidate_count", "valid_count", "best"])

    return _called(run, RESULT, operator)
