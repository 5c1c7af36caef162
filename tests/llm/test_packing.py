"""Packing: pieces against the library, and plans against what any packing must hold to."""

import random
import zlib

import numpy as np
import pytest

from semspark.llm import packing

SCHEMA = "doc_id long, text string, length string, piece int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.VOCABULARY)


def awkward(seed=4):
    rng = random.Random(seed)
    vocabulary = ["the", "Straße", "don't", "DON'T", "漢字かな", "<|endoftext|>", "<|startoftext|>x", "a<b", "1,5", "Σας", "é", "́x", "a b", "c　d", "ไทย", "x\x1cy", "\U0001f469‍\U0001f469", "ﬁn", "İ", "q\x00r"]
    make = lambda n: rng.choice([" ", "\n", " \t", "\x0b", "\x0c "]).join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \n\t", "one", "x" * 4000, make(3000), "<|endoftext|>", "<" * 50] + [make(rng.randint(1, 400)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "no id"), (5, "again"), (5, "again"), (3, "one")]
    return [(i, t, "clash", 7) for i, t in rows]


def wanted(rows, library, size):
    out = []
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            out.append((i, k // size, k, len(ids[k : k + size]), zlib.crc32(np.array(ids[k : k + size], "<u4").tobytes())))
    return sorted(out, key=str)


def check_sequences(rows, size):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


@pytest.mark.parametrize(("size", "block_rows"), [(2048, 1 << 16), (100, 5)])
def test_packed(spark, library, size, block_rows):
    rows = awkward()
    got = packing.packed(spark.createDataFrame(rows, SCHEMA).repartition(3), size=size, block_rows=block_rows).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == wanted(rows, library, size)
    many = check_sequences(got, size)
    assert many <= 1.05 * sum(r.length for r in got) / size + 1


def test_sequences_hold_the_ids(spark, library):
    rows = [r for r in awkward() if r[0] is not None][:20]
    packed = packing.packed(spark.createDataFrame(rows, SCHEMA), size=64, keep_ids=True)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        ids = np.frombuffer(bytes(whole[r.sequence_id].ids), "<u4")[r.offset : r.offset + r.length]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32 and r.doc_id in whole[r.sequence_id]["keys"]
    assert all(len(w.ids) <= 4 * 64 for w in whole.values())


def test_no_rows(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_are_forgotten_when_there_are_many(library, monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 5)
    coder = packing.Coder(packing.VOCABULARY, 0)
    for t in ("a b c d e f g", "h a <|endoftext|> b", "", "c d e f g h i j k"):
        ids, first = coder.ids([t.encode(), t.encode()])
        assert first.tolist() == [0, len(ids) // 2, len(ids)] and ids[: first[1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 0]


RNG = np.random.default_rng(3)
LENGTHS = {
    "documents": np.clip(RNG.lognormal(6, 1, 30_000).astype(int) + 1, 1, 2048), "even": RNG.integers(1, 2049, 20_000), "alike": RNG.normal(700, 20, 3000).astype(int), "long": RNG.integers(1100, 2049, 500),
    "hot": np.r_[np.full(9000, 683), RNG.integers(1, 2049, 18_000)], "ends": np.ones(10_000, int), "few": np.array([2048, 2048, 1, 5, 2043, 700, 700]), "none": np.zeros(0, int),
}


@pytest.mark.parametrize("name", LENGTHS)
def test_plan(name):
    lengths = LENGTHS[name]
    counts = np.bincount(lengths, minlength=2049)
    where = packing.plan(counts)
    length = np.sort(lengths)
    rank = np.arange(len(length)) - np.searchsorted(length, length)
    if len(length):
        k = np.searchsorted((where["length"] << 48) + where["first"], (length << 48) + rank, "right") - 1
        nth = rank - where["first"][k]
        sequence, offset = where["base"][k] + nth // where["times"][k], where["offset"][k] + nth % where["times"][k] * length
        order = np.lexsort((offset, sequence))
        s, at, n = sequence[order], offset[order], length[order]
        new = np.append(True, s[1:] != s[:-1])
        assert (where["length"][k] == length).all() and (at[new] == 0).all() and (at[1:][~new[1:]] == (at + n)[:-1][~new[1:]]).all() and (at + n <= 2048).all()
        assert len(np.unique(sequence)) == where["sequences"]
    plain = sum(n for n, _ in packing.best_fit(counts))
    assert where["sequences"] <= 1.015 * plain + 1
    assert len(where["length"]) <= 3 * 4 * (packing.PATTERNS + 1024) + 64 * 3 * 2048


def test_fit_matches_a_histogram_that_patterns_can_make():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 50, 30, 20]] = 30, 30, 20, 10, 10
    some = packing.patterns(counts)
    x = packing.fitted(some, counts)
    filled = np.bincount(some.ravel(), np.repeat(x, 3), 101)
    assert np.abs(filled[1:] - counts[1:]).max() < 0.5 and (x >= 0).all()
