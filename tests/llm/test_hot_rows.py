"""What very many rows or items share: it goes on once from each task, and its lists are joined late."""

import hashlib
import random

import pytest

from semspark.llm import common as C
from semspark.llm import decontaminate, shingles


def test_repeats_go_on_once_from_each_task(spark):
    rows = [(i % 3 if i % 5 else None, i % 2, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, text string").repartition(4)
    got = C.once_a_task(df, ["a", "b"]).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a, b, _ in rows} and len(got) <= 4 * 8
    assert C.once_a_task(df.where("a > 9"), ["a", "b"]).count() == 0


def test_a_row_in_a_third_of_the_table(spark):
    rng = random.Random(4)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    hot, near = make(60), None
    near = hot.rsplit(" ", 1)[0] + " end"
    rows = [(1, hot, "x", 1)] * 60 + [(1, hot, "y", 2)] * 40 + [(2, near, "x", 1)] + [(i, make(40), "x", 1) for i in range(3, 103)] + [(None, hot, "x", 1)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string, `order` int").repartition(6)
    got = {(r.doc_id, r.n_links, r.class_id) for r in shingles.joined(df).collect() if r.doc_id is not None}
    assert {x for x in got if x[0] < 3} == {(1, 100, 1), (2, 100, 1)} and all(x[1:] == (0, x[0]) for x in got if x[0] > 2)
    kept = shingles.one_of_each(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and sorted(i for i in ids if i is not None) == [1, *range(3, 103)] and ids.count(None) == 5


@pytest.mark.parametrize("block_words", [10**6, 60])
def test_a_pattern_that_most_items_share(spark, block_words):
    rng = random.Random(6)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, own = make(10), [make(12) for _ in range(5)]
    items = [(f"i{k}", f"{shared} {own[k % 5]}") for k in range(40)] + [(None, shared), (None, make(10)), ("i0", shared), ("z", own[0])]
    texts = [shared, f"{make(5)} {shared} {make(5)}", own[0], f"{own[1]} {own[2]}", make(50), None, items[41][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(docs, spark.createDataFrame(items, "item_id string, text string"), block_words=block_words).collect()}
    of = lambda names: (len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    every = [f"i{k}" for k in range(40)]
    nth = lambda *ks: [f"i{k}" for k in range(40) if k % 5 in ks]
    want = {0: (10, *of(every)), 1: (10, *of(every)), 2: (12, *of([*nth(0), "z"])), 3: (24, *of(nth(1, 2))), 4: (0, *of([])), 5: (0, *of([])), 6: (10, *of([]))}
    assert got == want


def test_blocks_hold_what_they_may(spark):
    rng = random.Random(8)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = spark.createDataFrame([(str(k), make(30)) for k in range(10)] + [("short", "one two")], "item_id string, text string")
    blocks, named = decontaminate.pattern_blocks(items, block_words=300)
    sizes = [sum(t["n"] * len(t["bytes"]) for t in b.tables) for b in blocks]
    assert sum(sizes) == 10 * 21 * 10 + 2 and max(sizes) <= 300 and len(sizes) < 16 and named.count() == 11
