"""Hard negatives against every anchor with every row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from semspark.llm import negatives

SCHEMA = "vec_id long, label long, embedding array<float>, rank int, score string"


def quantised(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


def brute(rows, anchor=lambda i: i % 10 == 0, most=5):
    fit = {(i, lab, tuple(quantised(v))) for i, lab, v, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, lab, q in fit:
        if not anchor(i):
            continue
        others = [(-sum(a * b for a, b in zip(q, p)), j, other) for j, other, p in fit if j != i and len(p) == len(q)]
        for s, j, _ in sorted(x[:2] + (0,) for x in others if x[2] == lab)[:most]:
            inside = sorted((n, k) for n, k, other in others if other != lab and 80 * -s <= 100 * -n <= 100 * -s)[:most]
            out += [(i, j, rank, k, -s, -n) for rank, (n, k) in enumerate(inside, 1)]
    return sorted(out)


def awkward(seed=1, n=120, labels=4, dim=8):
    rng = random.Random(seed)
    make = lambda d=dim: [rng.gauss(0, 1) for _ in range(d)]
    rows = [(i, rng.randrange(labels), make()) for i in range(n)]
    hot = make()
    rows += [(200 + i, rng.randrange(labels), hot) for i in range(60)]  # ties: a third of all rows are equal
    rows += [(300, 0, [0.0] * dim), (310, 1, None), (320, None, make()), (None, 1, make()), (330, 1, [1.0, None] + [0.5] * 6), (340, 1, [float("nan")] * dim), (350, 2, [float("inf")] * dim), (360, 0, []), (370, 9, make())]
    rows += [(380, 1, make(3)), (381, 1, make(3)), (382, 2, make(3)), rows[10], rows[10], (rows[20][0], 3, make())]
    return [(*r, 7, "clash") for r in rows]


@pytest.mark.parametrize("block_rows", [8192, 17])
def test_hard_negatives(spark, block_rows):
    rows = awkward()
    df = negatives.prepared(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 10 == 0, block_rows=block_rows).collect())
    assert got == brute(rows)


def test_no_rows_and_no_anchors(spark):
    none = negatives.prepared(spark.createDataFrame([], SCHEMA))
    assert negatives.hard_negatives(none, F.col("id") % 10 == 0).count() == 0
    some = negatives.prepared(spark.createDataFrame([(1, 0, [1.0], 7, ""), (2, 1, [1.0], 7, "")], SCHEMA))
    assert negatives.hard_negatives(some, F.col("id") % 10 == 0).count() == 0


@pytest.mark.parametrize("dim", [0, 1, 5, 8, 64])
def test_threshold_join_finds_all_pairs(dim):
    rng = np.random.default_rng(dim)
    x, y = rng.integers(-60, 60, (40, dim)).astype(float), rng.integers(-60, 60, (300, dim)).astype(float)
    y[:100] *= rng.random(dim) < 0.2  # sparse rows
    full = x @ y.T
    for part in (-np.inf, 0.0, 0.3, 0.7, 1.1):
        threshold = np.where(np.arange(40) % 3 == 0, part * 1.5, part) * max(1.0, full.max(initial=0))
        i, j, s = negatives.reaching(x, y, threshold)
        assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(full >= threshold[:, None] - 0.5))) and (full[i, j] == s).all()


def test_large_components_are_left_out(spark):
    rows = [(0, 0, [3e6, 0.0], 7, ""), (1, 0, [1.0, 0.0], 7, ""), (2, 0, [1e300, 1.0], 7, ""), (3, 1, [1.0, 0.0], 7, "")]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    assert {r.id for r in negatives.prepared(df).collect()} == {1, 3}
