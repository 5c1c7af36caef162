"""Scores by the vectors of a model: they move once, packed, and are those of the whole vectors."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semspark.operators import embedding as E
from semspark.operators import movement as M
from semspark.sources import sinks


def vectors_of(rng, n, size):
    return [None if k % 7 == 3 else [rng.choice((0.0, 0.0, rng.random() - 0.5, -0.0)) for _ in range(size)] for k in range(n)]


def test_packed_cosines_are_those_of_the_vectors():
    rng = random.Random(4)
    some = vectors_of(rng, 40, 12)
    norms = np.array([np.nan if v is None else np.linalg.norm(v) for v in some])
    packed = E.pack(pa.array(some, pa.list_(pa.float64())), norms)
    of = np.array([k - k % 5 for k in range(40)])
    want = [np.nan if some[k] is None or some[of[k]] is None else np.dot(some[k], some[of[k]]) / norms[k] / norms[of[k]] for k in range(40)]
    for table, at in ((packed, slice(None)), (pa.concat_arrays([packed.slice(0, 5), packed]).slice(5), slice(None))):
        assert np.allclose(E.packed_cosines(table, of)[at], want, equal_nan=True)
    assert len(E.packed_cosines(packed.slice(0, 0), of[:0])) == 0 and np.isnan(E.packed_cosines(pa.nulls(2, pa.binary()), np.array([0, 0]))).all()
    mixed = E.pack(pa.array([[1.0, 0.0], [1.0]], pa.list_(pa.float64())), np.array([1.0, 1.0]))
    with pytest.raises(ValueError, match="differ in length"):
        E.packed_cosines(mixed, np.array([0, 0]))
    with pytest.raises(ValueError, match="no cosine"):
        E.packed_cosines(E.pack(pa.array([[1.0], [0.0]], pa.list_(pa.float64())), np.array([1.0, 0.0])), np.array([0, 0]))


def _answered(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(k, "x", words(4), rng.choice(["a b c d", words(4), None]), rng.choice([None, "", "\n".join(words(rng.randint(1, 9)) for _ in range(rng.randint(1, 12)))])) for k in range(60)]
    return spark.createDataFrame(rows, "number long, individual_id string, current string, target string, raw string")


@pytest.mark.parametrize("operator", ["influence", "turbulence"])
@pytest.mark.parametrize("most", ["3", "10000"])
def test_rows_that_come_in_several_batches_are_scored_whole(spark, operator, most):
    rows = _answered(spark).withColumn("operator", F.lit(operator))
    path = sinks.shared_path(spark, "vectors")
    texts = E.text_set((rows.select(F.explode(F.split("raw", "\n")).alias("t")), "t"), (rows, "current"), (rows, "target"))
    E.cache_add(texts, path, "m", "1", lambda t: E.encode(t, E.hash_model, name="m", packed=True), packed=True)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        a, b = ({r.number: str(r) for r in M.score(rows, operator, 9, 9, v).collect()} for v in (None, E.cached(spark, path, "m", packed=True)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert a == b and len(a) == 60


def test_vectors_move_once_and_packed(spark):
    rows = _answered(spark).withColumn("operator", F.lit("influence"))
    vectors = E.encode(spark.createDataFrame([("a b",)], "text string"), E.hash_model, name="m")
    vectors.write.parquet(path := sinks.shared_path(spark, "vectors"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.score(rows, "influence", 9, 9, spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(re.findall("SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3  # texts, vectors, and both by row
    assert "ArrowEvalPython" in plan.split("Exchange hashpartitioning")[-1]  # packed before they are dealt out


def test_a_packed_cache_holds_texts_and_vectors_and_is_not_added_to_twice(spark):
    path = sinks.shared_path(spark, "cache")
    add = lambda epoch, *some: E.cache_add(spark.createDataFrame([(t,) for t in some], "text string"), path, "m", epoch, lambda t: E.encode(t, E.hash_model, name="m", packed=True), packed=True)
    for epoch, some in (("0", ("a", "b", "a", "")), ("1", ("b", "c")), ("0", ("a", "b"))):
        add(epoch, *some)
    rows = E.cached(spark, path, "m", packed=True)
    assert sorted((r.text, r.epoch) for r in rows.collect()) == [("a", "0"), ("b", "0"), ("c", "1")]
    assert spark.read.parquet(f"{path}/model_id=m/epoch=1").columns == ["text", "vector"]
