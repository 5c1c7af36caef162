"""Counting, scoring and running values inside rows and blocks, against plain loops."""

import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from semspark.operators import embedding as E
from semspark.operators import labels as L
from semspark.operators import movement as M
from semspark.operators import ranking as R
from semspark.operators import scoring as S
from semspark.plans import evaluate as EV


def test_copies_of_a_long_completion_take_linear_time(spark):
    rng = random.Random(1)
    lines = [f"line {rng.randrange(30_000)}" for _ in range(100_000)]
    runs = spark.createDataFrame([(1, 1, "\n".join(lines)), (1, 2, "A\na\nb"), (1, 3, ""), (1, 4, None)], "job_id long, run_number long, raw string")
    EV.run_candidates(runs.where("run_number > 1")).collect()
    began = time.time()
    some = EV.run_candidates(runs).groupBy("run_number").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.max("ordinal").alias("last")).collect()
    assert time.time() - began < 5
    counts = {}
    for x in lines:
        counts[x] = counts.get(x, 0) + 1
    assert sorted(map(tuple, some)) == [(1, 100_000, sum(n * n for n in counts.values()), 100_000), (2, 3, 5, 3)]


def test_copies_keep_the_order(spark):
    rows = [(k, some) for k, some in enumerate([["b", "A", "a", "B", "c", "a"], [], ["x"], None])]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k int, cs array<string>").select("k", L.counted(F.col("cs")).alias("c")).collect()}
    assert [(e.ordinal, e.candidate, e.copies) for e in got[0]] == [(1, "b", 2), (2, "A", 3), (3, "a", 3), (4, "B", 2), (5, "c", 1), (6, "a", 3)]
    assert got[1] == [] and [e.copies for e in got[2]] == [1] and got[3] is None


def test_vectors_in_the_row_equal_the_model(spark):
    rng = random.Random(2)
    some = ["a", "a a b", "Ünï cödé a", "x " * 3000, *(" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(1, 200))) for _ in range(20)), "", " \n"]
    texts = spark.createDataFrame([(t,) for t in some], "text string")
    mine = {r.text: r.embedding for r in E.hash_encode(texts).collect()}
    for parts, most in ((1, 1 << 20), (16, 10)):
        model = {r.text: r.embedding for r in E.encode(texts.repartition(parts), E.hash_model, name=f"m{parts}", batch_bytes=most).collect()}
        assert set(model) == set(mine) == {t for t in some if t.strip()}
        assert all(abs(x - y) < 1e-12 for t in mine for x, y in zip(mine[t], model[t]))


def test_batches_are_bounded_in_bytes_and_texts():
    texts = ["aa", "b" * 10, "", "c", "é" * 3, "d"]
    got = list(E.bounded(texts, 7, 3))
    assert [k for a, b in got for k in range(a, b)] == list(range(6))
    assert all(b - a <= 3 and (b - a == 1 or sum(len(t.encode()) for t in texts[a:b]) <= 7) for a, b in got) and not list(E.bounded([], 5, 5))


def test_scores_by_model_equal_scores_in_the_row(spark):
    rows = spark.createDataFrame([(1, "a b c", "d e f", "d b c\nd e c\nA B C\nd e f\nq"), (2, "a b", "c d", ""), (3, "a b", "c d", "c b")], "number long, current string, target string, raw string").withColumn("operator", F.lit("influence"))
    texts = E.text_set((S.exploded(S.parsed(rows), "candidates"), "candidate"), (rows, "target"))
    vectors = E.encode(E.text_dedupe(texts), E.hash_model, name="model")
    a, b = (sorted(map(str, M.movement_candidates(M.score(rows, "influence", None, 9, v)).collect())) for v in (None, vectors))
    assert a == b and len(a) == 6


def test_no_text_is_a_key_of_an_exchange(spark, monkeypatch):
    spark.range(1000).select(F.concat(F.lit("text "), F.col("id") % 50).alias("text")).write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/texts")
    texts = spark.read.parquet(path)
    vectors = E.hash_encode(E.text_dedupe(texts))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (E.text_dedupe(texts), E.cache_miss(texts, vectors.limit(20)), E.attach(texts, vectors, "text", "text")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            keys = [line for line in plan.splitlines() if "hashpartitioning" in line]
            assert keys and not any("text#" in line.split("hashpartitioning")[1].split(")")[0] for line in keys), plan
        assert E.attach(texts, vectors, "text", "text").where("text_vec IS NULL").count() == 0
        assert E.cache_miss(E.text_dedupe(texts), vectors).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_running_values_equal_the_window(spark):
    rng = random.Random(3)
    rows = [(g, n, rng.choice([None, rng.random()]), 1) for g in (1, 2, 3) for n in rng.sample(range(5000 * g), 300)]
    df = spark.createDataFrame(rows, "g long, n long, x double, one long")
    upto = Window.partitionBy("g").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("g", "n", F.sum("one").over(upto).alias("one"), F.round(F.sum("x").over(upto), 9).alias("s"), F.max("x").over(upto).alias("m"))
    for block in (4, 64, 1 << 20):
        got = R.carried(df.withColumn("m", F.col("x")), ("g",), "n", {"one": "sum", "x": "sum", "m": "max"}, block).select("g", "n", "one", F.round("x", 9).alias("s"), "m")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 2 == 0).alias("applied"), (F.col("id") % 3).alias("stage"), (F.col("id") % 20_011).cast("string").alias("individual_id"))
    sketches = M.affected_sketch(rows, "stage")
    exact = rows.where("applied").agg(F.countDistinct("individual_id")).first()[0]
    assert abs(M.merged_sketch(sketches).first()[0] - exact) <= 0.02 * exact
    assert all(abs(r.affected_about - r.affected) <= 0.02 * r.affected for r in M.merged_sketch(sketches, "stage").join(sketches.select("stage", "affected"), "stage").collect())
