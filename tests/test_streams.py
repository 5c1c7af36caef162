"""Streams whose summaries add up what is kept by epoch: no state, and after every batch the same as the batch query."""

import os

import pytest
from pyspark.sql import functions as F

from semspark.functions import text as X
from semspark.operators import embedding as E
from semspark.operators import rows as W
from semspark.plans import evaluate as EV
from semspark.plans import fixtures as FX
from semspark.plans import queries as Q
from semspark.sources import sinks
from semspark.streaming import completions as S
from semspark.streaming import queries as SQ

SF = "/root/testdata/sf0.001"
RUNS = "job_id long, run_number long, raw string, error string"


def test_summaries_add_up_after_every_batch(spark):
    jobs = EV.baseline(spark.createDataFrame([(1, "a b c", "d e f"), (2, "a b", "c d"), (3, "a b c", "d e f")], "job_id long, current string, target string"), 9)
    batches = [
        [(1, 2, "d e c x\nd e c", None), (1, 1, "d b c\nd e c", None), (2, 1, "x y", None)],  # two runs of one job
        [(2, 2, None, "timeout"), (3, 1, None, "timeout")],
        [(1, 3, "", None), (2, 3, "c b x", None)],
    ]
    arrivals, path = sinks.shared_path(spark, "arrivals"), sinks.shared_path(spark, "added")
    for k, some in enumerate(batches):
        spark.createDataFrame(some, RUNS).write.mode("append").parquet(arrivals)
        rows = S.additions(spark.readStream.schema(RUNS).parquet(arrivals), jobs, None, 9)

        def twice(batch, epoch):
            S.by_epoch(path)(batch, epoch)
            S.by_epoch(path)(batch, epoch)  # as after a failure

        S.finished(rows.writeStream.outputMode("append").foreachBatch(twice), path)
        so_far = spark.createDataFrame([r for b in batches[: k + 1] for r in b], RUNS)
        want = {r.job_id: r.asDict() for r in EV.evaluation_summary(EV.results(so_far, jobs, None, 9), "job_id").collect()}
        kept = spark.read.parquet(path)
        got = {r.job_id: r.asDict() for r in S.totals(kept).collect()}
        assert {j: {c: r[c] for c in want[j]} for j, r in got.items()} == want
        last = {r.job_id: r for r in S.running(kept).where(F.col("epoch") == k).collect()}
        assert set(last) == {r[0] for r in some}
        for j, r in last.items():
            assert (r.runs, r.completed, r.success_rate, r.mean_best_similarity, r.best_similarity) == (*(want[j][c] for c in ("runs", "completed", "success_rate", "mean_best_similarity")), got[j]["best_similarity"])
    assert (got[1]["best"], got[1]["best_run"]) == ("d e c", 1)  # of equals the first run's, whatever came first
    assert S.running(spark.read.parquet(path)).count() == 6


@pytest.mark.parametrize("name", ["stream_evaluation", "stream_cumulative"])
def test_evaluation_streams_keep_no_state_and_write_arrivals_once(spark, monkeypatch, name):
    paths = {}
    monkeypatch.setattr(SQ, "shared_path", lambda spark, what, real=SQ.shared_path: paths.setdefault(what, real(spark, what)))
    rows = Q.QUERIES[name](spark, SF).count()
    assert set(paths) == {"arrivals", "evaluated"}
    folder = f"{paths['evaluated'].removeprefix('file:')}-progress"
    assert os.path.isdir(f"{folder}/commits") and not os.path.exists(f"{folder}/state")
    assert spark.read.parquet(paths["arrivals"]).groupBy("run_number").count().count() == FX.RUNS
    assert spark.read.parquet(paths["arrivals"]).count() == (rows if name == "stream_cumulative" else rows * FX.RUNS)


ODD = ["a b", "", " ", "\0", "x \0", "\0 y", " \0 ", "ΑΣ", "ΑΣ Σ", "İ x", "a\x1cb", "a\x85b", "a﻿b", "A  A b"]


@pytest.mark.parametrize("some", [ODD, ODD[:3], ODD[7:10], [], ["\0"], ["x \0", "b"]])
def test_texts_that_are_worked_on_together_are_as_each_alone(some):
    assert W._lowered(some) == [t.lower() for t in some] if some else W._lowered(some) in ([], [""])
    n, slots, length = W._vectors(some)
    alone = [E.slots(t) for t in some]
    assert n.tolist() == [len(s) for s, _ in alone] and slots.tolist() == [x for s, _ in alone for x in s]
    assert length.tolist() == [x for _, x in alone]


def test_upper_case_is_that_of_columns(spark):
    some = ["abc Xyz", "ñandú é ß", "δελτα", ""]
    got = spark.createDataFrame([(t,) for t in some], "t string").select("t", X.ascii_upper(F.col("t")).alias("u")).collect()
    assert all(FX._upper(r.t) == r.u for r in got)


def test_no_passage_is_dealt_out_by_its_language(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FX.individuals(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("hashpartitioning(lang#") == 1  # that of the leaders, of which there is one a language
