"""What is run again neither loses nor doubles anything."""

import os
import time

import pytest
from pyspark.sql import functions as F

from semspark.operators import embedding as E
from semspark.plans import evaluate as EV
from semspark.sources import payloads, population, sinks
from semspark.streaming import completions as S

RUNS = "job_id long, run_number long, raw string, error string"


def texts(spark, *some):
    return spark.createDataFrame([(t,) for t in some], "text string")


def cache_rows(spark, path):
    return sorted((r.text, r.epoch) for r in E.cached(spark, path, "hash").collect())


def test_a_batch_that_is_run_again_leaves_the_same_vectors(spark):
    path = sinks.shared_path(spark, "cache")
    run = S.embedded("text", path)
    for epoch, some, want in ((0, ("a", "b", "a", None), [("a", "0"), ("b", "0")]), (1, ("b", "c"), [("a", "0"), ("b", "0"), ("c", "1")])):
        for _ in range(2):
            run(texts(spark, *some), epoch)
            assert cache_rows(spark, path) == want
    run(texts(spark, "a", "b"), 0)  # and so does an earlier one
    assert cache_rows(spark, path) == [("a", "0"), ("b", "0"), ("c", "1")]


def test_a_stream_that_dies_between_write_and_commit_loses_no_vector(spark):
    arrivals, path = sinks.shared_path(spark, "arrivals"), sinks.shared_path(spark, "cache")
    died = []

    def dies_once(batch, epoch):
        S.embedded("text", path)(batch, epoch)
        if not died:
            died.append(epoch)
            raise RuntimeError("after the write, before the commit")

    for k, some in enumerate((("a", "b"), ("b", "c"))):
        texts(spark, *some).write.mode("append").parquet(arrivals)
        stream = lambda: spark.readStream.schema("text string").parquet(arrivals).writeStream.foreachBatch(dies_once)
        if not k:
            with pytest.raises(Exception, match="before the commit"):
                S.finished(stream(), path)
        S.finished(stream(), path)
    assert [t for t, _ in cache_rows(spark, path)] == ["a", "b", "c"]


def test_completions_go_on_where_they_stopped(spark, tmp_path):
    calls, once = tmp_path / "calls", tmp_path / "died"

    def responder(prompt):
        with open(calls, "a") as f:
            f.write(prompt + "\n")
        if prompt == "p70" and not once.exists():
            once.touch()
            time.sleep(3)  # the other shards are done by then
            os._exit(1)
        return prompt.upper()

    path = sinks.shared_path(spark, "answers")
    prompts = spark.createDataFrame([(k, 1, f"p{k}") for k in range(100)], "job_id long, run_number long, prompt string")
    with pytest.raises(Exception):  # noqa: B017  a worker's death fails the job
        payloads.completions_batch(prompts, responder, path, 10)
    done = {r.job_id for r in spark.read.schema(payloads.COMPLETIONS).parquet(path).collect()}
    assert 50 <= len(done) < 100
    got = {r.job_id: r.raw for r in payloads.completions_batch(prompts, responder, path, 10).collect()}
    assert got == {k: f"P{k}" for k in range(100)}
    asked = calls.read_text().split()
    assert all(asked.count(f"p{k}") == 1 for k in done) and len(asked) <= 100 + 30
    assert payloads.completions_batch(prompts, responder, path, 10).count() == 100 and calls.read_text().split() == asked


def test_results_written_twice_read_back_once(spark):
    path = sinks.shared_path(spark, "results")
    make = lambda *rows: spark.createDataFrame(list(rows), "job_id long, n long")
    for _ in range(2):
        sinks.sink_results({"candidates": make((1, 1), (1, 2), (2, 3)), "run_results": make((1, 9))}, path)
    sinks.sink_results({"candidates": make((2, 4), (2, 5))}, path)  # replaces that job, and no other
    read = lambda name: sorted((r.job_id, r.n) for r in sinks.read_results(spark, path, name).collect())
    assert read("candidates") == [(1, 1), (1, 2), (2, 4), (2, 5)] and read("run_results") == [(1, 9)]
    assert sorted((r["name"], r.part, r.n_rows) for r in sinks.manifest(spark, path).collect()) == [("candidates", "1", 2), ("candidates", "2", 2), ("run_results", "1", 1)]
    make((3, 7)).write.mode("append").partitionBy("job_id").parquet(f"{path}/candidates")  # written, but never noted as complete
    assert read("candidates") == [(1, 1), (1, 2), (2, 4), (2, 5)]
    with pytest.raises(ValueError):
        sinks.sink_results({"other": make((1, 1))}, path)


def test_state_of_deduplication_is_bounded(spark):
    arrivals, path = sinks.shared_path(spark, "arrivals"), sinks.shared_path(spark, "once")
    kept = []
    for k in range(6):  # an hour apart; each run twice, in one batch or in two
        rows = [(k, n, "x", None, 3600 * (k + 1) + n) for n in range(20)] * 2 + [(k - 1, 19, "again", None, 3600 * (k + 1) + 19)] * (k > 0)
        spark.createDataFrame(rows, f"{RUNS}, at long").select("*", F.timestamp_seconds("at").alias("arrived")).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(f"{RUNS}, at long, arrived timestamp").parquet(arrivals)
        query = S.deduplicated(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(kept) <= 2 * 21 + 2
    once = spark.read.parquet(path).where("raw = 'x'").groupBy("job_id", "run_number").count()
    assert once.count() == 120 and once.where("count > 1").count() == 0


def test_running_summary_equals_the_batch_after_every_batch(spark):
    jobs = EV.baseline(spark.createDataFrame([(1, "a b c", "d e f"), (2, "a b", "c d")], "job_id long, current string, target string"), 9)
    runs = [(1, 1, "d b c\nd e c", None), (2, 1, "x y", None), (1, 2, "d e c x\nd e c", None), (2, 2, None, "timeout"), (1, 3, "", None), (2, 3, "c b x", None)]
    arrivals, path = sinks.shared_path(spark, "arrivals"), sinks.shared_path(spark, "summary")
    for number in (1, 2, 3):
        spark.createDataFrame([r for r in runs if r[1] == number], RUNS).write.mode("append").parquet(arrivals)
        rows = S.evaluation(spark.readStream.schema(RUNS).parquet(arrivals), jobs, None, 9)
        S.finished(rows.writeStream.outputMode("update").foreachBatch(S.by_epoch(path)), path)
        so_far = EV.run_result(EV.scored(spark.createDataFrame([r for r in runs if r[1] <= number], RUNS), jobs, None, 9))
        want = {r.job_id: r.asDict() for r in EV.evaluation_summary(so_far, "job_id").collect()}
        got = {r.job_id: r.asDict() for r in S.latest(spark.read.parquet(path), "job_id").collect()}
        assert {j: {c: r[c] for c in want[j]} for j, r in got.items()} == want
    assert got[1]["best"] == "d e c" and got[1]["best_run"] == 1  # of equals the first run's


def test_quarantine_parts_a_population(spark):
    part = "struct<rol: string, topico: string, accion: string>"
    good = ("i1", "a", "b", "c", ("a", "b", "c"), ("d", "e", "f"))
    rows = [(0, *good), (1, "i2", "a", " ", None, ("a", "b", "c"), None), (2, None, *good[1:]), (3, "i4", "a", "b", "c", ("a", None, "c"), ("d", "e", "f"))]
    df = spark.createDataFrame(rows, f"position long, id string, rol string, topico string, accion string, pbest {part}, lider {part}")
    valid, rejected = population.population_quarantine(df, sinks.shared_path(spark, "parted"))
    assert [r.position for r in valid.collect()] == [0] and valid.columns == df.columns
    assert sorted((r.file_position, r.bad_field) for r in rejected.collect()) == [(2, "topico"), (3, "id"), (4, "pbest.topico")]
