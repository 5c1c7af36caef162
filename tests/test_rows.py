"""The scoring of a row in one step, against the columns; what is written once; documents that meet, not passages."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semspark.functions import text as X
from semspark.operators import embedding as E
from semspark.operators import scoring as S
from semspark.plans import evaluate as EV
from semspark.plans import fixtures as FX

ANSWERS = [
    None, "", " ﻿\n", "uno dos\nUNO DOS\ntres cuatro\r\n- \"cinco seis\"", "1) <a b c>\n- 'a b'\nCandidate 3: d e\ncandidate:  x y z", "```text\na b\nc d\n```", "``a b``\n```\n<c d>\n>e f<", "İ Σ\néÉ x\n١) a b",
    "10] - k l\n* m n\n-- o p\nCANDIDATE 2. q r\ncandidatı s t", "a\x1cb c\na\x85b c\na​b c", "\"'`\n<\n>\n<>\n- \n3)", "a b c d e f g h i\na b c d e f g h\na b", "a b\n" * 40 + "c d",
]


@pytest.mark.parametrize("expected", [None, 3])
@pytest.mark.parametrize("operator", ["influence", "turbulence"])
def test_a_row_in_one_step_equals_the_columns(spark, operator, expected):
    sides = [("a b", "c d"), ("UNO dos", None), ("", "x y z"), (None, "tres CUATRO")]
    rows = spark.createDataFrame([(i, r, c, t) for i, (r, (c, t)) in enumerate((r, s) for r in ANSWERS for s in sides)], "number long, raw string, current string, target string")
    rows = S.baseline(rows, 9)
    parsed = S.hash_similarities(S.parsed(rows, expected), "target" if operator == "influence" else "current", 9)
    want = (S.influence_scored if operator == "influence" else S.turbulence_scored)(parsed, 9)
    got = S.hash_scored(rows, operator, expected, 9)
    a, b = ({r.number: r.scored and [tuple(e) for e in r.scored] for r in df.select("number", "scored").collect()} for df in (got, want))
    assert a == b and len(a) == len(ANSWERS) * len(sides)


def test_a_blank_text_is_told_at_its_first_character(spark):
    rows = spark.createDataFrame([(t,) for t in (None, "", " \t　﻿", "\x1c", " a", "​")], "t string")
    assert [r[0] for r in rows.select(X.blank(F.col("t"))).collect()] == [True, True, True, False, False, False]


def test_passages_of_a_long_text_take_linear_time(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(600_000))
    spark.createDataFrame([(1, text, "es"), (2, "a b", "es"), (4, None, "es")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    began = time.time()
    rows = FX.individuals(spark, str(tmp_path)).orderBy("position").collect()
    assert time.time() - began < 60
    assert [r.position for r in rows] == list(range(40_002)) and rows[39_999].accion == "w599995 w599996 w599997 w599998 w599999"
    assert rows[0].pbest.rol == "a b" and rows[1].pbest is None and rows[40_000].lider.rol == "w0 w1 w2 w3 w4" and rows[40_001].rol is None


def test_a_cumulative_summary_scores_each_run_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(raw: pa.Array) -> pa.Array:
        seen.add(len(raw))
        return raw

    runs = spark.createDataFrame([(1, k, "a b\nc d", None) for k in range(1, 9)], "job_id long, run_number long, raw string, error string")
    runs = runs.withColumn("raw", F.arrow_udf(watched, "string")("raw"))
    jobs = EV.baseline(spark.createDataFrame([(1, "a x", "a b c")], "job_id long, current string, target string"), 9)
    assert EV.cumulative_summary(EV.run_result(EV.scored(runs, jobs, 9, 9)), 3).count() == 8
    assert seen.value == 8


def test_products_by_batches(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [2.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    got = rows.select(F.arrow_udf(E._products, "double")("a", "b").alias("p")).collect()
    assert [r.p for r in got] == [11.0, 2.0, None, 0.0]


@pytest.mark.parametrize("expected", [None, 3])
def test_results_made_with_the_scores_equal_those_counted_in_them(spark, expected):
    sides = [("a b", "c d"), ("UNO dos", None), ("", "x y z"), (None, "tres CUATRO"), ("q", "k l m a b e")]
    rows = [(i, k, r, "timeout" if k == 3 else None, c, t) for i, (c, t) in enumerate(sides) for k, r in enumerate(ANSWERS)]
    runs = spark.createDataFrame(rows, "job_id long, run_number long, raw string, error string, current string, target string")
    bearing = EV.baseline(runs, 9)
    jobs = bearing.select("job_id", "current", "target", "baseline").distinct()
    want = EV.run_result(EV.scored(runs.drop("current", "target"), jobs, expected, 9))
    some = [EV.results(bearing, None, expected, 9), EV.results(runs.drop("current", "target"), jobs, expected, 9)]
    a, b, c = ({(r.job_id, r.run_number): r for r in df.collect()} for df in (want, *some))
    assert a == b == c and len(a) == len(rows) and any(r.best for r in a.values())


def test_runs_bear_their_job_and_meet_it_in_no_join(spark, tmp_path):
    people = [(k, "a b c d e", ("f g h i j",)) for k in range(20)] + [(20, None, None)]
    spark.createDataFrame(people, "position long, rol string, pbest struct<rol:string>").write.parquet(f"{tmp_path}/people")
    jobs = EV.baseline(FX.eval_jobs(spark.read.parquet(f"{tmp_path}/people")), 9)
    for rows in (EV.results(FX.eval_runs(jobs), None, 9, 9), EV.scored(FX.eval_runs(jobs), None, 9, 9)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        assert rows.count() == 84
