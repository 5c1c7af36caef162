"""What holds of whole queries, besides equality with SQL."""

from pyspark.sql import functions as F

from semspark.operators import embedding as E
from semspark.operators import movement as M
from semspark.plans import evaluate as EV
from semspark.plans import fixtures as FX
from semspark.plans import queries as Q
from semspark.sources import payloads, population
from semspark.sources.sinks import shared_path
from semspark.streaming import queries as _streaming  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_vectors_do_not_depend_on_partitions(spark):
    texts = FX.runs(spark, SF).select(F.col("raw").alias("text")).distinct()
    a, b = (sorted((r.text, r.embedding) for r in E.hash_encode(texts.repartition(n)).collect()) for n in (1, 7))
    assert a == b and all(abs(sum(x * x for x in v) - 1) < 1e-9 for _, v in a)


def test_custom_encoder(spark):
    texts = spark.createDataFrame([("a",), ("bb",)], "text string")
    got = {r.text: r.embedding for r in E.encode(texts, lambda: lambda some: [[float(len(t))] for t in some]).collect()}
    assert got == {"a": [1.0], "bb": [2.0]}


def test_at_most_one_move_a_component_and_later_prompts_see_it(spark):
    people = FX.individuals(spark, SF).where(population.complete())
    applied, positions = M.staged_apply(people, "turbulence", FX.responder, 9)
    moves = applied.collect()
    assert len({(m.individual_id, m.component_key) for m in moves}) == len(moves)
    roles = {m.individual_id: m.candidate for m in moves if m.stage == 1}
    later = [m for m in moves if m.stage == 2 and m.individual_id in roles]
    assert later and all(f"role = {roles[m.individual_id]}" in m.other_components for m in later)
    assert positions.count() == people.count()


def test_runs_without_candidates_stay_in_the_denominator(spark):
    runs = spark.createDataFrame([(1, 1, "", None), (1, 2, None, "timeout")], "job_id long, run_number long, raw string, error string")
    jobs = EV.baseline(spark.createDataFrame([(1, "a b", "c d")], "job_id long, current string, target string"))
    results = EV.run_result(EV.scored(runs, jobs, 5))
    s = EV.evaluation_summary(results, "job_id").first()
    assert (s.runs, s.completed, s.success_rate) == (2, 1, 0.0)
    assert {r.run_number: r.status for r in results.collect()} == {1: EV.UNPARSED, 2: None}


def test_failed_prompts_are_rows(spark):
    def responder(prompt):
        if prompt == "slow":
            raise TimeoutError
        return prompt.upper()

    prompts = spark.createDataFrame([(1, 1, "a"), (1, 2, "slow")], "job_id long, run_number long, prompt string")
    got = {r.run_number: (r.raw, r.error) for r in payloads.completions_batch(prompts, responder, shared_path(spark, "c"), 1).collect()}
    assert got == {1: ("A", None), 2: (None, "timeout")}


def test_pair_validation_keeps_rejected_pairs(spark):
    rows = EV.pair_validate(spark.createDataFrame([(1, " a ", "b"), (2, " ", "b"), (3, None, "b")], "pair_id long, text_a string, text_b string")).orderBy("pair_id").collect()
    assert [r.problem is None for r in rows] == [True, False, False] and rows[0].text_a == "a"


def test_no_candidate_of_a_run_is_dropped(spark, tmp_path):
    lines = [f"candidate line {k}" for k in range(11)] + ["CANDIDATE LINE 3"]
    turns = spark.createDataFrame([(2, 0, "user", "?"), (2, 1, "assistant", "\n".join(lines))], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {name: Q.QUERIES[name](spark, str(tmp_path)).collect() for name in ("parse_candidates", "reason_base", "text_dedupe", "cache_append", "stream_candidates", "stream_summary", "first_k")}
    assert [r.candidate for r in sorted(rows["parse_candidates"], key=lambda r: r.ordinal)] == lines
    for name in ("reason_base", "stream_candidates"):
        assert {r.ordinal for r in rows[name] if r.reason == "duplicate_output"} == {4, 12}
    assert len(rows["text_dedupe"]) == len(rows["cache_append"]) == rows["stream_summary"][0].candidates == 12 and len(rows["first_k"]) == 2
