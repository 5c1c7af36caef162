"""Plans that bear their individual's components: individuals are read once, and movements meet them in no join."""

import pyarrow as pa
from pyspark.sql import functions as F

from semspark.operators import movement as M
from semspark.plans import fixtures as FX

PART = "struct<rol:string,topico:string,accion:string>"


def _people(spark, n=60):
    part = lambda k, w: tuple(f"{w}{p}{k} {w}{p}b {w}{p}c {w}d e" for p in "rta")
    rows = [(k, f"ind-{k}", *part(k, "x"), part(k, "p"), part(0, "l")) for k in range(n)]
    return spark.createDataFrame(rows, f"position long, id string, rol string, topico string, accion string, pbest {PART}, lider {PART}")


def test_plans_read_individuals_once_and_bear_their_components(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(x: pa.Array) -> pa.Array:
        seen.add(len(x))
        return x

    people = _people(spark)
    plans = M.plan_movements(people.withColumn("id", F.explode(F.array(F.arrow_udf(watched, "string")("id")))), "influence", bearing=True)
    keep = ("number", "individual_id", "target", "current", "other_components")
    bound = M.bind_movement(plans)
    got = sorted(map(tuple, bound.select(*keep).collect()))
    assert seen.value == 60
    want = M.bind_movement(M.plan_movements(people, "influence"), people)
    assert got == sorted(map(tuple, want.select(*keep).collect())) and len(got) > 20


def test_stages_meet_what_was_chosen_and_not_all_individuals(spark):
    people = _people(spark)
    for operator in ("influence", "turbulence"):
        applied, final = M.staged_apply(people, operator, FX.responder, 9)
        # the same, stage by stage, over the positions of all individuals
        plans, positions, want = M.plan_movements(people, operator), people.select("id", *M.PARTS), []
        for stage in (1, 2, 3):
            answered = FX.responder(M.movement_prompt(M.bind_movement(plans.where(F.col("component_ord") == stage), positions)))
            chosen = M.selected(M.score(answered, operator, 9, 9), operator).where("chosen IS NOT NULL")
            chosen = chosen.select("number", "individual_id", "component_key", F.col("chosen.candidate").alias("candidate"), "other_components").localCheckpoint()
            positions = M.apply_to_position(positions, chosen).localCheckpoint()
            want += [(stage, *r) for r in chosen.collect()]
        got = applied.select("stage", "number", "individual_id", "component_key", "candidate", "other_components").collect()
        assert sorted(map(tuple, got)) == sorted(want) and {r[0] for r in want} == {1, 2, 3}
        assert sorted(map(tuple, final.collect())) == sorted(map(tuple, positions.collect()))
