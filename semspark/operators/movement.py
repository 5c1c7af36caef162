"""Semantic moves over a population, as table operators.

A pass is three bulk stages, one for each component in its order: what a stage
applies is seen by the prompts of the next.  Individuals are independent of each
other, so a stage is one job over all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.functions import text as X
from semspark.operators import ranking as R
from semspark.operators import scoring as S
from semspark.sources import catalogue
from semspark.sources.sinks import stored

SEED, THRESHOLD, EXPECTED = 42, 0.7, 9
PARTS = ("rol", "topico", "accion")

# What the result tables say of a movement without a candidate.
UNPARSED, NO_PROGRESS, OUT_OF_RANGE, FAILED = "sin candidatos parseables", "sin candidato con progreso semántico", "sin candidato en rango de turbulencia", "error de ejecución"

#: What names a movement in the table of its candidates.
CALLED = ("number", "individual_id", "operator", "component_key", "prompt_name", "source")

#: A responder gives ``raw`` (and may give ``error``) to movements with their prompts.
Responder = Callable[[DataFrame], DataFrame]


def draws(individuals: DataFrame, seed: int = SEED) -> DataFrame:
    """Each individual with each component, and its two draws."""
    comps = catalogue.components(individuals.sparkSession)
    return individuals.crossJoin(F.broadcast(comps)).withColumns({f"{use}_draw": X.uniform_draw(seed, F.col("id"), F.col("key"), use) for use in ("change", "source")})


def _of(struct: str | None) -> Column:
    """The component that the row's key names, of the individual or of one of its structs."""
    out = None
    for p in PARTS:
        field = F.col(f"{struct}.{p}" if struct else p)
        out = F.when(F.col("key") == p, field) if out is None else out.when(F.col("key") == p, field)
    return out


def plan_movements(individuals: DataFrame, operator: str, threshold: float = THRESHOLD, seed: int = SEED, bearing: bool = False) -> DataFrame:
    """Components that are to move: those drawn above the threshold, with source, target and number.

    What is drawn is written before it is numbered, which reads it twice; the
    individuals are read once.  Plans may be ``bearing`` their individual's three
    components, so that they need not meet it again.
    """
    drawn = draws(individuals, seed).where(F.col("change_draw") > threshold)
    pick = F.when(F.col("source_draw") < 0.5, "pbest").otherwise("lider") if operator == "influence" else F.lit("turbulence")
    target = F.when(F.col("source") == "pbest", _of("pbest")).when(F.col("source") == "lider", _of("lider"))
    plans = drawn.withColumn("source", pick).withColumn("target", target)
    plans = plans.select("position", F.col("id").alias("individual_id"), F.lit(operator).alias("operator"), "component_ord", F.col("key").alias("component_key"), "prompt_name", "definition", "source", F.col("change_draw").alias("random_value"), "target", *(PARTS if bearing else ()))
    return R.movement_number(stored(plans, "drawn"))


def other_components(key: Column, position: dict[str, Column]) -> Column:
    """The other two components as ``name = value``, joined, in the order of the catalogue."""
    rows = F.array(*(F.struct(F.lit(k).alias("key"), F.concat(F.lit(f"{name} = "), position[k]).alias("said")) for _, k, name, _ in catalogue.COMPONENTS))
    return F.concat_ws("; ", F.transform(F.filter(rows, lambda r: r["key"] != key), lambda r: r["said"]))


def bind_movement(plans: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Plans with ``current`` and ``other_components`` from the latest positions (id and the three components), or from the components that they bear."""
    bound = plans if positions is None else plans.join(positions.select(F.col("id").alias("individual_id"), *PARTS), "individual_id")
    current = None
    for p in PARTS:
        current = F.when(F.col("component_key") == p, F.col(p)) if current is None else current.when(F.col("component_key") == p, F.col(p))
    return bound.withColumn("current", current).withColumn("other_components", other_components(F.col("component_key"), {p: F.col(p) for p in PARTS}))


def movement_prompt(movements: DataFrame, expected: int = EXPECTED, reference_text: str = "") -> DataFrame:
    """Movements with their ``prompt``; a turbulence has no target to name."""
    names = {"num_candidates": F.lit(str(expected)), "component_name": F.col("prompt_name"), "component_definition": F.col("definition"), "current_component": F.col("current"), "target_component": F.coalesce("target", F.lit("")), "other_components": F.col("other_components"), "reference_text": F.lit(reference_text)}
    influence, turbulence = (X.render_fixed(catalogue.TEMPLATES[operator], names) for operator in ("influence", "turbulence"))
    return movements.withColumn("prompt", F.when(F.col("operator") == "influence", influence).otherwise(turbulence))


def score(answered: DataFrame, operator: str, expected: int | None = EXPECTED, scale: int | None = None, vectors: DataFrame | None = None, **limits) -> DataFrame:
    """Movements (with ``raw``) with ``baseline`` and ``scored``: influence against the target, turbulence against the current text.

    By hash vectors in the row, or by ``vectors`` (text, embedding, norm) of a model.
    """
    if "error" in answered.columns:  # a failed call has no candidates
        answered = answered.withColumn("raw", F.when(F.col("error").isNull(), F.col("raw")))
    rows = S.baseline(answered, scale) if operator == "influence" else answered.withColumn("baseline", F.lit(None).cast("double"))
    if vectors is None:
        return S.hash_scored(rows, operator, expected, scale, **limits).drop("raw")
    return S.model_scored(rows, operator, vectors, "number", expected=expected, scale=scale, **limits)


def movement_candidates(scored: DataFrame) -> DataFrame:
    """Scored movements as one row a candidate, with the ``reference`` that it was held against."""
    rows = scored.withColumn("reference", F.when(F.col("operator") == "influence", F.col("target")).otherwise(F.col("current")))
    return S.exploded(rows, "scored")


def selected(scored: DataFrame, operator: str, seed: int = SEED) -> DataFrame:
    """Movements with ``chosen``, the candidate that is applied: the best valid one, or for turbulence one drawn."""
    return scored.withColumn("chosen", S.best_valid() if operator == "influence" else S.random_valid(seed, F.col("number")))


def movement_result(chosen: DataFrame, operator: str) -> DataFrame:
    """One row a movement: counts, selected candidate, and why there is none; all in the row."""
    n, why_not = S.candidate_count(), NO_PROGRESS if operator == "influence" else OUT_OF_RANGE
    why = F.when(F.col("error").isNotNull(), FAILED).when(F.col("chosen").isNotNull(), None).when(n == 0, UNPARSED).otherwise(why_not)
    counts = {"candidate_count": n, "valid_count": S.valid_count(), "selected": F.col("chosen.candidate"), "selected_similarity": F.col("chosen.similarity"), "applied": F.col("chosen").isNotNull(), "failure_reason": why}
    return chosen.withColumns(counts).drop("scored", "chosen")


def swarm_summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts, rates and times over movement results (``applied``, ``error``, ``elapsed_ms``, ``valid_count``); a failed call counts as processed and as failed."""
    finite = F.col("elapsed_ms").isNotNull() & ~F.isnan("elapsed_ms")
    applied, failed = F.count_if("applied"), F.count_if(~F.col("applied"))
    return results.groupBy(*by).agg(
        F.count("*").alias("processed"),
        applied.alias("applied"),
        failed.alias("failed"),
        F.try_divide(100.0 * failed, F.count("*")).alias("failure_rate"),
        F.countDistinct(F.when(F.col("applied"), F.col("individual_id"))).alias("affected"),
        F.sum(F.when(finite, F.col("elapsed_ms"))).alias("elapsed_total"),
        F.avg(F.when(finite, F.col("elapsed_ms"))).alias("elapsed_mean"),
        F.coalesce(F.sum("valid_count"), F.lit(0)).alias("valid_candidates"),
        F.count_if(F.col("error").isNull() & ~F.col("applied")).alias("candidate_failures"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


SKETCH = 14


def affected_sketch(results: DataFrame, *by: str) -> DataFrame:
    """A mergeable sketch of the distinct individuals with an applied move, beside the exact count, for each group."""
    who = F.when(F.col("applied"), F.col("individual_id"))
    return results.groupBy(*by).agg(F.hll_sketch_agg(who, SKETCH).alias("sketch"), F.countDistinct(who).alias("affected"))


def merged_sketch(sketches: DataFrame, *by: str) -> DataFrame:
    """Stored sketches of stages or batches put together: an estimate of the distinct individuals of them all, with no pass over results."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("affected_about"))


def apply_to_position(positions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Positions with a stage's choices written into them; an individual moves at most one component a stage."""
    moves = chosen.select(F.col("individual_id").alias("id"), F.col("component_key").alias("_key"), F.col("candidate").alias("_new"))
    rows = positions.join(moves, "id", "left")
    return rows.withColumns({p: F.when(F.col("_key") == p, F.col("_new")).otherwise(F.col(p)) for p in PARTS}).drop("_key", "_new")


def staged_apply(individuals: DataFrame, operator: str, responder: Responder, scale: int | None = None, seed: int = SEED, threshold: float = THRESHOLD, expected: int = EXPECTED) -> tuple[DataFrame, DataFrame]:
    """(applied movements with their stage, final positions) of one pass.

    Answers are costly and may differ when asked again, so each stage's are written
    before anything is computed from them; their prompts, which nothing reads after
    that, are not.  Plans bear their individual's components, and of a stage only those
    meet what the stages before it have chosen; all individuals meet it once, when the
    final positions are read.
    """
    plans = stored(plan_movements(individuals, operator, threshold, seed, bearing=True), "plans").withColumnRenamed("individual_id", "id")
    stages: list[DataFrame] = []
    for stage in range(1, len(PARTS) + 1):
        latest = reduce(apply_to_position, stages, plans.where(F.col("component_ord") == stage))
        movements = movement_prompt(bind_movement(latest.withColumnRenamed("id", "individual_id")), expected)
        answered = stored(responder(movements).drop("prompt"), "answers")
        chosen = selected(score(answered, operator, expected, scale), operator, seed).where(F.col("chosen").isNotNull())
        stages.append(stored(chosen.select("number", "individual_id", "component_key", "current", F.col("chosen.candidate").alias("candidate"), F.col("chosen.similarity").alias("similarity"), "other_components").withColumn("stage", F.lit(stage)), "chosen"))
    return reduce(DataFrame.unionByName, stages), reduce(apply_to_position, stages, individuals.select("id", *PARTS))
