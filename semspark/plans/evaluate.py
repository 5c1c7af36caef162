"""Template evaluation: runs of a job, their candidates, and the summaries."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.functions import text as X
from semspark.functions import vectors as V
from semspark.operators import ranking as R
from semspark.operators import scoring as S
from semspark.sources.sinks import stored

# Fixed value: the status of a run whose completion has no candidate.
UNPARSED = "sin candidatos parseables"


def pair_validate(pairs: DataFrame) -> DataFrame:
    """Pairs with both texts trimmed, and ``problem`` where one is blank."""
    a, b = (F.coalesce(X.js_trim(F.col(c)), F.lit("")) for c in ("text_a", "text_b"))
    return pairs.withColumns({"text_a": a, "text_b": b}).withColumn("problem", F.when((F.col("text_a") == "") | (F.col("text_b") == ""), "both texts are required"))


def pair_report(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Similarity, distance, dimension, norms and previews of vector pairs; norms are reckoned once a vector."""
    x, y = F.col(a), F.col(b)
    rows = pairs.withColumns({"norm_a": V.norm(x), "norm_b": V.norm(y), "product": V.dot(x, y)})
    rows = rows.withColumn("similarity", V.cosine_of(F.col("product"), F.col("norm_a"), F.col("norm_b")))
    return rows.withColumns({"distance": V.distance(F.col("similarity")), "dimension": V.dimension(x), "preview_a": V.preview(x), "preview_b": V.preview(y)})


def baseline(jobs: DataFrame, scale: int | None = None) -> DataFrame:
    """Jobs (job_id, current, target) with the similarity that a candidate has to better, once a job."""
    return S.baseline(jobs, scale)


def run_candidates(runs: DataFrame, expected: int | None = None, lead: int = 0) -> DataFrame:
    """Runs (job_id, run_number, raw) exploded into candidates with their ordinal and number of equals; ``first`` has the ``lead`` first of the run."""
    rows = S.parsed(runs, expected)
    if lead:
        rows = rows.withColumn("first", F.transform(F.slice("candidates", 1, lead), lambda c: c["candidate"]))
    return S.exploded(rows, "candidates", "raw")


def _asked(runs: DataFrame, jobs: DataFrame | None) -> DataFrame:
    """Runs with the texts of their job, which they may bear already; a failed one without an answer."""
    rows = runs.withColumn("raw", F.when(F.col("error").isNull(), F.col("raw")))
    return rows if jobs is None else rows.join(jobs, "job_id")


def scored(runs: DataFrame, jobs: DataFrame | None, expected: int | None = None, scale: int | None = None, vectors: DataFrame | None = None, **limits) -> DataFrame:
    """Runs (job_id, run_number, raw, error) with ``scored`` against their job's target; ``jobs`` have their baseline.

    Runs that bear their job's current, target and baseline need no ``jobs`` and meet none.  A failed run has no candidates.  By hash vectors, or by ``vectors`` (text,
    embedding, norm) of a model, which must have all candidates and targets.
    """
    rows = _asked(runs, jobs)
    if vectors is None:
        rows = S.hash_scored(rows, "influence", expected, scale, **limits)
    else:
        rows = S.model_scored(rows, "influence", vectors, "job_id", "run_number", expected=expected, scale=scale, **limits)
    return rows.select("job_id", "run_number", "error", "scored")


def candidates(runs: DataFrame) -> DataFrame:
    """Scored runs as one row a candidate, invalid ones included."""
    return S.exploded(runs, "scored", "error")


def run_result(runs: DataFrame) -> DataFrame:
    """One row a scored run, those without candidates and those that failed included; counted and chosen in the row."""
    n = S.candidate_count()
    status = F.when(F.col("error").isNull() & (n == 0), UNPARSED)
    return runs.select("job_id", "run_number", n.alias("candidate_count"), S.valid_count().alias("valid_count"), S.best_valid().alias("best"), status.alias("status"), "error")


def results(runs: DataFrame, jobs: DataFrame | None, expected: int | None = None, scale: int | None = None, **limits) -> DataFrame:
    """What ``run_result`` gives of ``scored`` by hash vectors, in one step: scores are counted and chosen from where they are made."""
    rows = S.hash_results(_asked(runs, jobs), "influence", expected, scale, **limits)
    status = F.when(F.col("error").isNull() & (F.col("candidate_count") == 0), UNPARSED)
    return rows.select("job_id", "run_number", "candidate_count", "valid_count", "best", status.alias("status"), "error")


def evaluation_summary(results: DataFrame, *by: str, also: Iterable[Column] = ()) -> DataFrame:
    """Success rate over completed runs, means over the best candidates, and counts; ``also`` names further aggregates."""
    done = F.count_if(F.col("error").isNull())
    good = F.count_if(F.col("best").isNotNull())
    return results.groupBy(*by).agg(
        F.count("*").alias("runs"),
        done.alias("completed"),
        F.try_divide(100.0 * good, done).alias("success_rate"),
        F.avg("best.similarity").alias("mean_best_similarity"),
        F.avg("best.improvement").alias("mean_best_improvement"),
        F.coalesce(F.sum("valid_count"), F.lit(0)).alias("valid_candidates"),
        *also,
    )


def completed_runs(results: DataFrame) -> DataFrame:
    """Runs without an error; those without candidates stay."""
    return results.where(F.col("error").isNull())


def cumulative_summary(results: DataFrame, block: int = 4096) -> DataFrame:
    """The summary of each job after each of its runs, with no task over all runs of a job (see ``ranking.carried``).

    What is run up is written first: it is read several times, and comes from scoring.
    """
    none = F.col("error").isNull().cast("long")
    parts = {"completed": none, "good": F.col("best").isNotNull().cast("long"), "total": F.col("best.similarity"), "top": F.col("best.similarity")}
    rows = results.select("job_id", "run_number", *(c.alias(n) for n, c in parts.items()))
    rows = R.carried(stored(rows, "results"), ("job_id",), "run_number", {"completed": "sum", "good": "sum", "total": "sum", "top": "max"}, block)
    return rows.select("job_id", "run_number", "completed", F.try_divide(100.0 * F.col("good"), F.col("completed")).alias("success_rate"), F.try_divide("total", F.col("good")).alias("mean_best_similarity"), F.col("top").alias("best_similarity"))


def elapsed_stats(calls: DataFrame, *by: str) -> DataFrame:
    """Sum and mean of the finite times."""
    finite = F.when(F.col("elapsed_ms").isNotNull() & ~F.isnan("elapsed_ms"), F.col("elapsed_ms"))
    return calls.groupBy(*by).agg(F.count(finite).alias("timed"), F.sum(finite).alias("elapsed_total"), F.avg(finite).alias("elapsed_mean"))
