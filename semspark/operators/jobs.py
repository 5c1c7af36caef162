"""Job settings: numbers clamped to their ranges, and rules across fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.functions import text as X

# Ranges and defaults of the numeric settings; True marks counts.
FIELDS = {
    "runs": (1, 200, "20", True),
    "expected_candidates": (1, 20, "4", True),
    "temperature": (0, 2, "0.7", False),
    "top_p": (0, 1, "0.95", False),
    "max_tokens": (8, 2048, "180", True),
    "timeout_s": (5, 600, "120", False),
    "min_words": (1, 20, "2", True),
    "max_words": (1, 40, "8", True),
    "margin": (0, 1, "0", False),
    "copy_threshold": (0, 1, "0.94", False),
    "individuals": (1, 200, "20", True),
    "change_threshold": (0, 1, "0.7", False),
    "turbulence_min": (-1, 1, "0.55", False),
    "turbulence_max": (-1, 1, "0.9", False),
}


def number(raw: Column) -> Column:
    """A finite decimal number, with or without exponent; null for anything else."""
    text = X.js_trim(raw)
    value = text.try_cast("double")
    return F.when(F.rlike(text, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")) & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def clamp_number(raw: Column, low: float, high: float, whole: bool = False) -> Column:
    """Clamped to the range; counts are then floored.  Null marks blank or non-finite text, which is an error."""
    value = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number(raw)))
    value = F.when(number(raw).isNotNull(), value)
    return F.floor(value).cast("double") if whole else value


def clamped(jobs: DataFrame) -> DataFrame:
    """Jobs with every numeric setting, given as text, clamped."""
    return jobs.withColumns({c: clamp_number(F.col(c), low, high, whole) for c, (low, high, _, whole) in FIELDS.items() if c in jobs.columns})


def config_check(jobs: DataFrame) -> DataFrame:
    """Jobs (clamped) with ``problem``: the first rule that they break, or null."""
    blank = lambda c: F.coalesce(X.js_trim(F.col(c)), F.lit("")) == ""
    swarm = F.col("swarm")
    missing = [F.when(F.col(c).isNull(), f"{c} is not a number") for c in FIELDS if c in jobs.columns]
    rules = [
        F.when(~F.coalesce(F.col("operator").isin("influence", "turbulence"), F.lit(False)), "unknown operator"),
        F.when(~swarm & (blank("current") | blank("target")), "current and target are required"),
        F.when(swarm & blank("reference_text"), "the reference text is required"),
        *missing,
        F.when(F.col("min_words") > F.col("max_words"), "min_words is above max_words"),
        F.when(F.col("turbulence_min") > F.col("turbulence_max"), "turbulence_min is above turbulence_max"),
    ]
    return jobs.withColumn("problem", F.coalesce(*rules))
