"""Populations of structured prompts: reading, checking, writing."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semspark.functions import text as X

PARTS = ("rol", "topico", "accion")
_VECTOR = ", ".join(f"{p}: string" for p in PARTS)
SCHEMA = f"individuals array<struct<id: string, {_VECTOR}, pbest: struct<{_VECTOR}>, lider: struct<{_VECTOR}>>>"


def population_scan(spark: SparkSession, path: str) -> DataFrame:
    """Individuals of a population file, with their position in it."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return rows.select(F.posexplode("individuals").alias("position", "i")).select("position", "i.*")


FIELDS = ("id", *PARTS, *(f"pbest.{p}" for p in PARTS), *(f"lider.{p}" for p in PARTS))


def first_bad() -> Column:
    """The first field that is missing or blank, or null: id, own vector, best and leader must all be there."""
    return F.coalesce(*(F.when(X.blank(F.col(n)), n) for n in FIELDS))


def complete() -> Column:
    """Whether no field is missing or blank."""
    return first_bad().isNull()


def population_check(individuals: DataFrame) -> DataFrame:
    """One row: how many individuals there are, and the first bad one's position, from 1."""
    return individuals.agg(F.count("*").alias("individuals"), F.min(F.when(~complete(), F.col("position") + 1)).alias("first_bad"))


def population_validate(individuals: DataFrame, strict: bool = True) -> DataFrame:
    """All individuals with ``valid``; where ``strict``, an empty population or a bad individual is an error."""
    out = individuals.withColumn("valid", complete())
    if not strict:
        return out
    check = population_check(individuals)
    bad = F.when(F.col("individuals") == 0, F.raise_error(F.lit("the population is empty"))).when(F.col("first_bad").isNotNull(), F.raise_error(F.concat(F.lit("incomplete individual at "), F.col("first_bad").cast("string"))))
    # one row beside each: the check decides before any row comes through
    return out.crossJoin(F.broadcast(check.select(F.coalesce(bad.cast("string"), F.lit("")).alias("_checked")))).where("_checked = ''").drop("_checked")


def population_quarantine(individuals: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected), parted in one pass over the population and written below ``path``.

    A rejected individual bears the first bad field and its position in the file, from 1.
    """
    rows = individuals.withColumn("bad_field", first_bad()).withColumn("file_position", F.when(F.col("bad_field").isNotNull(), F.col("position") + 1))
    rows.withColumn("kept", F.col("bad_field").isNull()).write.mode("overwrite").partitionBy("kept").parquet(path)
    back = individuals.sparkSession.read.schema(T.StructType([*rows.schema, T.StructField("kept", T.BooleanType())])).parquet(path)
    return back.where("kept").select(*individuals.columns), back.where("NOT kept").drop("kept")


def population_head(individuals: DataFrame, n: int) -> DataFrame:
    """The first ``n`` in the order of the file."""
    return individuals.orderBy("position").limit(n)
