"""Result tables."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; in one of our own only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back, which cuts the lineage; tightly packed, as such tables stay until the cluster clears them."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


RESULTS = ("candidates", "run_results", "movement_candidates", "movement_results")


def sink_results(tables: dict[str, DataFrame], path: str, by: str = "job_id") -> None:
    """Write result tables below ``path``, partitioned by ``by``, and then note in the manifest what is complete.

    A partition that is written again replaces what was there, and no other is touched:
    the same write twice reads back once.  The manifest gets a row for each table and
    partition only after that table's write has been committed.
    """
    for name, df in tables.items():
        if name not in RESULTS:
            raise ValueError(f"no result table is called {name}")
        # a partition that is replaced is there twice until the new one is committed
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(f"{path}/{name}")
        written = df.groupBy(F.col(by).cast("string").alias("part")).agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(name).alias("name"), "part")
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name", "part").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, part, n_rows): which partitions of which tables are complete."""
    return spark.read.schema("n_rows long, name string, part string").parquet(f"{path}/manifest")


def read_results(spark: SparkSession, path: str, name: str, by: str = "job_id") -> DataFrame:
    """A result table, of its complete partitions only."""
    done = manifest(spark, path).where(F.col("name") == name).select(F.col("part").alias("_part"))
    rows = spark.read.parquet(f"{path}/{name}")
    return rows.join(done, F.col(by).cast("string") == F.col("_part"), "left_semi")
