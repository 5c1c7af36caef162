"""Choice of candidates, and numbering."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semspark.functions import text as X


def best_per(rows: DataFrame, *group: str, order: str = "ordinal") -> DataFrame:
    """Of each group the row of the highest similarity; of equals the earliest."""
    window = Window.partitionBy(*group).orderBy(F.desc("similarity"), order)
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def best_overall(runs: DataFrame, *order: str) -> DataFrame:
    """The run of the highest similarity; of equals the first by ``order`` (``run_number``)."""
    return runs.orderBy(F.desc("similarity"), *(order or ("run_number",))).limit(1)


def random_per(rows: DataFrame, seed: int, group: str, order: str = "ordinal") -> DataFrame:
    """Of each group one row, drawn by a seeded hash of group and order."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col(order).cast("string")))
    window = Window.partitionBy(group).orderBy(key, order)
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def numbered(rows: DataFrame, position: str, *within: str, bucket: int = 4096, name: str = "number") -> DataFrame:
    """1..M in the order of ``position`` and the columns ``within`` it, with no task over all rows.

    Rows are numbered inside buckets of positions; the buckets' counts, of which
    there is one for each ``bucket`` positions, are summed up and joined back.
    """
    rows = rows.withColumn("_bucket", F.floor(F.col(position) / bucket))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(position, *within)
    out = rows.withColumn(name, F.row_number().over(inside)).join(counts, "_bucket")
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_bucket", "_before")


_KINDS = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "max": (F.max, lambda a, b: F.greatest(a, b)), "min": (F.min, lambda a, b: F.least(a, b))}


def carried(rows: DataFrame, group: tuple[str, ...], order: str, parts: dict[str, str], block: int = 4096) -> DataFrame:
    """Rows with each column of ``parts`` (column to sum, max or min) replaced by its running value over the group, in the order of a whole-numbered column.

    A group's rows are run up in blocks of ``block`` numbers, each of which may be a
    task of its own; what the blocks before bring in is run up in the same way over the
    blocks' values, level by level.  So a group of any size is spread, and no window
    spans more than one block.  Nulls add nothing.
    """
    return _run_up(rows, group, order, parts, block, Window.currentRow)


def _run_up(rows: DataFrame, group: tuple[str, ...], order: str, parts: dict[str, str], block: int, last: int) -> DataFrame:
    place = f"_{order}"  # the number of the block, under a name that no level below has
    blocked = rows.withColumn(place, F.floor(F.col(order) / block))
    inside = Window.partitionBy(*group, place).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    out = blocked.withColumns({c: _KINDS[f][0](c).over(inside) for c, f in parts.items()})
    ends = blocked.agg(F.min(place), F.max(place)).first()
    if ends[0] == ends[1]:
        return out.drop(place)
    sums = blocked.groupBy(*group, place).agg(*(_KINDS[f][0](c).alias(c) for c, f in parts.items()))
    before = _run_up(sums, group, place, parts, block, -1).select(*group, place, *(F.col(c).alias(f"_before_{c}") for c in parts))
    out = out.join(before, [*group, place])
    return out.withColumns({c: _KINDS[f][1](F.col(f"_before_{c}"), F.col(c)) for c, f in parts.items()}).drop(place, *(f"_before_{c}" for c in parts))


def movement_number(plans: DataFrame) -> DataFrame:
    """Plans with their ``number``, over individuals and then components, and ``movement_id``."""
    return numbered(plans, "position", "component_ord").withColumn("movement_id", X.movement_id(F.col("number")))
