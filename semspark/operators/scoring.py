"""Candidates of a row scored in the row: parsing, vectors, similarity and labels need no shuffle.

Rows have ``raw`` (an answer) and the texts that its candidates are held against.  They
get ``scored``, an array of (ordinal, candidate, similarity, improvement, diversity,
reason, is_valid), which is chosen from, counted and exploded as it is wanted, in
tables and streams alike.  Vectors are hash vectors made of columns; with a model of
one's own, ``attached_similarities`` brings what the vectors of the embedding cache say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semspark.functions import arrays as A
from semspark.functions import text as X
from semspark.operators import embedding as E
from semspark.operators import labels as L
from semspark.operators import rows as W


def parsed(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """Rows with ``candidates``: (ordinal, candidate, copies) of all that ``raw`` holds, or of the first ``expected``."""
    return A.settled(rows, "candidates", L.counted(X.parse_candidates(F.col("raw"), expected)))


def exploded(rows: DataFrame, array: str, *drop: str) -> DataFrame:
    """A row for each entry of the array of structs, beside the row's other columns."""
    keep = [c for c in rows.columns if c not in (array, *drop)]
    # outer, or the optimizer tests for empty arrays on the answers and so parses each again
    return rows.select(*keep, F.inline_outer(array)).where(F.col("candidate").isNotNull())


def _at(value: Column, scale: int | None) -> Column:
    return value if scale is None else F.round(value, scale)


def hash_similarities(rows: DataFrame, anchor: str, scale: int | None = None) -> DataFrame:
    """Parsed rows with ``similarities``: of each candidate's hash vector to the anchor's."""
    texts = F.transform("candidates", lambda c: c["candidate"])
    rows = rows.withColumn("_all", E.hash_similarities(texts, F.col(anchor)))
    each = F.transform("_all", lambda s: _at(s, scale))
    return A.settled(rows, "similarities", F.when(F.size("candidates") > 0, each)).drop("_all")


def hash_scored(rows: DataFrame, operator: str, expected: int | None = None, scale: int | None = None, **limits) -> DataFrame:
    """Rows (raw, current; target and baseline for an influence) with ``scored`` by hash vectors, in one step."""
    # held by a generator, so that no filter or projection further up asks for it again
    return A.settled(rows.withColumn("_row", W.scored(operator, expected, scale, **limits)), "scored", F.col("_row")).drop("_row")


def hash_results(rows: DataFrame, operator: str, expected: int | None = None, scale: int | None = None, **limits) -> DataFrame:
    """The same rows with ``candidate_count``, ``valid_count`` and ``best``, which are made with the scores; no array of them comes back."""
    out = A.settled(rows.withColumn("_row", W.result(operator, expected, scale, **limits)), "_result", F.col("_row")).drop("_row")
    return out.select(*rows.columns, "_result.*")


def attached_similarities(rows: DataFrame, anchor: str, vectors: DataFrame, *key: str, scale: int | None = None) -> DataFrame:
    """The same by vectors (text, embedding, norm) of a cache: candidates meet their vectors by digest; ``key`` tells rows apart."""
    some = exploded(rows.select(*key, anchor, "candidates"), "candidates")
    some = E.attach(E.attach(some, vectors, "candidate", "candidate"), vectors, anchor, "anchor")
    some = some.select(*key, "ordinal", E.similarity("candidate", "anchor", scale).alias("s"))
    each = F.array_sort(F.collect_list(F.struct("ordinal", "s")))
    found = some.groupBy(*key).agg(F.transform(each, lambda e: e["s"]).alias("similarities"))
    return rows.join(found, list(key), "left")


def model_scored(rows: DataFrame, operator: str, vectors: DataFrame, *key: str, expected: int | None = None, scale: int | None = None, **limits) -> DataFrame:
    """Rows (raw, current, baseline; target for an influence) with ``scored`` by the vectors (text, embedding, norm; or text, vector) of a cache; ``key`` tells rows apart.

    Candidates and the texts they are held against meet their vectors in one join, by
    digest, and then come together by key, with the row, in one exchange: no vector is
    moved twice, and none but in packed form.
    """
    asked = F.col("raw").isNotNull()
    row = F.struct(*(c for c in rows.columns if c != "raw"), asked.alias("_asked"))
    texts = F.concat(F.array("target" if operator == "influence" else "current"), F.when(asked, W.lines(F.col("raw"), expected)).otherwise(F.array().cast("array<string>")))
    some = rows.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(key)), row.alias("_row"), F.posexplode(texts).alias("_ordinal", "_said"))
    some = some.withColumn("_row", F.when(F.col("_ordinal") == 0, F.col("_row")))
    met = E.attach(some, E.packed(vectors), "_said", "_said").repartition(*(f"_{k}" for k in range(len(key))))
    met = met.sortWithinPartitions(*(f"_{k}" for k in range(len(key))), "_ordinal").select("_ordinal", F.col("_said").alias("_text"), F.col("_said_vector").alias("_vector"), "_row")
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "raw"]
    return met.mapInArrow(W.by_vectors(operator, scale, **limits), T.StructType([*fields, T.StructField("scored", T.DataType.fromDDL(W.SCORED))]))


def baseline(rows: DataFrame, scale: int | None = None, name: str = "baseline") -> DataFrame:
    """Rows with the similarity of ``current`` and ``target``, which a candidate has to better."""
    return A.settled(rows.withColumn("_one", W.baseline(F.col("current"), F.col("target"), scale)), name, F.col("_one")).drop("_one")


def influence_scored(rows: DataFrame, scale: int | None = None, **limits) -> DataFrame:
    """Rows (candidates, similarities to ``target``, baseline, current, target) with ``scored``."""
    base = F.transform("candidates", lambda c: L.reason_base(c["candidate"], c["copies"], F.col("current"), F.col("target")))
    gains = F.transform("similarities", lambda s: _at(s - F.col("baseline"), scale))
    rows = rows.withColumns({"_base": base, "_gains": gains})
    reason = F.transform("_base", lambda b, i: L.reason_influence(b, F.get("similarities", i), F.get("_gains", i), **limits))
    return _assembled(rows.withColumn("_reasons", reason), F.col("_gains"), None)


def turbulence_scored(rows: DataFrame, scale: int | None = None, **limits) -> DataFrame:
    """Rows (candidates, similarities to ``current``, current) with ``scored``."""
    base = F.transform("candidates", lambda c: L.reason_base(c["candidate"], c["copies"], F.col("current"), None))
    apart = F.transform("similarities", lambda s: _at(1 - s, scale))
    rows = rows.withColumns({"_base": base, "_apart": apart})
    reason = F.transform("_base", lambda b, i: L.reason_turbulence(b, F.get("similarities", i), **limits))
    return _assembled(rows.withColumn("_reasons", reason), None, F.col("_apart"))


def _assembled(rows: DataFrame, gains: Column | None, apart: Column | None) -> DataFrame:
    none = F.lit(None).cast("double")

    def entry(c: Column, i: Column) -> Column:
        reason = F.get("_reasons", i)
        return F.struct(
            c["ordinal"].alias("ordinal"), c["candidate"].alias("candidate"), F.get("similarities", i).alias("similarity"), (none if gains is None else F.get(gains, i)).alias("improvement"),
            (none if apart is None else F.get(apart, i)).alias("diversity"), reason.alias("reason"), L.is_valid(reason).alias("is_valid"),
        )

    return A.settled(rows, "scored", F.transform("candidates", entry)).drop("candidates", "similarities", "_base", "_gains", "_apart", "_reasons")


def _valid() -> Column:
    return F.filter("scored", lambda c: c["is_valid"])


def best_valid() -> Column:
    """The valid candidate of the highest similarity; of equals the earliest; null where none is valid."""
    ranked = F.transform(_valid(), lambda c: F.struct(c["similarity"].alias("similarity"), (-c["ordinal"]).alias("_back"), c["candidate"].alias("candidate"), c["improvement"].alias("improvement"), c["ordinal"].alias("ordinal")))
    return F.array_max(ranked).dropFields("_back")


def random_valid(seed: int, key: Column) -> Column:
    """One of the valid candidates, drawn by a seeded hash of the row's key and the ordinal; null where none is valid."""
    draw = lambda c: F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), c["ordinal"].cast("string")))
    ranked = F.transform(_valid(), lambda c: F.struct(draw(c).alias("_draw"), c["ordinal"].alias("ordinal"), c["candidate"].alias("candidate"), c["similarity"].alias("similarity"), c["improvement"].alias("improvement")))
    return F.array_min(ranked).dropFields("_draw")


def candidate_count() -> Column:
    return F.coalesce(F.size("scored"), F.lit(0)).cast("long")


def valid_count() -> Column:
    return F.coalesce(F.size(_valid()), F.lit(0)).cast("long")
