"""What the candidates' table leaves on disk: its own record, and before it one row a movement."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from semspark.operators import movement as M
from semspark.plans import queries as Q
from semspark.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture
def kept(monkeypatch):
    """The tables that are written on the way, by their names."""
    out = {}

    def stored(df, name, real=sinks.stored):
        out[name] = real(df, name)
        return out[name]

    monkeypatch.setattr(sinks, "stored", stored)
    return out


def test_candidates_are_written_without_what_the_plans_hold(spark, kept, monkeypatch):
    written = []
    monkeypatch.setattr(sinks, "sink_results", lambda tables, path, by, real=sinks.sink_results: (written.append((path, tables)), real(tables, path, by)))
    rows = Q.QUERIES["sink_movement_candidates"](spark, SF)
    assert rows.count() == sinks.read_results(spark, written[0][0], "movement_candidates", "part").count() > 0
    record = [*M.CALLED, "ordinal", "current", "reference", "candidate", "similarity", "improvement", "diversity", "reason", "is_valid", "part"]
    assert len(written) == 2 and all(sorted(tables["movement_candidates"].columns) == sorted(record) for _, tables in written)
    for name in ("answers", "scored"):  # one row a movement, with no component but the one that moves
        table = kept[name]
        assert not {"definition", "other_components", *M.PARTS} & set(table.columns)
        assert table.groupBy("number").count().where("count > 1").count() == 0
    assert set(kept) == {"answers", "scored"}


def test_stored_tables_are_packed(spark, tmp_path):
    rows = sinks.stored(spark.range(10).select(F.col("id").cast("string").alias("t")), "some")
    files = [f.removeprefix("file://") for f in rows.inputFiles()]
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups} == {"ZSTD"}
