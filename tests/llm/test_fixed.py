"""What is read from files row by row is not written again for its rows' places."""

from semspark.llm import common as C


def test_a_table_read_from_files_is_not_stored_again(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").where("id > 3").selectExpr("id + 1 AS id")
    assert C.fixed(rows, "rows") is rows
    kept = rows.selectExpr("id AS kept").cache()
    kept.count()
    for unstable in (rows.repartition(3), rows.sample(0.5, 1), kept):
        assert C.fixed(unstable, "rows") is not unstable
    kept.unpersist()
