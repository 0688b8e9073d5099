"""Shared stage results follow the tables they were made from."""

from stockflow.plans import catalogue


def test_changed_tables_are_read_anew(spark, tmp_path):
    def build():
        return catalogue._cached(spark, str(tmp_path), "probe", lambda: spark.read.parquet(f"{tmp_path}/*.parquet").count())

    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    assert build() == 3 and build() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/a.parquet")
    assert build() == 5
    spark.range(2).write.parquet(f"{tmp_path}/b.parquet")
    assert build() == 7
