from pyspark.sql import functions as F

from geoloom.plans.catalogue import QUERIES


def test_many_parts_are_within_a_tenth(spark, tmp_path):
    """So many that a sketch of 5 % standard error is off by over 10 %."""
    parts = spark.range(1, 1_199_941).select(F.lit("A").alias("l_returnflag"), F.col("id").alias("l_partkey"), (F.col("id") % 50).cast("double").alias("l_quantity"))
    parts.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in QUERIES["q64_sketches"](spark, str(tmp_path)).collect()] == [("A", 1_199_940, True, 1_199_940, True)]
