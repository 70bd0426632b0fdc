"""What the near-duplicate scan writes of every row."""

from pyspark.sql import functions as F

from pactlens.operators import dedup


def test_the_order_of_shingles_carries_no_sets(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4]), (3, [9])], "id long, shingles array<long>").withColumn("n", F.size("shingles"))
    ordered = dedup.rare_first(sets)
    assert set(ordered.columns) == {"id", "n", "shared", "skipped"}
    assert sorted(map(tuple, ordered.select("id", "n", "skipped", "shared").collect())) == [(1, 3, 1, [2, 3]), (2, 3, 1, [2, 3])]
