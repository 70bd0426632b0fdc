"""The parts in which a table is written for a stream."""

from pyspark.sql import functions as F

from registry.base import Tables
from registry.streams import files_of, stream_of


def test_parts_grow_by_files_and_stay_apart(spark, tmp_path):
    rows = spark.range(0, 6400, 1, 64).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    limits = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in limits:
        spark.conf.set(k, "4096")
    try:
        stream = stream_of(Tables(spark, str(tmp_path)), "documents", "doc_id", batches=2)
    finally:
        for k, v in limits.items():
            spark.conf.set(k, v)
    seen = []

    def look(df, _):
        seen.append((df.select(F.input_file_name()).distinct().count(), *df.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()))

    stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(look).start().awaitTermination()
    first, second = seen
    assert first[0] == second[0] > 8  # no task writes more than a few splits of the table
    assert first[2] < second[1]
    assert first[3] + second[3] == 6400


def test_few_rows_leave_no_file_empty(spark):
    few = spark.range(0, 40, 1, 8)
    assert files_of(few, [F.col("id") < 9, F.col("id") >= 9]) == 1
