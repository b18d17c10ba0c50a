"""Arriving tables of the registered streams."""

from pathlib import Path

from pyspark.sql import functions as F

from lotgrid.plans import source_queries as SQ


def test_a_part_that_arrives_is_written_by_all_tasks(spark, tmp_path):
    class Tables:
        @staticmethod
        def table(name):
            return spark.range(4000).withColumnRenamed("id", "l_orderkey").repartition(3, F.col("l_orderkey") % 7)

    Tables.spark = spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    arrive, stream = SQ._arriving(Tables, "lineitem", str(tmp_path))
    assert len(list(Path(tmp_path, "in").glob("*.parquet"))) == 3
    for k in range(1, SQ.STREAM_FILES):
        arrive(k)
    batches = []
    query = stream().writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    query.foreachBatch(lambda df, k: batches.append(df.count())).start().awaitTermination()
    assert batches == [4000]
