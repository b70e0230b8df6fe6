from pathlib import Path

from pyspark.sql import functions as F

from textloom.session import CLEANUP, materialize


def shuffled(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(f) for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_a_written_table_leaves_no_shuffles(spark):
    before, setting = shuffled(spark), spark.conf.get(CLEANUP)
    rows = spark.range(20_000).repartition(5, "id").groupBy(F.col("id") % 100).count()
    kept = materialize(rows, "grouped")
    assert shuffled(spark) - before == set()
    assert spark.conf.get(CLEANUP) == setting and kept.agg(F.sum("count")).first()[0] == 20_000
