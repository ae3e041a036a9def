from __future__ import annotations

from pyspark.sql import functions as F

from quillvec.session import pin


def shuffle_files(spark) -> set[str]:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}


def test_pinned_rows_leave_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    wide = spark.range(1000).withColumn("key", F.col("id") % 7)
    grouped = wide.repartition(3, "id").groupBy("key").agg(F.count("id").alias("n"))
    pinned = pin(grouped.join(wide.hint("merge"), "key"))
    assert not shuffle_files(spark) - before
    assert pinned.count() == 1000
    assert pinned.agg(F.sum("n")).first()[0] == sum(r.n * r.n for r in grouped.collect())


def test_a_table_that_ran_before_it_was_pinned_runs_again(spark):
    rows = spark.range(100).withColumn("key", F.col("id") % 7).groupBy("key").count()
    first = sorted(rows.collect())
    assert sorted(pin(rows).collect()) == first
    assert sorted(pin(rows).collect()) == first
    assert sorted(rows.collect()) == first
