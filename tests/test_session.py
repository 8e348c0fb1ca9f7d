"""The shared folder, written tables and spreading."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from seamwright import session


def test_written_tables_are_read_by_column(spark):
    df = spark.range(100).withColumn("s", F.concat(F.lit("x"), "id")).withColumn("a", F.array("id"))
    table = session.written(df.where("id % 2 = 0"))
    assert table.count() == 50 and table.columns == ["id", "s", "a"] and "ReadSchema: struct<s:string>" in table.select("s")._jdf.queryExecution().executedPlan().toString()
    assert session.written(df.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        def __getattr__(self, name):
            return lambda *a: self

        def isEmpty(self):
            return True

    context = SimpleNamespace(_jsc=Nothing(), master="spark://somewhere:7077", getConf=lambda: SimpleNamespace(get=lambda name: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(SimpleNamespace(sparkContext=context))


def test_only_small_scans_are_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(scan).rdd.getNumPartitions() == cores and sorted(r["id"] for r in session.spread(scan).collect()) == list(range(50))
    wide = spark.range(50).repartition(2 * cores)
    assert session.spread(wide) is wide
    grouped = scan.groupBy("id").count()
    assert session.spread(grouped) is grouped
    chosen = scan.join(F.broadcast(spark.range(3)), "id", "left_semi")
    assert session.spread(chosen) is chosen and session.spread(chosen, scan).count() == 3
