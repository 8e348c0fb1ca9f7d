"""Sessions and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seamwright")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: the session's spark.checkpoint.dir.

    Only where that is unset and the master is this machine, as in tests, a temporary one is
    made, and removed when the process ends; elsewhere an unset folder is an error.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given:
            if not re.match(r"local(?:\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            given = tempfile.mkdtemp(prefix="seamwright-checkpoints-")
            atexit.register(shutil.rmtree, given, ignore_errors=True)
        sc.setCheckpointDir(given)
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the cluster's shared checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: its lineage is cut, and readers take only their columns.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


_MOVES = re.compile(r"^\W*(?:Join|Aggregate|Sort|Window|Repartition\w*|Rebalance\w*|Distinct|Deduplicate|GlobalLimit|LocalLimit|FlatMapGroups\w*|FlatMapCoGroups\w*)\b", re.M)


def spread(df: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """A scanned table over all cores, for work that is heavy for its size.

    Only a table with fewer parts than the cluster has cores is moved, which is small; larger
    ones, and what has been shuffled already, stay as they are.  ``scanned``: the table ``df``
    is a selection of.
    """
    scanned = df if scanned is None else scanned
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if _MOVES.search(scanned._jdf.queryExecution().optimizedPlan().toString()) or scanned.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)
