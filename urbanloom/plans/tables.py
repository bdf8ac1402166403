"""Reading tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`; a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables and checkpoints go.

    It is `spark.checkpoint.dir` of the session. Where that is unset and the
    session runs on this machine alone, a temporary folder is made; a cluster
    without the setting is refused, as its executors share no local folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "") or (context.getCheckpointDir() or "")
    if folder:
        return folder
    master = context.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="urbanloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(f"file://{folder}")
    return context.getCheckpointDir()


_WRITTEN: list[str] = []


def drop_written(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written; what still reads them fails. Gives their number.

    To be called between jobs of a long session; in any case it happens when the process ends with its session alive."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    count = len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return count


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            drop_written(spark)
    except Exception:  # noqa: BLE001, S110  the session is gone already
        pass


atexit.register(_at_exit)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read again.

    Cuts the lineage, and gives the planner the true size: what is small
    enough is broadcast under spark.sql.autoBroadcastJoinThreshold, what is
    not is shuffled.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` by reliable checkpoint: partitions and their order stay."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with `columns` computed once, in a step of its own.

    A one-row generator keeps the optimiser from copying long expressions into
    every place that uses them, which would outgrow generated code.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with `name`, the place of every row from 0 in the order of `order`, which must be unique.

    Rows are sorted in range partitions, and a partition's first number is the
    sum of the sizes before it, so no task sees more than its share.
    """
    held = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = held.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return placed.join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
