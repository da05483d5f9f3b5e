"""Folders that every executor can reach, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; beside the warehouse only for a local session without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/grapevine-work"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this run of Spark keeps what it writes for its own use."""
    return f"{shared_folder(spark)}/grapevine/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the run's folder that nothing else uses."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession) -> None:
    """Delete all that this run has written for its own use, once its results are read or written elsewhere.

    Tables that jobs keep in the catalog lie in that folder too and are dropped with it.
    """
    folder = run_folder(spark)
    for table in spark.catalog.listTables():
        if table.tableType == "EXTERNAL" and folder in (spark.sql(f"DESCRIBE TABLE EXTENDED `{table.name}`").where("col_name = 'Location'").first() or [""] * 2)[1]:
            spark.sql(f"DROP TABLE `{table.name}`")
    delete(spark, folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at ``path``, in whatever file system it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in whatever file system it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return [status.getPath().toString() for status in found or []]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Between the stages of a long job: let go of plans, broadcasts and shuffle files that nothing uses any more.

    Spark's cleaner learns of them only when the driver collects garbage: Python first, whose frames hold on to plans, then the JVM.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, path: str | None = None, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Results of model calls are paid for, so they are never left as a plan that a second action
    would run again, and a lost executor re-reads the files.
    """
    spark = df.sparkSession
    target = path or new_folder(spark, name)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for loops that would grow the plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows out evenly when their input has fewer files than there are cores.

    Python work per row would otherwise be left to as many tasks as the few files have row groups. Large inputs come in
    many files; they keep their own splits and are not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = len(rows.inputFiles())
    return rows.repartition(cores) if 0 < files < cores else rows


def in_slices(batches: Iterator[pd.Series] | Iterator[pa.Array], rows: int = 256) -> Iterator[pd.Series] | Iterator[pa.Array]:
    """The values of a task's batches, at most ``rows`` at a time.

    A batch may have 10,000 texts, and what Python makes of them can take many times their size. Spark matches results by row, so
    they may come in smaller parts than the values did.
    """
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows) if isinstance(batch, pa.Array) else batch.iloc[first:first + rows]
