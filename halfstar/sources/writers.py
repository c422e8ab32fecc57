"""Sinks: header CSV, parquet, JSON and text."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from halfstar.session import scratch_base, scratch_path


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Overwrite ``path`` with header CSV. ``single_file`` is for small result tables."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_split(train: DataFrame, test: DataFrame, folder: str, fmt: str = "csv") -> tuple[str, str]:
    """Write both halves of a split and return their paths."""
    paths = (f"{folder}/train", f"{folder}/test")
    for half, path in zip((train, test), paths):
        half.write.mode("overwrite").option("header", True).format(fmt).save(path)
    return paths


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str) -> None:
    """Write a one-column frame of text, in its own order."""
    lines.write.mode("overwrite").text(path)


_COMMIT = "batch string, attempt string"


def _commit_path(path: str, batch: str) -> str:
    return f"{path}/commits/{hashlib.sha256(batch.encode()).hexdigest()}"


def append_runs(runs: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append runs to a parquet run log, at most once per ``batch``; false if that batch is there already.

    The runs are written as an attempt of their own, which readers don't see until a
    commit names it. An append that was killed, before or after its commit, can be
    repeated with the same ``batch``: the runs are in the log once. Without ``batch``
    every call appends. Two writers of one batch at the same moment are not kept apart.
    """
    spark, batch, attempt = runs.sparkSession, batch or uuid.uuid4().hex, uuid.uuid4().hex
    if batch_committed(spark, path, batch):
        return False
    runs.write.parquet(f"{path}/attempts/attempt={attempt}")
    commit = spark.createDataFrame([(batch, attempt)], _COMMIT).coalesce(1)
    # A commit whose writer was killed is an empty folder, to be written again.
    commit.write.mode("overwrite").parquet(_commit_path(path, batch))
    return True


def batch_committed(spark: SparkSession, path: str, batch: str) -> bool:
    try:
        return not spark.read.schema(_COMMIT).parquet(_commit_path(path, batch)).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def read_runs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The committed runs of a run log; attempts without a commit are no part of it."""
    commits = spark.read.schema(_COMMIT).option("recursiveFileLookup", True).parquet(f"{path}/commits").select("attempt").distinct()
    attempts = spark.read.schema(StructType([*schema.fields, StructField("attempt", StringType())])).parquet(f"{path}/attempts")
    return attempts.join(commits, "attempt", "left_semi").select(*schema.names)


def store_split(train: DataFrame, test: DataFrame, buckets: int = 200, name: str = "split") -> tuple[DataFrame, DataFrame]:
    """Both halves stored in ``buckets`` by user, each sorted by user, as tables of the session's catalogue.

    Windows, aggregates and joins by user on them need no shuffle. The files are in
    the scratch folder. A user's ratings are in one bucket, so buckets are as uneven
    as users are. Joins on user and item go without a shuffle of these halves only if
    ``spark.sql.requireAllClusterKeysForCoPartition`` is false.
    """
    spark, stamp, stored = train.sparkSession, uuid.uuid4().hex, []
    for half, df in (("train", train), ("test", test)):
        table = f"{name}_{half}_{stamp}"
        writer = df.repartition(buckets, "userId").write.format("parquet").option("path", scratch_path(spark, table))
        writer.bucketBy(buckets, "userId").sortBy("userId").saveAsTable(table)
        stored.append(spark.table(table))
    return stored[0], stored[1]


def materialise_bucketed(df: DataFrame, name: str, buckets: int, key: str, *partition_by: str) -> DataFrame:
    """:func:`materialise` for a table already hashed by ``key`` into so many partitions, as a table in as many buckets.

    Each task writes its own bucket, and grouping, windows and joins by ``key`` on the result need no shuffle.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", scratch_path(spark, table)).bucketBy(buckets, key)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
    return spark.table(table).select(*df.columns)


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and scan it from there.

    Cuts the lineage of a table that several later jobs read: it survives lost
    executors and is not computed again for each of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` wrote, once a later one took its place and nothing reads it any more.

    Only what is in one folder right below the scratch folder is deleted.
    """
    files = df.inputFiles()
    if files:
        hadoop, conf = df.sparkSession._jvm.org.apache.hadoop.fs, df.sparkSession._jsc.hadoopConfiguration()
        path, base = hadoop.Path(files[0]), hadoop.Path(scratch_base(df.sparkSession))
        system = path.getFileSystem(conf)
        base = system.makeQualified(base)
        while path.getParent() is not None and not path.getParent().equals(base):
            path = path.getParent()
        if path.getParent() is not None:
            system.delete(path, True)


def side_by_side(parts: list[DataFrame], function: Callable, schema: str) -> DataFrame:
    """``function`` over the Arrow batches and the number of each of ``parts``, each in one task, without a shuffle.

    Parts are scans of files, and several may read the same files. A part must be
    small enough for a task.
    """
    # Spark 4.1 zips a union of single partitions into one task unless a branch has another partitioning: a range of nothing has.
    tasks = [parts[0].sparkSession.range(0).mapInArrow(lambda batches: iter(()), schema)]
    for at, part in enumerate(parts):
        tasks.append(part.coalesce(1).mapInArrow(lambda batches, at=at: function(batches, at), schema))
    return reduce(DataFrame.unionAll, tasks)
