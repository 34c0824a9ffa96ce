"""Stages: tables written once and read again, to resume a run or to cut lineage."""

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Spark deletes a query's shuffle files at its end; a table that is written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a task hands to Python at once: texts are long, and both sides hold a batch.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: And bytes: rows alone bound nothing where single texts are very long.
BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
#: Rows of both sides of a join that a task sorts, where no key has more. At under 200 tasks the writers of a shuffle hold no rows.
ROWS_A_TASK = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where that is unset in local mode."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tessaxis-"))
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended
        _delete(spark, path)


@contextmanager
def _settings(spark: SparkSession):
    """The session's settings while a table is written."""
    before = {name: spark.conf.get(name, None) for name in (CLEANUP, BATCH, BYTES)}
    rows = int(before[BATCH] or 10000)
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    if before[BYTES] is None:
        spark.conf.set(BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def merged(df: DataFrame) -> DataFrame:
    """df as one side of a join by sorting. Spark would send a table to all tasks by its packed size, and unpacked it may not fit the driver."""
    return df.hint("merge")


def spread(df: DataFrame, *on: str) -> DataFrame:
    """df dealt out to as many tasks as a shuffle has, by columns or evenly. Neither packed files and shuffles, whose small bytes Spark puts into few tasks, nor their growth decide how much a task holds."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


def dealt(df: DataFrame, rows: int, *on: str) -> DataFrame:
    """df as a side of a join by columns that sorts so many rows in all: left to Spark, or dealt out where the tasks of a shuffle would sort over ROWS_A_TASK each."""
    tasks = -(-rows // ROWS_A_TASK)
    return df.repartition(tasks, *on) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which goes when the program ends."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with _settings(spark):
        df.write.parquet(path)
    atexit.register(_delete_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if not re.fullmatch(r".*/[0-9a-f]{32}", folder):
                raise ValueError(f"{folder} is no table of written()")
            _delete(df.sparkSession, folder)


def _complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, or what build() gives, written there. A path names its parameters; what lacks the writer's success mark or can't be read is built again."""
    if not force and _complete(spark, path):
        with suppress(AnalysisException):
            return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
