"""Size checks, shared-storage tables and size-aware joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_INPUT_CONF = "spark.tallywatch.smallInputBytes"
SMALL_INPUT_BYTES = 32 * 1024 * 1024
SMALL_INPUT_ROWS = 2_000_000

_MULTIPLIES = re.compile(
    r"^\W*(Generate|Expand|MapInPandas|MapInArrow|PythonMapInArrow|FlatMap\w*|MapPartitions\w*) ",
    re.MULTILINE,
)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan; starts no job.

    Without column statistics Catalyst never assumes that a filter or an
    aggregate shrinks its input, so the estimate errs on the large side.
    """
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


@lru_cache(maxsize=1024)
def _parquet_rows(spark: SparkSession, files: tuple[str, ...]) -> int:
    """Rows of Parquet files, from their footers; Spark names new parts anew."""
    return spark.read.parquet(*files).count()


def is_small(df: DataFrame) -> bool:
    """Whether `df` fits in one task; a choice of plan, never of results.

    It does if the estimate is low, nothing in the plan can multiply rows, as the
    estimate does not see that, and the Parquet files it reads hold few rows
    however well they are compressed.
    """
    spark = df.sparkSession
    if estimated_bytes(df) > int(spark.conf.get(SMALL_INPUT_CONF, str(SMALL_INPUT_BYTES))):
        return False
    if _MULTIPLIES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return False
    files = tuple(f for f in sorted(df.inputFiles()) if f.endswith(".parquet"))
    return not files or _parquet_rows(spark, files) <= SMALL_INPUT_ROWS


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every node can reach."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    set_by_user = spark.sparkContext.getCheckpointDir()
    if set_by_user:
        return set_by_user.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="tallywatch-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tallywatch/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove_written(spark: SparkSession) -> None:
    """Delete this application's stored tables, once its results are saved."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to shared storage and read it back.

    Cuts the lineage, so a lost executor costs no recomputation of the input,
    and gives Catalyst the true size for its later join choices.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Add the columns of a one-row table to every row, as struct `name`.

    The row is a scalar subquery: computed once, then a constant to each task.
    Holding it in a column keeps the plan from repeating it at every use.
    """
    return df.withColumn(name, row.select(F.struct("*").alias(name)).scalar())


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join per-group statistics of `df` back to its rows.

    Spark picks the join. On larger inputs the statistics are written first, so
    that it knows their size: it broadcasts them only if that allows it and else
    uses a sort-merge join, whose hot keys adaptive execution splits.
    """
    keys = list(keys)
    if not is_small(df):
        stats = written(stats, "group-stats")
    return df.join(stats, keys, "left")
