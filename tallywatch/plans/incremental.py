"""Daily tables kept up to date by the days that changed.

All aggregates by date depend on the records of their date alone. Records are
read from Parquet partitioned by date; a day is recomputed when its files are
not those of the last run, and replaces its own partition of each table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.operators import aggregate, rollups
from tallywatch.sources.enrolment import path_exists

TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "state_daily": aggregate.aggregate_by_state,
    "district_daily": aggregate.aggregate_by_district,
    "daily_totals": aggregate.daily_totals,
    "summaries": rollups.summarise_days,
}


@dataclass(frozen=True)
class Refresh:
    """The days that a run computed, and those whose records are gone."""

    computed: list[dt.date]
    removed: list[dt.date]


def source_days(records: DataFrame) -> DataFrame:
    """(date, state): a digest of the names, sizes and times of each day's files.

    Reads no column of the records: the date comes from the folder names, the rest from the listing.
    """
    file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = records.select("date", file.alias("f")).where("date is not null").distinct()
    return files.groupBy("date").agg(
        F.count("*").alias("files"), F.bit_xor(F.xxhash64("f")).alias("digest")
    )


def _remove_days(spark: SparkSession, table: str, days: list[dt.date]) -> None:
    for day in days:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/date={day}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def refresh(
    spark: SparkSession,
    source: str,
    target: str,
    tables: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> Refresh:
    """Bring the tables in `target` up to date with the records in `source`.

    `source` is a Parquet folder partitioned by date. The list of days is as
    long as the calendar. The digests are stored last: a run that fails half
    way is done again by the next, with the same result.
    """
    tables = TABLES if tables is None else tables
    records = spark.read.parquet(source).withColumn("date", F.col("date").cast("date"))
    now = written(source_days(records), "source-days")
    log = f"{target}/source_days"
    before = spark.read.parquet(log) if path_exists(spark, log) else now.limit(0)
    both = now.alias("n").join(before.alias("b"), "date", "full")
    same = F.col("n.digest").eqNullSafe(F.col("b.digest")) & F.col("n.files").eqNullSafe(F.col("b.files"))
    changes = both.where(~same).select("date", F.col("n.files").isNull().alias("gone")).collect()
    computed = sorted(r["date"] for r in changes if not r["gone"])
    removed = sorted(r["date"] for r in changes if r["gone"])
    if computed:
        # A filter on the partition column: other days' files are not opened.
        days = records.where(F.col("date").isin(computed))
        for name, build in tables.items():
            writer = build(days).repartition("date").write.partitionBy("date")
            writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{target}/{name}")
    for name in tables:
        _remove_days(spark, f"{target}/{name}", removed)
    if changes:
        now.write.mode("overwrite").parquet(log)
    return Refresh(computed, removed)


def read_table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table that `refresh` keeps."""
    found = spark.read.parquet(f"{target}/{name}")
    return found.withColumn("date", F.col("date").cast("date"))
