"""Daily regional summaries that are stored once and rolled up without the records.

A summary row holds the sums of a day and region, and sketches of the places
counted in it. Sums add up and sketches merge, so totals of months, states or
the whole history come from the summary rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.columns import age_total, not_null, ratio
from tallywatch.functions.sketches import LG_K, distinct_estimate, distinct_sketch
from tallywatch.schema import AGE_COLS

PLACES = ("district", "pincode")


def summarise_days(
    df: DataFrame, keys: Sequence[str] = ("date", "state"), lg_k: int = LG_K
) -> DataFrame:
    """One row per key: records, band sums, total, and sketches of districts and pincodes.

    Combines per task before its one shuffle; what is shuffled of a key is a
    few kilobytes a task, however many records it has.
    """
    sums = [F.sum(c).alias(c) for c in AGE_COLS]
    places = [distinct_sketch(c, lg_k).alias(f"{c}_sketch") for c in PLACES]
    grouped = not_null(df, keys).groupBy(*keys)
    found = grouped.agg(F.count("*").alias("records"), *sums, *places)
    return found.withColumn("total_enrolments", age_total())


def _totals() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("records", *AGE_COLS, "total_enrolments")]


def roll_up(summaries: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """Summaries added up to coarser keys, with estimated district and pincode counts."""
    counts = [distinct_estimate(f"{c}_sketch").alias(f"{c}_count") for c in PLACES]
    return summaries.groupBy(*keys).agg(*_totals(), *counts).withColumns(
        {
            "child_ratio": ratio(F.col("age_0_5") + F.col("age_5_17"), F.col("total_enrolments")),
            "adult_ratio": ratio(F.col("age_18_greater"), F.col("total_enrolments")),
        }
    )


def summary_row(summaries: DataFrame) -> DataFrame:
    """The headline row of all records: counts, date range, sums, distinct places."""
    counts = [distinct_estimate(f"{c}_sketch").alias(f"{c}s") for c in PLACES]
    return summaries.agg(
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
        F.count_distinct("state").alias("states"),
        *counts,
        *_totals(),
    )
