"""Aggregation of records to regions and days.

Every group-by combines partially before the shuffle. Where several distinct
counts are wanted, records are first summed per combination of the counted
columns, so what is counted are combinations, not records; these are shuffled on
all their columns, so a region that holds much of the data is spread over many
tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.columns import age_total, not_null, ratio, round2, with_total
from tallywatch.schema import AGE_COLS


def _band_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in AGE_COLS]


def _with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumn("total_enrolments", age_total()).withColumns(
        {
            "child_ratio": ratio(F.col("age_0_5") + F.col("age_5_17"), F.col("total_enrolments")),
            "adult_ratio": ratio(F.col("age_18_greater"), F.col("total_enrolments")),
        }
    )


def _distinct(col: str, approximate: bool) -> Column:
    return F.approx_count_distinct(col) if approximate else F.count_distinct(col)


def _first_of(keys: Sequence[str], value: str, order: str) -> Column:
    """1 on one row of each value within the keys, else 0; missing values have none."""
    place = F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))
    return F.when((place == 1) & F.col(value).isNotNull(), 1).otherwise(0)


def aggregate_by_state(
    df: DataFrame, approximate: bool = False, counts: bool = True
) -> DataFrame:
    """One row per date and state. `approximate` estimates the distinct counts.

    Exact counts sum up in steps, from (date, state, district, pincode) to
    districts to states; a pincode counts where its first district does. Spark
    cannot leave these steps out when the counts are dropped later: without
    `counts` the sums take one shuffle of what each task has summed.
    """
    keys = ["date", "state"]
    records = not_null(df, keys)
    if not counts:
        return _with_ratios(records.groupBy(*keys).agg(*_band_sums()))
    if approximate:
        grouped = records.groupBy(*keys).agg(
            *_band_sums(),
            _distinct("district", True).alias("district_count"),
            _distinct("pincode", True).alias("pincode_count"),
        )
        return _with_ratios(grouped)
    places = records.groupBy(*keys, "district", "pincode").agg(*_band_sums())
    districts = (
        places.withColumn("pincode_count", _first_of(keys, "pincode", "district"))
        .groupBy(*keys, "district")
        .agg(*_band_sums(), F.sum("pincode_count").alias("pincode_count"))
    )
    grouped = districts.groupBy(*keys).agg(
        *_band_sums(),
        F.count("district").alias("district_count"),
        F.sum("pincode_count").alias("pincode_count"),
    )
    return _with_ratios(grouped)


def aggregate_by_district(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per date, state and district."""
    keys = ["date", "state", "district"]
    grouped = not_null(df, keys).groupBy(*keys).agg(
        *_band_sums(), _distinct("pincode", approximate).alias("pincode_count")
    )
    return _with_ratios(grouped)


def daily_totals(df: DataFrame) -> DataFrame:
    """Sums per date, from records or from any daily table."""
    grouped = not_null(df, ["date"]).groupBy("date").agg(*_band_sums())
    return grouped.withColumn("total_enrolments", age_total())


def demographic_summary(df: DataFrame, group_cols: Sequence[str] | None = None) -> DataFrame:
    """Band sums and their percentages, per group or overall."""
    keys = list(group_cols or [])
    sums = (
        not_null(with_total(df), keys)
        .groupBy(*keys)
        .agg(*_band_sums(), F.sum("total_enrolments").alias("total_enrolments"))
    )
    names = {"age_0_5": "pct_0_5", "age_5_17": "pct_5_17", "age_18_greater": "pct_18_greater"}
    return sums.withColumns(
        {out: round2(ratio(F.col(c), F.col("total_enrolments")) * 100) for c, out in names.items()}
    )


def risk_distribution(df: DataFrame) -> DataFrame:
    """Rows and percentage per risk level."""
    counts = not_null(df, ["risk_level"]).groupBy("risk_level").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("n")).scalar()
    return counts.withColumn("pct", F.col("count") / total * 100)


def kpis(records: DataFrame, scored: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of headline numbers for the records and their scored daily table."""
    rate = F.lit(0.0)
    if "is_anomaly" in scored.columns:
        rate = scored.agg((F.avg(F.col("is_anomaly").cast("double")) * 100).alias("r")).scalar()
    places = records.groupBy("state", "district").agg(
        F.count("*").alias("records"), F.sum(age_total()).alias("enrolments")
    )
    return places.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        F.sum("enrolments").alias("total_enrolments"),
        _distinct("state", approximate).alias("states"),
        _distinct("district", approximate).alias("districts"),
    ).withColumn("anomaly_rate", rate)


def age_totals(df: DataFrame) -> DataFrame:
    """One row per age band: sum and percentage of all enrolments."""
    labels = {"age_0_5": "0-5", "age_5_17": "5-17", "age_18_greater": "18+"}
    sums = df.agg(*_band_sums())
    rows = [F.struct(F.lit(labels[c]).alias("age_group"), F.col(c).alias("total")) for c in AGE_COLS]
    return sums.select(age_total().alias("_all"), F.inline(F.array(*rows))).select(
        "age_group", "total", (ratio(F.col("total"), F.col("_all")) * 100).alias("pct")
    )
