"""Summaries that are stored and rolled up, and tables kept up to date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.core import Query
from catalog.tables import Tables
from tallywatch.functions import sketches
from tallywatch.functions.columns import age_total
from tallywatch.functions.scale import new_path, written
from tallywatch.operators import outliers, rollups
from tallywatch.plans import incremental

_SUMS = "age_0_5:l age_5_17:l age_18_greater:l total_enrolments:l"


def _stored_summaries(t: Tables) -> DataFrame:
    return written(rollups.summarise_days(t.enrol_orders), "summaries")


def _near(estimate: str, exact: str):
    """Whether an estimated count lies within three standard errors, or one place of a few."""
    allowed = F.greatest(3 * sketches.distinct_error() * F.col(exact), F.lit(1.0))
    return F.abs(F.col(estimate) - F.col(exact)) <= allowed


def _rolled_up(t: Tables) -> DataFrame:
    """Months and states from stored days, beside the exact counts of the records."""
    month = F.date_format("date", "yyyy-MM").alias("month")
    rolled = rollups.roll_up(_stored_summaries(t), [month, "state"])
    exact = t.enrol_orders.groupBy(month, "state").agg(
        F.count_distinct("district").alias("districts"), F.count_distinct("pincode").alias("pincodes")
    )
    return rolled.join(exact, ["month", "state"]).withColumns(
        {
            "districts_near": _near("district_count", "districts"),
            "pincodes_near": _near("pincode_count", "pincodes"),
        }
    )


def _summary(t: Tables) -> DataFrame:
    found = rollups.summary_row(_stored_summaries(t))
    exact = t.enrol_orders.agg(F.count_distinct("pincode").alias("n")).scalar()
    return found.withColumn("exact", exact).withColumn("pincodes_near", _near("pincodes", "exact"))


_QUARTILES = {f"q{i}": ("total", i / 4) for i in (1, 2, 3)}


def _quartile_ranks(t: Tables) -> DataFrame:
    """Quartiles by state from daily sketches merged, and whether their true ranks are near."""
    records = t.enrol_events.withColumn("total", age_total())
    daily = written(sketches.quantile_sketches(records, ["total"], ["date", "state"]), "sketches")
    merged = sketches.merge_quantile_sketches(daily, ["total"], ["state"])
    found = merged.select(
        "state", *[sketches.sketched_quantile("total_sketch", p).alias(n) for n, (_, p) in _QUARTILES.items()]
    )
    ranks = sketches.rank_bounds(records, found, "total", list(_QUARTILES), ["state"])
    near = F.lit(True)
    for name, (_, p) in _QUARTILES.items():
        near = near & (F.col(f"{name}_below") <= p + sketches.rank_error())
        near = near & (F.col(f"{name}_upto") >= p - sketches.rank_error())
    return ranks.select("state", near.alias("near"))


def _flagged_about(t: Tables) -> DataFrame:
    """Rows beyond the fences of approximate quartiles, against those of exact ones."""
    orders = t.read("orders")
    rough, exact = (
        outliers.iqr_analysis(orders, "o_totalprice", 0.5, approximate=a).agg(
            F.avg(F.col("iqr_outlier").cast("double")).alias("share"), F.count("*").alias("rows")
        )
        for a in (True, False)
    )
    both = rough.crossJoin(exact.select(F.col("share").alias("exact_share")))
    return both.select("rows", (F.abs(F.col("share") - F.col("exact_share")) < 0.05).alias("near"))


def _incremental(t: Tables, name: str) -> DataFrame:
    """A first run without the last days, which then come in; the second run computes these."""
    source, target = new_path(t.spark, "by-date"), new_path(t.spark, "daily-tables")
    late = F.col("date") >= F.lit(dt.date(2024, 1, 29))
    for part in (~late, late):
        rows = t.enrol_events.where(part).repartition("date")
        rows.write.mode("append").partitionBy("date").parquet(source)
        done = incremental.refresh(t.spark, source, target)
    found = incremental.read_table(t.spark, target, name)
    return found.withColumn("second_run", F.col("date").isin(done.computed) if done.computed else F.lit(False))


_LATE = "date >= DATE '2024-01-29' AS second_run"

QUERIES = [
    Query(
        "sketch_rollup_by_month",
        f"month state records:l {_SUMS} districts:l pincodes:l districts_near pincodes_near",
        _rolled_up,
        """
        SELECT strftime(date, '%Y-%m') AS month, state, count(*) AS records, sum(age_0_5) AS age_0_5,
               sum(age_5_17) AS age_5_17, sum(age_18_greater) AS age_18_greater,
               sum(age_0_5 + age_5_17 + age_18_greater) AS total_enrolments,
               count(DISTINCT district) AS districts, count(DISTINCT pincode) AS pincodes,
               true AS districts_near, true AS pincodes_near
        FROM enrol_orders GROUP BY 1, 2""",
    ),
    Query(
        "sketch_summary_row",
        f"date_start date_end states:l records:l {_SUMS} districts:l pincodes_near",
        _summary,
        """
        SELECT min(date) AS date_start, max(date) AS date_end, count(DISTINCT state) AS states,
               count(*) AS records, sum(age_0_5) AS age_0_5, sum(age_5_17) AS age_5_17,
               sum(age_18_greater) AS age_18_greater,
               sum(age_0_5 + age_5_17 + age_18_greater) AS total_enrolments,
               count(DISTINCT district) AS districts, true AS pincodes_near
        FROM enrol_orders""",
    ),
    Query(
        "sketch_quartiles_by_state",
        "state near",
        _quartile_ranks,
        "SELECT DISTINCT state, true AS near FROM enrol_events",
    ),
    Query(
        "iqr_approximate",
        "rows:l near",
        _flagged_about,
        "SELECT count(*) AS rows, true AS near FROM orders",
    ),
    Query(
        "incremental_state_daily",
        f"date state {_SUMS} district_count:l pincode_count:l child_ratio:d second_run",
        lambda t: _incremental(t, "state_daily"),
        f"SELECT *, {_LATE} FROM event_states",
    ),
    Query(
        "incremental_district_daily",
        f"date state district {_SUMS} pincode_count:l second_run",
        lambda t: _incremental(t, "district_daily"),
        f"SELECT *, {_LATE} FROM event_districts",
    ),
    Query(
        "incremental_daily_totals",
        f"date {_SUMS} second_run",
        lambda t: _incremental(t, "daily_totals"),
        f"""
        SELECT date, sum(age_0_5) AS age_0_5, sum(age_5_17) AS age_5_17,
               sum(age_18_greater) AS age_18_greater, sum(total_enrolments) AS total_enrolments, {_LATE}
        FROM event_states GROUP BY date""",
    ),
]
