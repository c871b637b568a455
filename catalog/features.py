"""Temporal, demographic and combined features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.core import Query
from catalog.tables import Tables, demographic_sql
from tallywatch.operators import demographic, features, temporal

SERIES = "date state total_enrolments:l"
BY_EVENT = ["date", "event_id"]


def _record_totals(t: Tables) -> DataFrame:
    """Every event record with its total, missing where the total is below 5."""
    total = F.col("age_0_5") + F.col("age_5_17") + F.col("age_18_greater")
    return t.enrol_events.select(
        "date", "state", "event_id", F.when(total >= 5, total).alias("total_enrolments")
    )


RECORD_TOTALS = """
    SELECT date, state, event_id, CASE WHEN total >= 5 THEN total END AS total_enrolments
    FROM (SELECT *, age_0_5 + age_5_17 + age_18_greater AS total FROM enrol_events) AS e"""


def _growth_sql(source: str, group: str, order: str, periods: int = 1, fill: bool = True) -> str:
    part = f"PARTITION BY {group} " if group else ""
    filled = (
        f"last_value(total_enrolments IGNORE NULLS) OVER ({part}ORDER BY {order} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        if fill
        else "total_enrolments"
    )
    return f"""
    SELECT *, filled / nullif(lag(filled, {periods}) OVER ({part}ORDER BY {order}), 0)::DOUBLE - 1
                AS growth_rate
    FROM (SELECT *, {filled} AS filled FROM ({source}) AS s) AS f"""


def _rolling_sql(source: str, group: str, order: str) -> str:
    part = f"PARTITION BY {group} " if group else ""

    def frame(n: int) -> str:
        return f"OVER ({part}ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    return f"""
    SELECT *, volatility / nullif(mean14, 0) AS volatility_cv,
           (ma_short - mean14) / nullif(mean14, 0) AS trend_strength,
           CASE WHEN (ma_short - mean14) / nullif(mean14, 0) > 0.05 THEN 'upward'
                WHEN (ma_short - mean14) / nullif(mean14, 0) < -0.05 THEN 'downward'
                ELSE 'stable' END AS trend_direction
    FROM (SELECT *, stddev_samp(total_enrolments) {frame(14)} AS volatility,
                 avg(total_enrolments) {frame(14)} AS mean14, avg(total_enrolments) {frame(14)} AS ma_long,
                 avg(total_enrolments) {frame(7)} AS ma_short,
                 avg(total_enrolments) {frame(7)} AS rolling_mean
          FROM ({source}) AS s) AS w"""


def _seasonal_sql(source: str) -> str:
    return f"""
    SELECT s.*, month_mean / nullif(overall, 0) AS seasonal_factor,
           total_enrolments / nullif(month_mean, 0) - 1 AS seasonal_deviation
    FROM (SELECT *, month(date) AS month, isodow(date) - 1 AS day_of_week,
                 CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM {source}) AS s
    JOIN (SELECT month(date) AS m, avg(total_enrolments) AS month_mean FROM {source} GROUP BY 1)
      AS months ON month = m,
    (SELECT avg(total_enrolments) AS overall FROM {source}) AS o"""


TOTALS = "SELECT date, state, total_enrolments FROM event_states"
DAILY = "SELECT date, sum(total_enrolments) AS total_enrolments FROM event_states GROUP BY date"
GAPPY = "SELECT * FROM gappy"


def _daily(t: Tables) -> DataFrame:
    return t.event_sums.groupBy("date").agg(F.sum("total_enrolments").alias("total_enrolments"))


TEMPORAL = [
    Query(
        "growth_rate",
        f"{SERIES} growth_rate:d",
        lambda t: temporal.growth_rate(t.event_sums, group_cols=["state"]),
        _growth_sql(TOTALS, "state", "date"),
    ),
    Query(
        "growth_rate_over_gaps",
        f"{SERIES} growth_rate:d",
        lambda t: temporal.growth_rate(t.gappy, group_cols=["state"]),
        _growth_sql(GAPPY, "state", "date"),
    ),
    Query(
        "growth_rate_unfilled_weekly",
        f"{SERIES} growth_rate:d",
        lambda t: temporal.growth_rate(t.gappy, group_cols=["state"], periods=7, fill=None),
        _growth_sql(GAPPY, "state", "date", 7, fill=False),
    ),
    Query(
        "growth_rate_all_records",
        "date event_id total_enrolments:l growth_rate:d",
        lambda t: temporal.growth_rate(
            _record_totals(t), periods=2, order_cols=BY_EVENT, split=True
        ),
        _growth_sql(RECORD_TOTALS, "", "date, event_id", 2),
    ),
    Query(
        "volatility",
        f"{SERIES} volatility:d volatility_cv:d",
        lambda t: temporal.volatility(t.event_sums, group_cols=["state"]),
        _rolling_sql(TOTALS, "state", "date"),
    ),
    Query(
        "volatility_of_total",
        "date total_enrolments:l volatility:d volatility_cv:d",
        lambda t: temporal.volatility(_daily(t)),
        _rolling_sql(DAILY, "", "date"),
    ),
    Query(
        "volatility_state_records",
        "date state event_id volatility:d volatility_cv:d",
        lambda t: temporal.volatility(
            _record_totals(t), group_cols=["state"], order_cols=BY_EVENT, split=True
        ),
        _rolling_sql(RECORD_TOTALS, "state", "date, event_id"),
    ),
    Query(
        "rolling_mean",
        f"{SERIES} rolling_mean:d",
        lambda t: temporal.rolling_mean(t.event_sums, group_cols=["state"]),
        _rolling_sql(TOTALS, "state", "date"),
    ),
    Query(
        "rolling_mean_all_records",
        "date event_id rolling_mean:d",
        lambda t: temporal.rolling_mean(_record_totals(t), order_cols=BY_EVENT, split=True),
        _rolling_sql(RECORD_TOTALS, "", "date, event_id"),
    ),
    Query(
        "trends",
        f"{SERIES} ma_short:d ma_long:d trend_strength:d trend_direction",
        lambda t: temporal.trends(t.order_daily, group_cols=["state"]),
        _rolling_sql("SELECT * FROM order_states", "state", "date"),
    ),
    Query(
        "trends_all_records",
        "date event_id ma_short:d ma_long:d trend_strength:d trend_direction",
        lambda t: temporal.trends(_record_totals(t), order_cols=BY_EVENT, split=True),
        _rolling_sql(RECORD_TOTALS, "", "date, event_id"),
    ),
    Query(
        "trends_by_timestamp",
        "event_id:l ma_short:d ma_long:d trend_strength:d trend_direction",
        lambda t: temporal.trends(
            t.read("events").select(
                "event_id", "ts", "event_type", F.floor("value").cast("long").alias("total_enrolments")
            ),
            group_cols=["event_type"],
            order_cols=["ts", "event_id"],
            split=True,
        ),
        _rolling_sql(
            "SELECT event_id, ts, event_type, floor(value)::BIGINT AS total_enrolments FROM events",
            "event_type",
            "ts, event_id",
        ),
    ),
    Query(
        "series_features_state_records",
        "date state event_id growth_rate:d volatility:d volatility_cv:d ma_short:d ma_long:d "
        "trend_strength:d trend_direction",
        lambda t: temporal.series_features(
            _record_totals(t), group_cols=["state"], order_cols=BY_EVENT, split=True
        ),
        f"SELECT r.*, g.growth_rate FROM ({_rolling_sql(RECORD_TOTALS, 'state', 'date, event_id')}) AS r "
        f"JOIN ({_growth_sql(RECORD_TOTALS, 'state', 'date, event_id')}) AS g USING (event_id)",
    ),
    Query(
        "seasonal_indicator",
        f"{SERIES} month:i day_of_week:i is_weekend:i seasonal_factor:d seasonal_deviation:d",
        lambda t: temporal.seasonal_indicator(t.order_daily),
        _seasonal_sql("order_states"),
    ),
]

_RATIOS = "ratio_0_5:d ratio_5_17:d ratio_18_greater:d"
_TOTALLED = """
    (SELECT *, age_0_5 + age_5_17 + age_18_greater AS total_enrolments FROM enrol_events)"""
DEMOGRAPHIC_SQL = demographic_sql(f"{_TOTALLED} AS enrol_totals")
FLAGS_SQL = f"""
    SELECT *, high_imbalance OR extreme_ratio AS demographic_anomaly
    FROM (SELECT *, coalesce(demographic_imbalance > 0.15, false) AS high_imbalance,
                 coalesce(adult_child_ratio < 0.3 OR adult_child_ratio > 5, false) AS extreme_ratio
          FROM ({DEMOGRAPHIC_SQL}) AS d) AS f"""

DEMOGRAPHIC = [
    Query(
        "age_imbalance",
        f"event_id:l {_RATIOS} dev_0_5:d dev_5_17:d dev_18_greater:d demographic_imbalance:d",
        lambda t: demographic.age_imbalance(t.enrol_events),
        DEMOGRAPHIC_SQL,
    ),
    Query(
        "age_imbalance_custom_ratios",
        "event_id:l dev_0_5:d dev_5_17:d dev_18_greater:d demographic_imbalance:d",
        lambda t: demographic.age_imbalance(
            t.enrol_events, {"age_0_5": 0.15, "age_5_17": 0.30, "age_18_greater": 0.55}
        ),
        DEMOGRAPHIC_SQL.replace("- 0.10", "- 0.15").replace("- 0.25", "- 0.30").replace("- 0.65", "- 0.55"),
    ),
    Query(
        "adult_child_ratio",
        "event_id:l total_children:l adult_child_ratio:d child_dominance",
        lambda t: demographic.adult_child_ratio(t.enrol_events),
        DEMOGRAPHIC_SQL,
    ),
    Query(
        "age_concentration",
        f"event_id:l {_RATIOS} dominant_age_group age_concentration:d",
        lambda t: demographic.age_concentration(t.enrol_events),
        f"""
        SELECT *, ratio_0_5 ** 2 + ratio_5_17 ** 2 + ratio_18_greater ** 2 AS age_concentration,
               CASE WHEN ratio_0_5 > ratio_5_17 AND ratio_0_5 > ratio_18_greater THEN '0-5'
                    WHEN ratio_5_17 > ratio_0_5 AND ratio_5_17 > ratio_18_greater THEN '5-17'
                    ELSE '18+' END AS dominant_age_group
        FROM ({DEMOGRAPHIC_SQL}) AS d""",
    ),
    Query(
        "demographic_anomalies",
        "event_id:l high_imbalance extreme_ratio demographic_anomaly",
        lambda t: demographic.demographic_anomalies(t.enrol_events),
        FLAGS_SQL,
    ),
]

_ENRICHED = demographic_sql("(" + _seasonal_sql("district_windows") + ") AS seasons")
COMBINED = [
    Query(
        "enrich_features",
        "date state district growth_rate:d volatility:d volatility_cv:d seasonal_factor:d "
        "seasonal_deviation:d demographic_imbalance:d adult_child_ratio:d enrolment_zscore:d is_spike",
        lambda t: features.enrich(t.event_districts),
        f"""
        SELECT *, (total_enrolments - avg(total_enrolments) OVER p)
                    / nullif(stddev_pop(total_enrolments) OVER p, 0) AS enrolment_zscore,
               coalesce(abs((total_enrolments - avg(total_enrolments) OVER p)
                    / nullif(stddev_pop(total_enrolments) OVER p, 0)) > 3, false) AS is_spike
        FROM ({_ENRICHED}) AS e WINDOW p AS (PARTITION BY state, district)""",
    ),
]

QUERIES = [*TEMPORAL, *DEMOGRAPHIC, *COMBINED]
