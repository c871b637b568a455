"""The tables behind the dashboard's tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.operators import aggregate, alerts, forecast, geo, iforest, reports
from tallywatch.operators.clean import clean_data
from tallywatch.plans.pipeline import score_states, state_features
from tallywatch.schema import PIPELINE_FEATURES

FORECAST_DAYS = 30
ALERTS_SHOWN = 20


def latest_alerts(found: DataFrame, n: int = ALERTS_SHOWN) -> DataFrame:
    """The first alerts in date order, as the alert tab lists them."""
    rule = F.col("metadata")["rule"]
    return found.orderBy("timestamp", "region", rule).limit(n)


def dashboard_tables(
    raw: DataFrame, run_anomaly: bool = True, contamination: float | None = None
) -> dict[str, DataFrame]:
    """One table per view; the raw records are read once and stored as cleaned."""
    records = written(clean_data(raw), "clean-records")
    daily = written(aggregate.aggregate_by_state(records), "state-daily")
    states = score_states(state_features(daily))
    if run_anomaly:
        states = iforest.detect_anomalies(states, list(PIPELINE_FEATURES), contamination)
    states = written(states, "state-scored")
    found = alerts.process(states)
    # Sums over days do not need the records again.
    history, ahead = forecast.forecast_total(daily, FORECAST_DAYS)
    tables = {
        "kpis": aggregate.kpis(records, states),
        "risk_map": geo.risk_map(states),
        "enrolment_map": geo.enrolment_map(states),
        "child_ratio_map": geo.child_ratio_map(states),
        "trend": aggregate.daily_totals(states),
        "risk_levels": aggregate.risk_distribution(states),
        "history": history,
        "forecast": ahead,
        "alert_summary": alerts.summary(found),
        "alerts": latest_alerts(found),
        "age_totals": aggregate.age_totals(daily),
    }
    if run_anomaly:
        tables["anomaly_map"] = geo.anomaly_map(states)
        tables["anomalies"] = reports.anomaly_table(states)
    return tables
