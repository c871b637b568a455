"""The full analysis: records in, scored state table and district table out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallywatch.functions.scale import written
from tallywatch.operators import aggregate, demographic, iforest, reports, risk, temporal
from tallywatch.operators.clean import clean_data, validate_data
from tallywatch.schema import PIPELINE_FEATURES
from tallywatch.sources.enrolment import data_summary, write_csv

BY_STATE = ["state"]


def state_features(state_daily: DataFrame) -> DataFrame:
    """Temporal and demographic features; all windows share one sort."""
    return (
        temporal.series_features(state_daily, group_cols=BY_STATE)
        .transform(demographic.age_imbalance)
        .transform(demographic.adult_child_ratio)
    )


def score_states(features: DataFrame) -> DataFrame:
    return features.transform(risk.risk_score).transform(risk.classify_risk)


def state_risk(records: DataFrame, counts: bool = False) -> DataFrame:
    """Risk level per state and day; `counts` adds the distinct districts and pincodes.

    The daily table is small next to the records but read several times, so it
    is stored once; the records are scanned a single time. The scores need sums
    alone, which take one shuffle of what each task has summed.
    """
    daily = written(aggregate.aggregate_by_state(records, counts=counts), "state-daily")
    return daily.transform(state_features).transform(score_states)


@dataclass(frozen=True)
class Analysis:
    validation: DataFrame
    state_analysis: DataFrame
    district_daily: DataFrame
    risk_distribution: DataFrame
    anomaly_summary: DataFrame
    top_anomalies: DataFrame
    data_summary: DataFrame
    age_totals: DataFrame


def run_full_analysis(
    raw: DataFrame,
    feature_cols: Sequence[str] = PIPELINE_FEATURES,
    contamination: float | None = None,
    output_dir: str | None = None,
) -> Analysis:
    """Clean, check, aggregate, add features, detect anomalies, score.

    The raw rows are read once: cleaned records are stored, and what follows
    reads the columns it needs of them.
    """
    records = written(clean_data(raw), "clean-records")
    daily = written(aggregate.aggregate_by_state(records), "state-daily")
    features = state_features(daily)
    cols = [c for c in feature_cols if c in features.columns]
    flagged = written(iforest.detect_anomalies(features, cols, contamination), "state-flagged")
    states = score_states(flagged)
    districts = written(aggregate.aggregate_by_district(records), "district-daily")
    if output_dir:
        write_csv(states.orderBy("date", "state"), f"{output_dir}/state_analysis")
        write_csv(districts.orderBy("date", "state", "district"), f"{output_dir}/district_analysis")
    return Analysis(
        validation=validate_data(records),
        state_analysis=states,
        district_daily=districts,
        risk_distribution=aggregate.risk_distribution(states),
        anomaly_summary=reports.anomaly_summary(flagged),
        top_anomalies=reports.top_anomalies(flagged),
        data_summary=data_summary(records),
        # Sums over the days equal sums over the records; no further scan of those.
        age_totals=aggregate.age_totals(daily),
    )
