"""All features of a daily table in one chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallywatch.operators.demographic import adult_child_ratio, age_imbalance
from tallywatch.operators.outliers import zscore_analysis
from tallywatch.operators.temporal import seasonal_indicator, series_features
from tallywatch.schema import AGE_COLS


def enrich(
    df: DataFrame,
    group_cols: Sequence[str] = ("state", "district"),
    value_col: str = "total_enrolments",
    split: bool | None = None,
) -> DataFrame:
    """Temporal, seasonal, demographic and spike features."""
    groups = list(group_cols)
    df = series_features(df, value_col, groups, split=split, trend=False)
    if "date" in df.columns:
        df = seasonal_indicator(df, value_col=value_col)
    if all(c in df.columns for c in AGE_COLS):
        df = df.transform(age_imbalance).transform(adult_child_ratio)
    df = zscore_analysis(df, value_col, group_cols=groups)
    return df.withColumnsRenamed({"zscore": "enrolment_zscore", "zscore_outlier": "is_spike"})
