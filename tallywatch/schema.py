"""Record schemas, column names and default parameters."""

from __future__ import annotations

from pyspark.sql import types as T

AGE_COLS = ("age_0_5", "age_5_17", "age_18_greater")
KEY_COLS = ("date", "state", "district", "pincode")
RECORD_COLS = KEY_COLS + AGE_COLS
CRITICAL_COLS = ("date", "state", "district")

# CSV text as it arrives; `date` is parsed day-first after the read.
CSV_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in KEY_COLS]
    + [T.StructField(c, T.LongType()) for c in AGE_COLS]
)

RECORD_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in KEY_COLS[1:]]
    + [T.StructField(c, T.LongType()) for c in AGE_COLS]
)

# Default parameters.
ROLLING_WINDOW = 7
VOLATILITY_WINDOW = 14
CONTAMINATION = 0.05
ZSCORE_THRESHOLD = 3.0
RISK_WEIGHTS = {
    "growth_rate_anomaly": 0.25,
    "volatility_score": 0.20,
    "demographic_imbalance": 0.25,
    "seasonal_deviation": 0.15,
    "statistical_outlier": 0.15,
}
RISK_FEATURES = (
    "volatility_cv",
    "demographic_imbalance",
    "growth_rate",
    "seasonal_deviation",
)
DEFAULT_FEATURE_WEIGHT = 0.2
EXPECTED_RATIOS = {"age_0_5": 0.10, "age_5_17": 0.25, "age_18_greater": 0.65}
RISK_THRESHOLDS = {"low": 0.3, "medium": 0.6, "high": 0.8}
ANOMALY_FEATURES = (
    "total_enrolments",
    "growth_rate",
    "volatility_cv",
    "demographic_imbalance",
    "adult_child_ratio",
)
PIPELINE_FEATURES = ANOMALY_FEATURES[:4]
