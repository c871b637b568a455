"""Tables of the reports and of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.columns import not_null, ratio

REPORT_COLS = (
    "date",
    "state",
    "district",
    "total_enrolments",
    "risk_score",
    "risk_level",
    "anomaly_score",
    "risk_explanation",
)
NOT_AVAILABLE = "N/A"


def _metrics(df: DataFrame, rows: list[tuple[str, Column | None]]) -> DataFrame:
    """(metric, value) rows from a single aggregation; None reads N/A."""
    known = [(i, c) for i, (_, c) in enumerate(rows) if c is not None]
    facts = df.agg(*[c.cast("string").alias(f"v{i}") for i, c in known])
    have = {i for i, _ in known}
    out = [
        F.struct(
            F.lit(name).alias("metric"),
            (F.col(f"v{i}") if i in have else F.lit(NOT_AVAILABLE)).alias("value"),
        )
        for i, (name, _) in enumerate(rows)
    ]
    return facts.select(F.inline(F.array(*out)))


def summary_sheet(df: DataFrame) -> DataFrame:
    """Nine headline metrics; those without their column read N/A."""

    def when_present(col: str, agg: Column) -> Column | None:
        return agg if col in df.columns else None

    return _metrics(
        df,
        [
            ("Total Records", F.count("*")),
            ("Date Range Start", when_present("date", F.min("date"))),
            ("Date Range End", when_present("date", F.max("date"))),
            ("Unique States", when_present("state", F.count_distinct("state"))),
            ("Unique Districts", when_present("district", F.count_distinct("district"))),
            ("Total Enrolments", when_present("total_enrolments", F.sum("total_enrolments"))),
            (
                "Avg Risk Score",
                when_present("risk_score", F.format_string("%.3f", F.avg("risk_score"))),
            ),
            (
                "High Risk Records",
                when_present("risk_level", F.count_if(F.col("risk_level").isin("High", "Critical"))),
            ),
            ("Anomalies Detected", when_present("is_anomaly", F.count_if("is_anomaly"))),
        ],
    )


def _anomalies(df: DataFrame) -> DataFrame:
    if "is_anomaly" not in df.columns:
        raise ValueError("DataFrame must contain anomaly detection results")
    return df.where("is_anomaly")


def _tie_break(df: DataFrame) -> list[str]:
    return [c for c in ("date", "state", "district") if c in df.columns]


def anomalies_report(df: DataFrame, top_n: int = 100) -> DataFrame:
    """The worst anomalies with the report's columns."""
    rows = _anomalies(df)
    score = [F.desc_nulls_last("anomaly_score")] if "anomaly_score" in df.columns else []
    top = rows.orderBy(*score, *_tie_break(df)).limit(top_n)
    return top.select(*[c for c in REPORT_COLS if c in df.columns])


def anomalies_summary(df: DataFrame) -> DataFrame:
    """Four (metric, value) rows about the anomalies."""
    if "is_anomaly" not in df.columns:
        raise ValueError("DataFrame must contain anomaly detection results")
    hit = F.col("is_anomaly")
    score = state = None
    if "anomaly_score" in df.columns:
        mean = F.avg(F.when(hit, F.col("anomaly_score")))
        score = F.coalesce(F.format_string("%.3f", mean), F.lit("nan"))
    if "state" in df.columns:
        state = F.count_distinct(F.when(hit, F.col("state")))
    return _metrics(
        df,
        [
            ("Total Anomalies", F.count_if(hit)),
            ("Anomaly Rate", F.format_string("%.2f%%", F.avg(hit.cast("double")) * 100)),
            ("Avg Anomaly Score", score),
            ("States Affected", state),
        ],
    )


def top_anomaly_states(df: DataFrame, n: int = 5) -> DataFrame:
    """The regions with the most anomalies."""
    counts = not_null(_anomalies(df), ["state"]).groupBy("state").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "state").limit(n)


def top_risk_states(df: DataFrame, n: int = 10) -> DataFrame:
    """The regions with the highest mean risk, with their row counts."""
    grouped = not_null(df, ["state"]).groupBy("state")
    means = grouped.agg(F.avg("risk_score").alias("risk_score"), F.count("*").alias("count"))
    return means.orderBy(F.desc_nulls_last("risk_score"), "state").limit(n)


def anomaly_table(df: DataFrame, n: int = 20) -> DataFrame:
    """The worst anomalies with all their columns, for display."""
    return (
        _anomalies(df).orderBy(F.desc_nulls_last("anomaly_score"), *_tie_break(df)).limit(n)
    )


def anomaly_summary(df: DataFrame) -> DataFrame:
    """One row: rows, anomalies, rate in percent, mean score of the anomalies."""
    if "is_anomaly" not in df.columns:
        raise ValueError("No anomaly detection results found")
    hit = F.col("is_anomaly")
    return df.agg(
        F.count("*").alias("total_records"),
        F.count_if(hit).alias("anomaly_count"),
        (ratio(F.count_if(hit), F.count("*")) * 100).alias("anomaly_rate"),
        F.coalesce(F.avg(F.when(hit, F.col("anomaly_score"))), F.lit(0.0)).alias(
            "avg_anomaly_score"
        ),
    )


def top_anomalies(df: DataFrame, n: int = 10) -> DataFrame:
    """The worst anomalies by region and score; empty if there are none."""
    shown = [c for c in ("state", "district") if c in df.columns]
    top = _anomalies(df).orderBy(F.desc_nulls_last("anomaly_score"), *_tie_break(df)).limit(n)
    return top.select(*shown, "anomaly_score")
