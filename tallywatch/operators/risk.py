"""Risk scores, levels and explanations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.columns import not_null, ratio
from tallywatch.functions.ranks import exact_quantiles
from tallywatch.functions.scale import with_row
from tallywatch.schema import (
    AGE_COLS,
    DEFAULT_FEATURE_WEIGHT,
    RISK_FEATURES,
    RISK_THRESHOLDS,
    RISK_WEIGHTS,
)


def _min_max(value: Column, low: Column, high: Column) -> Column:
    """Scale to 0..1; a constant column gives 0.5 for every row."""
    return F.when(low == high, F.lit(0.5)).otherwise((value - low) / F.nullif(high - low, F.lit(0)))


def normalize_feature(
    df: DataFrame, col: str, method: str = "minmax", output: str = "normalized"
) -> DataFrame:
    """Min-max or z-score scaling; the statistics are a one-row scalar subquery."""
    value = F.col(col).cast("double")
    if method == "minmax":
        ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        scaled = _min_max(value, F.col("_s.lo"), F.col("_s.hi"))
        return with_row(df, ends, "_s").withColumn(output, scaled).drop("_s")
    if method == "zscore":
        moments = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
        std = F.col("_s.std")
        scaled = F.when(std == 0, F.lit(0.0)).otherwise(ratio(value - F.col("_s.mean"), std))
        return with_row(df, moments, "_s").withColumn(output, scaled).drop("_s")
    raise ValueError(f"Unknown normalization method: {method}")


def _feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: median of each feature and its range after filling.

    The range of |x| with gaps filled by the median follows from the range of
    |x| and the median, so no second pass over filled values is needed.
    """
    ranges = df.agg(
        *[
            f(F.abs(F.col(c).cast("double"))).alias(f"{name}_{i}")
            for i, c in enumerate(features)
            for f, name in ((F.min, "lo"), (F.max, "hi"))
        ],
        *[F.count_if(F.col(c).isNull()).alias(f"gaps_{i}") for i, c in enumerate(features)],
    )
    medians = exact_quantiles(df, {f"m_{i}": (c, 0.5) for i, c in enumerate(features)})
    out = []
    for i in range(len(features)):
        m = F.col(f"_m.m_{i}")
        fill = F.when(F.col(f"gaps_{i}") > 0, F.abs(m))
        out += [
            m.alias(f"m_{i}"),
            F.least(F.col(f"lo_{i}"), fill).alias(f"lo_{i}"),
            F.greatest(F.col(f"hi_{i}"), fill).alias(f"hi_{i}"),
        ]
    return with_row(ranges, medians, "_m").select(*out)


def risk_score(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    feature_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Weighted mean of the min-max scaled sizes of the risk features present."""
    weights = RISK_WEIGHTS if weights is None else weights
    features = [c for c in (feature_cols or RISK_FEATURES) if c in df.columns]
    if not features:
        return df.withColumn("risk_score", F.lit(0.5))
    scored = with_row(df, _feature_stats(df, features), "_s")
    weighted, total = [], 0.0
    for i, c in enumerate(features):
        weight = weights.get(c, DEFAULT_FEATURE_WEIGHT)
        size = F.abs(F.coalesce(F.col(c).cast("double"), F.col(f"_s.m_{i}")))
        scaled = _min_max(size, F.col(f"_s.lo_{i}"), F.col(f"_s.hi_{i}"))
        weighted.append(scaled * F.lit(weight))
        total += weight
    score = reduce(lambda a, b: a + b, weighted)
    if total > 0:
        score = score / F.lit(total)
    raw = F.col("_raw")
    clipped = F.when(raw < 0, F.lit(0.0)).when(raw > 1, F.lit(1.0)).otherwise(raw)
    return scored.withColumn("_raw", score).withColumn("risk_score", clipped).drop("_s", "_raw")


def classify_risk(
    df: DataFrame, score_col: str = "risk_score", thresholds: dict[str, float] | None = None
) -> DataFrame:
    """Level and tier; a missing score is Unknown, tier 0."""
    t = RISK_THRESHOLDS if thresholds is None else thresholds
    score = F.col(score_col)

    def pick(low, medium, high, critical, unknown) -> Column:
        return (
            F.when(score <= t["low"], low)
            .when(score <= t["medium"], medium)
            .when(score <= t["high"], high)
            .when(score > t["high"], critical)
            .otherwise(unknown)
        )

    return df.withColumns(
        {
            "risk_level": pick("Low", "Medium", "High", "Critical", "Unknown"),
            "risk_tier": pick(1, 2, 3, 4, 0),
        }
    )


def explain_risk(df: DataFrame, output: str = "risk_explanation") -> DataFrame:
    """Readable reasons, from whichever features the table has."""
    v, d, g, s = (
        F.col(c) if c in df.columns else F.lit(None).cast("double")
        for c in ("volatility_cv", "demographic_imbalance", "growth_rate", "seasonal_deviation")
    )
    direction = F.when(g > 0, F.lit("surge")).otherwise(F.lit("drop"))
    reasons = F.concat_ws(
        "; ",
        F.when(v > 0.5, F.format_string("High volatility (CV: %.2f)", v)),
        F.when(d > 0.15, F.format_string("Demographic imbalance detected (%.2f)", d)),
        F.when(
            F.abs(g) > 0.5, F.format_string("Unusual enrolment %s (%.1f%%)", direction, g * 100)
        ),
        F.when(F.abs(s) > 0.3, F.format_string("Seasonal pattern deviation (%.1f%%)", s * 100)),
    )
    return df.withColumn(
        output,
        F.when(reasons == "", F.lit("No significant risk factors identified")).otherwise(reasons),
    )


def high_risk_regions(
    df: DataFrame, risk_col: str = "risk_score", top_n: int = 10, group_col: str = "district"
) -> DataFrame:
    """The regions with the highest mean risk; ties go by name."""
    size = (
        F.sum("total_enrolments") if "total_enrolments" in df.columns else F.count("*")
    ).alias("total_enrolments")
    grouped = not_null(df, [group_col]).groupBy(group_col)
    return (
        grouped.agg(F.avg(risk_col).alias(risk_col), size)
        .orderBy(F.desc_nulls_last(risk_col), group_col)
        .limit(top_n)
    )


def district_risk_score(df: DataFrame) -> DataFrame:
    """Score, level and explanation per district over all its days."""
    if "date" in df.columns:
        keys = ["state", "district"]
        means = [
            F.avg(c).alias(c)
            for c in ("volatility_cv", "growth_rate", "demographic_imbalance")
            if c in df.columns
        ]
        sums = [F.sum(c).alias(c) for c in ("total_enrolments", *AGE_COLS)]
        df = not_null(df, keys).groupBy(*keys).agg(*sums, *means)
    return df.transform(risk_score).transform(classify_risk).transform(explain_risk)
