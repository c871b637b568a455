"""Age-band features: plain column arithmetic, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.columns import flag, ratio, with_total
from tallywatch.schema import AGE_COLS, EXPECTED_RATIOS

_SUFFIX = {c: c.removeprefix("age_") for c in AGE_COLS}


def _with_ratios(df: DataFrame) -> DataFrame:
    df = with_total(df)
    return df.withColumns(
        {f"ratio_{s}": ratio(F.col(c), F.col("total_enrolments")) for c, s in _SUFFIX.items()}
    )


def age_imbalance(df: DataFrame, expected_ratios: dict[str, float] | None = None) -> DataFrame:
    """Mean absolute deviation of the age shares from the expected shares."""
    expected = EXPECTED_RATIOS if expected_ratios is None else expected_ratios
    df = _with_ratios(df).withColumns(
        {f"dev_{s}": F.abs(F.col(f"ratio_{s}") - expected[c]) for c, s in _SUFFIX.items()}
    )
    deviations = F.col("dev_0_5") + F.col("dev_5_17") + F.col("dev_18_greater")
    return df.withColumn("demographic_imbalance", deviations / 3)


def adult_child_ratio(df: DataFrame) -> DataFrame:
    """Adults per child, capped at 100, and which side dominates."""
    raw = ratio(F.col("age_18_greater"), F.col("total_children"))
    value = F.col("adult_child_ratio")
    return (
        df.withColumn("total_children", F.col("age_0_5") + F.col("age_5_17"))
        .withColumn("adult_child_ratio", F.when(raw > 100, F.lit(100.0)).otherwise(raw))
        .withColumn(
            "child_dominance",
            F.when(value < 0.5, "high").when(value > 2, "low").otherwise("normal"),
        )
    )


def age_concentration(df: DataFrame) -> DataFrame:
    """The strictly largest age group (a tie gives 18+) and the Herfindahl index."""
    young, middle, old = (F.col(f"ratio_{s}") for s in _SUFFIX.values())
    return _with_ratios(df).withColumns(
        {
            "dominant_age_group": F.when((young > middle) & (young > old), "0-5")
            .when((middle > young) & (middle > old), "5-17")
            .otherwise("18+"),
            "age_concentration": young * young + middle * middle + old * old,
        }
    )


def demographic_anomalies(df: DataFrame, imbalance_threshold: float = 0.15) -> DataFrame:
    """Flags for strong imbalance and for extreme adult to child ratios."""
    if "demographic_imbalance" not in df.columns:
        df = age_imbalance(df)
    if "adult_child_ratio" not in df.columns:
        df = adult_child_ratio(df)
    value = F.col("adult_child_ratio")
    return df.withColumns(
        {
            "high_imbalance": flag(F.col("demographic_imbalance") > imbalance_threshold),
            "extreme_ratio": flag((value < 0.3) | (value > 5)),
        }
    ).withColumn("demographic_anomaly", F.col("high_imbalance") | F.col("extreme_ratio"))
