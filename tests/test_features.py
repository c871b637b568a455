import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywatch.operators import demographic, features, risk, temporal

VALUES = [100, 110, 105, 115, 120, 125, 130, 128, 135, 140]
DAYS = [dt.date(2025, 1, 1) + dt.timedelta(days=i) for i in range(10)]


@pytest.fixture
def series(spark):
    rows = [(d, "State A", v) for d, v in zip(DAYS, VALUES)]
    return spark.createDataFrame(rows, "date date, state string, total_enrolments bigint")


@pytest.fixture
def bands(spark):
    rows = [("A", 100, 250, 650), ("B", 150, 300, 550), ("C", 80, 200, 720)]
    return spark.createDataFrame(
        rows, "state string, age_0_5 bigint, age_5_17 bigint, age_18_greater bigint"
    )


@pytest.fixture
def risky(spark):
    rows = [
        ("A", 0.1, 0.05, 0.02, 0.05),
        ("B", 0.5, 0.15, 0.40, 0.20),
        ("C", 0.3, 0.10, 0.10, 0.10),
        ("D", 0.8, 0.25, 0.75, 0.45),
    ]
    return spark.createDataFrame(
        rows,
        "state string, volatility_cv double, demographic_imbalance double, "
        "growth_rate double, seasonal_deviation double",
    )


def test_growth_rate(series):
    rows = temporal.growth_rate(series).orderBy("date").collect()
    assert rows[0].growth_rate is None
    assert sum(r.growth_rate is not None for r in rows) == 9
    assert rows[1].growth_rate == pytest.approx(0.1)


def test_growth_rate_by_group(series):
    both = series.unionByName(series.withColumn("state", F.lit("State B")))
    rows = temporal.growth_rate(both, group_cols=["state"]).collect()
    assert len(rows) == 20
    assert sum(r.growth_rate is None for r in rows) == 2


def test_growth_rate_carries_values_over_gaps(spark):
    data = list(zip(DAYS[:5], [100, None, 120, None, 140]))
    df = spark.createDataFrame(data, "date date, total_enrolments bigint")
    rates = [r.growth_rate for r in temporal.growth_rate(df).orderBy("date").collect()]
    assert rates[0] is None
    assert rates[1:] == pytest.approx([0.0, 0.2, 0.0, 140 / 120 - 1])


def test_growth_after_zero_is_null(spark):
    df = spark.createDataFrame(
        list(zip(DAYS[:3], [0, 5, 10])), "date date, total_enrolments bigint"
    )
    rates = [r.growth_rate for r in temporal.growth_rate(df).orderBy("date").collect()]
    assert rates == [None, None, 1.0]


def test_rows_without_group_have_no_growth(spark):
    df = spark.createDataFrame(
        [(DAYS[0], None, 1), (DAYS[1], None, 2)], "date date, state string, total_enrolments bigint"
    )
    rows = temporal.growth_rate(df, group_cols=["state"]).collect()
    assert [r.growth_rate for r in rows] == [None, None]


def test_volatility(series):
    rows = temporal.volatility(series, window=3).orderBy("date").collect()
    assert rows[0].volatility is None
    assert rows[2].volatility == pytest.approx(5.0)
    assert rows[2].volatility_cv == pytest.approx(5.0 / 105)


def test_trends(series):
    rows = temporal.trends(series, window=2).orderBy("date").collect()
    assert rows[0].trend_direction == "stable"
    assert rows[1].ma_short == pytest.approx(105)
    assert {"ma_long", "trend_strength"} <= set(rows[0].asDict())


def test_seasonal_indicator(series):
    rows = temporal.seasonal_indicator(series).orderBy("date").collect()
    assert rows[0].month == 1
    assert rows[0].day_of_week == 2
    assert [r.is_weekend for r in rows][3:5] == [1, 1]
    assert all(r.seasonal_factor == pytest.approx(1.0) for r in rows)


def test_age_imbalance(bands):
    rows = demographic.age_imbalance(bands).collect()
    assert all(
        r.ratio_0_5 + r.ratio_5_17 + r.ratio_18_greater == pytest.approx(1.0) for r in rows
    )
    assert rows[0].demographic_imbalance == pytest.approx(0.0, abs=1e-12)


def test_age_imbalance_custom_ratios(bands):
    ratios = {"age_0_5": 0.15, "age_5_17": 0.30, "age_18_greater": 0.55}
    rows = demographic.age_imbalance(bands, ratios).collect()
    assert rows[1].demographic_imbalance == pytest.approx(0.0, abs=1e-12)


def test_adult_child_ratio(bands):
    rows = demographic.adult_child_ratio(bands).collect()
    assert all(r.adult_child_ratio > 0 for r in rows)
    assert {"total_children", "child_dominance"} <= set(rows[0].asDict())


def test_zero_totals_give_null(spark):
    df = spark.createDataFrame(
        [(0, 0, 0)] * 3, "age_0_5 bigint, age_5_17 bigint, age_18_greater bigint"
    )
    rows = demographic.age_concentration(demographic.age_imbalance(df)).collect()
    assert all(r.demographic_imbalance is None for r in rows)
    assert all(r.dominant_age_group == "18+" for r in rows)
    flags = demographic.demographic_anomalies(df).collect()
    assert not any(r.demographic_anomaly for r in flags)


def test_single_row(spark):
    df = spark.createDataFrame(
        [(dt.date(2025, 1, 1), "State A", 1000, 100, 300, 600)],
        "date date, state string, total_enrolments bigint, age_0_5 bigint, age_5_17 bigint, "
        "age_18_greater bigint",
    )
    assert demographic.age_imbalance(df).count() == 1


@pytest.mark.parametrize("method", ["minmax", "zscore"])
def test_normalize(spark, method):
    df = spark.createDataFrame([(float(v),) for v in (0, 25, 50, 75, 100)], "value double")
    rows = [r.normalized for r in risk.normalize_feature(df, "value", method).collect()]
    if method == "minmax":
        assert (min(rows), max(rows)) == (0.0, 1.0)
        assert rows[2] == pytest.approx(0.5)
    else:
        assert sum(rows) == pytest.approx(0.0)


def test_normalize_constant_and_unknown_method(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "value double")
    assert [r.normalized for r in risk.normalize_feature(df, "value").collect()] == [0.5, 0.5]
    assert [r.normalized for r in risk.normalize_feature(df, "value", "zscore").collect()] == [0, 0]
    with pytest.raises(ValueError):
        risk.normalize_feature(df, "value", "other")


def test_risk_score(risky):
    rows = risk.risk_score(risky).orderBy("state").collect()
    scores = [r.risk_score for r in rows]
    assert all(0 <= s <= 1 for s in scores)
    assert scores[3] == max(scores)


def test_risk_levels(spark):
    df = spark.createDataFrame(
        [(0.2,), (0.4,), (0.7,), (0.9,), (None,)], "risk_score double"
    )
    rows = risk.classify_risk(df).collect()
    assert [r.risk_level for r in rows] == ["Low", "Medium", "High", "Critical", "Unknown"]
    assert [r.risk_tier for r in rows] == [1, 2, 3, 4, 0]


def test_risk_score_with_one_feature(spark):
    df = spark.createDataFrame([("State A", 0.5)], "state string, volatility_cv double")
    assert risk.risk_score(df).first().risk_score == 0.5


def test_risk_score_without_features_or_rows(spark):
    df = spark.createDataFrame([("A",)], "state string")
    assert risk.risk_score(df).first().risk_score == 0.5
    empty = spark.createDataFrame([], "state string, volatility_cv double")
    assert risk.risk_score(empty).count() == 0


def test_risk_score_fills_gaps_with_the_signed_median(spark):
    df = spark.createDataFrame([(-4.0,), (None,), (1.0,), (2.0,)], "growth_rate double")
    scores = [r.risk_score for r in risk.risk_score(df).collect()]
    assert scores == pytest.approx([1.0, 0.0, 0.0, 1 / 3])


def test_explanations(spark):
    df = spark.createDataFrame(
        [(0.8, 0.25, -0.75), (0.1, 0.05, None)],
        "volatility_cv double, demographic_imbalance double, growth_rate double",
    )
    texts = [r.risk_explanation for r in risk.explain_risk(df).collect()]
    assert texts == [
        "High volatility (CV: 0.80); Demographic imbalance detected (0.25); "
        "Unusual enrolment drop (-75.0%)",
        "No significant risk factors identified",
    ]


def test_high_risk_regions_counts_without_totals(risky):
    rows = risk.high_risk_regions(risk.risk_score(risky), top_n=2, group_col="state").collect()
    assert [r.state for r in rows] == ["D", "B"]
    assert rows[0].total_enrolments == 1


def test_enrich_adds_all_features(series):
    wide = series.withColumns(
        {
            "district": F.lit("D1"),
            "age_0_5": F.lit(10),
            "age_5_17": F.lit(20),
            "age_18_greater": F.col("total_enrolments") - 30,
        }
    )
    out = features.enrich(wide)
    assert out.count() == 10
    assert {"growth_rate", "seasonal_deviation", "enrolment_zscore", "is_spike"} <= set(out.columns)
