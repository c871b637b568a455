import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.operators import alerts, forecast, geo, reports
from tallywatch.streaming.alerts import read_scored, start_alerts

START = dt.date(2025, 1, 1)


def history(spark, values, state="A"):
    rows = [(START + dt.timedelta(days=i), state, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, state string, total_enrolments double")


def expected_forecast(values, periods):
    """The forecast of one series, written out with NumPy."""
    y = np.asarray(values, dtype=float)
    x = np.arange(len(y))
    slope, intercept = np.polyfit(x, y, 1)
    dow = np.array([(START + dt.timedelta(days=int(i))).weekday() for i in x])
    factor = {d: y[dow == d].mean() / y.mean() for d in set(dow)}
    spread = y[-14:].std(ddof=1)
    out = []
    for h in range(1, periods + 1):
        day = START + dt.timedelta(days=len(y) - 1 + h)
        raw = (intercept + slope * (len(y) - 1 + h)) * factor.get(day.weekday(), 1.0)
        margin = 1.96 * spread * h**0.5
        out.append((day, max(0, raw), max(0, raw - margin), raw + margin))
    return out


@pytest.mark.parametrize("n", [5, 30])
def test_forecast_values(spark, n):
    rng = np.random.default_rng(1)
    values = 1000 + rng.normal(0, 100, n) + np.arange(n) * 10
    _, ahead = forecast.forecast_total(history(spark, values), 7)
    got = [
        (r.date, r.predicted, r.lower_bound, r.upper_bound)
        for r in ahead.orderBy("date").collect()
    ]
    for a, b in zip(got, expected_forecast(values, 7), strict=True):
        assert a[0] == b[0]
        assert a[1:] == pytest.approx(b[1:])


def test_states_with_short_histories_are_skipped(spark):
    df = history(spark, range(10, 20), "long").unionByName(history(spark, [1, 2, 3], "short"))
    out = forecast.forecast_by_state(df, 3)
    assert {r.state for r in out.collect()} == {"long"}
    assert out.count() == 3


def test_one_day_forecast_keeps_the_change_column(spark):
    _, ahead = forecast.forecast_total(history(spark, range(10, 30)), 1)
    row = ahead.first()
    assert row.trend_change is None
    assert row.anomaly_risk == row.high_uncertainty


def test_single_day_has_no_forecast(spark):
    assert forecast.forecast_total(history(spark, [5]), 3)[1].count() == 0


@pytest.mark.parametrize("values", [[5.0], [5.0, 9.0], [3.0, 8.0, 1.0, 7.0, 7.5, 2.0]])
def test_holt(spark, values):
    level, trend = values[0], (values[1] - values[0] if len(values) > 1 else 0.0)
    for v in values[1:]:
        new = 0.3 * v + 0.7 * (level + trend)
        level, trend = new, 0.1 * (new - level) + 0.9 * trend
    model = forecast.holt_fit(forecast.daily_series(history(spark, values)))
    row = model.first()
    assert (row.level, row.trend) == pytest.approx((level, trend))
    ahead = forecast.holt_predict(model, periods=3).orderBy("h").collect()
    assert [r.predicted for r in ahead] == pytest.approx([level + h * trend for h in (1, 2, 3)])


def plain_holt(values, alpha, beta):
    level, trend = values[0], (values[1] - values[0] if len(values) > 1 else 0.0)
    for v in values[1:]:
        new = alpha * v + (1 - alpha) * (level + trend)
        level, trend = new, beta * (new - level) + (1 - beta) * trend
    return level, trend


# A complex pair of eigenvalues, two real ones, one twice, one zero, none smoothed.
@pytest.mark.parametrize("alpha, beta", [(0.3, 0.1), (0.9, 0.01), (0.75, 1 / 3), (1.0, 0.4), (0.0, 0.0), (1.0, 0.0)])
def test_holt_over_chunks(spark, alpha, beta):
    rng = np.random.default_rng(4)
    series = {"a": rng.gamma(2.0, 50.0, 400), "b": rng.gamma(2.0, 50.0, 1), "c": rng.gamma(2.0, 50.0, 2)}
    rows = [(k, START + dt.timedelta(days=i // 3), i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, date date, i int, value double").repartition(7)
    for split in (False, True):
        found = forecast.holt_fit(df, ["k"], alpha, beta, ["date", "i"], split)
        for row in found.collect():
            want = plain_holt(series[row.k], alpha, beta)
            assert (row.level, row.trend) == pytest.approx(want, rel=1e-9, abs=1e-6)
    last = {r.k: r.last_date for r in found.collect()}
    assert last["a"] == START + dt.timedelta(days=133)


def test_holt_with_a_gap_and_without_rows(spark):
    rows = [(START, 1.0), (START + dt.timedelta(days=1), None), (START + dt.timedelta(days=2), 3.0)]
    df = spark.createDataFrame(rows, "date date, value double")
    assert forecast.holt_fit(df).first().level is None
    assert forecast.holt_fit(df.limit(0)).first().level is None
    plan = forecast.holt_fit(df, split=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_holt_of_a_long_series(spark):
    """Ten million values in one key, one of them at the end still felt."""
    n = 10_000_000
    df = spark.range(n, numPartitions=8).select(
        F.date_add(F.lit(START), (F.col("id") % 1000).cast("int")).alias("date"), "id",
        (100 + F.sin(F.col("id") / 50.0) * 10).alias("value"),
    )
    row = forecast.holt_fit(df, order_cols=["id"]).first()
    tail = [100 + math.sin(i / 50.0) * 10 for i in range(n - 3000, n)]
    assert (row.level, row.trend) == pytest.approx(plain_holt(tail, 0.3, 0.1), rel=1e-6)


SCORED = (
    "state string, risk_score double, is_anomaly boolean, demographic_imbalance double, "
    "volatility_cv double, growth_rate double"
)
ROWS = [
    ("Maharashtra", 0.85, True, 0.25, 0.65, 0.60),
    ("Karnataka", 0.45, False, 0.10, 0.30, 0.10),
    ("Tamil Nadu", 0.30, False, 0.05, 0.20, -0.35),
    ("UP", 0.78, True, 0.22, 0.55, 0.15),
    ("Gujarat", 0.55, None, 0.08, 0.40, None),
]


def test_default_alerts(spark):
    found = alerts.process(spark.createDataFrame(ROWS, SCORED))
    got = sorted((r.region, r.metadata["rule"]) for r in found.collect())
    assert got == sorted(
        [("Maharashtra", n) for n in (
            "high_risk_score", "anomaly_detected", "demographic_imbalance", "high_volatility",
            "enrolment_spike",
        )]
        + [("UP", n) for n in (
            "high_risk_score", "anomaly_detected", "demographic_imbalance", "high_volatility",
        )]
        + [("Tamil Nadu", "enrolment_drop"), ("Gujarat", "medium_risk_score")]
    )
    texts = {r.message for r in found.collect()}
    assert "High risk score detected: 0.850 (threshold: 0.75)" in texts
    assert "Enrolment drop: -35.0% decrease" in texts
    summary = alerts.summary(found).first()
    assert (summary.total_alerts, summary.critical, summary.warnings, summary.info) == (11, 2, 9, 0)
    counts = {r.type: r["count"] for r in alerts.count_by_type(found).collect()}
    assert counts["threshold_breach"] == 0 and len(counts) == 7


def test_alerts_without_region_or_known_columns(spark):
    df = spark.createDataFrame([(0.9,)], "risk_score double")
    assert alerts.process(df).first().region == "Unknown"
    assert alerts.process(df.select(F.lit(1).alias("other"))).count() == 0


def test_alerts_do_not_shuffle(spark):
    plan = alerts.process(spark.createDataFrame(ROWS, SCORED))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_alert_stream(spark, tmp_path):
    schema = T.StructType.fromDDL(SCORED) if hasattr(T.StructType, "fromDDL") else None
    scored = spark.createDataFrame(ROWS, SCORED)
    scored.write.parquet(str(tmp_path / "in"))
    stream = read_scored(spark, str(tmp_path / "in"), schema or scored.schema)
    query = start_alerts(
        stream, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True
    )
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == alerts.process(scored).count() == 11


def test_state_names(spark):
    names = [" delhi", "NCT OF DELHI", "Jammu and Kashmir", "orissa", "Goa"]
    df = spark.createDataFrame([(n,) for n in names], "state string")
    full = [r[0] for r in df.select(geo.normalize_state_name(F.col("state"))).collect()]
    assert full == ["NCT of Delhi", "NCT of Delhi", "Jammu & Kashmir", "Odisha", "Goa"]
    exact = [r[0] for r in df.select(geo.shape_name(F.col("state"))).collect()]
    assert exact == [" delhi", "NCT OF DELHI", "Jammu & Kashmir", "orissa", "Goa"]


def test_risk_grid_finds_its_columns(spark):
    df = spark.createDataFrame(
        [(START, "A", 0.5), (START, "A", 0.7), (START, "B", None)],
        "date date, state string, risk_score double",
    )
    row = geo.risk_grid(df).first()
    assert row.A == pytest.approx(0.6)
    assert row.B == 0.0


def test_summary_sheet_marks_missing_columns(spark):
    df = spark.createDataFrame([("A", 5)], "state string, total_enrolments bigint")
    rows = {r.metric: r.value for r in reports.summary_sheet(df).collect()}
    assert rows["Total Enrolments"] == "5"
    assert rows["Avg Risk Score"] == rows["Anomalies Detected"] == "N/A"


def test_reports_need_anomalies(spark):
    df = spark.createDataFrame([("A",)], "state string")
    for table in (reports.anomalies_report, reports.anomalies_summary, geo.anomaly_map):
        with pytest.raises(ValueError):
            table(df)


SPECS = ["", ".2f", "d", ">8.2f", "<9.1f", "^11.3f", "*>10d", "+.1f", ",.2f", "08.2f", "+09.1f", ".1%", "e", "12.3e", "10"]


@pytest.mark.parametrize("spec", SPECS)
def test_alert_formats(spark, spec):
    rule = alerts.AlertRule("r", "high_risk", "v", "v is not null", "high", f"is {{value:{spec}}}!")
    values = [1234.5678, -0.26, 7.0]
    got = alerts.process(spark.createDataFrame([(v,) for v in values], "v double"), [rule]).collect()
    for row, v in zip(got, values):
        assert row.message == f"is {format(round(v) if spec.endswith('d') else v, spec)}!"


@pytest.mark.parametrize(
    "spec", [",", ">14,", "+,", "", "e", ",.3e", ",.1%", "012.2f", "+,d", "*^20"]
)
def test_alert_formats_of_wide_ranges(spark, spec):
    """Doubles from tiny to huge, as Python writes them; halves that tie are left out."""
    rule = alerts.AlertRule("r", "high_risk", "v", "v is not null", "high", f"{{value:{spec}}}")
    values = [1234.56, -1234567.75, 12345678.0, 0.0, 3e-7, -0.00012, 1e16, 1.5e22, 123456789012345.0, 7.0]
    if "d" in spec:
        values = [v for v in values if v == int(v) and abs(v) < 1e18]
    if "%" in spec or "f" in spec:  # Java pads the shortest digits with zeros, Python goes on
        values = [v for v in values if abs(v) < 1e15]
    got = alerts.process(spark.createDataFrame([(v,) for v in values], "v double"), [rule]).collect()
    for row, v in zip(got, values, strict=True):
        assert row.message == format(int(v) if "d" in spec else v, spec)


def test_alert_formats_of_whole_numbers_flags_and_text(spark):
    text = "{region:>10}|{region:*^9}|{region:.2}|{value:,}|{value}|{threshold:.1%}|{threshold}"
    rule = alerts.AlertRule("r", "high_risk", "v", "v is not null", "high", text, 0.25)
    rows = [("Goa", 1234567), ("Uttarakhand", -12), ("", 0)]
    found = alerts.process(spark.createDataFrame(rows, "state string, v long"), [rule]).collect()
    for row, (region, value) in zip(found, rows, strict=True):
        assert row.message == text.format(region=region, value=value, threshold=0.25)
    flags = spark.createDataFrame([("Goa", True)], "state string, v boolean")
    assert "|1|True|" in alerts.process(flags, [rule]).first().message


@pytest.mark.parametrize(
    "text",
    [
        "{value:x}", "{value:.2q}", "{other}", "{value!r}", "{value:,s}", "{value:08,.2f}", "{value:.3}",
        "{region:d}", "{region:,}", "{region:05}", "{threshold:.1f}", "{value:{width}}",
    ],
)
def test_bad_alert_formats_are_refused(text):
    with pytest.raises(ValueError):
        alerts.AlertRule("r", "high_risk", "v", "true", "high", text)
