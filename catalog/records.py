"""Sources, cleaning, quality checks and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.core import Query
from catalog.tables import (
    CTES,
    PIPELINE_WEIGHTS,
    STRIP,
    TITLE,
    Tables,
    daily_sql,
    features_sql,
    demographic_sql,
    risk_sql,
)
from tallywatch.functions.scale import new_path
from tallywatch.operators import aggregate, clean, quality
from tallywatch.plans.pipeline import run_full_analysis
from tallywatch.schema import RECORD_COLS
from tallywatch.sources import enrolment

RECORDS = "date state district pincode age_0_5:l age_5_17:l age_18_greater:l"
AS_OF = "2024-03-01"
STATES = ("click", "error", "view")


def _as_csv_text(df: DataFrame) -> DataFrame:
    return df.select(
        F.date_format("date", "dd-MM-yyyy").alias("date"), *[c for c in RECORD_COLS if c != "date"]
    )


def _load_parts(t: Tables) -> DataFrame:
    """Write the records as three CSV parts, then load them with one part missing."""
    folder = new_path(t.spark, "csv-parts")
    text = _as_csv_text(t.enrol_events)
    for name, test in (
        ("low.csv", F.col("age_18_greater") < 10),
        ("middle.csv", F.col("age_18_greater").between(10, 19)),
        ("high.csv", F.col("age_18_greater") > 19),
    ):
        enrolment.write_csv(text.where(test), f"{folder}/{name}")
    return enrolment.load_all(t.spark, folder, ["low.csv", "absent.csv", "middle.csv", "high.csv"])


def _load_single(t: Tables) -> DataFrame:
    path = new_path(t.spark, "csv-single")
    return enrolment.read_records(t.spark, enrolment.write_csv(_as_csv_text(t.enrol_events), path))


def _result_csv(t: Tables) -> DataFrame:
    """The state table written as CSV and read back."""
    path = enrolment.write_csv(t.event_states, new_path(t.spark, "state-csv"))
    return t.spark.read.schema(t.event_states.schema).option("header", True).csv(path)


SUMMARY_SQL = """
    SELECT count(*) AS total_records, min(date) AS date_start, max(date) AS date_end,
           count(DISTINCT state) AS states, count(DISTINCT district) AS districts,
           count(DISTINCT pincode) AS pincodes, sum(age_0_5) AS age_0_5,
           sum(age_5_17) AS age_5_17, sum(age_18_greater) AS age_18_greater,
           sum(total) AS total_enrolments, avg(total) AS mean_total,
           stddev_samp(total) AS std_total, min(total) AS min_total, max(total) AS max_total
    FROM (SELECT *, age_0_5 + age_5_17 + age_18_greater AS total FROM enrol_orders) AS t"""
SUMMARY_COLS = (
    "total_records:l date_start date_end states:l districts:l pincodes:l age_0_5:l age_5_17:l "
    "age_18_greater:l total_enrolments:l mean_total:d std_total:d min_total:l max_total:l"
)

SOURCES = [
    Query("load_single_file", RECORDS, _load_single, "SELECT * FROM enrol_events"),
    Query("load_all_parts", RECORDS, _load_parts, "SELECT * FROM enrol_events"),
    Query(
        "data_summary",
        SUMMARY_COLS,
        lambda t: enrolment.data_summary(t.enrol_orders),
        SUMMARY_SQL,
    ),
    Query(
        "result_csv_output",
        "date state age_0_5:l total_enrolments:l child_ratio:d adult_ratio:d",
        _result_csv,
        "SELECT * FROM event_states",
    ),
]

_PRESENT = "date IS NOT NULL AND state IS NOT NULL AND district IS NOT NULL"
_FILL = ", ".join(
    f"greatest(coalesce({c}, 0), 0) AS {c}" for c in ("age_0_5", "age_5_17", "age_18_greater")
)
_PIN = STRIP.format("pincode")
_PINCODE = f"CASE WHEN length({_PIN}) = 6 THEN {_PIN} ELSE 'UNKNOWN' END"
_STATE, _DISTRICT = (TITLE.format(STRIP.format(c)) for c in ("state", "district"))
CLEAN_SQL = f"""
    SELECT date, {_STATE} AS state, {_DISTRICT} AS district, {_PINCODE} AS pincode,
           age_0_5, age_5_17, age_18_greater,
           age_0_5 + age_5_17 + age_18_greater AS total_enrolments
    FROM (SELECT date, state, district, pincode, {_FILL} FROM enrol_dirty WHERE {_PRESENT}) AS f"""

CLEAN = [
    Query(
        "drop_incomplete_rows",
        RECORDS,
        lambda t: clean.drop_incomplete(t.enrol_dirty),
        f"SELECT * FROM enrol_dirty WHERE {_PRESENT}",
    ),
    Query(
        "fill_and_clip_counts",
        "date state pincode age_0_5:l age_5_17:l age_18_greater:l",
        lambda t: clean.fill_counts(t.enrol_dirty),
        f"SELECT date, state, pincode, {_FILL} FROM enrol_dirty",
    ),
    Query(
        "row_total",
        "date state age_0_5:l total_enrolments:l",
        lambda t: clean.add_total(t.enrol_dirty),
        "SELECT *, age_0_5 + age_5_17 + age_18_greater AS total_enrolments FROM enrol_dirty",
    ),
    Query(
        "normalise_pincode",
        "date pincode",
        lambda t: clean.normalise_pincode(t.enrol_dirty),
        f"SELECT date, {_PINCODE} AS pincode FROM enrol_dirty",
    ),
    Query(
        "standardise_names",
        "date state district",
        lambda t: clean.standardise_names(t.enrol_dirty),
        f"SELECT date, {_STATE} AS state, {_DISTRICT} AS district FROM enrol_dirty",
    ),
    Query(
        "clean_data",
        RECORDS + " total_enrolments:l",
        lambda t: clean.clean_data(t.enrol_dirty),
        CLEAN_SQL,
    ),
    Query(
        "validate_data",
        "is_valid record_count:l null_state:l null_pincode:l null_age_5_17:l negative_age_0_5:l "
        "duplicate_count:l date_start date_end states:l districts:l n_issues:i n_warnings:i",
        lambda t: clean.validate_data(t.enrol_dirty).withColumns(
            {"n_issues": F.size("issues"), "n_warnings": F.size("warnings")}
        ),
        """
        SELECT negative_age_0_5 = 0 AS is_valid, *,
               CASE WHEN negative_age_0_5 > 0 THEN 1 ELSE 0 END AS n_issues,
               1 + CASE WHEN duplicate_count > 0 THEN 1 ELSE 0 END AS n_warnings
        FROM (
          SELECT count(*) AS record_count, count(*) - count(state) AS null_state,
                 count(*) - count(pincode) AS null_pincode,
                 count(*) - count(age_5_17) AS null_age_5_17,
                 count(*) FILTER (age_0_5 < 0) AS negative_age_0_5,
                 min(date) AS date_start, max(date) AS date_end,
                 count(DISTINCT state) AS states, count(DISTINCT district) AS districts
          FROM enrol_dirty) AS a,
          (SELECT sum(n - 1) AS duplicate_count
           FROM (SELECT count(*) AS n FROM enrol_dirty
                 GROUP BY date, state, district, pincode) AS k) AS d""",
    ),
]

CHECK_COLS = "check passed value:d n_warnings:i"


def _checks(*makers):
    """Run the checks that `makers` build for the dirty records."""

    def run(t: Tables) -> DataFrame:
        table = quality.run_checks(t.enrol_dirty, [m(t.enrol_dirty) for m in makers])
        return table.withColumn("n_warnings", F.size("warnings"))

    return run


def _check_sql(name: str, passed: str, value: str, warnings: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS \"check\", {passed} AS passed, {value} AS value, "
        f"{warnings} AS n_warnings FROM ({source}) AS facts"
    )


_COLS = list(RECORD_COLS)
_BAD = "CASE WHEN v > 0 THEN 1 ELSE 0 END"
_NULL_SHARES = ", ".join(f"1 - count({c}) / count(*)::DOUBLE AS n_{c}" for c in _COLS)
_OVER = " + ".join(f"CASE WHEN n_{c} > {{0}} THEN 1 ELSE 0 END" for c in _COLS)
SCHEMA_CHECK = (
    "SELECT 'schema_validation' AS \"check\", true AS passed, 0 AS value, 0 AS n_warnings"
)
MISSING_CHECK = _check_sql(
    "missing_values", "v = 0", "v", _BAD,
    f"SELECT {_OVER.format(0.1)} AS v FROM (SELECT {_NULL_SHARES} FROM enrol_dirty) AS s",
)
DUPLICATE_CHECK = _check_sql(
    "duplicates", "v = 0", "v", _BAD,
    "SELECT sum(n - 1) AS v FROM (SELECT count(*) AS n FROM enrol_dirty "
    "GROUP BY date, state, district) AS k",
)
GAP_CHECK = _check_sql(
    "date_continuity", "v = 0", "v", _BAD,
    "SELECT count(*) AS v FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day "
    "FROM (SELECT min(date)::TIMESTAMP AS lo, max(date)::TIMESTAMP AS hi FROM enrol_dirty) AS e) "
    "AS days WHERE CAST(day AS DATE) NOT IN (SELECT date FROM enrol_dirty WHERE date IS NOT NULL)",
)
_COUNTS = ", ".join(
    f"count(*) FILTER ({c} < 0) AS neg_{c}, count(*) FILTER ({c} < 0 OR {c} > {hi}) AS out_{c}"
    for c, hi in (("age_0_5", 10000), ("age_5_17", 20000), ("age_18_greater", 50000))
)


def _summed(prefix: str) -> tuple[str, str]:
    cols = [f"{prefix}_{c}" for c in ("age_0_5", "age_5_17", "age_18_greater")]
    return " + ".join(cols), " + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END" for c in cols)


NEGATIVE_CHECK = _check_sql(
    "negative_values", f"{_summed('neg')[0]} = 0", _summed("neg")[0], _summed("neg")[1],
    f"SELECT {_COUNTS} FROM enrol_dirty",
)
RANGE_CHECK = _check_sql(
    "value_ranges", f"{_summed('out')[0]} = 0", _summed("out")[0], _summed("out")[1],
    f"SELECT {_COUNTS} FROM enrol_dirty",
)
FRESH_CHECK = _check_sql(
    "data_freshness", "v <= 30", "v", "CASE WHEN v > 30 THEN 1 ELSE 0 END",
    f"SELECT date_diff('day', max(date), DATE '{AS_OF}') AS v FROM enrol_dirty",
)
_FILLED = " + ".join(f"count({c})" for c in _COLS)
COMPLETE_CHECK = _check_sql(
    "completeness", "v >= 95", "v", "0",
    f"SELECT ({_FILLED}) / (count(*) * {len(_COLS)})::DOUBLE * 100 AS v FROM enrol_dirty",
)
ALL_CHECKS = " UNION ALL ".join(
    [
        SCHEMA_CHECK, MISSING_CHECK, DUPLICATE_CHECK, GAP_CHECK,
        NEGATIVE_CHECK, RANGE_CHECK, FRESH_CHECK, COMPLETE_CHECK,
    ]
)


def _as_of():
    return F.lit(AS_OF).cast("date")


def _all_checks(t: Tables) -> DataFrame:
    return quality.validate_all(t.enrol_dirty, as_of=_as_of()).withColumn(
        "n_warnings", F.size("warnings")
    )


def _distribution(t: Tables) -> DataFrame:
    spend = t.read("orders")
    checks = [
        quality.distribution_check(spend, "o_totalprice"),
        quality.distribution_check(spend, "o_custkey"),
    ]
    return quality.run_checks(spend, checks).withColumn("n_warnings", F.size("warnings"))


def _distribution_sql(col: str) -> str:
    return _check_sql(
        f"distribution_{col}", "v <= 10", "v", "CASE WHEN v > 5 THEN 1 ELSE 0 END",
        f"SELECT count(*) FILTER ({col} < q1 - 3 * (q3 - q1) OR {col} > q3 + 3 * (q3 - q1)) "
        f"/ count({col})::DOUBLE * 100 AS v FROM orders, (SELECT "
        f"quantile_cont({col}::DOUBLE, 0.25) AS q1, quantile_cont({col}::DOUBLE, 0.75) AS q3 "
        "FROM orders) AS q",
    )


QUALITY = [
    Query(
        "schema_check",
        CHECK_COLS,
        _checks(quality.schema_check, lambda d: quality.schema_check(d, ["date", "zone"])),
        SCHEMA_CHECK + " UNION ALL SELECT 'schema_validation', false, 1, 0",
    ),
    Query(
        "missing_values_check",
        CHECK_COLS,
        _checks(quality.missing_values_check, lambda d: quality.missing_values_check(d, 0.5)),
        MISSING_CHECK + " UNION ALL " + MISSING_CHECK.replace("> 0.1", "> 0.5"),
    ),
    Query(
        "duplicates_check",
        CHECK_COLS,
        _checks(
            lambda d: quality.duplicates_check(d, ["date", "state", "district"]),
            quality.duplicates_check,
        ),
        DUPLICATE_CHECK
        + " UNION ALL "
        + DUPLICATE_CHECK.replace("GROUP BY date, state, district", f"GROUP BY {', '.join(_COLS)}"),
    ),
    Query("date_continuity_check", CHECK_COLS, _checks(quality.date_continuity_check), GAP_CHECK),
    Query(
        "missing_dates",
        "date",
        lambda t: quality.missing_dates(t.enrol_dirty),
        """
        SELECT CAST(day AS DATE) AS date
        FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day
              FROM (SELECT min(date)::TIMESTAMP AS lo, max(date)::TIMESTAMP AS hi
                    FROM enrol_dirty) AS e) AS days
        EXCEPT SELECT date FROM enrol_dirty""",
    ),
    Query("value_ranges_check", CHECK_COLS, _checks(quality.value_ranges_check), RANGE_CHECK),
    Query("negative_values_check", CHECK_COLS, _checks(quality.negative_values_check), NEGATIVE_CHECK),
    Query(
        "distribution_check",
        CHECK_COLS,
        _distribution,
        _distribution_sql("o_totalprice") + " UNION ALL " + _distribution_sql("o_custkey"),
    ),
    Query(
        "categorical_check",
        CHECK_COLS,
        _checks(
            lambda d: quality.categorical_check(d, "state", STATES),
            lambda d: quality.categorical_check(d, "district"),
        ),
        _check_sql(
            "categorical_state", "v = 0", "v", _BAD,
            "SELECT count(*) AS v FROM (SELECT DISTINCT state FROM enrol_dirty) AS s "
            "WHERE state IS NULL OR state NOT IN ('click', 'error', 'view')",
        )
        + " UNION ALL SELECT 'categorical_district', true, 0, 0",
    ),
    Query(
        "unexpected_values",
        "state",
        lambda t: quality.unexpected_values(t.enrol_dirty, "state", STATES),
        "SELECT DISTINCT state FROM enrol_dirty "
        "WHERE state IS NULL OR state NOT IN ('click', 'error', 'view')",
    ),
    Query(
        "freshness_check",
        CHECK_COLS,
        _checks(lambda d: quality.freshness_check(d, as_of=_as_of())),
        FRESH_CHECK,
    ),
    Query("completeness_check", CHECK_COLS, _checks(quality.completeness_check), COMPLETE_CHECK),
    Query("validate_all_checks", CHECK_COLS, _all_checks, ALL_CHECKS),
    Query(
        "quality_report_summary",
        "valid total_checks:l passed:l failed:l warnings:l",
        lambda t: quality.report_summary(quality.validate_all(t.enrol_dirty, as_of=_as_of())),
        f"""
        SELECT bool_and(passed) AS valid, count(*) AS total_checks,
               count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
               sum(n_warnings) AS warnings
        FROM ({ALL_CHECKS}) AS checks""",
    ),
    Query(
        "quality_metadata",
        "total_records:l total_columns:l date_start date_end completeness:d",
        lambda t: quality.report_metadata(t.enrol_dirty),
        f"""
        SELECT count(*) AS total_records, {len(_COLS)} AS total_columns, min(date) AS date_start,
               max(date) AS date_end,
               ({_FILLED}) / (count(*) * {len(_COLS)})::DOUBLE * 100 AS completeness
        FROM enrol_dirty""",
    ),
]

_BANDS = "age_0_5:l age_5_17:l age_18_greater:l total_enrolments:l"
_PCTS = "pct_0_5:d pct_5_17:d pct_18_greater:d"
_SUMS = ", ".join(f"sum({c}) AS {c}" for c in ("age_0_5", "age_5_17", "age_18_greater"))
_TOTAL = "age_0_5 + age_5_17 + age_18_greater AS total_enrolments"


def _summary_sql(keys: str) -> str:
    shares = ", ".join(
        f"round_even({c} / nullif(total_enrolments, 0)::DOUBLE * 100 * 100, 0) / 100 AS {p}"
        for c, p in (("age_0_5", "pct_0_5"), ("age_5_17", "pct_5_17"), ("age_18_greater", "pct_18_greater"))
    )
    select = f"{keys}, {_SUMS}" if keys else _SUMS
    group = f"GROUP BY {keys}" if keys else ""
    return (
        f"SELECT *, {shares} FROM (SELECT *, {_TOTAL} FROM "
        f"(SELECT {select} FROM enrol_orders {group}) AS s) AS t"
    )


AGGREGATES = [
    Query(
        "aggregate_by_state",
        f"date state {_BANDS} district_count:l pincode_count:l child_ratio:d adult_ratio:d",
        lambda t: t.order_states,
        "SELECT * FROM order_states",
    ),
    Query(
        "aggregate_by_state_events",
        f"date state {_BANDS} district_count:l pincode_count:l child_ratio:d adult_ratio:d",
        lambda t: t.event_states,
        "SELECT * FROM event_states",
    ),
    Query(
        "aggregate_by_district",
        f"date state district {_BANDS} pincode_count:l child_ratio:d adult_ratio:d",
        lambda t: t.event_districts,
        "SELECT * FROM event_districts",
    ),
    Query(
        "daily_totals",
        f"date {_BANDS}",
        lambda t: aggregate.daily_totals(t.enrol_events),
        f"SELECT *, {_TOTAL} FROM (SELECT date, {_SUMS} FROM enrol_events GROUP BY date) AS s",
    ),
    Query(
        "daily_trend_of_states",
        f"date {_BANDS}",
        lambda t: aggregate.daily_totals(t.order_sums),
        f"SELECT *, {_TOTAL} FROM (SELECT date, {_SUMS} FROM order_states GROUP BY date) AS s",
    ),
    Query(
        "demographic_summary",
        f"{_BANDS} {_PCTS}",
        lambda t: aggregate.demographic_summary(t.enrol_orders),
        _summary_sql(""),
    ),
    Query(
        "demographic_summary_by_state",
        f"state {_BANDS} {_PCTS}",
        lambda t: aggregate.demographic_summary(t.enrol_orders, ["state"]),
        _summary_sql("state"),
    ),
    Query(
        "risk_distribution",
        "risk_level count:l pct:d",
        lambda t: aggregate.risk_distribution(t.scored),
        """
        SELECT risk_level, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM scored) AS pct
        FROM scored GROUP BY risk_level""",
    ),
    Query(
        "dashboard_kpis",
        "total_records:l total_enrolments:l states:l districts:l anomaly_rate:d",
        lambda t: aggregate.kpis(t.enrol_events, t.scored),
        """
        SELECT count(*) AS total_records, sum(age_0_5 + age_5_17 + age_18_greater) AS total_enrolments,
               count(DISTINCT state) AS states, count(DISTINCT district) AS districts,
               (SELECT avg(is_anomaly::INT) * 100 FROM scored) AS anomaly_rate
        FROM enrol_events""",
    ),
    Query(
        "age_totals",
        "age_group total:l pct:d",
        lambda t: aggregate.age_totals(t.enrol_orders),
        """
        SELECT age_group, total, total * 100.0 / sum(total) OVER () AS pct
        FROM (SELECT unnest(['0-5', '5-17', '18+']) AS age_group,
                     unnest([sum(age_0_5), sum(age_5_17), sum(age_18_greater)]) AS total
              FROM enrol_orders) AS rows""",
    ),
]

CTES |= {
    "cleaned": CLEAN_SQL,
    "clean_states": daily_sql(
        "cleaned",
        "date, state",
        "count(DISTINCT district) AS district_count, count(DISTINCT pincode) AS pincode_count",
    ),
    "clean_windows": features_sql("clean_states", "state"),
    "clean_features": demographic_sql("clean_windows"),
    "clean_risky": risk_sql("clean_features", PIPELINE_WEIGHTS),
}

ANALYSIS = [
    Query(
        "full_analysis_states",
        "date state total_enrolments:l district_count:l pincode_count:l growth_rate:d "
        "volatility_cv:d trend_direction demographic_imbalance:d risk_score:d risk_level",
        lambda t: run_full_analysis(t.enrol_dirty).state_analysis,
        "SELECT * FROM clean_risky",
    ),
    Query(
        "full_analysis_districts",
        "date state district total_enrolments:l pincode_count:l child_ratio:d",
        lambda t: run_full_analysis(t.enrol_dirty).district_daily,
        daily_sql("cleaned", "date, state, district", "count(DISTINCT pincode) AS pincode_count"),
    ),
    Query(
        "full_analysis_risk_levels",
        "risk_level records:l",
        lambda t: run_full_analysis(t.enrol_dirty)
        .state_analysis.groupBy("risk_level")
        .agg(F.count("*").alias("records")),
        "SELECT risk_level, count(*) AS records FROM clean_risky GROUP BY risk_level",
    ),
    Query(
        "full_analysis_summary",
        "total_records:l date_start:t date_end:t states:l districts:l total_enrolments:l mean_total:d",
        lambda t: run_full_analysis(t.enrol_dirty).data_summary,
        """
        SELECT count(*) AS total_records, min(date) AS date_start, max(date) AS date_end,
               count(DISTINCT state) AS states, count(DISTINCT district) AS districts,
               sum(total_enrolments) AS total_enrolments, avg(total_enrolments) AS mean_total
        FROM cleaned""",
    ),
]

QUERIES = [*ANALYSIS, *SOURCES, *CLEAN, *QUALITY, *AGGREGATES]
