"""Data-quality checks. Each yields one row of a check table.

A check is a set of named aggregates plus a row built from them, so any number
of checks runs in a single scan of the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.columns import flag, ratio, with_columns
from tallywatch.functions.ranks import exact_quantiles
from tallywatch.functions.sketches import approx_quantiles
from tallywatch.schema import AGE_COLS

REQUIRED_COLS = ("date", "state", "district", *AGE_COLS)
# Accepted count ranges per record.
VALUE_RANGES = {
    "age_0_5": (0, 10000),
    "age_5_17": (0, 20000),
    "age_18_greater": (0, 50000),
}
MISSING_THRESHOLD = 0.1
MAX_AGE_DAYS = 30
MIN_COMPLETENESS = 95.0


@dataclass(frozen=True)
class Check:
    """`row` is built from `aggregates` over the data and from scalar `lookups`."""

    row: Column
    aggregates: dict[str, Column] = field(default_factory=dict)
    lookups: dict[str, Column] = field(default_factory=dict)


def _row(
    name: str,
    passed: Column,
    value: Column,
    message: Column,
    warnings: Sequence[Column] = (),
    details: dict[str, Column] | None = None,
) -> Column:
    detail_pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(name).alias("check"),
        flag(passed).alias("passed"),
        value.cast("double").alias("value"),
        message.alias("message"),
        F.array_compact(F.array(*[w.cast("string") for w in warnings]))
        .cast("array<string>")
        .alias("warnings"),
        F.create_map(*detail_pairs).cast("map<string,string>").alias("details"),
    )


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def run_checks(df: DataFrame, checks: Sequence[Check | None]) -> DataFrame:
    """The check table for `checks`, from one aggregation of `df`.

    A check on a column that does not exist is None and gives no row.
    """
    kept = [c for c in checks if c is not None]
    aggregates = {name: col for c in kept for name, col in c.aggregates.items()}
    facts = df.agg(F.count("*").alias("_rows"), *[c.alias(n) for n, c in aggregates.items()])
    lookups = {name: col for c in kept for name, col in c.lookups.items()}
    return with_columns(facts, lookups).select(F.inline(F.array(*[c.row for c in kept])))


def schema_check(df: DataFrame, expected: Sequence[str] = REQUIRED_COLS) -> Check:
    missing = [c for c in expected if c not in df.columns]
    message = f"Missing required columns: {missing}" if missing else "All required columns present"
    details = {"missing_columns": F.lit(",".join(missing))} if missing else None
    return Check(
        _row("schema_validation", F.lit(not missing), F.lit(len(missing)), F.lit(message), (), details)
    )


def missing_values_check(df: DataFrame, threshold: float = MISSING_THRESHOLD) -> Check:
    aggs = {
        f"_null_{i}": F.avg(F.col(c).isNull().cast("double")) for i, c in enumerate(df.columns)
    }
    over = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"_null_{i}") > threshold, _text(f"{c}: ", F.col(f"_null_{i}")))
                for i, c in enumerate(df.columns)
            ]
        )
    )
    n = F.size(over)
    listed = F.array_join(over, ", ")
    return Check(
        _row(
            "missing_values",
            n == 0,
            n,
            F.when(n == 0, F.lit("Missing values within acceptable range")).otherwise(
                _text(n, " columns have excessive missing values")
            ),
            [F.when(n > 0, _text(f"Columns with >{threshold * 100}% missing values: ", listed))],
            {"problematic_columns": listed},
        ),
        aggs,
    )


def duplicate_count(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row, one column: rows beyond the first of each key (NULLs are equal).

    Copies are counted before the shuffle, so a key with very many rows moves
    as one partial count per task.
    """
    per_key = df.groupBy(*(keys or df.columns)).agg(F.count("*").alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"))


def duplicates_check(df: DataFrame, keys: Sequence[str] | None = None) -> Check:
    name = "_copies_" + "_".join(keys or ["row"])
    n = F.col(name)
    return Check(
        _row(
            "duplicates",
            n == 0,
            n,
            F.when(n == 0, F.lit("No duplicate records found")).otherwise(
                _text(n, " duplicate records found")
            ),
            [F.when(n > 0, _text("Found ", n, " duplicate records"))],
            {"count": n},
        ),
        lookups={name: duplicate_count(df, keys).scalar()},
    )


def missing_dates(df: DataFrame, date_col: str = "date") -> DataFrame:
    """The calendar days between the first and last date that have no row."""
    day = F.to_date(date_col)
    days = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias(date_col)
    )
    return days.join(df.select(day.alias(date_col)).distinct(), date_col, "left_anti")


def date_continuity_check(df: DataFrame, date_col: str = "date") -> Check | None:
    if date_col not in df.columns:
        return None
    day = F.to_date(date_col)
    span = F.datediff(F.max(day), F.min(day)) + 1
    n = F.coalesce(F.col("_gap_days"), F.lit(0))
    return Check(
        _row(
            "date_continuity",
            n == 0,
            n,
            F.when(n == 0, F.lit("Date sequence is continuous")).otherwise(
                _text(n, " dates missing from sequence")
            ),
            [F.when(n > 0, _text("Found ", n, " missing dates in sequence"))],
            {"missing_dates_count": n},
        ),
        {"_gap_days": span - F.count_distinct(day)},
    )


def _count_check(
    df: DataFrame, name: str, bad: dict[str, Column], good: str, failed: str, warning: dict[str, str]
) -> Check:
    """Passes if no value of any listed column meets its `bad` condition."""
    aggs = {f"_{name}_{c}": F.count_if(cond) for c, cond in bad.items()}
    total = sum((F.col(a) for a in aggs), F.lit(0))
    warnings = [
        F.when(F.col(f"_{name}_{c}") > 0, _text(f"{c}: ", F.col(f"_{name}_{c}"), warning[c]))
        for c in bad
    ]
    message = F.when(total == 0, F.lit(good)).otherwise(F.lit(failed))
    return Check(_row(name, total == 0, total, message, warnings), aggs)


def value_ranges_check(
    df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None
) -> Check:
    ranges = VALUE_RANGES if ranges is None else ranges
    known = {c: b for c, b in ranges.items() if c in df.columns}
    return _count_check(
        df,
        "value_ranges",
        {c: (F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in known.items()},
        "All values within expected ranges",
        "Some values out of range",
        {c: f" values out of range [{lo}, {hi}]" for c, (lo, hi) in known.items()},
    )


def negative_values_check(df: DataFrame, cols: Sequence[str] = AGE_COLS) -> Check:
    known = [c for c in cols if c in df.columns]
    return _count_check(
        df,
        "negative_values",
        {c: F.col(c) < 0 for c in known},
        "No unexpected negative values",
        "Some negative values found",
        {c: " negative values found" for c in known},
    )


def distribution_check(
    df: DataFrame, column: str, approximate: bool = False
) -> Check | None:
    """Share of values beyond three interquartile ranges from the quartiles.

    `approximate` takes these from a mergeable sketch.
    """
    if column not in df.columns:
        return None
    quantiles = approx_quantiles if approximate else exact_quantiles
    bounds = quantiles(df, {"q1": (column, 0.25), "q3": (column, 0.75)})
    spread = F.col("q3") - F.col("q1")
    fences = bounds.select(
        F.struct(
            (F.col("q1") - 3 * spread).alias("lo"), (F.col("q3") + 3 * spread).alias("hi")
        ).alias("fences")
    ).scalar()
    value = F.col(column)
    outside = (value < fences["lo"]) | (value > fences["hi"])
    pct = F.col(f"_outside_{column}")
    return Check(
        _row(
            f"distribution_{column}",
            pct <= 10,
            pct,
            F.format_string("Distribution check: %.1f%% outliers", pct),
            [F.when(pct > 5, F.format_string(f"{column}: %.1f%% outliers detected", pct))],
            {"outlier_percentage": pct},
        ),
        {f"_outside_{column}": ratio(F.count_if(outside), F.count(value)) * 100},
    )


def unexpected_values(df: DataFrame, column: str, expected: Sequence) -> DataFrame:
    """Distinct values not in the expected list; NULL counts as unexpected."""
    values = df.select(column).distinct()
    return values.where(~F.coalesce(F.col(column).isin(list(expected)), F.lit(False)))


def categorical_check(df: DataFrame, column: str, expected: Sequence | None = None) -> Check | None:
    """The number of distinct values outside `expected`.

    The values themselves, which may be many, are the rows of
    `unexpected_values`.
    """
    if column not in df.columns:
        return None
    name = f"categorical_{column}"
    lookups = {}
    n, bad = F.lit(0), F.lit(False)
    if expected:
        others = unexpected_values(df, column, expected).agg(F.count("*").alias("n"))
        lookups[f"_unexpected_{column}"] = others.scalar()
        n = F.col(f"_unexpected_{column}")
        bad = n > 0
    distinct = F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))
    return Check(
        _row(
            name,
            ~bad,
            n,
            F.when(bad, F.lit(f"Unexpected categorical values in {column}")).otherwise(
                _text(f"{column}: ", F.col(f"_distinct_{column}"), " unique values")
            ),
            [F.when(bad, _text(f"{column}: ", n, " unexpected values found"))],
            {"unexpected_count": n},
        ),
        {f"_distinct_{column}": distinct},
        lookups,
    )


def freshness_check(
    df: DataFrame,
    date_col: str = "date",
    max_age_days: int = MAX_AGE_DAYS,
    as_of: Column | None = None,
) -> Check | None:
    if date_col not in df.columns:
        return None
    today = F.current_date() if as_of is None else as_of
    age = F.datediff(today, F.col("_latest"))
    return Check(
        _row(
            "data_freshness",
            age <= max_age_days,
            age,
            _text("Latest data is ", age, " days old"),
            [F.when(age > max_age_days, _text("Data may be stale (", age, " days old)"))],
            {"age_days": age, "latest_date": F.col("_latest")},
        ),
        {"_latest": F.max(F.to_date(date_col))},
    )


def completeness_check(df: DataFrame) -> Check:
    filled = sum((F.count(F.col(c)) for c in df.columns), F.lit(0))
    pct = F.col("_complete")
    return Check(
        _row(
            "completeness",
            pct >= MIN_COMPLETENESS,
            pct,
            F.format_string("Data completeness: %.2f%%", pct),
            (),
            {"completeness_percentage": pct},
        ),
        {"_complete": ratio(filled, F.count("*") * len(df.columns)) * 100},
    )


def validate_all(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The standard eight checks: one scan, plus one aggregation for duplicates."""
    keys = [c for c in ("date", "state", "district") if c in df.columns]
    return run_checks(
        df,
        [
            schema_check(df),
            missing_values_check(df),
            duplicates_check(df, keys) if keys else None,
            date_continuity_check(df),
            negative_values_check(df),
            value_ranges_check(df),
            freshness_check(df, as_of=as_of),
            completeness_check(df),
        ],
    )


def report_metadata(df: DataFrame) -> DataFrame:
    """One row: record and column counts, date range, completeness."""
    filled = sum((F.count(F.col(c)) for c in df.columns), F.lit(0))
    dates = (
        [F.min("date").alias("date_start"), F.max("date").alias("date_end")]
        if "date" in df.columns
        else []
    )
    return df.agg(
        F.count("*").alias("total_records"),
        F.lit(len(df.columns)).alias("total_columns"),
        *dates,
        (ratio(filled, F.count("*") * len(df.columns)) * 100).alias("completeness"),
    )


def report_summary(checks: DataFrame) -> DataFrame:
    """One row: verdict and counts over a check table. Warnings do not fail it."""
    return checks.agg(
        (F.count_if(~F.col("passed")) == 0).alias("valid"),
        F.count("*").alias("total_checks"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"),
    )
