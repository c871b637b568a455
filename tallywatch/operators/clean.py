"""Cleaning and validation of raw records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.columns import age_total, flag, strip, title_case
from tallywatch.functions.scale import with_row
from tallywatch.operators.quality import duplicate_count
from tallywatch.schema import AGE_COLS, CRITICAL_COLS, KEY_COLS, RECORD_COLS

UNKNOWN_PINCODE = "UNKNOWN"


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows with a date, a state and a district."""
    return df.na.drop(subset=list(CRITICAL_COLS))


def fill_counts(df: DataFrame) -> DataFrame:
    """Missing or negative counts become 0."""
    return df.withColumns({c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in AGE_COLS})


def add_total(df: DataFrame) -> DataFrame:
    return df.withColumn("total_enrolments", age_total())


def normalise_pincode(df: DataFrame) -> DataFrame:
    """Six characters after stripping, else UNKNOWN (also for NULL)."""
    code = strip(F.col("pincode"))
    return df.withColumn(
        "pincode", F.when(F.length(code) == 6, code).otherwise(F.lit(UNKNOWN_PINCODE))
    )


def standardise_names(df: DataFrame) -> DataFrame:
    return df.withColumns({c: title_case(strip(F.col(c))) for c in ("state", "district")})


def clean_data(df: DataFrame) -> DataFrame:
    """All cleaning steps; Catalyst folds them into one filter and projection."""
    return (
        df.transform(drop_incomplete)
        .transform(fill_counts)
        .transform(add_total)
        .transform(normalise_pincode)
        .transform(standardise_names)
    )


def _listed(entries: list[Column]) -> Column:
    return F.array_compact(F.array(*entries)) if entries else F.array().cast("array<string>")


def validate_data(df: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """One row: verdict, issues, warnings, counts and date range.

    Missing columns are reported as an issue; the other checks go on with the
    columns that exist. With the `rejects` of the load, the report also counts
    the lines set aside, and those among them whose date was not understood.
    """
    present = [c for c in RECORD_COLS if c in df.columns]
    missing = [c for c in RECORD_COLS if c not in df.columns]
    ages = [c for c in AGE_COLS if c in present]
    keys = [c for c in KEY_COLS if c in present]

    aggs = [F.count("*").alias("record_count")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]
    aggs += [F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in ages]
    if "date" in present:
        aggs += [F.min("date").alias("date_start"), F.max("date").alias("date_end")]
    for col, name in (("state", "states"), ("district", "districts")):
        if col in present:
            aggs.append(F.count_distinct(col).alias(name))
    facts = df.agg(*aggs)
    if keys:
        facts = facts.withColumn("duplicate_count", duplicate_count(df, keys).scalar())

    set_aside = []
    if rejects is not None:
        unread = F.array_contains("reasons", F.lit("date not understood"))
        lost = rejects.agg(F.count("*").alias("rejected"), F.count_if(unread).alias("dates"))
        facts = with_row(facts, lost, "_r").withColumns(
            {"rejected_lines": F.col("_r.rejected"), "unparsed_dates": F.col("_r.dates")}
        ).drop("_r")
        some = F.concat(F.col("rejected_lines").cast("string"), F.lit(" lines set aside"))
        set_aside = [F.when(F.col("rejected_lines") > 0, some)]

    issues = []
    if missing:
        issues.append(F.lit(f"Missing columns: {missing}"))
    issues += [
        F.when(F.col(f"negative_{c}") > 0, F.lit(f"Negative values found in {c}")) for c in ages
    ]
    if "date" in present:
        issues.append(F.when(F.col("date_start") > F.col("date_end"), F.lit("Invalid date range")))
    warnings = set_aside
    if present:
        nulls = [
            F.when(
                F.col(f"null_{c}") > 0,
                F.concat(F.lit(f"{c}: "), F.col(f"null_{c}").cast("string")),
            )
            for c in present
        ]
        any_null = reduce(lambda a, b: a | b, [F.col(f"null_{c}") > 0 for c in present])
        warnings.append(
            F.when(any_null, F.concat(F.lit("Null values found: "), F.concat_ws(", ", *nulls)))
        )
    if keys:
        warnings.append(
            F.when(
                flag(F.col("duplicate_count") > 0),
                F.concat(
                    F.lit("Found "),
                    F.col("duplicate_count").cast("string"),
                    F.lit(" duplicate entries"),
                ),
            )
        )
    report = facts.withColumns({"issues": _listed(issues), "warnings": _listed(warnings)})
    return report.withColumn("is_valid", F.size("issues") == 0)
