"""Small column expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.schema import AGE_COLS

WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero divisor, as ANSI mode would raise."""
    return numerator / F.nullif(denominator, F.lit(0))


def flag(condition: Column) -> Column:
    """A boolean that is false where the comparison met a NULL."""
    return F.coalesce(condition, F.lit(False))


def round2(value: Column) -> Column:
    """Half-even rounding to two decimals."""
    return F.rint(value * 100) / 100


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def title_case(value: Column) -> Column:
    """Upper-case each letter that does not follow a letter, lower-case the rest.

    ``initcap`` does this for plain letters and spaces, which nearly all names
    are. Other names are cut into runs of letters and of the rest.
    """
    runs = F.regexp_extract_all(value, F.lit(r"([\p{Lu}\p{Ll}]+|[^\p{Lu}\p{Ll}]+)"), F.lit(1))
    by_run = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(value.rlike("^[A-Za-z ]*$"), F.initcap(value)).otherwise(by_run)


def age_total() -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in AGE_COLS])


def with_total(df: DataFrame) -> DataFrame:
    if "total_enrolments" in df.columns:
        return df
    return df.withColumn("total_enrolments", age_total())


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness: NULL below three values, 0 for a constant."""
    n = F.count(value).cast("double")
    corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(F.count(value) >= 3, F.when(F.stddev_pop(value) == 0, 0.0).otherwise(corrected))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis: NULL below four values, 0 for a constant."""
    n = F.count(value).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(F.count(value) >= 4, F.when(F.stddev_pop(value) == 0, 0.0).otherwise(corrected))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as NULL in all floating-point columns, for data from outside Spark.

    Spark orders NaN above every number, so it would pass for a large value.
    """
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return with_columns(df, {c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def not_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Rows with all group keys present; a NULL key forms no group."""
    cols = list(cols)
    return df.na.drop(subset=cols) if cols else df


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns) if columns else df
