"""Region names as map shapes spell them, and the tables behind the maps."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.columns import not_null, ratio, strip, title_case, with_total
from tallywatch.functions.ranks import exact_quantiles
from tallywatch.functions.scale import written

# Other spellings of region names, matched after title case.
SPELLINGS = {
    "Andaman And Nicobar Islands": "Andaman & Nicobar Island",
    "Andaman & Nicobar": "Andaman & Nicobar Island",
    "Dadra And Nagar Haveli": "Dadara & Nagar Havelli",
    "Dadra & Nagar Haveli": "Dadara & Nagar Havelli",
    "Daman And Diu": "Daman & Diu",
    "Jammu And Kashmir": "Jammu & Kashmir",
    "NCT Of Delhi": "NCT of Delhi",
    "Delhi": "NCT of Delhi",
    "Telengana": "Telangana",
    "Chattisgarh": "Chhattisgarh",
    "Pondicherry": "Puducherry",
    "Orissa": "Odisha",
}

# Region names that differ from their map shape, matched exactly.
SHAPE_NAMES = {
    "Andaman and Nicobar Islands": "Andaman & Nicobar Island",
    "Dadra and Nagar Haveli": "Dadara & Nagar Haveli",
    "Daman and Diu": "Daman & Diu",
    "Delhi": "NCT of Delhi",
    "Jammu and Kashmir": "Jammu & Kashmir",
}

# Both tables together; where they differ, the spelling table wins.
ALL_NAMES = {k.title(): v for k, v in {**SHAPE_NAMES, **SPELLINGS}.items()}


def _lookup(names: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(table, key), key)


def normalize_state_name(state: Column, names: dict[str, str] | None = None) -> Column:
    """Strip, title case, then look up; names not listed stay as they are."""
    return _lookup(ALL_NAMES if names is None else names, title_case(strip(state)))


def shape_name(state: Column, names: dict[str, str] | None = None) -> Column:
    """Look the name up as written."""
    return _lookup(SHAPE_NAMES if names is None else names, state)


def _normalized(df: DataFrame, state_col: str) -> DataFrame:
    """Names are mapped after grouping, on one row per region."""
    return df.withColumn("state_normalized", normalize_state_name(F.col(state_col)))


def risk_map(df: DataFrame, state_col: str = "state", value_col: str = "risk_score") -> DataFrame:
    """Mean value and total enrolments per region."""
    size = F.sum("total_enrolments") if "total_enrolments" in df.columns else F.count("*")
    grouped = not_null(df, [state_col]).groupBy(state_col)
    return grouped.agg(
        F.avg(value_col).alias(value_col), size.alias("total_enrolments")
    ).transform(_normalized, state_col)


def enrolment_map(df: DataFrame, state_col: str = "state") -> DataFrame:
    """Total enrolments per region, also on a log scale."""
    grouped = not_null(with_total(df), [state_col]).groupBy(state_col)
    totals = grouped.agg(F.sum("total_enrolments").alias("total_enrolments"))
    return totals.transform(_normalized, state_col).withColumn(
        "log_enrolments", F.log10(F.col("total_enrolments") + 1)
    )


def anomaly_map(df: DataFrame, state_col: str = "state") -> DataFrame:
    """Anomaly share per region, with the 95 % quantile that caps the colours."""
    if "is_anomaly" not in df.columns:
        raise ValueError("No anomaly data available")
    rates = (
        not_null(df, [state_col])
        .groupBy(state_col)
        .agg(
            F.count_if("is_anomaly").alias("anomaly_count"),
            F.count("is_anomaly").alias("total_records"),
        )
        .withColumn("anomaly_rate", ratio(F.col("anomaly_count"), F.col("total_records")))
    )
    cap = exact_quantiles(rates, {"cap": ("anomaly_rate", 0.95)}).scalar()
    return rates.transform(_normalized, state_col).withColumn("colour_cap", cap)


def child_ratio_map(df: DataFrame, state_col: str = "state") -> DataFrame:
    """Band sums and child share per region."""
    bands = ("age_0_5", "age_5_17", "age_18_greater", "total_enrolments")
    sums = (
        not_null(with_total(df), [state_col])
        .groupBy(state_col)
        .agg(*[F.sum(c).alias(c) for c in bands])
    )
    children = F.col("age_0_5") + F.col("age_5_17")
    return sums.withColumn("child_ratio", ratio(children, F.col("total_enrolments"))).transform(
        _normalized, state_col
    )


def choropleth(
    df: DataFrame, value_col: str = "risk_score", state_col: str = "state"
) -> DataFrame:
    """Mean value per region of a dated table; an undated one passes through."""
    if "date" in df.columns:
        size = (
            F.sum("total_enrolments").alias("total_enrolments")
            if "total_enrolments" in df.columns
            else F.count("*").alias("total_enrolments")
        )
        df = (
            not_null(df, [state_col])
            .groupBy(state_col)
            .agg(F.avg(value_col).alias(value_col), size)
        )
    return df.withColumn(state_col, shape_name(F.col(state_col)))


def top_regions(
    df: DataFrame, value_col: str = "risk_score", state_col: str = "state", n: int = 15
) -> DataFrame:
    """The rows with the largest values, for a chart when there is no map."""
    ties = [c for c in (state_col, "date") if c in df.columns]
    return df.orderBy(F.desc_nulls_last(value_col), *ties).limit(n)


def risk_grid(
    df: DataFrame,
    values: Sequence[str] | None = None,
    x_col: str = "state",
    y_col: str = "date",
    value_col: str = "risk_score",
) -> DataFrame:
    """Mean value per date and region, regions as columns, gaps as 0.

    Without `values` Spark finds the regions and refuses more of them than
    spark.sql.pivotMaxValues allows columns: `risk_grid_rows` takes any number.
    """
    grouped = not_null(df, [y_col] if values is not None else [y_col, x_col]).groupBy(y_col)
    pivoted = grouped.pivot(x_col, None if values is None else list(values))
    return pivoted.agg(F.avg(value_col)).na.fill(0.0)


def risk_grid_rows(
    df: DataFrame, x_col: str = "state", y_col: str = "date", value_col: str = "risk_score"
) -> DataFrame:
    """The grid as rows: a mean for every region on every date, gaps as 0.

    For any number of regions: none of them is a column, and their names never
    leave the executors. The dates, as many as the calendar has, are put beside
    each region from one array. Rows without a date or region are left out.
    """
    cells = not_null(df, [x_col, y_col]).groupBy(x_col, y_col).agg(F.avg(value_col).alias(value_col))
    cells = written(cells, "grid-cells")
    days = cells.agg(F.array_sort(F.collect_set(y_col)).alias("d")).scalar()
    regions = cells.select(x_col).distinct()
    full = regions.select(x_col, F.explode(days).alias(y_col)).join(cells, [x_col, y_col], "left")
    return full.select(y_col, x_col, F.coalesce(value_col, F.lit(0.0)).alias(value_col))


def grid_rows(
    grid: DataFrame, x_col: str = "state", y_col: str = "date", value_col: str = "risk_score"
) -> DataFrame:
    """The cells of a grid as rows, whatever its columns are."""
    columns = [c for c in grid.columns if c != y_col]
    return grid.unpivot([y_col], columns, x_col, value_col)


def district_bubbles(
    df: DataFrame, size_col: str = "total_enrolments", color_col: str = "risk_score", n: int = 50
) -> DataFrame:
    """The largest districts with their mean risk."""
    size = F.sum(size_col) if size_col == "total_enrolments" else F.avg(size_col)
    keys = ["state", "district"]
    return (
        not_null(df, keys)
        .groupBy(*keys)
        .agg(size.alias(size_col), F.avg(color_col).alias(color_col))
        .orderBy(F.desc_nulls_last(size_col), *keys)
        .limit(n)
    )
