"""Growth, volatility, rolling means, trends and seasonality.

Frames count rows, not days. `split` cuts groups so that one group can run in
several tasks; by default the size of the table decides (functions/row_windows).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallywatch.functions.columns import ratio
from tallywatch.functions.row_windows import (
    must_split,
    over_rows,
    plain_window,
    sort_columns,
    with_carry,
    with_chunks,
)
from tallywatch.schema import ROLLING_WINDOW, VOLATILITY_WINDOW

Cols = Sequence[str] | None
WindowColumns = Callable[[WindowSpec], dict[str, Column]]


def _last_rows(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-(n - 1), Window.currentRow)


def _pad(df: DataFrame, value_col: str, keys: list[str], order: list[str], split: bool) -> DataFrame:
    """Add `_filled`: the value, or the last one before it in the group.

    A split result keeps the `_chunk` of its rows.
    """
    if not split:
        history = plain_window(keys, order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return df.withColumn("_filled", F.last(value_col, ignorenulls=True).over(history))
    carried = with_carry(with_chunks(df, keys, order), keys, order, value_col)
    within = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = F.coalesce(F.last(value_col, ignorenulls=True).over(within), F.col("_carry"))
    return carried.withColumn("_filled", filled).drop("_carry")


def _growth(source: str, periods: int) -> WindowColumns:
    return lambda w: {"growth_rate": ratio(F.col(source), F.lag(source, periods).over(w)) - 1}


def _volatility(value_col: str, window: int) -> WindowColumns:
    def columns(w: WindowSpec) -> dict[str, Column]:
        frame = _last_rows(w, window)
        std = F.stddev_samp(value_col).over(frame)
        return {"volatility": std, "volatility_cv": ratio(std, F.avg(value_col).over(frame))}

    return columns


def _averages(value_col: str, window: int) -> WindowColumns:
    return lambda w: {
        "ma_short": F.avg(value_col).over(_last_rows(w, window)),
        "ma_long": F.avg(value_col).over(_last_rows(w, 2 * window)),
    }


def _with_trend(averaged: DataFrame) -> DataFrame:
    strength = F.col("trend_strength")
    return averaged.withColumn(
        "trend_strength", ratio(F.col("ma_short") - F.col("ma_long"), F.col("ma_long"))
    ).withColumn(
        "trend_direction",
        F.when(strength > 0.05, "upward").when(strength < -0.05, "downward").otherwise("stable"),
    )


def growth_rate(
    df: DataFrame,
    value_col: str = "total_enrolments",
    group_cols: Cols = None,
    periods: int = 1,
    fill: str | None = "pad",
    order_cols: Cols = None,
    split: bool | None = None,
) -> DataFrame:
    """Change against the value `periods` rows earlier; NULL after a zero.

    `fill='pad'` carries the last value over gaps first; None leaves them.
    """
    keys = list(group_cols or [])
    order = sort_columns(df, keys, order_cols)
    splits = must_split(df, split)
    columns, source, pads = df.columns, value_col, fill == "pad"
    if pads:
        df, source = _pad(df, value_col, keys, order, splits), "_filled"
    new = _growth(source, periods)
    out = over_rows(df, keys, order, splits, periods, new, chunked=pads and splits)
    return out.select(*[c for c in columns if c != "growth_rate"], "growth_rate")


def volatility(
    df: DataFrame,
    value_col: str = "total_enrolments",
    group_cols: Cols = None,
    window: int = VOLATILITY_WINDOW,
    order_cols: Cols = None,
    split: bool | None = None,
) -> DataFrame:
    """Rolling sample deviation, absolute and relative to the rolling mean."""
    new = _volatility(value_col, window)
    return over_rows(df, group_cols, order_cols, split, window - 1, new)


def rolling_mean(
    df: DataFrame,
    value_col: str = "total_enrolments",
    group_cols: Cols = None,
    window: int = ROLLING_WINDOW,
    order_cols: Cols = None,
    split: bool | None = None,
) -> DataFrame:
    return over_rows(
        df,
        group_cols,
        order_cols,
        split,
        window - 1,
        lambda w: {"rolling_mean": F.avg(value_col).over(_last_rows(w, window))},
    )


def trends(
    df: DataFrame,
    value_col: str = "total_enrolments",
    group_cols: Cols = None,
    window: int = ROLLING_WINDOW,
    order_cols: Cols = None,
    split: bool | None = None,
) -> DataFrame:
    """Short against long moving average, as a ratio and as a direction."""
    new = _averages(value_col, window)
    return _with_trend(over_rows(df, group_cols, order_cols, split, 2 * window - 1, new))


def series_features(
    df: DataFrame,
    value_col: str = "total_enrolments",
    group_cols: Cols = None,
    order_cols: Cols = None,
    split: bool | None = None,
    trend: bool = True,
) -> DataFrame:
    """Growth, volatility and, with `trend`, trends together, over one cut of the rows."""
    keys = list(group_cols or [])
    order = sort_columns(df, keys, order_cols)
    splits = must_split(df, split)
    parts = [_growth("_filled", 1), _volatility(value_col, VOLATILITY_WINDOW)]
    lookback = VOLATILITY_WINDOW - 1
    if trend:
        parts.append(_averages(value_col, ROLLING_WINDOW))
        lookback = max(lookback, 2 * ROLLING_WINDOW - 1)

    def columns(w: WindowSpec) -> dict[str, Column]:
        return {name: c for part in parts for name, c in part(w).items()}

    filled = _pad(df, value_col, keys, order, splits)
    out = over_rows(filled, keys, order, splits, lookback, columns, chunked=splits).drop("_filled")
    return _with_trend(out) if trend else out


def seasonal_indicator(
    df: DataFrame, date_col: str = "date", value_col: str = "total_enrolments"
) -> DataFrame:
    """Month and weekday, and the value against the mean of its calendar month.

    Month means run over all regions and years. They are at most twelve rows
    and a NULL month, so the broadcast is bounded whatever the input.
    """
    dated = df.withColumns(
        {"month": F.month(date_col), "day_of_week": F.weekday(date_col)}
    ).withColumn("is_weekend", F.col("day_of_week").isin(5, 6).cast("int"))
    value = F.col(value_col)
    months = dated.groupBy("month").agg(
        F.avg(value).alias("_month_mean"),
        F.sum(value.cast("double")).alias("_sum"),
        F.count(value).alias("_n"),
    )
    overall = months.agg(ratio(F.sum("_sum"), F.sum("_n")).alias("m")).scalar()
    joined = dated.join(F.broadcast(months.drop("_sum", "_n")), "month", "left")
    return joined.withColumns(
        {
            "seasonal_factor": ratio(F.col("_month_mean"), overall),
            "seasonal_deviation": ratio(value, F.col("_month_mean")) - 1,
        }
    ).select(
        *df.columns,
        *[c for c in ("month", "day_of_week", "is_weekend") if c not in df.columns],
        "seasonal_factor",
        "seasonal_deviation",
    )
