"""Forecasts per key. Every key is a row set of the same plan; there is no loop.

Records are summed per key and date first, so a key has at most one row per
calendar day from then on and its windows stay small. Holt's method takes
series of any length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.columns import flag, not_null, ratio, with_total
from tallywatch.functions.row_windows import must_split, with_chunks

TREND_WINDOW = 14
MIN_ROWS = 7
BOUND_SCORE = 1.96
HOLT_ALPHA = 0.3
HOLT_BETA = 0.1
FORECAST_COLS = (
    "date",
    "predicted",
    "lower_bound",
    "upper_bound",
    "trend",
    "seasonal_factor",
)


def daily_series(
    df: DataFrame,
    keys: Sequence[str] = (),
    date_col: str = "date",
    value_col: str = "total_enrolments",
) -> DataFrame:
    """(keys, date, value, records): the history that a forecast is fitted on."""
    source = with_total(df) if value_col == "total_enrolments" else df
    return (
        not_null(source, [*keys, date_col])
        .groupBy(*keys, F.to_date(date_col).alias("date"))
        .agg(F.sum(value_col).cast("double").alias("value"), F.count("*").alias("records"))
    )


def fit(series: DataFrame, keys: Sequence[str] = (), trend_window: int = TREND_WINDOW) -> DataFrame:
    """One row per key: trend line over the day index, weekday factors, spread.

    The trend runs over the position of a day in the history, not the calendar.
    A key with a single day has no slope and is left out.
    """
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    place = F.row_number().over(by_key.orderBy("date"))
    indexed = series.withColumns(
        {
            "x": (place - 1).cast("double"),
            "recency": F.count("*").over(by_key) - place + 1,
            "weekday": F.weekday("date"),
        }
    )
    # Seven conditional means instead of a second grouping and a join.
    weekday_means = [
        F.avg(F.when(F.col("weekday") == d, F.col("value"))).alias(f"_w{d}") for d in range(7)
    ]
    model = indexed.groupBy(*keys).agg(
        F.regr_slope("value", "x").alias("slope"),
        F.regr_intercept("value", "x").alias("intercept"),
        F.max("date").alias("last_date"),
        F.count("*").alias("days"),
        F.sum("records").alias("records"),
        F.avg("value").alias("mean"),
        F.stddev_samp(F.when(F.col("recency") <= trend_window, F.col("value"))).alias("spread"),
        *weekday_means,
    )
    factors = F.array(*[ratio(F.col(f"_w{d}"), F.col("mean")) for d in range(7)])
    return (
        model.where(F.col("days") >= 2)
        .withColumn("factors", factors)
        .drop(*[f"_w{d}" for d in range(7)])
    )


def predict(model: DataFrame, keys: Sequence[str] = (), periods: int = 7) -> DataFrame:
    """`periods` days per key with bounds that widen with the horizon."""
    ahead = model.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    ahead = ahead.withColumn("date", F.date_add("last_date", F.col("h"))).withColumns(
        {
            "trend": F.col("intercept") + F.col("slope") * (F.col("days") - 1 + F.col("h")),
            "seasonal_factor": F.coalesce(F.get("factors", F.weekday("date")), F.lit(1.0)),
        }
    )
    raw = F.col("trend") * F.col("seasonal_factor")
    margin = F.col("spread") * F.sqrt(F.col("h").cast("double")) * BOUND_SCORE
    zero = F.lit(0.0)
    return ahead.select(
        *keys,
        "date",
        F.greatest(zero, raw).alias("predicted"),
        F.greatest(zero, raw - margin).alias("lower_bound"),
        (raw + margin).alias("upper_bound"),
        "trend",
        "seasonal_factor",
        F.col("mean").alias("history_mean"),
    )


def future_anomalies(
    forecast: DataFrame, keys: Sequence[str] = (), threshold: float = 0.3
) -> DataFrame:
    """Flags wide bounds and jumps above 20 % between forecast days."""
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    previous = F.lag("predicted").over(by_key.orderBy("date"))
    jump_from_zero = (F.col("_previous") == 0) & (F.col("predicted") > 0)
    change = F.abs(ratio(F.col("predicted"), F.col("_previous")) - 1)
    return (
        forecast.withColumn("_previous", previous)
        .withColumns(
            {
                "volatility_ratio": ratio(
                    F.col("upper_bound") - F.col("lower_bound"), F.col("history_mean")
                ),
                "trend_change": F.when(jump_from_zero, F.lit(float("inf"))).otherwise(change),
            }
        )
        .withColumn("high_uncertainty", flag(F.col("volatility_ratio") > threshold))
        .withColumn("anomaly_risk", flag(F.col("trend_change") > 0.2) | F.col("high_uncertainty"))
        .drop("_previous", "history_mean")
    )


def forecast_by_state(
    df: DataFrame,
    periods: int = 7,
    date_col: str = "date",
    value_col: str = "total_enrolments",
    state_col: str = "state",
) -> DataFrame:
    """Forecasts of every state that has at least seven rows."""
    keys = [state_col]
    model = fit(daily_series(df, keys, date_col, value_col), keys)
    model = model.where(F.col("records") >= MIN_ROWS)
    return model.transform(predict, keys, periods).transform(future_anomalies, keys)


def forecast_total(
    df: DataFrame, periods: int = 14, date_col: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """(daily history, forecast) over all regions together."""
    series = daily_series(df, (), date_col)
    forecast = fit(series).transform(predict, (), periods).transform(future_anomalies)
    return series.select("date", F.col("value").alias("total_enrolments")), forecast


def _matrix_power(alpha: float, beta: float, k: Column) -> list[list[Column]]:
    """The matrix of `k` Holt steps without new values, entry by entry.

    One step takes (level, trend) to A (level, trend) + value (alpha, alpha * beta).
    By Cayley and Hamilton every power of A is x A + y I, where x and y follow
    from its eigenvalues: two real ones, one twice, or a complex pair.
    """
    a = [[1 - alpha, 1 - alpha], [-alpha * beta, 1 - alpha * beta]]
    half, det = (a[0][0] + a[1][1]) / 2, 1 - alpha
    root = half * half - det
    k = k.cast("double")
    if root > 1e-12:
        e1, e2 = half + math.sqrt(root), half - math.sqrt(root)
        p1, p2 = F.pow(F.lit(e1), k), F.pow(F.lit(e2), k)
        x, y = (p1 - p2) / (e1 - e2), (e1 * p2 - e2 * p1) / (e1 - e2)
    elif root < -1e-12:
        size, angle = math.sqrt(det), math.atan2(math.sqrt(-root), half)
        grown = F.pow(F.lit(size), k)
        sine = F.sin(k * angle) / math.sin(angle)
        x, y = grown / size * sine, grown * (F.cos(k * angle) - math.cos(angle) * sine)
    else:
        x = k * F.pow(F.lit(half), k - 1) if half else F.when(k == 1, 1.0).otherwise(0.0)
        y = F.pow(F.lit(half), k) - half * x
    return [[a[i][j] * x + (y if i == j else 0) for j in (0, 1)] for i in (0, 1)]


def holt_fit(
    series: DataFrame,
    keys: Sequence[str] = (),
    alpha: float = HOLT_ALPHA,
    beta: float = HOLT_BETA,
    order_cols: Sequence[str] = ("date",),
    split: bool | None = None,
) -> DataFrame:
    """Holt's level and trend per key, over its values in the given order.

    Steps are affine maps of (level, trend), and maps compose in any grouping.
    So the rows are cut into chunks along the order, each chunk is summed to
    one map, and the few maps of a key are composed: no key is gathered in one
    task, however long its series. Small inputs are one chunk. A missing value
    makes its key's result NULL, and the result is the same as stepping through
    the rows, but for rounding. `order_cols` must not tie within a key.
    """
    keys, order = list(keys), list(order_cols)
    rows = series.select(
        *dict.fromkeys([*keys, *order, "date"]), F.col("value").cast("double").alias("value")
    )
    if must_split(rows, split):
        rows = with_chunks(rows, keys, order)
    else:
        rows = rows.withColumn("_chunk", F.lit(0))
    in_chunk = Window.partitionBy(*keys, "_chunk")
    placed = rows.withColumns(
        {
            "_i": F.row_number().over(in_chunk.orderBy(*order)),
            "_left": F.count("*").over(in_chunk) - F.row_number().over(in_chunk.orderBy(*order)),
        }
    )
    value = F.col("value")
    power = _matrix_power(alpha, beta, F.col("_left"))
    # What a value adds to (level, trend) at the end of its chunk.
    added = [(row[0] * alpha + row[1] * (alpha * beta)) * value for row in power]
    first = F.col("_i") == 1
    chunks = placed.groupBy(*keys, "_chunk").agg(
        F.count("*").alias("_n"),
        (F.count(value) < F.count("*")).alias("_gap"),
        F.max("date").alias("last_date"),
        F.max(F.when(first, value)).alias("_v1"),
        F.max(F.when(F.col("_i") == 2, value)).alias("_v2"),
        *[F.coalesce(F.sum(F.when(~first, a)), F.lit(0.0)).alias(f"_b{i}") for i, a in enumerate(added)],
        *[F.max(F.when(first, a)).alias(f"_f{i}") for i, a in enumerate(added)],
    )
    # From here on one row a chunk.
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk")
    rest = along.rowsBetween(1, Window.unboundedFollowing)
    chunks = chunks.withColumns(
        {
            "_after": F.coalesce(F.sum("_n").over(rest), F.lit(0)),
            "_opens": F.row_number().over(along) == 1,
            "_second": F.coalesce("_v2", F.lead("_v1").over(along)),
        }
    )
    # The first value of a key is its first level, not a step.
    b = [F.col(f"_b{i}") + F.when(F.col("_opens"), 0.0).otherwise(F.col(f"_f{i}")) for i in (0, 1)]
    power = _matrix_power(alpha, beta, F.col("_after"))
    steps = _matrix_power(alpha, beta, F.col("_after") + F.col("_n") - 1)
    start = [F.col("_v1"), F.coalesce(F.col("_second") - F.col("_v1"), F.lit(0.0))]
    parts = [
        row[0] * b[0] + row[1] * b[1] + F.when(F.col("_opens"), s[0] * start[0] + s[1] * start[1]).otherwise(0.0)
        for row, s in zip(power, steps)
    ]
    return chunks.groupBy(*keys).agg(
        F.max("last_date").alias("last_date"),
        *[
            F.when(~F.bool_or("_gap"), F.sum(part)).alias(name)
            for name, part in zip(("level", "trend"), parts)
        ],
    )


def holt_predict(model: DataFrame, keys: Sequence[str] = (), periods: int = 7) -> DataFrame:
    """level + h * trend for h = 1..periods."""
    return model.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(periods)))).select(
        *keys,
        "h",
        F.date_add("last_date", F.col("h")).alias("date"),
        (F.col("level") + F.col("h") * F.col("trend")).alias("predicted"),
    )
