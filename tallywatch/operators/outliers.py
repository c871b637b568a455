"""Statistical outliers, ranks and distribution statistics.

Group statistics come from aggregations that combine before the shuffle and
are joined back. A window over the whole group would put it in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.columns import (
    flag,
    not_null,
    ratio,
    sample_kurtosis,
    sample_skewness,
    with_columns,
)
from tallywatch.functions.normal import normal_quantile, normal_upper_tail, polynomial
from tallywatch.functions.ranks import average_ranks, exact_quantiles, known
from tallywatch.functions.samples import spread_sample
from tallywatch.functions.scale import join_stats, with_row
from tallywatch.functions.sketches import approx_quantiles
from tallywatch.schema import ZSCORE_THRESHOLD


def _direction(high: Column, low: Column) -> Column:
    return F.when(high, "high").when(low, "low").otherwise("normal")


def _zscore_columns(z: Column, threshold: float, prefix: str = "") -> dict[str, Column]:
    return {
        f"{prefix}zscore": z,
        f"{prefix}zscore_outlier": flag(F.abs(z) > threshold),
        f"{prefix}zscore_direction": _direction(z > threshold, z < -threshold),
    }


def _iqr_columns(value: Column, low: Column, high: Column, prefix: str = "") -> dict[str, Column]:
    return {
        f"{prefix}iqr_lower": low,
        f"{prefix}iqr_upper": high,
        f"{prefix}iqr_outlier": flag((value < low) | (value > high)),
        f"{prefix}iqr_direction": _direction(value > high, value < low),
    }


def zscore_analysis(
    df: DataFrame,
    value_col: str,
    threshold: float = ZSCORE_THRESHOLD,
    group_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Population z-score with flag and direction; a constant group has none."""
    value = F.col(value_col).cast("double")
    moments = [F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")]
    if group_cols:
        stats = not_null(df, group_cols).groupBy(*group_cols).agg(*moments)
        z = ratio(value - F.col("_mean"), F.col("_std"))
        joined = join_stats(df, stats, group_cols)
        return joined.withColumns(_zscore_columns(z, threshold)).drop("_mean", "_std")
    z = ratio(value - F.col("_s._mean"), F.col("_s._std"))
    return with_row(df, df.agg(*moments), "_s").withColumns(_zscore_columns(z, threshold)).drop("_s")


def _fences(q1: Column, q3: Column, multiplier: float) -> tuple[Column, Column]:
    spread = q3 - q1
    return q1 - multiplier * spread, q3 + multiplier * spread


def iqr_analysis(
    df: DataFrame,
    value_col: str,
    multiplier: float = 1.5,
    group_cols: Sequence[str] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Interquartile-range fences with flag and direction.

    `approximate` takes the quartiles from mergeable sketches, one shuffle of a
    few kilobytes per group and task; their ranks are within `sketches.rank_error`.
    """
    wanted = {"_q1": (value_col, 0.25), "_q3": (value_col, 0.75)}
    quantiles = approx_quantiles if approximate else exact_quantiles
    value = F.col(value_col)
    if group_cols:
        stats = quantiles(not_null(df, group_cols), wanted, group_cols)
        joined = join_stats(df, stats, group_cols)
        low, high = _fences(F.col("_q1"), F.col("_q3"), multiplier)
        return joined.withColumns(_iqr_columns(value, low, high)).drop("_q1", "_q3")
    low, high = _fences(F.col("_s._q1"), F.col("_s._q3"), multiplier)
    quartiles = quantiles(df, wanted)
    return with_row(df, quartiles, "_s").withColumns(_iqr_columns(value, low, high)).drop("_s")


def statistical_outliers(
    df: DataFrame,
    value_cols: Sequence[str],
    method: str = "both",
    zscore_threshold: float = ZSCORE_THRESHOLD,
    iqr_multiplier: float = 1.5,
) -> DataFrame:
    """Both tests on several columns; all statistics share one aggregation each."""
    cols = [c for c in value_cols if c in df.columns]
    new: dict[str, Column] = {}
    flags: list[str] = []
    source = df
    if cols and method in ("zscore", "both"):
        moments = [
            f(F.col(c).cast("double")).alias(f"{name}_{i}")
            for i, c in enumerate(cols)
            for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))
        ]
        source = with_row(source, df.agg(*moments), "_s")
        for i, c in enumerate(cols):
            z = ratio(F.col(c).cast("double") - F.col(f"_s.mean_{i}"), F.col(f"_s.std_{i}"))
            new |= _zscore_columns(z, zscore_threshold, f"{c}_")
            flags.append(f"{c}_zscore_outlier")
    if cols and method in ("iqr", "both"):
        wanted = {
            f"{name}_{i}": (c, p) for i, c in enumerate(cols) for name, p in (("q1", 0.25), ("q3", 0.75))
        }
        source = with_row(source, exact_quantiles(df, wanted), "_q")
        for i, c in enumerate(cols):
            low, high = _fences(F.col(f"_q.q1_{i}"), F.col(f"_q.q3_{i}"), iqr_multiplier)
            new |= _iqr_columns(F.col(c), low, high, f"{c}_")
            flags.append(f"{c}_iqr_outlier")
    df = with_columns(source, new).drop("_s", "_q")
    if method == "both":
        count = sum((F.col(f).cast("int") for f in flags), F.lit(0))
        df = df.withColumn("outlier_count", count).withColumn(
            "any_outlier", F.col("outlier_count") > 0
        )
    return df


def percentile_rank(
    df: DataFrame, value_col: str, group_cols: Sequence[str] | None = None
) -> DataFrame:
    """Average-tie rank as a percentage of the non-null values of the group."""
    keys = list(group_cols or [])
    ranks = average_ranks(not_null(df, keys), value_col, keys).select(
        *keys,
        F.col("_value").alias(value_col),
        (F.col("_rank") / F.col("_total") * 100).alias("percentile_rank"),
    )
    return join_stats(df, ranks, [*keys, value_col])


NORMALITY_ROWS = 5000
# Royston's polynomials (1995) for the weights of the two largest values, and for
# the mean and the logarithm of the deviation of the transformed statistic. Highest power first.
_LARGEST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
_SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
_FEW_MEAN = (-0.0006714, 0.025054, -0.39978, 0.5440)
_FEW_SPREAD = (-0.0020322, 0.062767, -0.77857, 1.3822)
_MANY_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
_MANY_SPREAD = (0.0030302, -0.082676, -0.4803)


def shapiro_wilk(
    df: DataFrame, value_col: str, max_rows: int = NORMALITY_ROWS, seed: int = 42
) -> DataFrame:
    """One row of the Shapiro-Wilk test: n_tested, w_statistic and normality_pvalue.

    It runs on all known values, or on `max_rows` of them (5000 at most, as the
    p-value is fitted up to there) spread evenly in hash order, so that reruns
    agree. Null and NaN are left out. Fewer than eight values, or values all
    alike, have no statistic.
    """
    if not 8 <= max_rows <= NORMALITY_ROWS:
        raise ValueError(f"max_rows must be from 8 to {NORMALITY_ROWS}")
    values = df.select(known(F.col(value_col)).alias("v")).where("v is not null")
    rows = values.count()
    drawn = spread_sample(values, ["v"], rows, min(rows, max_rows), seed)
    # At most max_rows rows from here on, so one task may hold them.
    whole = Window.partitionBy(F.lit(0))
    placed = drawn.select(
        (F.col("v") - F.avg("v").over(whole)).alias("x"),
        F.row_number().over(whole.orderBy("v", "slot")).alias("i"),
        F.count("*").over(whole).alias("n"),
    )
    # Expected normal order scores; the weights are these but for the two ends.
    score = normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25))
    scored = placed.withColumn("m", score)
    from_top = F.col("n") - F.col("i")
    ends = (F.col("i") <= 2) | (from_top < 2)

    def at(place: Column, name: str) -> Column:
        return F.max(F.when(place, F.col(name)))

    sums = scored.agg(
        F.count("*").alias("n"),
        F.sum(F.col("x") * F.col("x")).alias("squares"),
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.when(~ends, F.col("m") * F.col("x"))).alias("inner"),
        at(from_top == 0, "m").alias("m1"),
        at(from_top == 1, "m").alias("m2"),
        (at(from_top == 0, "x") - at(F.col("i") == 1, "x")).alias("range1"),
        (at(from_top == 1, "x") - at(F.col("i") == 2, "x")).alias("range2"),
    )
    n, root, mm = F.col("n"), 1 / F.sqrt("n"), F.col("mm")
    m1, m2 = F.col("m1"), F.col("m2")
    weighted = sums.where((n >= 8) & (F.col("range1") > 0)).withColumns(
        {
            "a1": m1 / F.sqrt(mm) + polynomial(root, _LARGEST),
            "a2": m2 / F.sqrt(mm) + polynomial(root, _SECOND),
        }
    )
    a1, a2 = F.col("a1"), F.col("a2")
    rest = F.sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
    slope = a1 * F.col("range1") + a2 * F.col("range2") + F.col("inner") / rest
    w = F.least(slope * slope / F.col("squares"), F.lit(1.0))
    gap, size, log_n = F.log(1 - F.col("w")), n.cast("double"), F.log("n")
    few = (-F.log(0.459 * size - 2.273 - gap) - polynomial(size, _FEW_MEAN)) / F.exp(
        polynomial(size, _FEW_SPREAD)
    )
    many = (gap - polynomial(log_n, _MANY_MEAN)) / F.exp(polynomial(log_n, _MANY_SPREAD))
    p = normal_upper_tail(F.when(n < 12, few).otherwise(many))
    tested = weighted.withColumn("w", w).select(
        F.col("w").alias("w_statistic"),
        F.when(F.col("w") < 1, p).otherwise(1.0).alias("normality_pvalue"),
    )
    return with_row(sums.select(n.alias("n_tested")), tested, "_t").select(
        "n_tested", "_t.w_statistic", "_t.normality_pvalue"
    )


def distribution_stats(
    df: DataFrame,
    value_col: str,
    normality: str = "shapiro_wilk",
    approximate: bool = False,
    **options,
) -> DataFrame:
    """One row of moments, quartiles and a normality test.

    `approximate` takes the quartiles from a mergeable sketch.

    `normality` is "shapiro_wilk", which adds n_tested and w_statistic and takes
    the options of `shapiro_wilk`, or "jarque_bera", which needs only moments
    and uses every row however many there are.
    """
    if normality not in ("shapiro_wilk", "jarque_bera"):
        raise ValueError(f"unknown normality test: {normality}")
    value = F.col(value_col).cast("double")
    n = F.count(value)
    tests = []
    if normality == "jarque_bera":
        skew, kurt = F.skewness(value), F.kurtosis(value)
        statistic = n / 6 * (skew * skew + kurt * kurt / 4)
        p_value = F.when((n >= 8) & (F.stddev_pop(value) > 0), F.exp(-statistic / 2))
        tests = [p_value.alias("normality_pvalue")]
    quartiles = {f"_q{i}": (value_col, i / 4) for i in (1, 2, 3)}
    stats = df.agg(
        n.alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        sample_skewness(value).alias("skewness"),
        sample_kurtosis(value).alias("kurtosis"),
        *tests,
    )
    if normality == "shapiro_wilk":
        tested = with_row(stats, shapiro_wilk(df, value_col, **options), "_t")
        names = ("n_tested", "w_statistic", "normality_pvalue")
        stats = tested.withColumns({c: F.col(f"_t.{c}") for c in names}).drop("_t")
    q1, q2, q3 = (F.col(f"_s._q{i}") for i in (1, 2, 3))
    return (
        with_row(stats, (approx_quantiles if approximate else exact_quantiles)(df, quartiles), "_s")
        .withColumns({"median": q2, "q1": q1, "q3": q3, "iqr": q3 - q1})
        .withColumn("is_normal", F.col("normality_pvalue") > 0.05)
        .drop("_s")
    )
