"""Mergeable sketches: distinct counts and quantiles from bounded summaries.

A sketch of a day, a file or a region is a few kilobytes whatever it covers, and
sketches of parts merge into the sketch of the whole. So they can be stored
beside daily sums and rolled up later without the records. Estimates are within
the bounds below; exact functions stay the default everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.ranks import known

LG_K = 14
KLL_K = 400


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a distinct count; 99.7 % of estimates lie within three."""
    return 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = KLL_K) -> float:
    """How far the rank of an estimated quantile is from the one asked for, with 99 % confidence."""
    return 2.296 / k**0.9723


def distinct_sketch(col: str | Column, lg_k: int = LG_K) -> Column:
    """An aggregate: the sketch of a column's distinct values; null is not one of them."""
    return F.hll_sketch_agg(col, F.lit(lg_k))


def distinct_estimate(sketch: str | Column) -> Column:
    """An aggregate: the distinct values behind all sketches of a group; 0 without any."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0)).cast("long")


def quantile_sketches(
    df: DataFrame, value_cols: Sequence[str], group_cols: Sequence[str] = (), k: int = KLL_K
) -> DataFrame:
    """One row per group with a `<column>_sketch` of each column. Null and NaN are left out."""
    aggs = [
        F.kll_sketch_agg_double(known(F.col(c)), F.lit(k)).alias(f"{c}_sketch") for c in value_cols
    ]
    return df.groupBy(*group_cols).agg(*aggs)


def merge_quantile_sketches(
    sketches: DataFrame, value_cols: Sequence[str], group_cols: Sequence[str] = ()
) -> DataFrame:
    """Sketches rolled up to coarser groups."""
    names = [f"{c}_sketch" for c in value_cols]
    aggs = [F.kll_merge_agg_double(n).alias(n) for n in names]
    return sketches.groupBy(*group_cols).agg(*aggs)


def sketched_quantile(sketch: str, prob: float) -> Column:
    """A value of the data whose rank is within `rank_error` of `prob`; null if there is none."""
    some = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(float(prob))))


def approx_quantiles(
    df: DataFrame,
    quantiles: dict[str, tuple[str, float]],
    group_cols: Sequence[str] = (),
    k: int = KLL_K,
) -> DataFrame:
    """`ranks.exact_quantiles` from sketches: one shuffle of a few kilobytes per group and task.

    Estimates are values that occur, not interpolated between two.
    """
    columns = list(dict.fromkeys(c for c, _ in quantiles.values()))
    found = quantile_sketches(df, columns, group_cols, k)
    return found.select(
        *group_cols, *[sketched_quantile(f"{c}_sketch", p).alias(name) for name, (c, p) in quantiles.items()]
    )


def rank_bounds(df: DataFrame, estimates: DataFrame, value_col: str, names: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """The true ranks of estimated quantiles: `<name>_below` and `<name>_upto`, as shares.

    One pass over the values, beside the estimates of their group.
    """
    keys = list(group_cols)
    own = df.select(*keys, known(F.col(value_col)).alias("_value"))
    renamed = estimates.select(*[F.col(c).alias(f"_of_{c}") for c in keys], *names)
    if keys:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
        joined = own.join(renamed, same)
    else:
        joined = own.withColumn("_e", renamed.select(F.struct(*names).alias("e")).scalar()).select(
            "_value", "_e.*"
        )
    aggs = []
    for name in names:
        aggs.append(F.avg((F.col("_value") < F.col(name)).cast("double")).alias(f"{name}_below"))
        aggs.append(F.avg((F.col("_value") <= F.col(name)).cast("double")).alias(f"{name}_upto"))
    return joined.where(F.col("_value").isNotNull()).groupBy(*keys).agg(*aggs)
