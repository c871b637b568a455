"""Exact quantiles and average ranks without gathering a group in one task.

Large inputs are first reduced to (group, value, count). Those rows are cut
along (group, value) into stored chunks of even size, whatever the values are.
Rank positions come from running sums over the chunks' counts, and only chunks
that hold a wanted rank are sorted again. A value shared by many rows is a
single counted row throughout.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.row_windows import with_chunks
from tallywatch.functions.scale import is_small


def known(value: Column) -> Column:
    """The value as a double; null if it is NaN."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def _running(df: DataFrame, keys: Sequence[str], order: str, count: str = "_n") -> DataFrame:
    """Add `_before`: the count of all rows in earlier positions of the group."""
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_before", F.sum(count).over(window) - F.col(count))


def _ranks(probs: Sequence[float], total: Column) -> Column:
    """The distinct 0-based ranks around each quantile position."""
    positions = [F.lit(float(p)) * (total - 1) for p in probs]
    ranks = [f(x) for x in positions for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*ranks))


def _placed(counts: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The counts in chunks, and (keys, _chunk, _n, _base, _total) of every chunk.

    `_base` counts the rows of the group in earlier chunks. A group has at most
    as many rows in the second table as there are chunks.
    """
    chunked = with_chunks(counts, keys, [value])
    sums = chunked.groupBy(*keys, "_chunk").agg(F.sum("_n").alias("_n"))
    sums = _running(sums, keys, "_chunk").withColumnRenamed("_before", "_base")
    return chunked, sums.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))


def _on_chunk(rows: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the columns of their chunk; a null key is a group of its own."""
    names = {k: f"_of_{i}" for i, k in enumerate([*keys, "_chunk"])}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(
        chunks.withColumnsRenamed(names), reduce(lambda a, b: a & b, same)
    ).drop(*names.values())


def _select_ranks(counts: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """(keys, _total, _rank, _v) for each rank that the quantiles need."""
    chunked, sums = _placed(counts, keys, "_v")
    held = F.filter(
        _ranks(probs, F.col("_total")),
        lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_n")),
    )
    wanted = sums.select(*keys, "_chunk", "_base", "_total", F.explode(held).alias("_rank"))
    rows = _running(_on_chunk(chunked, wanted, keys), [*keys, "_chunk", "_rank"], "_v")
    first = F.col("_base") + F.col("_before")
    return rows.where(
        (F.col("_rank") >= first) & (F.col("_rank") < first + F.col("_n"))
    ).select(*keys, "_total", "_rank", "_v")


def _at(prob: float) -> Column:
    """The interpolated quantile over the selected ranks of one group."""
    position = F.lit(float(prob)) * (F.col("_total") - 1)
    low = F.max(F.when(F.col("_rank") == F.floor(position), F.col("_v")))
    high = F.max(F.when(F.col("_rank") == F.ceil(position), F.col("_v")))
    total = F.max("_total")
    share = F.lit(float(prob)) * (total - 1) - F.floor(F.lit(float(prob)) * (total - 1))
    return low + (high - low) * share


def exact_quantiles(
    df: DataFrame,
    quantiles: dict[str, tuple[str, float]],
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group (one row if ungrouped).

    `quantiles` maps an output column to (value column, probability).
    """
    group_cols = list(group_cols)
    value_cols = list(dict.fromkeys(c for c, _ in quantiles.values()))
    # NaN is a missing value, whichever way the ranks are found.
    narrow = df.select(*group_cols, *[known(F.col(c)).alias(c) for c in value_cols])
    if is_small(narrow):
        return narrow.groupBy(*group_cols).agg(
            *[
                F.percentile(F.col(c), F.lit(p)).alias(name)
                for name, (c, p) in quantiles.items()
            ]
        )

    entries = [
        F.struct(F.lit(i).alias("_c"), F.col(c).alias("_v"))
        for i, c in enumerate(value_cols)
    ]
    counts = (
        narrow.select(*group_cols, F.inline(F.array(*entries)))
        .where(F.col("_v").isNotNull())
        .groupBy(*group_cols, "_c", "_v")
        .agg(F.count("*").alias("_n"))
    )
    per_column = sorted({p for _, p in quantiles.values()})
    ranks = _select_ranks(counts, [*group_cols, "_c"], per_column)
    by_column = ranks.groupBy(*group_cols, "_c").agg(
        *[_at(p).alias(f"_p{i}") for i, p in enumerate(per_column)]
    )
    found = by_column.groupBy(*group_cols).agg(
        *[
            F.max(
                F.when(F.col("_c") == value_cols.index(c), F.col(f"_p{per_column.index(p)}"))
            ).alias(name)
            for name, (c, p) in quantiles.items()
        ]
    )
    if not group_cols:
        return found
    # A group whose values are all NULL keeps its row, with NULL quantiles.
    keys = df.select(*group_cols).distinct()
    same = [keys[c].eqNullSafe(found[c]) for c in group_cols]
    return keys.join(found, reduce(lambda a, b: a & b, same), "left").select(
        *[keys[c] for c in group_cols], *list(quantiles)
    )


def average_ranks(df: DataFrame, value_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group, value, average rank, group size) per distinct value, null and NaN left out.

    Each sort covers one chunk of one group, never the group itself.
    """
    keys = list(group_cols)
    counts = (
        df.where(known(F.col(value_col)).isNotNull())
        .groupBy(*keys, F.col(value_col).alias("_value"))
        .agg(F.count("*").alias("_n"))
    )
    chunked, sums = _placed(counts, keys, "_value")
    rows = _running(_on_chunk(chunked, sums.drop("_n"), keys), [*keys, "_chunk"], "_value")
    before = F.col("_base") + F.col("_before")
    return rows.select(
        *keys,
        F.col("_value"),
        (before + (F.col("_n") + 1) / 2).alias("_rank"),
        F.col("_total"),
    )
