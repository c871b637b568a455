"""Row-frame windows, with or without splitting a group over several tasks.

An ordinary window puts each group in one task, which is right for tables that
are small as a whole. In a larger table one group may hold much of the rows, so
the rows are range-partitioned by group and order and stored with the number of
their partition: chunks of even size, of which each boundary cuts at most one
group. A chunk also gets copies of the last rows before it in a group that was
cut (its halo), so frames that reach back a fixed number of rows see the same
rows as without the cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallywatch.functions.scale import estimated_bytes, is_small, written

CHUNK_CONF = "spark.tallywatch.chunkBytes"
# Of stored Parquet: several times as much in memory.
CHUNK_BYTES = 32 * 1024 * 1024
TIE_COLS = ("state", "district", "pincode")


def sort_columns(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str] | None
) -> list[str]:
    """The caller's order, or the date with the region keys as tie-breaks."""
    if order_cols:
        return list(order_cols)
    ties = [c for c in TIE_COLS if c in df.columns and c not in group_cols]
    return ["date", *ties]


def must_split(df: DataFrame, split: bool | None) -> bool:
    """The caller's choice, or by size. False suits groups known to be short."""
    return not is_small(df) if split is None else split


def plain_window(group_cols: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*(group_cols or [F.lit(0)])).orderBy(*order)


def chunk_count(rows: DataFrame) -> int:
    """How many chunks keep each near the target size; `rows` is a stored table."""
    target = int(rows.sparkSession.conf.get(CHUNK_CONF, str(CHUNK_BYTES)))
    return -(-estimated_bytes(rows) // target)


def with_chunks(df: DataFrame, group_cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The stored rows of `df` with `_chunk`, which never decreases along (group, order).

    There are as many chunks as the stored rows' bytes ask for, so a chunk stays
    the same size as the table grows; below the session's shuffle partitions
    adaptive execution chooses their number. Rows that are equal in group and
    order are dealt over several chunks, if they are many, by a number of their
    own. The rows are stored first, as finding even bounds reads them once more,
    and after, so that every reader sees the same chunks.
    """
    numbered = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = written(numbered, "window-input")
    count = chunk_count(rows)
    few = count <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [*group_cols, *order, "_tie"]
    placed = rows.repartitionByRange(*cuts) if few else rows.repartitionByRange(count, *cuts)
    return written(placed.drop("_tie").withColumn("_chunk", F.spark_partition_id()), "window-chunks")


def with_carry(df: DataFrame, group_cols: Sequence[str], order: Sequence[str], col: str) -> DataFrame:
    """Add `_carry`: the last non-null `col` in the chunks before a row's own."""
    keys = list(group_cols)
    last = F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.struct(*order)))
    per_chunk = df.groupBy(*keys, "_chunk").agg(last.alias("_last"))
    before = plain_window(keys, ["_chunk"]).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *keys, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carry")
    ).where(F.col("_carry").isNotNull())
    # Only a chunk's first group can have earlier chunks: at most one row per chunk.
    return df.join(F.broadcast(carried), [*keys, "_chunk"], "left")


def with_halo(
    df: DataFrame, group_cols: Sequence[str], order: Sequence[str], lookback: int
) -> DataFrame:
    """Rows of `df` plus, per chunk, the `lookback` rows before it (`_halo`).

    Only groups that lie in several chunks need one, at most one for each
    boundary between chunks; of those only the last rows of each chunk are
    copied. So the copies grow with the number of chunks, not of rows or groups.
    """
    keys, cut = list(group_cols), df
    if keys:
        ends = df.groupBy(*keys).agg(F.min("_chunk").alias("_lo"), F.max("_chunk").alias("_hi"))
        # At most one group for each boundary between chunks.
        spanning = F.broadcast(ends.where("_lo < _hi").select(*keys))
        cut = df.join(spanning, keys, "left_semi")
    newest = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(c) for c in order])
    tails = (
        cut.withColumn("_q", F.row_number().over(newest))
        .where(F.col("_q") <= lookback)
        .withColumn("_q", F.col("_q") - 1)
    )
    along = plain_window(keys, ["_chunk"])
    # Without keys this is one task over one row for each chunk.
    chunks = (
        tails.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_t"))
        .withColumns(
            {"_i": F.row_number().over(along), "_sum": F.sum("_t").over(along)}
        )
    )
    sources = tails.join(chunks.drop("_t"), [*keys, "_chunk"]).drop("_chunk")
    # Every chunk holds at least one row, so a halo spans at most `lookback` chunks.
    steps = F.sequence(F.lit(1), F.lit(lookback))
    sources = sources.withColumn("_step", F.explode(steps)).withColumn(
        "_i", F.col("_i") + F.col("_step")
    )
    targets = chunks.select(*keys, "_chunk", "_i", (F.col("_sum") - F.col("_t")).alias("_upto"))
    halo = (
        sources.join(targets, [*keys, "_i"])
        .where(F.col("_upto") - F.col("_sum") + F.col("_q") < lookback)
        .select(*df.columns, F.lit(True).alias("_halo"))
    )
    return df.withColumn("_halo", F.lit(False)).unionByName(halo)


def over_rows(
    df: DataFrame,
    group_cols: Sequence[str] | None,
    order_cols: Sequence[str] | None,
    split: bool | None,
    lookback: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    chunked: bool = False,
) -> DataFrame:
    """Add window columns that look back at most `lookback` rows in the group.

    Rows without a complete group key get NULL, as they belong to no group. A
    split run stores tables while it is being built. `chunked` tells that `df`
    comes from `with_chunks` and needs no other cut.
    """
    keys = list(group_cols or [])
    order = sort_columns(df, keys, order_cols)

    def masked(window: WindowSpec) -> dict[str, Column]:
        new = columns(window)
        if not keys:
            return new
        in_group = F.lit(True)
        for k in keys:
            in_group = in_group & F.col(k).isNotNull()
        return {name: F.when(in_group, c) for name, c in new.items()}

    if not must_split(df, split):
        return df.withColumns(masked(plain_window(keys, order)))
    # The rows and their halo all read the chunks: store them, do not derive them twice.
    # The result is stored too, so a chain of features does not nest these plans.
    stored = written(df, "window-chunks") if chunked else with_chunks(df, keys, order)
    padded = with_halo(stored, keys, order, lookback)
    window = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    done = padded.withColumns(masked(window)).where(~F.col("_halo")).drop("_halo", "_chunk")
    return written(done, "window-output")
