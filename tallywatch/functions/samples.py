"""Samples that depend on the rows and a seed alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_CHUNK_DIGITS = 3


def spread_sample(
    df: DataFrame, names: Sequence[str], rows: int, size: int, seed: int
) -> DataFrame:
    """(names, slot): `size` of the `rows` rows of `df`, evenly spaced in hash order.

    Equal rows are counted before the shuffle and fill slots in proportion, so
    a value shared by many rows is neither missed nor gathered anywhere. The
    leading hash digits cut the order into equal chunks for the running sum. The
    result depends on the data and the seed only, not on the partitioning.
    """
    counted = df.groupBy(*names).agg(F.count("*").alias("_n"))
    text = F.concat_ws(",", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in names])
    hashed = counted.withColumn("_h", F.md5(text)).withColumn(
        "_chunk", F.substring("_h", 1, _CHUNK_DIGITS)
    )
    chunks = hashed.groupBy("_chunk").agg(F.sum("_n").alias("_sum"))
    along = Window.partitionBy(F.lit(0)).orderBy("_chunk")
    bases = chunks.select("_chunk", (F.sum("_sum").over(along) - F.col("_sum")).alias("_base"))
    within = Window.partitionBy("_chunk").orderBy("_h", *names)
    # At most 16**_CHUNK_DIGITS rows, whatever the input.
    placed = hashed.join(F.broadcast(bases), "_chunk").withColumn(
        "_upto", F.col("_base") + F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0))
    )
    step = max(rows / max(size, 1), 1.0)
    first = F.ceil((F.col("_upto") - F.col("_n")) / step - 0.5)
    last = F.ceil(F.col("_upto") / step - 0.5)
    slots = placed.withColumns({"_first": first, "_last": F.least(last, F.lit(size))})
    return slots.where(F.col("_last") > F.col("_first")).select(
        *names, F.explode(F.sequence("_first", F.col("_last") - 1)).alias("slot")
    )
