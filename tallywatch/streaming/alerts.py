"""Alerts on a stream of scored rows.

The rules look at one row at a time, so the batch operator serves a stream as
it is: no state, no watermark, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallywatch.operators.alerts import DEFAULT_RULES, AlertRule, process


def read_scored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def start_alerts(
    scored: DataFrame,
    output_path: str,
    checkpoint_path: str,
    rules: Sequence[AlertRule] = DEFAULT_RULES,
    available_now: bool = False,
) -> StreamingQuery:
    """Append alerts to Parquet, exactly once per input row."""
    writer = (
        process(scored, rules)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint_path)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(output_path)
