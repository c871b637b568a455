"""Parts with more messages than a block holds keep the order of the dialogue."""

import duckdb
from pyspark.sql import functions as F

from tallywatch.llm import perspectives, queries


def test_crowded_parts_in_order_and_as_in_sql(spark, tmp_path):
    number = F.col("id")
    talks = spark.range(6000).select(
        F.when(number % 2 == 0, 1).cast("long").alias("conv_id"),
        F.when(number % 5 > 0, number % 3 - 1).cast("long").alias("turn"),
        F.when(number % 7 > 0, F.concat(F.lit("r"), number % 3)).alias("role"),
        F.concat(F.lit("said <|"), (number * 7919) % 6000).alias("text"),
    )
    few = spark.createDataFrame([(2, 0, "ann", "hi"), (2, 1, "bob", None)], talks.schema)
    talks.unionAll(few).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op8_perspectives(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    result = duck.execute(queries.ORACLES["op8_perspectives"])
    assert got.columns == [d[0] for d in result.description]
    rows = {(r.conv_id, r.speaker, r.part): tuple(r) for r in got.collect()}
    want = {r[:3]: r for r in result.fetchall()}
    assert rows == want and max(r[3] for r in want.values()) > perspectives.PART_MESSAGES

    blocks = perspectives.rotate(spark.read.parquet(str(tmp_path / "conversations.parquet"))).collect()
    assert max(r.n_messages for r in blocks) == perspectives.PART_MESSAGES
    for key, row in want.items():
        own = sorted((r.block, r.text) for r in blocks if (r.conv_id, r.speaker, r.part) == key)
        assert [b for b, _ in own] == list(range(len(own)))
        assert "".join(t for _, t in own) == row[4]
