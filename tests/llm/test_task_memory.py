"""What a task holds at a time: slices of a batch, and feature lists at two bytes a place."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from tallywatch.llm import chunk_dedup, toxicity
from tallywatch.llm.common import PART_ROWS, map_rows, parts

N = 2 * PART_ROWS + 3


def texts(n):
    return [None if i % 7 == 0 else f"word{i} and Some more {i % 5} " * (i % 4) for i in range(n)]


def test_parts_are_small_and_whole():
    batch = pa.RecordBatch.from_pydict({"a": list(range(N)), "b": texts(N)})
    got = list(parts([batch, batch.slice(0, 0), batch]))
    assert [b.num_rows for b in got] == [PART_ROWS, PART_ROWS, 3, 0, PART_ROWS, PART_ROWS, 3]
    assert pa.Table.from_batches(got).to_pylist() == 2 * batch.to_pylist()


@pytest.mark.parametrize("places", [[], [0], [65535, 65536], [(1 << 20) - 1], range(1 << 20)])
def test_packed_lists(places):
    places = np.array(places, dtype=np.int64)
    raw = toxicity.pack(places)
    assert len(raw) <= 2 * len(places) + 64
    assert (toxicity.unpack(raw) == places).all()
    assert all((x == places).all() for x in toxicity.PackedLists([raw, raw]))


def test_features_come_packed_and_in_parts():
    ids = list(range(N))
    columns = {"doc_id": ids, "y": ids, "at": ids, "text": [t and t.encode() for t in texts(N)]}
    batch = pa.RecordBatch.from_pydict(columns)
    got = list(toxicity._packed_features(iter([batch])))
    assert max(b.num_rows for b in got) <= PART_ROWS
    rows = pa.Table.from_batches(got).to_pylist()
    assert [r["doc_id"] for r in rows] == ids
    for r, text in zip(rows, columns["text"], strict=True):
        wanted = np.unique(toxicity.Features().of(text)) if r["doc_id"] % 50 == 1 else None
        assert wanted is None or (toxicity.unpack(r["places"]) == wanted).all()
    # fewer rows than a feature needs leave the bias alone; none at all, too
    for batches in ([], [got[0].slice(0, 0)], [got[0].slice(0, 3)]):
        (weights,) = toxicity._train(iter(batches))
        assert set(weights.column(0).to_pylist()) <= {1 << toxicity.BITS}


def test_repeats_are_cut_in_parts(spark):
    schema = StructType.fromDDL(
        "doc_id long, text string, r struct<n_words: bigint, n_removed: bigint,"
        " spans: array<struct<first: bigint, past: bigint>>, owners: array<bigint>>"
    )
    found = pa.array([None] * N, type=pa.list_(pa.struct({"digest": pa.int64(), "owner": pa.int64()})))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(N)), pa.array(texts(N)), found], names=["doc_id", "text", "found"]
    )
    got = list(chunk_dedup._remover(schema, 1, 2, chunk_dedup.MIN_RUN)(iter([batch])))
    assert max(b.num_rows for b in got) <= PART_ROWS
    rows = pa.Table.from_batches(got)
    assert rows["doc_id"].to_pylist() == list(range(N)) and rows["text"].to_pylist() == texts(N)


def test_map_rows_in_parts(spark):
    df = spark.range(N).coalesce(1)
    sizes = map_rows(df, "n long", ["id"], lambda ids: [(len(ids),)], part_rows=PART_ROWS).collect()
    assert sorted(r.n for r in sizes) == [3, PART_ROWS, PART_ROWS]
