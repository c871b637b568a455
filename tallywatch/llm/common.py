"""Text helpers used inside tasks, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from tallywatch.functions.scale import written

LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
# Java and Spark regular expression of one word; bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
# Rows of a batch that a task turns into Python objects at a time.
PART_ROWS = 256


def lower_words(raw: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased. Null has none."""
    return raw.translate(LOWER).split() if raw else []


def col(name: str) -> Column:
    """A column by its exact name, also when the name holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(columns: Iterable[str], name: str) -> str:
    """`name`, with as many underscores as keep it apart from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, so that other columns cannot clash."""
    return docs.select(
        col(id_col).cast("long").alias("doc_id"), col(text_col).cast("binary").alias("text")
    )


def parts(batches: Iterable[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows.

    A task then holds Python's copies of a slice and not of a batch, and what it
    sends back is no larger either. An empty batch is one slice.
    """
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def map_rows(
    df: DataFrame,
    schema: str,
    names: Sequence[str],
    function: Callable[..., Iterable[tuple]],
    setup: Callable[[], object] | None = None,
    part_rows: int | None = None,
) -> DataFrame:
    """Map each Arrow batch of `df` to rows of `schema`.

    `function` gets one Python list per column of `names` (and what `setup`
    returned, once per task) and yields output rows. With `part_rows` it gets the
    batch in slices of so many rows, for functions that yield many rows for one.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in parts(batches, part_rows) if part_rows else batches:
            lists = [batch.column(n).to_pylist() for n in names]
            rows = list(function(state, *lists) if setup else function(*lists))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out
            )

    return df.select(*[col(n) for n in names]).mapInArrow(run, schema)


def plus(schema: StructType, name: str, ddl: str) -> StructType:
    """A schema with one more nullable field."""
    return StructType([*schema.fields, StructField(name, DataType.fromDDL(ddl))])


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, root), root the least node.

    `edges` has long columns a and b. Only nodes of some edge are returned.
    Alternates large-star and small-star steps until the edges form stars. A
    step is two groupings and two joins; a node with very many edges is one
    pre-aggregated minimum, and its edges are the side of the join that
    adaptive execution splits. Each round is written to shared storage.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    edges = written(edges.select(low, high).where("low < high").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high"))).first()
        if state == before:
            break
        before = state
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(
            edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            edges.join(least, edges.low == least.u)
            .select(F.col("m").alias("low"), "high")
            .distinct()
        )
        large = written(large, "edges")
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        moved = (
            large.join(least, "high").where("low != m").select(F.col("m").alias("l"), F.col("low"))
        )
        small = least.select(F.col("m").alias("low"), "high").unionAll(
            moved.select(F.col("l").alias("low"), F.col("low").alias("high"))
        )
        edges = written(small.distinct(), "edges")
    members = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return members.unionAll(roots)
