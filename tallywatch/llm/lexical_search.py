"""Ranked lexical search: one automaton of all item terms over the documents' texts.

The terms of all items, each between two guard spaces, form one Aho-Corasick
automaton that is broadcast. A text is normalised so that whatever parts terms
is a space, and scanned once: every output is one occurrence of a whole term.
No index of the documents is built; only the counts of the items' own terms
are kept between the scan and the scoring, which needs the corpus counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tallywatch.functions.scale import written
from tallywatch.llm.common import col

TOP = 10
# Terms of all items, each item's own counted once, that one automaton serves.
MAX_POSTINGS = 2_000_000
_BLOCK = 256  # documents scored together

_FOLD = bytes(
    b + 32
    if 0x41 <= b <= 0x5A
    else (b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20)
    for b in range(256)
)
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def folded(raw: bytes | None) -> bytes:
    """A text whose terms, A-Z lower-cased, stand between single or more spaces."""
    return raw.translate(_FOLD) if raw else b""


class TermScanner:
    """Counts the occurrences of some terms in texts."""

    def __init__(self, terms: list[bytes]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            # One character for each byte; the guards make it match whole terms only.
            self.automaton.add_word(f" {term.decode('latin-1')} ", i)
        self.any = bool(terms)
        if self.any:
            self.automaton.make_automaton()

    def count(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers in ascending order, their occurrences) of a folded text."""
        if not self.any or not text:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        matches = self.automaton.iter(f" {text.decode('latin-1')} ")
        return np.unique(np.fromiter((i for _, i in matches), np.int64), return_counts=True)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, text, postings) of the items that have terms."""
    lower = F.translate(col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
    return benchmark.select(
        col(id_col).alias("item_id"),
        col(text_col).cast("binary").alias("text"),
        F.size(terms).cast("long").alias("postings"),
    ).where("postings > 0")


def _shards(items: DataFrame, most: int) -> Iterator[list]:
    """Rows of items, about `most` postings at a time, in a fixed order within each part."""
    total = items.agg(F.sum("postings")).first()[0] or 0
    count = max(1, -(-int(total) // most))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        rows = items.where(shard == k).select("item_id", "text").collect()
        yield sorted(rows, key=lambda r: (r[0] is None, str(r[0]), bytes(r[1])))


def _counted(docs: DataFrame, terms, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, term, tf) of each row: its number of terms, and the items' terms in it."""
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"))
    extra = StructType.fromDDL("n bigint, term array<int>, tf array<bigint>")
    schema = StructType([narrow.schema["doc_id"], *extra.fields])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = TermScanner(terms.value)
        for batch in batches:
            sizes, found, tfs, ends = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [0]
            for text in batch.column("text"):
                text = folded(text.as_py())
                sizes.append(len(text.split()))
                number, tf = scanner.count(text)
                found.append(number)
                tfs.append(tf)
                ends.append(ends[-1] + len(number))
            ends = pa.array(ends, pa.int32())
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind))
                for parts, kind in ((found, pa.int32()), (tfs, pa.int64()))
            ]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists]
            columns = [c.cast(f.type) for c, f in zip(columns, out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return narrow.mapInArrow(run, schema)


class Best:
    """The best-scoring documents of one item, equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.floor, self.rows = k, 1, []

    def offer(self, ids: list, scores: np.ndarray) -> None:
        if not len(at := np.flatnonzero(scores >= self.floor)):
            return
        rows = self.rows + [(-int(scores[i]), ids[i] is None, ids[i]) for i in at.tolist()]
        # Null ids are equal to each other, and never compared with others.
        self.rows = sorted(rows, key=lambda r: r if not r[1] else r[:2])[: self.k]
        if len(self.rows) == self.k:
            self.floor = max(1, -self.rows[-1][0])


def _partial_tops(counted: DataFrame, postings, weights, docs_n: int, words_n: int, k: int):
    """(item, doc_id, score): each task's best documents of each item."""
    item, score = StructType.fromDDL("item int, score bigint").fields
    schema = StructType([item, counted.schema["doc_id"], score])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, items = weights.value, postings.value
        best = [Best(k) for _ in items]
        for batch in batches:
            all_ids = batch.column("doc_id").to_pylist()
            n = batch.column("n").to_numpy(zero_copy_only=False)
            # 64-bit integers hold 90 * n * N only up to a point; Python's have no bound.
            m = np.array([10 + 90 * v * docs_n // words_n for v in n.tolist()], np.int64)
            offsets = batch.column("term").offsets.to_numpy()
            term = batch.column("term").values.to_numpy()
            tf = batch.column("tf").values.to_numpy()
            row = np.repeat(np.arange(len(all_ids)), np.diff(offsets))
            term, tf = term[offsets[0] : offsets[-1]], tf[offsets[0] : offsets[-1]]
            part = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            for a in range(0, len(all_ids), _BLOCK):
                ids = all_ids[a : a + _BLOCK]
                x, y = offsets[[a, a + len(ids)]] - offsets[0]
                if x == y:
                    continue
                present, local = np.unique(term[x:y], return_inverse=True)
                grid = np.zeros((len(present) + 1, len(ids)), np.int64)
                grid[local, row[x:y] - a] = part[x:y]
                place = np.full(len(w), len(present))  # the last row is of absent terms
                place[present] = np.arange(len(present))
                for number, terms in enumerate(items):
                    best[number].offer(ids, grid[place[terms]].sum(axis=0))
        rows = [(i, r[2], -r[0]) for i, b in enumerate(best) for r in b.rows]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        arrays = [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return counted.where("n > 0").mapInArrow(run, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    max_postings: int = MAX_POSTINGS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best-scoring documents of each item.

    The score is the sum over an item's distinct terms of
    ``w * (10**9 * tf div (1000 * tf + 8 * m))``, where w = floor(1000 * ln((2N + 2) /
    (2df + 1))) and m = 10 + 90 * n * N div L. Only scores above 0 are ranked;
    equal scores rank by ascending doc_id, null ids last.

    Null and empty texts have no terms: such documents do not count in N, and
    such items get no rows. Each row is a document or an item of its own,
    whatever its id, so repeated rows fill several ranks, and items that share
    an id have their ranks each. Other columns of either table are not read.

    A task keeps at most `top` documents an item, and these are cut again in
    salted groups before the last ranking. Items of more than about
    `max_postings` distinct terms in sum are searched in several runs.
    """
    spark = docs.sparkSession
    found = None
    kept = written(_items(items, item_id_col, item_text_col), "items")
    for shard in _shards(kept, max_postings):
        texts = [folded(bytes(r["text"])).split() for r in shard]
        terms = sorted({t for words in texts for t in words})
        number = {t: i for i, t in enumerate(terms)}
        postings = [np.array(sorted({number[t] for t in words})) for words in texts]
        broadcast = spark.sparkContext.broadcast
        counted = _counted(docs, broadcast(terms), id_col, text_col)
        counted = written(counted, "term-counts")
        size = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        docs_n, words_n = size[0], size[1] or 0
        df = counted.select(F.explode("term").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(terms), np.int64)
        for term, n in df:
            weights[term] = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * n + 1)))
        tops = _partial_tops(
            counted, broadcast(postings), broadcast(weights), docs_n, words_n, top
        )
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(32))
        for keys in (["item", salt], ["item"]):
            order = [F.desc("score"), F.asc_nulls_last("doc_id")]
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
            tops = tops.withColumn("rank", place).where(F.col("rank") <= top)
        names = StructType([StructField("item", IntegerType()), kept.schema["item_id"]])
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(shard)], names)
        part = tops.join(ids, "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionAll(part)
    return found


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    f"'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
)
SQL = f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
sized AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized),
items AS (
    SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
asked AS MATERIALIZED (SELECT q, item_id, unnest(terms) AS term FROM items),
tf AS MATERIALIZED (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d)
    WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
w AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, corpus GROUP BY term, docs),
parts AS (
    SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS part
    FROM tf JOIN w USING (term) JOIN sized USING (r), corpus),
scores AS (
    SELECT q, r, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY q, r),
ranked AS (
    SELECT q, doc_id, score,
           row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scores JOIN sized USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM ranked JOIN items USING (q) WHERE rank <= {TOP}
"""
