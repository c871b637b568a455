"""Benchmark decontamination with an Aho-Corasick automaton.

Items are normalised to words and cut into windows. All windows of all items
form one automaton over word numbers; each document is normalised the same way
and scanned once. Hits are words inside any occurrence, and spans give them as
code point offsets in the original text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallywatch.functions.scale import written
from tallywatch.llm.common import col, free_name, map_rows, parts, plus

WINDOW = 13
MIN_HIT_SHARE = 0.05
# Words of all items in one automaton, about: items are dealt by hash.
MAX_WORDS = 50_000

_NORMAL = bytes(
    b + 32
    if 0x41 <= b <= 0x5A
    else (b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20)
    for b in range(256)
)


def normal_words(raw: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return raw.translate(_NORMAL).split() if raw else []


class Windows:
    """The windows of some items as one automaton over word numbers."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = normal_words(text)
            codes = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            for at in range(max(1, len(codes) - window + 1) if codes else 0):
                owners[tuple(codes[at : at + window])].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in owners.items():
            self.automaton.add_word(key, (len(key), names))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (first, past last) word ranges of all occurrences, and their items."""
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.any or not words:
            return ranges, found
        get = self.number.get
        for last, (length, names) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            ranges.append((last - length + 1, last + 1))
            found |= names
        return merged(ranges), found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point offsets in the original text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    table = np.frombuffer(_NORMAL, dtype=np.uint8)
    word = np.concatenate(([False], table[data] != 0x20, [False]))
    starts = np.flatnonzero(~word[:-1] & word[1:])
    stops = np.flatnonzero(word[:-1] & ~word[1:])
    # bytes that begin a code point, counted up to each offset
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[stops[b - 1]])) for a, b in ranges]


def _shards(items: DataFrame, max_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items for each automaton. Only one shard's items are on the driver at a time."""
    total = items.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-int(total) // max_words))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        rows = items.where(shard == k).select("item_id", "text").collect()
        yield [(r[0], bytes(r[1])) for r in rows]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_share: float = MIN_HIT_SHARE,
    max_words: int = MAX_WORDS,
    name: str = "_scan",
) -> DataFrame:
    """One row per row of `docs`: its columns and `name`, which replaces a column so named.

    It is a struct of n_words, n_hit, spans (code point offsets), items (sorted
    ids as strings, a null id last) and contaminated, true if there are hits and
    they are at least `min_share` of the words. Null, empty and wordless texts
    have no words and are clean. An item without words has no window; one of
    fewer words than `window` is a window as a whole. Items that share an id, or
    have none, count as one. Benchmarks of more than about `max_words` words
    are split over several automata; the texts are then read once for each,
    and only their hits are stored and put together.
    """
    words = F.regexp_count(col(item_text_col), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[A-Z]+"))
    items = written(
        benchmark.select(
            col(item_id_col).cast("string").alias("item_id"),
            col(item_text_col).cast("binary").alias("text"),
            words.alias("n"),
        ).where("n > 0"),
        "items",
    )
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    base = docs.select(*[col(c) for c in columns])
    shards = _shards(items, max_words)
    send = docs.sparkSession.sparkContext.broadcast
    first = send(next(shards))
    rest = [send(shard) for shard in shards]
    hits = free_name(columns, "_hits")
    if not rest:
        base = base.withColumn(hits, F.lit(None).cast(_HITS))
    else:
        # A number of the stored rows tells them apart, whatever their ids.
        row = free_name(columns, "_row")
        base = written(base.withColumn(row, F.monotonically_increasing_id()), "scanned")
        texts = base.select(col(row).alias("row"), col(text_col).alias("text"))
        found = None
        for shard in rest:
            part = written(_hits(texts, shard, window), "hits")
            found = part if found is None else found.unionAll(part)
        # One entry for each automaton that hits the row.
        whole = found.groupBy("row").agg(F.collect_list("hits").alias("hits"))
        whole = whole.select(
            F.col("row").alias(row),
            F.struct(
                F.flatten("hits.ranges").alias("ranges"),
                F.array_distinct(F.flatten("hits.items")).alias("items"),
            ).alias(hits),
        )
        base = base.join(whole, row, "left").select(*[col(c) for c in columns], col(hits))
    return _judged(base, first, columns, hits, name, text_col, window, min_share)


_HITS = "struct<ranges: array<struct<first: bigint, past: bigint>>, items: array<string>>"
_SCAN = (
    "struct<n_words: bigint, n_hit: bigint, spans: array<struct<first: bigint, past: bigint>>,"
    " items: array<string>, contaminated: boolean>"
)


def _hits(texts: DataFrame, items, window: int) -> DataFrame:
    """(row, hits) of the texts that one automaton hits."""

    def rows(windows, numbers, raws):
        for row, raw in zip(numbers, raws, strict=True):
            ranges, found = windows.find(normal_words(raw))
            if found:
                ranges = [{"first": a, "past": b} for a, b in ranges]
                yield row, {"ranges": ranges, "items": list(found)}

    narrow = texts.select("row", F.col("text").cast("binary").alias("text"))
    setup = lambda: Windows(items.value, window)
    return map_rows(narrow, f"row long, hits {_HITS}", ["row", "text"], rows, setup)


def _judged(df, items, columns, hits: str, name: str, text_col: str, window: int, min_share: float):
    """`columns` of `df` and the verdict, from the hits it holds and those of one automaton."""
    schema = plus(df.select(*[col(c) for c in columns]).schema, name, _SCAN)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(items.value, window)
        for batch in parts(batches):
            texts = batch.column(columns.index(text_col)).cast(pa.binary()).to_pylist()
            before = batch.column(len(columns)).to_pylist()
            rows = []
            for raw, old in zip(texts, before, strict=True):
                words = normal_words(raw)
                ranges, found = windows.find(words)
                if old:
                    ranges = merged(ranges + [(r["first"], r["past"]) for r in old["ranges"]])
                    found |= set(old["items"])
                hit = sum(b - a for a, b in ranges)
                cut = spans(raw, ranges) if ranges else []
                rows.append(
                    {
                        "n_words": len(words),
                        "n_hit": hit,
                        "spans": [{"first": a, "past": b} for a, b in cut],
                        "items": sorted(found, key=lambda i: (i is None, i or "")),
                        "contaminated": hit > 0 and hit / len(words) >= min_share,
                    }
                )
            kept = [batch.column(i) for i in range(len(columns))]
            kept.append(pa.array(rows, type=target.field(len(columns)).type))
            yield pa.RecordBatch.from_arrays(kept, names=target.names)

    return df.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, contaminated) for every document."""
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"))
    return scan(narrow, benchmark, **options).select(
        "doc_id",
        "_scan.n_words",
        "_scan.n_hit",
        F.size("_scan.items").cast("long").alias("n_items"),
        "_scan.items",
        "_scan.spans",
        "_scan.contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without contaminated rows."""
    name = free_name(docs.columns, "_scan")
    scanned = scan(docs, benchmark, name=name, **options)
    return scanned.where(~col(name)["contaminated"]).select(*[col(c) for c in docs.columns])


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
# Windows as strings, joined to each document's stretches of the same length.
SQL = f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark),
windows AS MATERIALIZED (
    SELECT DISTINCT item, least(len(words), {WINDOW}) AS n, unnest(list_transform(
        range(1, greatest(len(words) - {WINDOW}, 0) + 2),
        lambda i: array_to_string(words[i:i + {WINDOW - 1}], ' '))) AS win
    FROM items WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
stretches AS (
    SELECT r, n, unnest(range(1, len(words) - n + 2)) AS i, unnest(list_transform(
        range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS win
    FROM d JOIN sizes ON len(words) >= n),
hits AS MATERIALIZED (
    SELECT r, n, i, item FROM stretches JOIN windows USING (n, win)),
covered AS (
    SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
named AS (SELECT r, list(DISTINCT item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256,
    coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
