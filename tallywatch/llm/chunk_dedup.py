"""Substring dedup by content-defined chunking.

A gear hash rolls over the normalised text (A-Z lower-cased, white space as one
space). Where its upper bits are zero at the end of a word, and the chunk has
at least `MIN_WORDS` words, a chunk ends; so boundaries depend on the last 32
bytes only and fall back into step after an insertion. A stretch of more than
`MAX_WORDS` words without one is cut where the hash is largest. A chunk is its
64-bit digest. The document with the least id that holds a digest owns it, and other
documents lose the chunk if it is part of a passage: a run of chunks owned by
others in which one owner has at least `MIN_RUN` words, or all of them together
`MIN_MIXED_RUN`. Lone common phrases fall short of that.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallywatch.functions.scale import written
from tallywatch.llm.common import LOWER, PART_ROWS, col, free_name, map_rows, parts, plus

MIN_WORDS = 4
MAX_WORDS = 64
MASK_BITS = 2
MIN_RUN = 13
MIN_MIXED_RUN = 40
SEED = 7

GEAR = np.array(
    [xxhash.xxh64_intdigest(bytes([b]), SEED) & 0xFFFFFFFF for b in range(256)], dtype=np.uint32
)


def gear_hashes(data: bytes) -> np.ndarray:
    """h[i] = 2 * h[i - 1] + GEAR[byte i], modulo 2**32, for all i.

    A byte leaves the hash after 32 steps, so five doublings give all values.
    """
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < 32:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def chunks(raw: bytes | None) -> tuple[list[int], list[int]]:
    """(number of the first word, digest) of each chunk, digests as signed numbers."""
    words = raw.translate(LOWER).split() if raw else []
    if not words:
        return [], []
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    hashes = gear_hashes(text)[ends - 1]
    cut = hashes >> np.uint32(32 - MASK_BITS) == 0
    bounds, last = [0], 0
    for i in [*(np.flatnonzero(cut) + 1).tolist(), len(words)]:
        while i - last > MAX_WORDS:
            # Where the hash is largest: after the same words, whatever is before them.
            last += MIN_WORDS + int(hashes[last + MIN_WORDS - 1 : last + MAX_WORDS].argmax())
            bounds.append(last)
        if i - last >= MIN_WORDS:
            last = i
            bounds.append(last)
    if last < len(words):
        bounds.append(len(words))
    starts = [0, *(ends + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    found = [
        digest(text[starts[a] : starts[b] - 1], SEED) for a, b in zip(bounds, bounds[1:])
    ]
    return bounds, [d - (1 << 64) if d >> 63 else d for d in found]


def repeated_words(
    bounds: list[int], digests: list[int], owners: dict[int, int], min_run: int
) -> list[tuple[int, int]]:
    """Word ranges (first, past last) that repeat other documents.

    `owners` maps the digests that other documents own to the owner.
    """
    out: list[tuple[int, int]] = []
    at, n = 0, len(digests)
    while at < n:
        if digests[at] not in owners:
            at += 1
            continue
        stop = at
        held: dict[int, list[int]] = defaultdict(list)
        while stop < n and digests[stop] in owners:
            held[owners[digests[stop]]].append(stop)
            stop += 1
        if bounds[stop] - bounds[at] >= max(min_run, MIN_MIXED_RUN):
            out.append((bounds[at], bounds[stop]))
        for run in held.values():
            if sum(bounds[i + 1] - bounds[i] for i in run) >= min_run:
                out.append((bounds[run[0]], bounds[run[-1] + 1]))
        at = stop
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def byte_ranges(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as byte ranges of the original text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    word = np.concatenate(([False], ~((data == 0x20) | ((data >= 9) & (data <= 13))), [False]))
    starts = np.flatnonzero(~word[:-1] & word[1:])
    stops = np.flatnonzero(word[:-1] & ~word[1:])
    return [(int(starts[a]), int(stops[b - 1])) for a, b in ranges]


def char_offsets(raw: bytes, cut: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte ranges as code point offsets."""
    data = np.frombuffer(raw, dtype=np.uint8)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [{"first": int(chars[a]), "past": int(chars[b])} for a, b in cut]


def without(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without byte ranges and the white space after each."""
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at:a])
        at = b
        while at < len(raw) and raw[at] in b" \t\n\x0b\x0c\r":
            at += 1
    out.append(raw[at:])
    text = b"".join(out)
    return text.rstrip() if ranges and at >= len(raw) else text


def owned_elsewhere(docs: DataFrame) -> DataFrame:
    """(doc_id, key, found) for documents with chunks owned by others: digests and owners.

    `docs` has doc_id, binary text and key, a hash of both: documents that share
    an id are told apart by it, so each gets what its own chunks found, and no id is a
    group of more than one text. Texts are cut into chunks once, and these stored.
    Owners are pre-aggregated minima; the chunks of a digest that many documents
    share are one side of a join that adaptive execution splits.
    """

    def rows(ids, keys, texts):
        for doc, key, raw in zip(ids, keys, texts, strict=True):
            if doc is not None:
                for digest in dict.fromkeys(chunks(raw)[1]):
                    yield digest, doc, key

    names = ["doc_id", "key", "text"]
    kind = "digest long, doc_id long, key long"
    held = written(map_rows(docs, kind, names, rows, part_rows=PART_ROWS), "chunks")
    shared = (
        held.groupBy("digest")
        .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        .where("owner < last")
        .select("digest", "owner")
    )
    found = held.join(written(shared, "shared-chunks"), "digest").where("doc_id > owner")
    # Copies with one id have the same chunks: a set holds each once.
    return found.groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("digest", "owner")).alias("found")
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_run: int = MIN_RUN,
    name: str = "_repeats",
) -> DataFrame:
    """`docs` without passages that a document of smaller id holds, and `name`.

    This is a struct of n_words (of the whole text), n_removed (words), spans
    (code point offsets of what was removed) and owners (ids whose passages
    these were); a column so named is replaced. Every row stays, if need be
    with an empty text. Rows that share an id keep what is theirs; rows without an
    id own nothing and lose nothing. Ids are whole numbers. Null texts stay null.
    """
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    found_name, id_name, key_name = (free_name(columns, f"_found{c}") for c in ("", "_id", "_key"))
    id_, text = col(id_col).cast("long"), col(text_col).cast("binary")
    narrow = docs.select(id_.alias("doc_id"), text.alias("text"), F.xxhash64(id_, text).alias("key"))
    found = written(owned_elsewhere(narrow), "found-chunks")
    base = docs.select(*[col(c) for c in columns])
    kind = (
        "struct<n_words: bigint, n_removed: bigint,"
        " spans: array<struct<first: bigint, past: bigint>>, owners: array<bigint>>"
    )
    schema = plus(base.schema, name, kind)
    found = found.select(
        F.col("doc_id").alias(id_name), F.col("key").alias(key_name), F.col("found").alias(found_name)
    )
    same = (id_ == col(id_name)) & (F.xxhash64(id_, text) == col(key_name))
    joined = base.join(found, same, "left").select(*[col(c) for c in columns], col(found_name))
    place = columns.index(text_col)
    return joined.mapInArrow(_remover(schema, place, len(columns), min_run), schema)


def _remover(schema, place: int, n: int, min_run: int):
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            new, said = [], []
            for raw, found in zip(texts, batch.column(n).to_pylist(), strict=True):
                owners = {f["digest"]: f["owner"] for f in found or []}
                ranges = []
                if owners:
                    bounds, digests = chunks(raw)
                    ranges = repeated_words(bounds, digests, owners, min_run)
                said.append(
                    {
                        "n_words": len(raw.split()) if raw else 0,
                        "n_removed": sum(b - a for a, b in ranges),
                        "spans": [],
                        "owners": [],
                    }
                )
                if ranges:
                    cut = byte_ranges(raw, ranges)
                    said[-1]["spans"] = char_offsets(raw, cut)
                    starts = np.array([a for a, _ in ranges])
                    within = np.searchsorted(starts, bounds[:-1], "right") - 1
                    said[-1]["owners"] = sorted(
                        {
                            owners[d]
                            for d, i, k in zip(digests, bounds, within.tolist())
                            if d in owners and k >= 0 and i < ranges[k][1]
                        }
                    )
                    raw = without(raw, cut)
                new.append(raw)
            columns = [batch.column(i) for i in range(n)]
            columns[place] = pa.array(new, type=pa.binary()).cast(target.field(place).type)
            columns.append(pa.array(said, type=target.field(n).type))
            yield pa.RecordBatch.from_arrays(columns, names=target.names)

    return run


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed, spans, owners): the cleaned text of every document."""
    narrow = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return remove_repeats(narrow).select("doc_id", "text", "_repeats.*")
