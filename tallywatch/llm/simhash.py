"""Near-duplicate documents by SimHash.

A fingerprint is eight bytes. Two fingerprints that differ in at most d bits
differ in at most d bytes, so they share at least 8 - d of their positional
bytes: that is the guaranteed minimum of matches. The inverted index is kept at
that depth. A posting is named by 8 - d byte positions and the bytes found
there, and lists the fingerprints that hold them; whoever meets in a posting
has reached the minimum, and the bits of the d bytes left are compared to
finish the tally and verify. Postings of single bytes would find the same
pairs, but each would list 1/256 of all fingerprints and their pairs grow with
the square of the input.

Members of a posting are distinct and differ in d bytes only, so there are at
most 256**d of them. They are linked to the least member they reach, not
emitted as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.llm.common import (
    col,
    connected_components,
    free_name,
    id_and_text,
    lower_words,
    map_rows,
    parts,
    plus,
)

SHINGLE = 3
MAX_DISTANCE = 2


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, as a signed 64-bit number."""
    words = lower_words(raw)
    if not words:
        return 0
    text = b" ".join(words)
    stops = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(text, 42)]
    else:
        starts = [0, *(e + 1 for e in stops)]
        hashes = [digest(text[a:b], 42) for a, b in zip(starts, stops[shingle - 1 :])]
    rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), 4096):
        part = np.unpackbits(rows[at : at + 4096], axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.uint16)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of `text_col` as long column `name`.

    An input column of that name is replaced.
    """
    rest = [c for c in docs.columns if c.lower() != name.lower()]
    schema = plus(docs.select(*[col(c) for c in rest]).schema, name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            prints = pa.array([fingerprint(t) for t in texts], type=pa.int64())
            columns = [*batch.columns, prints]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, name])

    return docs.select(*[col(c) for c in rest]).mapInArrow(run, schema)


def _flips(free: tuple[int, ...], distance: int) -> np.ndarray:
    """All masks of one to `distance` bits within the given byte positions."""
    bits = [8 * p + i for p in free for i in range(8)]
    masks = [sum(1 << b for b in c) for k in range(1, distance + 1) for c in combinations(bits, k)]
    return np.array(masks, dtype=np.uint64)


def _posting_links(values: np.ndarray, masks: np.ndarray, distance: int) -> np.ndarray:
    """For each member of a posting, the index of the least one it reaches."""
    n = len(values)
    if n <= 32:
        near = np.bitwise_count(values[:, None] ^ values) <= distance
        pairs = [np.nonzero(near)]
    else:
        order = np.argsort(values)
        ranked = values[order]
        pairs = []
        for mask in masks:
            other = ranked ^ mask
            at = np.minimum(np.searchsorted(ranked, other), n - 1)
            found = np.flatnonzero(ranked[at] == other)
            pairs.append((order[found], order[at[found]]))
    label = np.arange(n)
    while True:
        old = label.copy()
        for a, b in pairs:
            np.minimum.at(label, a, label[b])
        label = label[label]
        if (old == label).all():
            return label


def links(fingerprints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (a, b) whose components are those of all links within `distance` bits.

    `fingerprints` has one long column, fingerprint, without repeats or nulls.
    """
    if not 0 < distance <= 3:
        raise ValueError("distance must be 1, 2 or 3")
    free = list(combinations(range(8), distance))
    every = (1 << 64) - 1
    kept = [every & ~sum(0xFF << (8 * p) for p in f) for f in free]
    signed = [m - (1 << 64) if m >> 63 else m for m in kept]
    print_ = F.col("fingerprint")
    postings = [
        F.struct(F.lit(i).cast("byte").alias("place"), print_.bitwiseAND(F.lit(m)).alias("bytes"))
        for i, m in enumerate(signed)
    ]
    index = (
        fingerprints.select("fingerprint", F.explode(F.array(*postings)).alias("p"))
        .select("p.place", "p.bytes", "fingerprint")
        .repartition("place", "bytes")
        .sortWithinPartitions("place", "bytes")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [_flips(f, distance) for f in free]
        rest = None

        def edges(place, key, value):
            """Edges of whole postings; the arrays are sorted by posting."""
            new = np.flatnonzero((place[1:] != place[:-1]) | (key[1:] != key[:-1])) + 1
            first = np.concatenate(([0], new))
            size = np.diff(np.concatenate((first, [len(key)])))
            a, b = [], []
            for at, n in zip(first[size > 1], size[size > 1]):
                values = value[at : at + n].view(np.uint64)
                to = _posting_links(values, masks[place[at]], distance)
                moved = np.flatnonzero(to != np.arange(n))
                a.append(value[at + moved])
                b.append(value[at + to[moved]])
            joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in joined], names=["a", "b"])

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            place, key, _ = now
            if not len(key):
                continue
            same = (place == place[-1]) & (key == key[-1])
            cut = len(key) - int(same.sum())
            rest = [x[cut:] for x in now]
            if cut:
                yield edges(*[x[:cut] for x in now])
        if rest is not None:
            yield edges(*rest)

    return index.mapInArrow(run, "a long, b long")


def components(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(fingerprint, root, component_id): the least doc_id reachable over links.

    `prints` has doc_id and fingerprint, one row per document, and should be a
    stored table. Copies share a fingerprint and are one node; a null doc_id
    counts only if its component has no other. `root`, the least fingerprint of
    a component, names it also where ids are missing or shared.
    """
    classes = written(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprints"
    )
    found = connected_components(links(classes.select("fingerprint"), distance))
    nodes = classes.join(found, classes.fingerprint == found.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return nodes.select("fingerprint", "root").join(ids, "root").select(
        "fingerprint", "root", "component_id"
    )


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Null and wordless texts have fingerprint zero, which links like any other.
    Repeated rows give repeated rows. A row without doc_id gets the component
    of its fingerprint, or null if none of its members has an id.
    """
    prints = written(
        map_rows(
            id_and_text(docs, id_col, text_col),
            "doc_id long, fingerprint long",
            ["doc_id", "text"],
            lambda ids, texts: zip(ids, map(fingerprint, texts)),
        ),
        "simhash",
    )
    groups = written(components(prints), "components")
    return prints.join(groups, "fingerprint").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the one with the least id.

    Groups are the components, whatever ids they hold. Rows that repeat the kept
    document's id and fingerprint count as one. A group without any id keeps one
    of the rows of its least fingerprint.
    """
    name, id_name, print_name = (
        free_name(docs.columns, f"_simhash_{c}") for c in ("fingerprint", "id", "print")
    )
    marked = with_fingerprint(docs, text_col, name)
    prints = written(
        marked.select(col(id_col).cast("long").alias("doc_id"), col(name).alias("fingerprint")),
        "simhash",
    )
    groups = components(prints)
    keepers = written(
        prints.join(groups, "fingerprint")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint")).alias("k"))
        .select(F.col("k.doc_id").alias(id_name), F.col("k.fingerprint").alias(print_name)),
        "keepers",
    )
    rows = marked.join(
        keepers,
        col(id_col).cast("long").eqNullSafe(col(id_name)) & (col(name) == col(print_name)),
    )
    return rows.dropDuplicates([id_name, print_name]).select(*[col(c) for c in docs.columns])
