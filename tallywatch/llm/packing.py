"""Packing documents into sequences, with bounds that certify the bin counts.

Pieces of documents are dealt to partitions, and each partition is packed by
best-fit decreasing. Dual feasible functions give a lower bound of the bins a
partition needs: where both agree, no packing of these pieces is better. What
is left open - bins of partitions with a gap, and the emptiest bin of all
others - is dealt anew and packed again, as long as that saves bins.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallywatch.functions.scale import written
from tallywatch.llm.common import col

CAPACITY = 2048
END_ID = 0
# Pieces of one partition, on average; a partition is packed in one task.
PIECES = 20_000
MIN_SAVING, LARGEST = 1e-4, 16
# Parts whose ids a Python worker remembers, twice so many at most; longer parts are not.
MAX_WORDS, MAX_WORD_BYTES = 500_000, 48
_BEFORE_MARK = r"([a-z0-9])([.,;:!?)])"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def worker_memory(run: str, make: Callable[[], object]) -> object:
    """What this Python worker made for a run; its later tasks of that run find it again.

    A run is one call of the operator: nothing is kept for the next.
    """
    name = "tallywatch_worker_memory"
    memory = sys.modules.setdefault(name, ModuleType(name)).__dict__.setdefault("made", {})
    if run not in memory:
        memory.clear()
        memory[run] = make()
    return memory[run]


class WordIds:
    """Token ids of texts, tokenized word by word.

    Right for tokenizers that lower-case, drop white space, and let no token reach
    across it or from a letter or digit on into punctuation: a text's ids are
    then those of its lower-cased parts, one after the other. Texts that may hold a special
    token go through the tokenizer whole, others in parts, each when it is new.
    Remembered are the parts of late: once `MAX_WORDS` are new, those not
    seen since the last such time are forgotten.
    """

    def __init__(self, file: str):
        # Spark's tasks are the parallelism.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        decoded = [t.decode("utf-8", "replace") for t in texts]
        found = self.tokenizer.encode_batch_fast(decoded, add_special_tokens=False)
        # array.array holds 32-bit numbers as this machine does, which numpy puts in order.
        return [np.array(array("I", e.ids), "<u4").tobytes() for e in found]

    def _part_ids(self, parts: list[bytes]) -> list[bytes]:
        """The ids of some different parts."""
        ids = list(map(self.known.get, parts))
        missing = [p for p, i in zip(parts, ids) if i is None]
        if missing:
            again = list(map(self.older.get, missing))
            encoded = iter(self._encoded([p for p, i in zip(missing, again) if i is None]))
            found = [next(encoded) if i is None else i for i in again]
            fill = iter(found)
            ids = [next(fill) if i is None else i for i in ids]
            if len(self.known) + len(found) > MAX_WORDS:
                self.older, self.known = self.known, {}
            if len(found) <= MAX_WORDS:
                self.known.update((p, i) for p, i in zip(missing, found) if len(p) <= MAX_WORD_BYTES)
        return ids

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        special = [i for i, t in enumerate(texts) if b"<|" in t]
        plain = [b"" if b"<|" in t else t for t in texts] if special else texts
        lower = pc.ascii_lower(pa.array(plain, pa.binary()).view(pa.string()))
        cut = pc.replace_substring_regex(
            lower.view(pa.binary()), pattern=_BEFORE_MARK, replacement=r"\1 \2"
        )
        split = pc.ascii_split_whitespace(cut.view(pa.string()))
        parts = split.flatten().dictionary_encode()
        different = parts.dictionary.view(pa.binary()).to_pylist()
        # One array of all ids in the order of the parts, and where each part's begin.
        placed = pa.array(self._part_ids(different), pa.large_binary()).take(parts.indices)
        begins = np.frombuffer(placed.buffers()[1], np.int64)[: len(placed) + 1]
        data = memoryview(placed.buffers()[2] or b"")
        ends = begins[split.offsets.to_numpy()].tolist()
        out = [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
        if special:
            for i, ids in zip(special, self._encoded([texts[i] for i in special])):
                out[i] = ids
        return out


def grouped(texts: Iterable[bytes], size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Texts in their order, in groups of about `size` bytes."""
    group, total = [], 0
    for text in texts:
        group.append(text)
        total += len(text)
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


def cut_pieces(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32 of the ids) of a document, in order."""
    total = len(ids) // 4
    return [
        (i, a, min(capacity, total - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)]))
        for i, a in enumerate(range(0, total, capacity))
    ]


def token_pieces(
    docs: DataFrame, file: str, capacity: int, end_id: int, id_col: str, text_col: str
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, the end among them."""
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"))
    extra = StructType.fromDDL("piece int, start bigint, length bigint, ids_crc32 bigint")
    schema = StructType([narrow.schema["doc_id"], *extra.fields])
    out = to_arrow_schema(schema)
    end, run_name = end_id.to_bytes(4, "little"), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_memory(run_name, lambda: WordIds(file))
        for batch in batches:
            rows, owner = [], []
            texts = (text.as_py() or b"" for text in batch.column("text"))
            ids = (i for group in grouped(texts) for i in words.ids(group))
            for i, found in enumerate(ids):
                pieces = cut_pieces(found + end, capacity)
                rows += pieces
                owner += [i] * len(pieces)
            ids = batch.column("doc_id").take(pa.array(owner, pa.int64()))
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids.cast(out.field(0).type), *arrays], schema=out)

    return narrow.mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, given the number of pieces of each length.

    A dual feasible function maps lengths to numbers that sum to at most one in
    every bin, so their sum over all pieces is a bound. Two families are tried:
    one rounds lengths above 1 - e up and below e down, the other rounds
    to multiples of 1/k. All sums are exact integers.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    counts = counts[sizes].astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    n = np.concatenate(([0], np.cumsum(counts)))
    length = np.concatenate(([0], np.cumsum(sizes * counts)))
    # Bounds change only where e passes a length that is there.
    e = np.unique(np.concatenate((sizes, capacity + 1 - sizes)))
    e = e[2 * e <= capacity]
    low = np.searchsorted(sizes, e, "left")
    high = np.searchsorted(sizes, capacity - e, "right")
    rounded = n[-1] - n[high] - -(length[high] - length[low]) // capacity
    best = max(best, int(rounded.max(initial=0)))
    for k in range(1, 101):
        # In units of 1 / (k * capacity).
        exact = (k + 1) * sizes % capacity == 0
        units = np.where(exact, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((units * counts).sum()) // (k * capacity)))
    return best


@dataclass
class _Open:
    """Bins by what is left in them."""

    capacity: int
    bins: dict[int, list[np.ndarray]] = field(default_factory=dict)

    def put(self, left: int, bins: np.ndarray) -> None:
        if len(bins):
            self.bins.setdefault(left, []).append(bins)

    def take(self, size: int) -> tuple[int, np.ndarray] | None:
        """All bins of the least space that holds `size`."""
        left = min((x for x in self.bins if x >= size), default=None)
        return None if left is None else (left, np.concatenate(self.bins.pop(left)))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; bins are numbered from 0.

    Pieces of one length are placed together: best fit fills the fullest bin
    that takes one with as many as it holds, then the next such bin.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    sizes, starts = np.unique(-lengths[order], return_index=True)
    ends = [*starts[1:].tolist(), len(lengths)]
    opened, left_over = 0, _Open(capacity)
    for size, at, end in zip((-sizes).tolist(), starts.tolist(), ends):
        while at < end:
            found = left_over.take(size)
            if found is None:
                new = -(-(end - at) // (capacity // size))
                left, used = capacity, np.arange(opened, opened + new)
                opened += new
            else:
                left, used = found
            each = left // size
            placed = min(end - at, len(used) * each)
            step = np.arange(placed)
            bins[order[at : at + placed]] = used[step // each]
            offsets[order[at : at + placed]] = capacity - left + step % each * size
            full, rest = divmod(placed, each)
            if left - each * size:
                left_over.put(left - each * size, used[:full])
            if rest:
                left_over.put(left - rest * size, used[full : full + 1])
            left_over.put(left, used[full + bool(rest) :])
            at += placed
    return bins, offsets


PACKED = "part long, bin long, offset long, bins long, bound long, open boolean, space boolean"


def pack_partition(rows: pa.Table, capacity: int) -> pa.Table:
    """The rows of one partition with their places, its certificate, and what is open.

    Open are the bins with space of a partition with a gap, and the emptiest
    bin of one without, as the bounds of two partitions may both be rounded up.
    """
    lengths = rows.column("length").to_numpy()
    bins, offsets = best_fit_decreasing(lengths, capacity)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    if len(fill) > bound:
        is_open = fill < capacity
    else:
        is_open = (np.arange(len(fill)) == fill.argmin()) & (fill < capacity)
    new = {
        "bin": bins,
        "offset": offsets,
        "bins": np.full(len(bins), len(fill)),
        "bound": np.full(len(bins), bound),
        "open": is_open[bins],
        "space": fill[bins] < capacity,
    }
    for name, values in new.items():
        rows = rows.append_column(name, pa.array(values))
    return rows


def _packed(pieces: DataFrame, count: int, seed: int, capacity: int) -> DataFrame:
    """`pieces` dealt to `count` partitions by hash and packed there."""
    schema = StructType([*pieces.schema.fields, *StructType.fromDDL(PACKED).fields])
    target = to_arrow_schema(schema)

    def pack(rows: pa.Table) -> pa.Table:
        # In a fixed order, so that a task that runs again returns the same.
        return pack_partition(rows.sort_by("row"), capacity).cast(target)

    part = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count))
    return pieces.withColumn("part", part).groupBy("part").applyInArrow(pack, schema)


def _bins(packed: DataFrame) -> int:
    parts = packed.groupBy("part").agg(F.first("bins").alias("bins"))
    return parts.agg(F.sum("bins")).first()[0] or 0


@dataclass
class Packing:
    """`rows` are the placed pieces; the bins used, and a bound for all pieces together."""

    rows: DataFrame
    sequences: int
    bound: int
    rounds: int


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES
) -> Packing:
    """Place pieces (any columns, with `length` from 1 to `capacity`) in sequences.

    Adds sequence_id and offset. Pieces as long as a sequence are sequences of
    their own. Rounds of exchange go on until the bins meet the bound of the
    whole. A round that saves less than `MIN_SAVING` of its bins, or none, is
    followed by one in which all bins with space take part, in partitions twice
    as large, up to `LARGEST` times; then the packing is done. A round's result
    is kept only if it uses fewer bins. Pieces are dealt by a hash of their row,
    so equal lengths or ids make no partition larger.
    """
    rows = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full, short = rows.where(F.col("length") == capacity), rows.where(F.col("length") < capacity)
    # One row for each length: at most `capacity` of them.
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():
        counts[length] = n
    bound = lower_bound(counts, capacity)
    n_full, n_short = int(counts[capacity]), int(counts[:capacity].sum())

    def round_of(source: DataFrame, n: int, seed: int, size: int) -> DataFrame:
        return written(_packed(source, max(1, -(-n // size)), seed, capacity), "packed")

    names, seed, factor = rows.columns, 0, 1
    tables = [(0, round_of(short, n_short, 0, per_part))]
    sequences = n_full + _bins(tables[0][1])
    # One partition has nobody to exchange with.
    while sequences > bound and n_short > per_part:
        which, opened = "open" if factor == 1 else "space", None
        for k, table in tables:
            part = table.where(which).select(*names, F.lit(k).alias("round"), "part", "bin")
            opened = part if opened is None else opened.unionAll(part)
        before, n = opened.select("round", "part", "bin").distinct().count(), opened.count()
        seed += 1
        new = round_of(opened.select(*names), n, seed, per_part * factor)
        saved = before - _bins(new)
        if saved < max(1, before * MIN_SAVING):
            if factor >= LARGEST or (factor > 1 and n <= per_part * factor):
                break
            factor *= 2
            continue
        tables = [(k, table.where(f"not {which}")) for k, table in tables] + [(seed, new)]
        sequences, factor = sequences - saved, 1
    # Round, partition and bin in one number: a partition holds fewer than 2**28 pieces.
    named = [
        part.select(
            *names,
            (F.lit(k << 56) + F.col("part") * (1 << 28) + F.col("bin")).alias("sequence_id"),
            "offset",
        )
        for k, part in tables
    ]
    alone = (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    out = full.select(*names, *alone)
    for part in named:
        out = out.unionAll(part)
    return Packing(out.drop("row"), sequences, bound, seed + 1)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | Callable[[], str] = default_tokenizer,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    per_part: int = PIECES,
) -> Packing:
    """Documents as token ids, cut where longer than `capacity`, packed into sequences.

    Rows are doc_id, piece, start, length, ids_crc32, sequence_id and offset. A
    null or empty text is the end id alone. Rows that share an id, or have
    none, are documents each. An empty table gives no rows. Other columns are
    not read. `tokenizer` is a file that every executor can read, or a function that
    names it, in the format of the `tokenizers` library; its tokens must not reach across white
    space.
    """
    file = tokenizer() if callable(tokenizer) else tokenizer
    pieces = token_pieces(docs, file, capacity, end_id, id_col, text_col)
    return pack_pieces(pieces, capacity, per_part)
