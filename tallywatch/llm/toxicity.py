"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features are words, their prefixes (so that inflected forms share one), pairs
of neighbours, and skip-grams of two words with one or two between them, hashed
into 2**20 places; a text has a feature or not. Each coordinate has its own
learning rate, and the L1 term keeps all but the telling weights at zero, so
the model is a short list of places and weights.

The fit uses a bounded sample of labelled rows: `MAX_SAMPLE` rows in the order
of a hash of their id. Features are made where the texts are; one task then
passes over the sample's feature lists in that order, which makes the fit
repeatable. Features of fewer than `MIN_DOCS` sampled texts are left out. Lists
travel and stay packed, at two bytes a place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.llm.common import col, free_name, parts, plus
from tallywatch.llm.decontaminate import normal_words

BITS = 20
MAX_SAMPLE = 20_000
MIN_DOCS = 4
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1
THRESHOLD = 0.7
PREFIXES = (5, 7)

_SKIPS = (1, 2, 3)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_SCALE = np.uint64(0xD6E8FEB86659FD93)
_KNOWN = 200_000


class Features:
    """Hashed features of texts. Hashes of words are kept between texts, up to a bound."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros((_KNOWN, 1 + len(PREFIXES)), dtype=np.uint64)

    def _add(self, word: bytes) -> int:
        at = self.number[word] = len(self.number)
        digest = xxhash.xxh64_intdigest
        # a word no longer than the prefix stands for itself
        self.hashes[at] = [digest(word), *(digest(word[:k], k) for k in PREFIXES)]
        return at

    def of(self, raw: bytes | None) -> np.ndarray:
        """Places of all features of the text, repeats included."""
        words = normal_words(raw)
        parts = []
        for at in range(0, len(words), _KNOWN // 2):
            parts.append(self._hashes(words[at : at + _KNOWN // 2]))
        h = np.concatenate(parts) if parts else self.hashes[:0]
        word = h[:, 0]
        keys = [h.ravel()]
        for skip, odd in zip(_SKIPS, _ODD):
            if len(word) > skip:
                keys.append(word[:-skip] * odd + word[skip:])
        return ((np.concatenate(keys) * _SCALE) >> np.uint64(64 - BITS)).astype(np.int64)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) + len(words) > _KNOWN:
            self.number.clear()
        get, add = self.number.get, self._add
        ids = [add(w) if (i := get(w)) is None else i for w in words]
        return self.hashes[ids]


_UPPER = np.arange(1 << (BITS - 16), dtype=np.int32) << 16


def pack(places: np.ndarray) -> bytes:
    """Ascending places, without repeats: how many have each upper part, then the lower 16 bits."""
    counts = np.bincount(places >> 16, minlength=len(_UPPER)).astype("<u4")
    return counts.tobytes() + (places & 0xFFFF).astype("<u2").tobytes()


def unpack(raw: bytes | pa.Buffer) -> np.ndarray:
    """The places of a packed list."""
    counts = np.frombuffer(raw, dtype="<u4", count=len(_UPPER))
    return np.repeat(_UPPER, counts) + np.frombuffer(raw, dtype="<u2", offset=counts.nbytes)


class PackedLists:
    """Packed lists, each unpacked when its turn comes."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(unpack, self.packed)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def ftrl(features: Iterable[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the last of them the bias, after `epochs` passes in the given order.

    `features` is iterated once an epoch.
    """
    z = np.zeros((1 << BITS) + 1)
    n = np.zeros((1 << BITS) + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(epochs):
        for x, y in zip(features, labels):
            i = np.append(x, 1 << BITS)
            w = weights(i)
            g = _sigmoid(w.sum()) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange((1 << BITS) + 1))


@dataclass(frozen=True)
class Model:
    """The places of nonzero weights, their weights, and the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.places] = self.weights
        return out


def score(places: np.ndarray, table: np.ndarray, bias: float) -> float:
    """Probability of label 1 for a text with these features."""
    hit = places[table[places] != 0]
    return float(_sigmoid(bias + float(table[np.unique(hit)].sum())))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_sample: int = MAX_SAMPLE,
) -> Model:
    """Fit on at most `max_sample` labelled rows of `docs`.

    A document labelled twice counts once, as toxic if any label says so; null
    labels and ids are left out, and of rows that share an id the least text
    counts. Without labelled rows all weights are zero and every score is 0.5.
    """
    order = F.xxhash64("doc_id", F.lit(5))
    sample = (
        labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).alias("y"))
        .where("doc_id is not null and y is not null")
        .groupBy("doc_id")
        .agg(F.max("y").cast("int").alias("y"))
        .select("doc_id", "y", order.alias("at"))
        .orderBy("at", "doc_id")
        .limit(max_sample)
    )
    sample = written(sample, "sample")  # at most max_sample ids, so broadcast below
    texts = docs.select(
        col(id_col).cast("long").alias("doc_id"), col(text_col).cast("binary").alias("text")
    )
    rows = (
        texts.join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "y", "at")
        .agg(F.min("text").alias("text"))
    )

    lists = rows.mapInArrow(_packed_features, "doc_id long, y int, at long, places binary")
    weights = lists.repartition(1).mapInArrow(_train, "place long, weight double").toPandas()
    places, values = weights["place"].to_numpy(dtype=np.int64), weights["weight"].to_numpy(dtype=float)
    is_bias = places == 1 << BITS
    return Model(places[~is_bias], values[~is_bias], float(values[is_bias].sum()))


def _packed_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = Features()
    for batch in parts(batches):
        lists = [pack(np.unique(find.of(t))) for t in batch.column(3).to_pylist()]
        columns = [batch.column(i) for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(lists, type=pa.binary())], names=["doc_id", "y", "at", "places"]
        )


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.Buffer]]:
    for batch in batches:
        ids, ys, ats = (batch.column(i).to_pylist() for i in range(3))
        for at, doc, y, raw in zip(ats, ids, ys, batch.column(3), strict=True):
            yield at, doc, y, raw.as_buffer()


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Packed, and one list at a time: copies and sums of all would be several times their size.
    rows, docs_with = list(_packed_rows(batches)), np.zeros(1 << BITS, dtype=np.int32)
    for *_, packed in rows:
        docs_with[unpack(packed)] += 1  # a list holds a place once
    found = []
    while rows:
        *key, packed = rows.pop()
        places = unpack(packed)
        found.append((*key, pack(places[docs_with[places] >= MIN_DOCS])))
    found.sort(key=lambda r: r[:2])
    w = ftrl(PackedLists([r[3] for r in found]), np.array([r[2] for r in found], dtype=float))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])


def with_score(
    docs: DataFrame, model: Model, text_col: str = "text", name: str = "score"
) -> DataFrame:
    """`docs` with the probability of toxicity of each text as column `name`.

    An input column of that name is replaced. Null, empty and wordless texts
    get the probability that the bias alone gives. Reads the text only.
    """
    rest = [c for c in docs.columns if c.lower() != name.lower()]
    base = docs.select(*[col(c) for c in rest])
    schema = plus(base.schema, name, "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias, find = sent.value.table(), sent.value.bias, Features()
        for batch in parts(batches):
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            scores = pa.array([score(find.of(t), table, bias) for t in texts], type=pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*rest, name])

    return base.mapInArrow(run, schema)


def drop_toxic(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """`docs` without rows that score `threshold` or more."""
    name = free_name(docs.columns, "_toxicity")
    kept = with_score(docs, model, text_col, name).where(F.col(name) < threshold)
    return kept.select(*[col(c) for c in docs.columns])


def train_only(df: DataFrame, id_col: str = "doc_id", folds: int = 3, held: int = 1) -> DataFrame:
    """Rows whose id is not held out."""
    return df.where(~held_out(col(id_col), folds, held))


def held_out(id_, folds: int, held: int):
    """Whether crc32 of the id as text leaves `held`; a null id is never held out."""
    text = F.encode(id_.cast("string"), "utf-8")
    return F.coalesce(F.crc32(text) % folds == held, F.lit(False))
