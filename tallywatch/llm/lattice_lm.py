"""Document likelihood under a subword lattice.

A text is its words and an end token. A word's probability is the sum over all
its segmentations into pieces of an existing vocabulary, found by a forward
recursion in log space; pieces never span white space, so a text's probability
is the product over its words and the end. The vocabulary's own scores weight
the segmentations of training words; the expected piece counts that this gives,
over all training words, weight the segmentations when scoring.

Words are counted once over the corpus and each distinct word is scored once.
The most frequent words, at most `HEAD_WORDS`, go to the tasks as a table of
that bound; the occurrences of all others are joined with the scored words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.llm.common import col, lower_words, map_rows
from tallywatch.llm.toxicity import held_out

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1_000_000
HEAD_WORDS = 200_000
HEAD_BYTES = 64
_COUNTED = 200_000
_MARK = "▁"


def load_pieces(model_file: str = MODEL_FILE) -> tuple[dict[str, float], list[float]]:
    """Natural log weights of a vocabulary's pieces, and of its 256 byte pieces.

    Scores of a merge vocabulary are ranks, not log probabilities; a piece of
    rank r weighs 1 / (r + 10), as word frequencies do. Byte pieces, which
    spell characters the vocabulary lacks, rank last.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    if size > MAX_PIECES:
        raise ValueError(f"{model_file} has {size} pieces, more than {MAX_PIECES}")
    names = [
        i
        for i in range(size)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
    ]
    names.sort(key=lambda i: (-model.get_score(i), i))
    weights = [1.0 / (r + 10) for r in range(len(names) + 256)]
    total = math.fsum(weights)
    logs = [math.log(w / total) for w in weights]
    return {model.id_to_piece(i): x for i, x in zip(names, logs)}, logs[len(names) :]


class Lattice:
    """Segmentations of a word into pieces with given log weights."""

    def __init__(self, pieces: dict[str, float], byte_pieces: list[float]):
        self.table: dict[str, float | None] = {}
        for piece in pieces:
            for k in range(1, len(piece)):
                self.table.setdefault(piece[:k], None)
        self.table.update(pieces)
        self.byte_pieces = byte_pieces

    def _edges(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(from, to, log weight), ordered by from. Unknown characters are spelt in bytes."""
        get, n = self.table.get, len(text)
        for i in range(n):
            if get(text[i]) is None:
                yield i, i + 1, sum(self.byte_pieces[b] for b in text[i].encode())
            for j in range(i + 1, n + 1):
                weight = get(text[i:j], 0)
                if weight == 0:
                    break
                if weight is not None:
                    yield i, j, weight

    def _forward(self, n: int, edges: Iterable[tuple[int, int, float]]) -> list[float]:
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        alpha, done = [0.0] * (n + 1), 0
        for i, j, weight in edges:
            while done < i:
                done += 1
                alpha[done] = _logsum(terms[done])
            terms[j].append(alpha[i] + weight)
        while done < n:
            done += 1
            alpha[done] = _logsum(terms[done])
        return alpha

    def log_probability(self, word: bytes) -> float:
        """Natural log of the summed weight of all segmentations of the word."""
        text = _MARK + word.decode("utf-8", "replace")
        return self._forward(len(text), self._edges(text))[-1]

    def add_expected(self, word: bytes, times: int, counts: dict[str, float]) -> None:
        """Add the expected number of uses of each piece in `times` such words."""
        text = _MARK + word.decode("utf-8", "replace")
        n, edges = len(text), list(self._edges(text))
        alpha = self._forward(n, edges)
        turned = [(n - j, n - i, w) for i, j, w in edges]
        turned.sort(key=lambda e: e[0])
        beta = self._forward(n, turned)
        for i, j, weight in edges:
            share = times * math.exp(alpha[i] + weight + beta[n - j] - alpha[n])
            if j == i + 1 and self.table.get(text[i]) is None:
                for b in text[i].encode():
                    counts[f"<0x{b:02X}>"] += share
            else:
                counts[text[i:j]] += share


class WordBatches:
    """The recursions of `Lattice` over many words at a time.

    Words of one length are the rows of a matrix of code points; substrings are
    looked up by a 64-bit hash. Words longer than `LONG` go one by one.
    """

    LONG = 48
    _ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, float], byte_pieces: list[float]):
        self.lattice = Lattice(pieces, byte_pieces)
        self.names = list(pieces)
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.names = [self.names[i] for i in order]
        self.logs = np.array([pieces[p] for p in self.names])

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self._ODD) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _groups(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
        """(places in `words`, matrix of code points) for each length."""
        by_length: dict[int, list[int]] = defaultdict(list)
        texts = [_MARK + w.decode("utf-8", "replace") for w in words]
        for i, t in enumerate(texts):
            by_length[len(t)].append(i)
        for n, at in by_length.items():
            if n <= self.LONG:
                joined = "".join([texts[i] for i in at]).encode("utf-32-le")
                yield at, np.frombuffer(joined, dtype="<u4").reshape(len(at), n)
            else:
                yield at, np.empty((len(at), 0), dtype="<u4")

    def _edges(self, codes: np.ndarray) -> list[tuple]:
        """(from, to, rows, pieces, log weights); piece -1 is a character spelt in bytes."""
        out, n = [], codes.shape[1]
        for i in range(n):
            h = np.zeros(len(codes), dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * self._ODD + codes[:, j - 1] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                found = self.hashes[at] == h
                rows = np.flatnonzero(found)
                if len(rows):
                    out.append((i, j, rows, at[rows], self.logs[at[rows]]))
                if j == i + 1 and len(rows) < len(codes):
                    rows = np.flatnonzero(~found)
                    spelt = self.lattice.byte_pieces
                    logs = [sum(spelt[b] for b in chr(c).encode()) for c in codes[rows, i].tolist()]
                    out.append((i, j, rows, None, np.array(logs)))
        return out

    @staticmethod
    def _recursion(size: int, n: int, edges: Iterable[tuple]) -> np.ndarray:
        alpha = np.full((n + 1, size), -np.inf)
        alpha[0] = 0.0
        for i, j, rows, _, logs in edges:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logs)
        return alpha

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """`Lattice.log_probability` of each word."""
        out = np.empty(len(words))
        for at, codes in self._groups(words):
            n = codes.shape[1]
            if n:
                out[at] = self._recursion(len(at), n, self._edges(codes))[n]
            else:
                out[at] = [self.lattice.log_probability(words[i]) for i in at]
        return out

    def expected(self, batches: Iterable[tuple[list[bytes], list[int]]]) -> dict[str, float]:
        """Expected uses of each piece over words that occur so many times."""
        sums, counts = np.zeros(len(self.names)), defaultdict(float)
        for words, times in batches:
            for at, codes in self._groups(words):
                n, size = codes.shape[1], len(at)
                if not n:
                    for i in at:
                        self.lattice.add_expected(words[i], times[i], counts)
                    continue
                edges = self._edges(codes)
                alpha = self._recursion(size, n, edges)
                back = sorted(edges, key=lambda e: -e[1])
                beta = self._recursion(size, n, [(n - j, n - i, *e) for i, j, *e in back])
                share = np.log(np.array([times[i] for i in at], dtype=float)) - alpha[n]
                for i, j, rows, pieces, logs in edges:
                    uses = np.exp(alpha[i, rows] + logs + beta[n - j, rows] + share[rows])
                    if pieces is not None:
                        np.add.at(sums, pieces, uses)
                        continue
                    for c, x in zip(codes[rows, i].tolist(), uses.tolist()):
                        for b in chr(c).encode():
                            counts[f"<0x{b:02X}>"] += x
        for name, x in zip(self.names, sums.tolist()):
            if x:
                counts[name] += x
        return counts


def _logsum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    most = max(terms)
    return most + math.log(math.fsum([math.exp(t - most) for t in terms]))


def reestimated(
    pieces: dict[str, float], byte_pieces: list[float], counts: dict[str, float], ends: int
) -> tuple[dict[str, float], list[float], float]:
    """Log weights from expected counts, one added use per piece on average; and the end's."""
    prior = len(pieces) + 256
    total = math.fsum(counts.values()) + ends + 1 + prior
    weight = lambda name, log: math.log((counts.get(name, 0.0) + prior * math.exp(log)) / total)
    new = {p: weight(p, x) for p, x in pieces.items()}
    spelt = [weight(f"<0x{b:02X}>", x) for b, x in enumerate(byte_pieces)]
    return new, spelt, math.log((ends + 1) / total)


@dataclass(frozen=True)
class Trained:
    """What the corpus gave: stored words (word, c, log_p) and a few numbers."""

    words: DataFrame
    total: int
    distinct: int
    end_count: int
    end_log: float


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c): words of all rows, c their number in rows that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def out():
            # words of held-out rows only come with zero
            words = [*train, *(w for w in other if w not in train)]
            n = [train.get(w, 0) for w in words]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, type=pa.binary()), pa.array(n, type=pa.int64())], names=["word", "c"]
            )

        for batch in batches:
            for raw, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (other if held else train).update(lower_words(raw))
                if len(train) + len(other) > _COUNTED:
                    yield out()
                    train.clear()
                    other.clear()
        yield out()

    found = rows.select("text", "held_out").mapInArrow(run, "word binary, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


def train(rows: DataFrame, model_file: str = MODEL_FILE) -> Trained:
    """Count the words of `rows` (text, held_out) and learn piece weights from them."""
    sc = rows.sparkSession.sparkContext
    pieces, byte_pieces = load_pieces(model_file)
    words = written(count_words(rows).repartition("word"), "word-counts")
    total, distinct = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    ends = rows.where("not held_out").count()
    sent = sc.broadcast((pieces, byte_pieces))  # at most MAX_PIECES

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
        counts = WordBatches(*sent.value).expected(lists)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.float64())],
            names=["piece", "n"],
        )

    # one row per piece at most, so as bounded as the vocabulary
    found = (
        words.where("c > 0")
        .mapInArrow(expected, "piece string, n double")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = {r[0]: r[1] for r in found}
    new, spelt, end_log = reestimated(pieces, byte_pieces, counts, ends)
    learned = sc.broadcast((new, spelt))

    def setup():
        return WordBatches(*learned.value)

    def score(lattice, names, counts):
        return zip(names, counts, lattice.log_probabilities(names).tolist())

    scored = map_rows(words, "word binary, c long, log_p double", ["word", "c"], score, setup)
    return Trained(
        written(scored, "scored-words"),
        int(total or 0) + ends,
        int(distinct or 0) + (ends > 0),
        ends,
        end_log,
    )


def head_words(words: DataFrame, most: int = HEAD_WORDS) -> list[tuple[bytes, int, float]]:
    """The most frequent words, at most `most`, none longer than `HEAD_BYTES`.

    Counts are put in eighths of powers of two; whole classes are taken from
    the top as long as they fit.
    """
    level = F.floor(F.log2("c") * 8)
    short = words.where((F.col("c") > 0) & (F.octet_length("word") <= HEAD_BYTES))
    classes = short.groupBy(level.alias("level")).count().collect()
    least, room = None, most
    for r in sorted(classes, key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    if least is None:
        return []
    return [(bytes(r[0]), r[1], r[2]) for r in short.where(level >= least).collect()]


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held: int = 2,
    model_file: str = MODEL_FILE,
    head: int = HEAD_WORDS,
) -> DataFrame:
    """One row per row of `docs`, scored by what the rows not held out teach.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (an
    add-one word model) and score, both log10. Null, empty and wordless texts
    are the end token alone. Repeated rows count and are scored each. A row
    without id is not held out. If nothing is left to learn from, the
    vocabulary's own weights score.
    """
    rows = docs.select(
        col(id_col).alias("doc_id"),
        held_out(col(id_col), folds, held).alias("held_out"),
        col(text_col).cast("binary").alias("text"),
    )
    model = train(rows, model_file)
    unseen = math.log10(1 / (model.total + model.distinct + 1))
    sent = docs.sparkSession.sparkContext.broadcast(head_words(model.words, head))

    def setup():
        words = sent.value
        number = {w[0]: i for i, w in enumerate(words)}
        base = np.log10(np.array([w[1] for w in words], dtype=float) + 1) + unseen
        return number, base, np.array([w[2] for w in words], dtype=float)

    def look_up(state, ids, held_outs, texts):
        number, base, logs = state
        get = number.get
        for doc, held_out_, raw in zip(ids, held_outs, texts):
            words = lower_words(raw)
            at = [get(w, -1) for w in words]
            found = np.array([i for i in at if i >= 0], dtype=np.int64)
            rest = Counter(w for w, i in zip(words, at) if i < 0)
            yield (
                doc,
                held_out_,
                len(words),
                len(found),
                float(base[found].sum()),
                float(logs[found].sum()),
                [{"word": w, "n": n} for w, n in rest.items()],
            )

    schema = (
        "doc_id bigint, held_out boolean, words bigint, known bigint, base double, logs double,"
        " rest array<struct<word: binary, n: bigint>>"
    )
    narrow = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    first = map_rows(narrow, schema, ["doc_id", "held_out", "text"], look_up, setup)
    first = written(first.withColumn("row", F.monotonically_increasing_id()), "first-words")
    n, c = F.col("n"), F.col("c")
    tail = (
        first.select("row", F.explode("rest").alias("r"))
        .select("row", "r.word", "r.n")
        .join(model.words, "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, n).otherwise(0)).alias("known_"),
            F.sum(n * (F.log10(c + 1.0) + unseen)).alias("base_"),
            F.sum(n * F.col("log_p")).alias("logs_"),
        )
    )
    out = first.drop("rest").join(tail, "row", "left")
    plus = lambda name: F.col(name) + F.coalesce(f"{name}_", F.lit(0))
    end_base = math.log10(model.end_count + 1) + unseen
    return out.select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (plus("known") + int(model.end_count > 0)).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (plus("base") + end_base).alias("base_score"),
        ((plus("logs") + model.end_log) / math.log(10)).alias("score"),
    )
