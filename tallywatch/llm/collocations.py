"""Phrase collocations from counts of the longest windows alone.

Every word opens one window of the longest phrase length, padded where its
piece of text ends. Only these windows are counted. A shorter phrase's count
is the sum over the windows that begin with it, which a Spark ROLLUP forms for
successively shorter prefixes. Before it, windows too rare to matter are padded
further, so that little is left to roll up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.llm.common import col

MAX_WORDS = 3
MIN_COUNT = 10
INSIDE_SHARE = 50  # per cent
TOP = 2000
# Windows that a task sums up before it sends them.
_WINDOWS = 1 << 22
_ROWS = 1 << 17  # sorted windows summed at a time
_SEGMENT = 1 << 20  # bytes of a long text handled at a time
# A word or prefix that opens more than this share of a sample's windows is dealt to several tasks.
HOT_SHARE, HOT_PARTS, SAMPLE_ROWS = 1 / 2000, 64, 2_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(
    0x0A if b in _BREAKS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def tokens(raw: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, b"\\n" between pieces, some at a time."""
    data = raw.translate(_FOLD)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > _SEGMENT:
            cuts = [data.find(c, at + _SEGMENT) for c in (b" ", b"\n")]
            end = min((c for c in cuts if c >= 0), default=end)
        part = data[at:end].replace(b"\n", b" \n ").split(b" ")
        yield [w for w in part if w]
        at = end


class _Numbers(dict):
    """Words numbered as they come; 0 is the pad."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class WindowCounts:
    """Counts the padded windows of `n` words, by language, until it is full."""

    def __init__(self, n: int):
        self.n, self.bits = n, 63 // n
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers({b"\n": 0})
        self.codes: dict[str, list[np.ndarray]] = {}
        self.size = 0

    @property
    def full(self) -> bool:
        # Half the numbers are left for the words of the next segment.
        return self.size >= _WINDOWS or len(self.number) >= 1 << (self.bits - 1)

    def add(self, lang: str, words: Sequence[bytes], opening: int) -> None:
        """Add the windows that the first `opening` of the words open."""
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        padded = np.concatenate((ids, np.zeros(self.n, np.int64)))
        code, inside = ids[:opening], ids[:opening] != 0
        for k in range(1, self.n):
            nxt = padded[k : k + opening]
            inside = inside & (nxt != 0)
            code = code << self.bits | np.where(inside, nxt, 0)
        self.codes.setdefault(lang, []).append(code[ids[:opening] != 0])
        self.size += opening

    def rows(self) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """(prefix and language, last word, count) of the windows so far."""
        words = pa.array([b"", *list(self.number)[1:]], pa.binary())
        mask = (1 << self.bits) - 1
        for lang, codes in self.codes.items():
            windows, counts = np.unique(np.concatenate(codes), return_counts=True)
            parts = [
                words.take(pa.array(windows >> (self.bits * (self.n - 1 - k)) & mask))
                for k in range(self.n)
            ]
            head = pc.binary_join_element_wise(*parts[:-1], pa.scalar(b" ", pa.binary()))
            tail = pa.scalar(b"\t" + lang.encode(), pa.binary())
            head = pc.binary_join_element_wise(head, tail, pa.scalar(b"", pa.binary()))
            yield head, parts[-1], pa.array(counts, pa.int64())


def _windows(docs: DataFrame, n: int) -> DataFrame:
    """(prefix, word, n): windows, summed as far as one task has seen them together.

    `prefix` is all words but the last, a tab and the language.
    """
    out = pa.schema([("prefix", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def batches_of(counts: WindowCounts) -> Iterator[pa.RecordBatch]:
        for head, word, number in counts.rows():
            arrays = [head.view(pa.string()), word.view(pa.string()), number]
            for batch in pa.Table.from_arrays(arrays, schema=out).to_batches(1 << 16):
                yield batch
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WindowCounts(n)
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                raw, lang = text.as_py(), lang.as_py()
                carried: list[bytes] = []
                for words in tokens(raw) if raw else ():
                    # The last words of a segment open windows that reach into the next.
                    words = carried + words
                    for a in range(0, len(words) - n + 1, 1 << (counts.bits - 2)):
                        opening = min(len(words) - n + 1 - a, 1 << (counts.bits - 2))
                        counts.add(lang, words[a : a + opening + n - 1], opening)
                        if counts.full:
                            yield from batches_of(counts)
                    carried = words[max(0, len(words) - n + 1) :]
                if carried:
                    counts.add(lang, carried, len(carried))
                if counts.full:
                    yield from batches_of(counts)
        yield from batches_of(counts)

    return docs.mapInArrow(run, "prefix string, word string, n bigint")


def _first_word(prefix: Column) -> Column:
    """The first word of a prefix and the language, which decide where a window goes."""
    words = F.substring_index(F.substring_index(prefix, "\t", 1), " ", 1)
    return F.concat(words, F.expr("substring(prefix, instr(prefix, '\t'))"))


def _hot(docs: DataFrame, n: int) -> tuple[list[str], list[str]]:
    """First words and prefixes of many windows, estimated; they decide where rows go, never a count."""
    rows = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    seen = written(
        _windows(docs.sample(fraction=share, seed=1), n).groupBy("prefix").agg(F.sum("n").alias("n")),
        "window-sample",
    )
    total = seen.agg(F.sum("n").alias("t")).scalar()
    heads = seen.groupBy(_first_word(F.col("prefix")).alias("key")).agg(F.sum("n").alias("n"))
    lists = []
    for found in (heads, seen.select(F.col("prefix").alias("key"), "n")):
        # At most 1 / HOT_SHARE rows.
        rows = found.where(F.col("n") > HOT_SHARE * total).select("key").collect()
        lists.append([r["key"] for r in rows])
    return lists[0], lists[1]


def phrase_counts(
    docs: DataFrame, n: int = MAX_WORDS, least: int = MIN_COUNT, lang_col="lang", text_col="text"
) -> DataFrame:
    """(lang, phrase, words, f): phrases of up to `n` words that occur `least` times or more.

    The row of no words counts all words of the language. Stored, as it is
    read several times.

    The windows take one shuffle, by their first word, so that all windows of a
    prefix meet in one task and lie beside others of that word. First words of
    many windows are dealt by the prefix as well, prefixes of many windows by the
    last word; ROLLUP puts these sums together.
    """
    narrow = docs.select(
        F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        col(text_col).cast("binary").alias("text"),
    )
    hot_words, hot_prefixes = _hot(narrow, n)
    head = _first_word(F.col("prefix"))
    is_hot = F.col("prefix").isin(hot_prefixes) if hot_prefixes else F.lit(False)
    of_hot = head.isin(hot_words) if hot_words else F.lit(False)
    part = F.when(is_hot, F.pmod(F.xxhash64("prefix", "word"), F.lit(HOT_PARTS))).when(
        of_hot, F.pmod(F.xxhash64("prefix"), F.lit(HOT_PARTS))
    )
    home = F.hash(head, F.coalesce(part, F.lit(-1)))
    dealt = _windows(narrow, n).withColumn("home", home).repartition("home")
    sorted_ = dealt.sortWithinPartitions("home", "prefix", "word")
    summed = _summed(sorted_, n, least, set(hot_prefixes))
    # Parts of hot words and prefixes meet here; infrequent windows are padded by now.
    words = [F.col(f"w{k + 1}") for k in range(n)]
    keys = ["lang", *[f"w{k + 1}" for k in range(n)]]
    # ROLLUP drops the last word of the windows, then the next, down to the language.
    rolled = summed.rollup(*keys).agg(F.sum("f").alias("f"), F.grouping_id().alias("level"))
    depth = F.lit(n) - F.bit_count("level").cast("int")
    last = F.get(F.array(F.lit("-"), *words), depth)
    found = rolled.where(F.col("lang").isNotNull() & (last != "")).select(
        "lang", F.concat_ws(" ", *words).alias("phrase"), depth.alias("words"), "f"
    )
    return written(found.where((F.col("words") == 0) | (F.col("f") >= least)), "phrase-counts")


def _summed(windows: DataFrame, n: int, least: int, hot: set[str]) -> DataFrame:
    """(lang, w1 ... wn, f): windows summed, and padded where they are infrequent.

    `windows` come sorted within partitions, and all of one prefix in one, but those
    of `hot` prefixes. A window that occurs less than `least` times is padded in its
    last place, and one whose prefix does in the place before as well: no
    phrase that ends there is asked for, and the counts of shorter ones stay whole.
    """
    names = ["lang", *[f"w{k + 1}" for k in range(n)], "f"]
    out = pa.schema([*[(c, pa.string()) for c in names[:-1]], ("f", pa.int64())])

    def padded(prefix: pa.Array, word: pa.Array, count: np.ndarray) -> pa.RecordBatch:
        """Whole prefixes, sorted by prefix and word."""
        new_prefix = np.ones(len(count), bool)
        new = np.ones(len(count), bool)
        if len(count) > 1:
            new_prefix[1:] = pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = new_prefix[1:] | pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
        starts, groups = np.flatnonzero(new), np.flatnonzero(new_prefix)
        f = np.add.reduceat(count, starts)
        # By prefix: its total, and the windows among `f`.
        total = np.add.reduceat(count, groups)
        of = np.cumsum(new_prefix)[starts] - 1
        often = f >= least
        kept = total >= least
        if hot:
            is_hot = pc.is_in(prefix.take(pa.array(groups)), pa.array(sorted(hot)))
            kept |= is_hot.to_numpy(zero_copy_only=False)
        often &= kept[of] & pc.not_equal(word.take(pa.array(starts)), "").to_numpy(zero_copy_only=False)
        # What is left of a prefix beside its frequent windows.
        rest = total - np.bincount(of[often], weights=f[often], minlength=len(total)).astype(np.int64)
        left = np.flatnonzero(rest > 0)
        at = np.concatenate((starts[often], groups[left]))
        ends = pc.if_else(pa.array(np.arange(len(at)) < often.sum()), word.take(pa.array(at)), "")
        keeps = np.concatenate((np.ones(int(often.sum()), bool), kept[left]))
        head = pc.split_pattern(prefix.take(pa.array(at)), "\t", max_splits=1)
        words = pc.split_pattern(pc.list_element(head, 0), " ")
        columns = [pc.list_element(head, 1)]
        for k in range(n - 1):
            w = pc.list_element(words, k)
            columns.append(pc.if_else(pa.array(keeps), w, "") if k and k == n - 2 else w)
        columns += [ends, pa.array(np.concatenate((f[often], rest[left])))]
        return pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.select(["prefix", "word", "n"]))
            if sum(b.num_rows for b in held) < _ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            prefix = table.column("prefix").chunk(0)
            # The last prefix may go on in the next batch.
            ends = np.flatnonzero(pc.not_equal(prefix, prefix[-1]).to_numpy(zero_copy_only=False))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            held = table.slice(cut).to_batches()
            if cut:
                yield padded(*_columns(table.slice(0, cut)))
        if held:
            yield padded(*_columns(pa.Table.from_batches(held)))

    ddl = ", ".join(f"{c} string" for c in names[:-1]) + ", f bigint"
    return windows.mapInArrow(run, ddl)


def _columns(table: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray]:
    table = table.combine_chunks()
    prefix, word, count = (table.column(c).chunk(0) for c in ("prefix", "word", "n"))
    return prefix, word, count.to_numpy()


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """a * a * 10**6 div (left * right), exact beyond 64 bits."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def _inner_phrases(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): shorter phrases inside candidates, and the largest count of these."""
    size = F.size("parts")
    starts = F.sequence(F.lit(1), size - 1)
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda k: F.transform(
                F.filter(starts, lambda i: i + k <= size + 1),
                lambda i: F.array_join(F.slice("parts", i, k), " "),
            ),
        )
    )
    longer = candidates.where("words > 2")
    return (
        longer.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    inside_share: int = INSIDE_SHARE,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best `top` phrases.

    A candidate is a phrase of 2 to `max_words` (4 at most) words of one piece of
    text that occurs `min_count` times or more. Its score is the least, over the
    places to cut it in two, of a * a * 10**6 div (l * r), in exact decimals;
    equal scores go to the first cut. Candidates inside a longer candidate with
    at least `inside_share` per cent of their count are dropped.

    A null language is `und`, also for texts that say so themselves; null and
    empty texts have no words. Repeated rows count as often as they are there.
    Ties rank by count, then phrase in byte order. An empty table gives no rows. Other columns are not read.
    """
    if not 2 <= max_words <= 4:
        raise ValueError("max_words must be from 2 to 4")
    counts = phrase_counts(docs, max_words, min_count, lang_col, text_col)
    candidates = counts.where("words >= 2").select(
        "lang", "phrase", F.split("phrase", " ").alias("parts"), "words", F.col("f").alias("a")
    )
    # A part occurs wherever the phrase does, so its count is among the kept ones.
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cut.withColumns(
        {
            "first": F.array_join(F.slice("parts", F.lit(1), F.col("k")), " "),
            "rest": F.array_join(F.slice("parts", F.col("k") + 1, F.col("words")), " "),
        }
    )
    for name, key in (("l", "first"), ("r", "rest")):
        side = counts.where("words >= 1").select(
            "lang", F.col("phrase").alias(key), F.col("f").alias(name)
        )
        sides = sides.join(side, ["lang", key])
    best = (
        sides.withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r")))
        .groupBy("lang", "phrase")
        .agg(
            F.first("a").alias("a"),
            F.min(F.struct("score", "k", "l", "r")).alias("cut"),
        )
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    inner = _inner_phrases(candidates)
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < inside_share * F.col("a"))
    )
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: its best are taken in parts first.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(HOT_PARTS))
    for keys in (["lang", salt], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        kept = kept.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


_TEXT = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_TEXT}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS MATERIALIZED (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spans AS (
    SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
    FROM words, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
f AS MATERIALIZED (
    SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS f FROM spans GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, p, k, f AS a FROM f WHERE k > 1 AND f >= {MIN_COUNT}),
cuts AS (SELECT lang, p, a, unnest(range(1, k)) AS c FROM candidates),
scored AS (
    SELECT cuts.lang, cuts.p, a, c, x.f AS l, y.f AS r,
           (a::HUGEINT * a * 1000000) // (x.f::HUGEINT * y.f) AS score
    FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.p = cuts.p[1:c]
              JOIN f AS y ON y.lang = cuts.lang AND y.p = cuts.p[c + 1:]),
best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
inside AS (
    SELECT lang, p[1:2] AS p, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, p[2:3], a FROM candidates WHERE k = 3),
longest AS (SELECT lang, p, max(a) AS longer FROM inside GROUP BY lang, p),
kept AS (
    SELECT best.lang, array_to_string(best.p, ' ') AS phrase, a, l, r, score
    FROM best LEFT JOIN longest ON best.lang = longest.lang AND best.p = longest.p
    WHERE longer IS NULL OR 100 * longer < {INSIDE_SHARE} * a),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
