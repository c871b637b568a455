"""Quality rules with cross-document line frequency, in built-in functions only.

Lines are normalised (lower case, white space as one space, trimmed) and
hashed. A line that more than `MIN_DOCS` different texts of a host hold, and
more than `MAX_SHARE` of the host's texts, is boilerplate; exact copies of a
text count once. A document is rejected if it fails the base rules or if
without its boilerplate less than `MIN_LEFT` of its words are left.

Each text is read once, into a table of counts and line hashes; only hashes are
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.llm.common import SPACE, WORD, col

MIN_DOCS = 20
MAX_SHARE = 0.01
MIN_LEFT = 0.3
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def _repeated_words(df: DataFrame) -> DataFrame:
    """Replace `_words` by `n_repeat_words`: words in windows of three found twice.

    Windows are hashed; where a hash repeats, the windows are sorted by hash,
    repeated ones give their positions, and each position covers three words
    less what the next one covers too. Each step is a column of its own that
    later ones name several times, so Spark computes it once per row.
    """
    n = F.greatest(F.size("_words") - 2, F.lit(0))
    zipped = F.arrays_zip(*[F.slice("_words", i, n).alias(f"w{i}") for i in (1, 2, 3)])
    df = df.withColumn("_windows", F.transform(zipped, lambda w: F.xxhash64(w)))
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(repeats, F.array_sort(placed)))
    again = F.filter(
        "_sorted",
        lambda w, i: w["h"].eqNullSafe(F.get("_sorted", i - 1)["h"])
        | w["h"].eqNullSafe(F.get("_sorted", i + 1)["h"]),
    )
    df = df.withColumn("_at", F.sort_array(F.transform(again, lambda w: w["i"])))
    covered = F.transform(
        "_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3)))
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop(
        "_words", "_windows", "_sorted", "_at"
    )


def base_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Stored table of one row per document: counts, and the hashes of its lines."""
    text = F.coalesce(col(text_col), F.lit(""))
    df = docs.select(
        col(id_col).alias("doc_id"), col(host_col).cast("string").alias("host"), text.alias("text")
    )
    df = df.select(
        "doc_id",
        "host",
        "text",
        F.array_remove(F.split("text", SPACE), "").alias("_words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    df = df.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_key"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            "_lines",
            lambda x: F.struct(
                _line_key(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words")
            ),
        ).alias("lines"),
        "_words",
    )
    # Stored once, so the row number stays the same for all that read it.
    return written(
        _repeated_words(df).withColumn("row", F.monotonically_increasing_id()), "line-counts"
    )


def frequent_lines(
    counts: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE
) -> DataFrame:
    """(host, line, n_docs, host_docs) of the lines above both limits."""
    texts = counts.select("host", "text_key").distinct()
    hosts = texts.groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = (
        counts.select("host", "text_key", F.explode("lines.line").alias("line"))
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") > min_docs)
    )
    hosts = written(hosts, "hosts").withColumnRenamed("host", "h")
    found = lines.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return found.where(F.col("n_docs") > max_share * F.col("host_docs"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """Counts and verdict for every row of `docs`.

    Null, empty and wordless texts have zero counts and fail the base rules.
    Documents without a host share one. Repeated rows are judged alike, and
    count as one text for the frequencies.
    """
    counts = base_counts(docs, id_col, text_col, host_col)
    frequent = written(
        frequent_lines(counts, min_docs, max_share).select(F.col("host").alias("h"), "line"),
        "frequent-lines",
    )
    lines = counts.select("row", "host", F.explode("lines").alias("l")).select(
        "row", "host", "l.line", "l.words"
    )
    removed = (
        lines.join(frequent, lines.host.eqNullSafe(frequent.h) & (lines.line == frequent.line))
        .groupBy("row")
        .agg(F.sum("words").alias("n_removed_words"), F.count("*").alias("n_removed_lines"))
    )
    out = counts.drop("lines").join(written(removed, "removed-lines"), "row", "left")
    for name in ("n_removed_words", "n_removed_lines"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < min_left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """(doc_id, text) of all documents without their frequent lines, blank lines included."""
    frequent = frequent_lines(base_counts(docs, id_col, text_col, host_col))
    frequent = written(frequent.select(F.col("host").alias("h"), F.col("line").alias("k")), "frequent-lines")
    rows = written(
        docs.select(
            col(id_col).alias("doc_id"),
            col(host_col).cast("string").alias("host"),
            F.coalesce(col(text_col), F.lit("")).alias("text"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "texts",
    )
    lines = rows.select(
        "row", "host", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "part")
    ).withColumn("key", F.when(F.col("part").rlike(WORD), _line_key(F.col("part"))))
    kept = lines.join(
        frequent, lines.host.eqNullSafe(frequent.h) & (lines.key == frequent.k), "left_anti"
    )
    parts = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p"))
    text = F.coalesce(F.array_join("p.part", "\n"), F.lit("")).alias("text")
    return rows.select("row", "doc_id").join(parts, "row", "left").select("doc_id", text)


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
places AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w),
windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM places),
covered AS (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM windows WHERE n > 1),
repeats AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
lines AS (
    SELECT * FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
keyed AS (
    SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
frequent AS (
    SELECT k.host, k.k FROM keyed k JOIN hosts h ON k.host IS NOT DISTINCT FROM h.host
    GROUP BY k.host, k.k, h.texts
    HAVING count(DISTINCT k.text) > {MIN_DOCS} AND count(DISTINCT k.text) > {MAX_SHARE} * h.texts),
removed AS (
    SELECT r, sum(n) AS n FROM keyed k JOIN frequent f
    ON k.host IS NOT DISTINCT FROM f.host AND k.k = f.k GROUP BY r),
counts AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
    FROM d JOIN w USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r)
    LEFT JOIN removed USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
        AND n_words - n_removed_words >= {MIN_LEFT} * n_words AS kept
FROM counts
"""
