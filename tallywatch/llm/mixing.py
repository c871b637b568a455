"""Mixing sources to target weights.

Words are counted per source, targets are filled by weight up to a limit, and
the repetition rate of a source is its target over its size. A document is
taken floor(rate) times, and once more if a hash of its id and the seed falls
below the fraction left. The draw depends on the document alone, so reruns and
other partitionings agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.llm.common import WORD, col, free_name

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
SEED = 17


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST,
) -> DataFrame:
    """(source, source_size, target) from a table (source, source_size).

    Sources in order of code points, null last, get `weights` in turn. They
    share `budget` times all words by weight; a target stops at `most` times
    its source's size and the excess is shared again among the others. One
    number per round, the words each unit of weight gets, passes the driver.
    """
    # Ranks without a single-task sort: Spark sorts in ranges and counts each.
    ordered = sources.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    # groupBy keeps null as a key of its own, so this holds one row per source.
    ranked = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    rows = sources.sparkSession.createDataFrame(
        ranked, "source string, source_size long, rank long"
    )
    each = F.array(*[F.lit(float(w)) for w in weights])
    rows = written(
        rows.select(
            "source",
            "source_size",
            F.element_at(each, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
        ),
        "sources",
    )
    size, weight = F.col("source_size"), F.col("weight")
    total = rows.agg(F.sum(size)).first()[0] or 0
    share, full = 0.0, -1
    while True:
        capped = most * size <= share * weight
        left = rows.agg(
            F.sum(F.when(capped, most * size)), F.sum(F.when(~capped, weight)), F.count_if(capped)
        ).first()
        if left[2] == full or not left[1]:
            break
        full = left[2]
        share = (budget * total - (left[0] or 0.0)) / left[1]
    target = F.least(most * size, F.lit(share) * weight).cast("double")
    return rows.select("source", "source_size", target.alias("target"))


def _taken(
    docs: DataFrame,
    name: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST,
    seed: int = SEED,
) -> DataFrame:
    """`docs` and a struct `name` of size, source_size, target and copies."""
    source, found = (free_name([*docs.columns, name], f"_mix_{c}") for c in ("source", "found"))
    kept = docs.withColumn(name, n_words(col(text_col)))
    sources = written(
        kept.groupBy(col(source_col).alias("source")).agg(F.sum(col(name)).alias("source_size")),
        "source-sizes",
    )
    targets = source_targets(sources, weights, budget, most)
    targets = written(
        targets.select(
            F.col("source").alias(source), F.struct("source_size", "target").alias(found)
        ),
        "targets",
    )
    joined = kept.join(targets, col(source_col).eqNullSafe(col(source)))
    source_size, target = col(found)["source_size"], col(found)["target"]
    rate = F.coalesce(target / F.nullif(source_size, F.lit(0)), F.lit(0.0))
    # 52 bits of the hash, as a number in [0, 1); the text tells rows without an id apart.
    id_ = F.coalesce(col(id_col).cast("string"), F.lit(""))
    text = F.md5(F.coalesce(col(text_col).cast("binary"), F.lit("").cast("binary")))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_, F.lit(":"), text)), 1, 13)
    draw = F.conv(digits, 16, 10).cast("long") / float(1 << 52)
    taken = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    all_ = {"size": col(name), "source_size": source_size, "target": target, "copies": taken}
    return joined.withColumn(name, F.struct(*[c.alias(n) for n, c in all_.items()])).select(
        *[col(c) for c in docs.columns], col(name)
    )


def copies(docs: DataFrame, **options) -> DataFrame:
    """`docs` with size, source_size, target and copies; input columns so named are replaced.

    Options are id_col, text_col, source_col, weights, budget, most and seed.
    Null and empty texts have size 0; a null source is a source. The draw depends
    on id and text, so rows without an id, or with a repeated one, draw apart, and only rows
    equal in both draw alike. Without words every target is 0 and nothing is taken.
    """
    name = free_name(docs.columns, "_mix")
    new = ("size", "source_size", "target", "copies")
    kept = [col(c) for c in docs.columns if c.lower() not in new]
    return _taken(docs, name, **options).select(*kept, *[col(name)[n].alias(n) for n in new])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: each document as many times as it is taken, numbered from 1.

    All columns stay as they are. The number is `copy`, or `copy_` where the
    input has such a column.
    """
    name = free_name(docs.columns, "_mix")
    numbers = F.sequence(F.lit(1).cast("long"), col(name)["copies"])
    taken = _taken(docs, name, **options).where(col(name)["copies"] > 0)
    return taken.select(
        *[col(c) for c in docs.columns], F.explode(numbers).alias(free_name(docs.columns, "copy"))
    )


_CASES = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
# Targets without rounds: sources fill up in order of size over weight, and the
# share of a unit of weight is final at the first that is not filled.
SQL = rf"""
WITH d AS (
    SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
        CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
ranked AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} AS place
    FROM d GROUP BY source),
s AS (
    SELECT source, source_size, (CASE place {_CASES} END)::DOUBLE AS weight,
        {MOST}::DOUBLE * source_size AS most FROM ranked),
filling AS (
    SELECT *, row_number() OVER w AS i,
        ({BUDGET}::DOUBLE * sum(source_size) OVER () - (sum(most) OVER w - most))
            / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS share
    FROM s WINDOW w AS (ORDER BY most / weight, source ROWS UNBOUNDED PRECEDING)),
final AS (SELECT arg_min(share, i) AS share FROM filling WHERE most > share * weight),
targets AS (
    SELECT source, source_size, least(most, coalesce((SELECT share FROM final), 0) * weight) AS target
    FROM s),
drawn AS (
    SELECT doc_id, size, source_size, target,
        coalesce(target / nullif(source_size, 0), 0) AS rate,
        ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT
            / {1 << 52}::DOUBLE AS draw
    FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) * size AS taken
FROM drawn
"""
