"""Chat formatting with the perspective rotated over the participants.

For every participant the dialogue is rendered with that speaker as the
assistant and the others as named users; the mask holds the character ranges of
the speaker's own messages. System messages stay so in every perspective and
are nobody's perspective. Long dialogues come in parts of `PART_TURNS` turns.
Parts crowded with messages are cut in the order of the dialogue, and rendered
block by block; `whole` joins the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.llm.common import col

PART_TURNS = 128
# Messages of one part beyond which it is cut into blocks: only if turns repeat.
PART_MESSAGES = 1024
SYSTEM = "system"
NOBODY = "unknown"
END = "<|end|>\n"


def _plain(text: Column) -> Column:
    """A text that cannot be taken for a tag."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _blocks(messages: DataFrame) -> DataFrame:
    """`messages` with their block: each `PART_MESSAGES` in order of turn, role and text.

    Rows are sorted by range, so a part with most messages is spread out; the
    counts of the ranges before one, a small table, number its rows on.
    """
    order = [F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")]
    ranged = messages.repartitionByRange(F.asc("conv_id"), F.asc("part"), *order)
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "crowded-messages")
    before = Window.partitionBy("c", "p").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        ranged.groupBy(F.col("range").alias("r"), F.col("conv_id").alias("c"), F.col("part").alias("p"))
        .agg(F.count("*").alias("n"))
        .select("r", "c", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    counts = written(counts, "range-counts")
    numbered = ranged.withColumn(
        "at", F.row_number().over(Window.partitionBy("range", "conv_id", "part").orderBy(*order))
    )
    same = (F.col("range") == F.col("r")) & F.col("conv_id").eqNullSafe(F.col("c"))
    block = F.floor((F.col("before") + F.col("at") - 1) / PART_MESSAGES).cast("long")
    return numbered.join(counts, same & (F.col("part") == F.col("p"))).select(
        *messages.columns, block.alias("block")
    )


def _joined(blocks: DataFrame) -> DataFrame:
    """The rendered blocks of each part as one row, block 0."""
    key = ["conv_id", "speaker", "part"]
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    moved = blocks.withColumn(
        "past", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int")
    ).withColumn(
        "mask",
        F.transform(
            "mask",
            lambda m: F.struct(
                (m["first"] + F.col("past")).alias("first"), (m["past"] + F.col("past")).alias("past")
            ),
        ),
    )
    pieces = F.sort_array(F.collect_list(F.struct("block", "text", "mask")))
    return moved.groupBy(*key).agg(F.sum("n_messages").alias("n_messages"), pieces.alias("pieces")).select(
        *key,
        F.lit(0).cast("long").alias("block"),
        "n_messages",
        F.array_join("pieces.text", "").alias("text"),
        F.flatten("pieces.mask").alias("mask"),
    )


def rotate(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    whole: bool = False,
) -> DataFrame:
    """(conv_id, speaker, part, block, n_messages, text, mask) per participant and part.

    Messages are ordered by turn (null last), then role and text. Exact
    repeats of a message are one message. A null role is a participant called
    "unknown", a null text is empty, a null conv_id a conversation of its own.
    `block` is above 0 only where more than `PART_MESSAGES` messages claim the
    turns of one part: such a part is cut after each `PART_MESSAGES` messages,
    and blocks are numbered in that order. With `whole` every part is one row,
    whatever its size, and `block` is 0. `mask` is an array of (first, past
    last) code points of the row's text.
    """
    role = F.coalesce(col(role_col).cast("string"), F.lit(NOBODY))
    said = conversations.select(
        col(conv_col).alias("conv_id"),
        col(turn_col).cast("long").alias("turn"),
        _plain(role).alias("role"),
        _plain(F.coalesce(col(text_col), F.lit(""))).alias("text"),
    ).distinct()
    part = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-1)).cast("long")
    said = written(said.withColumn("part", part), "messages")
    crowded = written(
        said.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > PART_MESSAGES),
        "crowded-parts",
    )
    speakers = (
        said.where(F.col("role") != SYSTEM)
        .select(F.col("conv_id").alias("c"), F.col("role").alias("speaker"))
        .distinct()
    )
    if crowded.isEmpty():
        return _rendered(said.withColumn("block", F.lit(0).cast("long")), speakers)
    here = said.conv_id.eqNullSafe(crowded.c) & (said.part == crowded.p)
    others = said.join(crowded, here, "left_anti").withColumn("block", F.lit(0).cast("long"))
    cut = _rendered(_blocks(said.join(crowded, here, "left_semi")), speakers)
    return _rendered(others, speakers).unionAll(_joined(cut) if whole else cut)


def _rendered(said: DataFrame, speakers: DataFrame) -> DataFrame:
    """Each block of `said` in the perspective of each of the conversation's speakers."""
    message = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text")
    parts = said.groupBy("conv_id", "part", "block").agg(
        F.sort_array(F.collect_list(message)).alias("messages")
    )
    each = parts.join(speakers, parts.conv_id.eqNullSafe(speakers.c)).drop("c")
    me = F.col("speaker")

    def head(m: Column) -> Column:
        other = F.concat(F.lit("<|user name="), m["role"], F.lit("|>\n"))
        return (
            F.when(m["role"] == me, "<|assistant|>\n")
            .when(m["role"] == SYSTEM, "<|system|>\n")
            .otherwise(other)
        )

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(head(m))
        past = start + F.length(m["text"])
        own = F.array(F.struct(start.alias("first"), past.alias("past")))
        return F.struct(
            (past + len(END)).alias("at"),
            F.when(m["role"] == me, F.concat(state["mask"], own))
            .otherwise(state["mask"])
            .alias("mask"),
        )

    nothing = F.lit(None).cast("array<struct<first: int, past: int>>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(nothing, F.array()).alias("mask"))
    text = F.array_join(
        F.transform("messages", lambda m: F.concat(head(m), m["text"], F.lit(END))), ""
    )
    kind = "struct<at: int, mask: array<struct<first: int, past: int>>>"
    return each.select(
        "conv_id",
        "speaker",
        "part",
        "block",
        F.size("messages").cast("long").alias("n_messages"),
        text.alias("text"),
        F.aggregate("messages", start.cast(kind), lambda s, m: add(s, m).cast(kind))["mask"].alias("mask"),
    )


SQL = f"""
WITH said AS (
    SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn,
        replace(coalesce(role, '{NOBODY}'), '<|', '< |') AS role,
        replace(coalesce(text, ''), '<|', '< |') AS text
    FROM conversations),
parted AS (
    SELECT *, CAST(coalesce(floor(turn / {PART_TURNS}.0), -1) AS BIGINT) AS part FROM said),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> '{SYSTEM}'),
lines AS (
    SELECT p.conv_id, speaker, part, turn, role, text,
        CASE WHEN role = speaker THEN '<|assistant|>' || chr(10)
             WHEN role = '{SYSTEM}' THEN '<|system|>' || chr(10)
             ELSE '<|user name=' || role || '|>' || chr(10) END AS head
    FROM parted p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
    SELECT *, sum(length(head) + length(text) + {len(END)}) OVER (
        PARTITION BY conv_id, speaker, part ORDER BY turn NULLS LAST, role, text) AS past
    FROM lines)
SELECT conv_id, speaker, part, count(*) AS n_messages,
    string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS text,
    coalesce(string_agg(
        CAST(CAST(past - {len(END)} - length(text) AS BIGINT) AS VARCHAR) || '-' ||
        CAST(CAST(past - {len(END)} AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS LAST, role, text)
        FILTER (WHERE role = speaker), '') AS mask
FROM placed GROUP BY conv_id, speaker, part
"""
