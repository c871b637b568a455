"""The operators as queries over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.llm import (
    chunk_dedup,
    collocations,
    decontaminate,
    lattice_lm,
    lexical_search,
    line_frequency,
    mixing,
    packing,
    page_diff,
    perspectives,
    simhash,
    toxicity,
    url_graph,
)

QUERIES = {}
ORACLES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Fitted on the labelled rows that are not held out."""
    labels = toxicity.train_only(table(spark, sf_dir, "labels"))
    return toxicity.fit(docs, labels)


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query
def op2_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_graph.judge_urls(table(spark, sf_dir, "pages"))
    # How far the links to and from a host speak against it, whatever the number of hosts.
    share = F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0))
    return judged.select(
        "page_id", "host", "path", "rule", "verdict", F.round(share, 6).alias("distrust_share")
    )


ORACLES["op2_url_graph"] = url_graph.sql()


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


ORACLES["op3_decontaminate"] = decontaminate.SQL


@query
def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_frequency.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_removed_words",
        "base_failed",
        "kept",
    )


ORACLES["op4_line_frequency"] = line_frequency.SQL


@query
def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_passages(table(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.with_score(
        docs.select("doc_id", "text"), toxicity_model(spark, sf_dir, docs)
    )
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = perspectives.rotate(table(spark, sf_dir, "conversations"), whole=True)
    ranges = F.transform("mask", lambda m: F.concat_ws("-", m["first"], m["past"]))
    return rendered.select(
        "conv_id", "speaker", "part", "n_messages", "text", F.array_join(ranges, ",").alias("mask")
    )


ORACLES["op8_perspectives"] = perspectives.SQL


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(table(spark, sf_dir, "documents"))
    return taken.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


ORACLES["op9_mixing"] = mixing.SQL


@query
def op10_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = page_diff.main_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


ORACLES["op11_lexical_search"] = lexical_search.SQL


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = collocations.SQL


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).rows
