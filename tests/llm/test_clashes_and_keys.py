"""Clashing columns, missing and repeated ids, and the passages cut against a plain version."""

import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallywatch.llm import chunk_dedup, decontaminate, mixing, queries, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = [
    "_simhash_fingerprint", "_simhash_id", "_simhash_print", "_scan", "_hits", "_row", "_repeats",
    "_found", "_found_id", "_found_key", "_toxicity", "_mix", "_mix_source", "_mix_found", "size",
    "source_size", "target", "copies", "copy", "key", "digest", "text_",
]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def test_stages_keep_all_columns(spark, clashing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, "/root/testdata/sf0.001")
        extra = ["copy_"] if name == "mixing sources" else []
        assert out.columns == [*clashing.columns, *extra]
        rows = out.select(*NAMES).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(f"own {n}" for n in NAMES)]
        plain = stage(spark, clashing.drop(*NAMES), "/root/testdata/sf0.001")
        assert out.count() == plain.count()


def test_null_items_beside_others(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = [(None, words), ("b", words), (None, "lone item"), ("a", "lone item"), ("c", None)]
    items = spark.createDataFrame(bench, "item_id string, text string")
    docs = spark.createDataFrame([(1, words), (2, "a LONE item here"), (3, "clean")], "doc_id long, text string")
    whole = decontaminate.contamination(docs, items).orderBy("doc_id").collect()
    assert [r["items"] for r in whole] == [["b", None], ["a", None], []]
    assert [(r.n_words, r.n_hit, r.n_items) for r in whole] == [(14, 14, 2), (4, 2, 2), (1, 0, 0)]
    # An automaton for about every item; the texts are read for each.
    split = decontaminate.contamination(docs, items, max_words=1).orderBy("doc_id").collect()
    assert split == whole
    assert decontaminate.drop_contaminated(docs, items, max_words=1).count() == 1


def test_rows_without_ids_are_mixed_near_their_target(spark):
    rows = [(None if s != "c" else 7, f"{s} {i} one two", s) for s in "abc" for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.copies(docs).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")
    )
    for row in found.collect():
        assert row.taken == pytest.approx(row.target, rel=0.02)


# --- passages


def plain_chunks(words):
    """(first word, past last, digest), byte by byte."""
    text, hash_, at_end, n = " ".join(words).encode(), 0, [], 0
    for byte in text + b" ":
        if byte == 0x20:
            at_end.append(hash_)
        gear = xxhash.xxh64_intdigest(bytes([byte]), chunk_dedup.SEED) & 0xFFFFFFFF
        hash_ = (2 * hash_ + gear) % 2**32
    out, n = [], 0
    while n < len(words):
        stop = None
        for end in range(n + chunk_dedup.MIN_WORDS, min(n + chunk_dedup.MAX_WORDS, len(words)) + 1):
            if end == len(words) or at_end[end - 1] >> (32 - chunk_dedup.MASK_BITS) == 0:
                stop = end
                break
        if stop is None and len(words) - n > chunk_dedup.MAX_WORDS:
            window = range(n + chunk_dedup.MIN_WORDS, n + chunk_dedup.MAX_WORDS + 1)
            stop = max(window, key=lambda e: (at_end[e - 1], -e))
        stop = len(words) if stop is None else stop
        out.append((n, stop, xxhash.xxh64_intdigest(" ".join(words[n:stop]).encode(), chunk_dedup.SEED)))
        n = stop
    return out


def plain_dedup(rows):
    """What is left of each text, and how many words went."""
    cut = [plain_chunks((t or "").translate(LOWER).split()) for _, t in rows]
    owner = {}
    for (doc, _), parts in zip(rows, cut):
        for *_, digest in parts:
            if doc is not None:
                owner[digest] = min(owner.get(digest, doc), doc)
    out = []
    for (doc, text), parts in zip(rows, cut):
        gone = set()
        foreign = [doc is not None and owner[d] < doc for *_, d in parts]
        at = 0
        while at < len(parts):
            stop = at
            while stop < len(parts) and foreign[stop]:
                stop += 1
            run = parts[at:stop]
            if run and run[-1][1] - run[0][0] >= chunk_dedup.MIN_MIXED_RUN:
                gone |= set(range(run[0][0], run[-1][1]))
            held = defaultdict(list)
            for a, b, d in run:
                held[owner[d]].append((a, b))
            for own in held.values():
                if sum(b - a for a, b in own) >= chunk_dedup.MIN_RUN:
                    gone |= set(range(own[0][0], own[-1][1]))
            at = max(stop, at + 1)
        words = (text or "").split()
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, left, len(gone)))
    return sorted(out, key=str)


def test_passages_match_a_plain_version(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "kmnrst" for b in ("a", "é", "io", "Une", "x")]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passages = [prose(k) for k in (20, 60, 90, 200)]
    rows = []
    for i in range(80):
        parts = [prose(rng.randint(0, 60)), *rng.sample(passages, rng.randint(0, 3)), prose(rng.randint(0, 30))]
        rng.shuffle(parts)
        rows.append((rng.choice([i, i, 5, None]), " ".join(parts)))
    rows += [(100, "again " * 300), (101, "x again " + "again " * 300 + "y"), (102, None), (103, "")]
    rows += [(5, rows[3][1]), (5, rows[3][1]), (200, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = chunk_dedup.dedup_passages(docs).collect()
    got = sorted(((r.doc_id, " ".join((r.text or "").split()), r.n_removed) for r in found), key=str)
    assert got == plain_dedup(rows)
    assert sum(r.n_removed for r in found) > 1000
    for r in found:
        spans = [(s["first"], s["past"]) for s in r.spans]
        assert spans == sorted(spans) and bool(spans) == bool(r.n_removed)


def test_one_id_for_half_the_rows(spark):
    """Rows of one id do not meet in a group; spans of a long text are found in one pass."""
    text = F.concat_ws(" ", *[F.concat(F.lit(c), (F.col("id") * k % 1009).cast("string")) for k, c in enumerate("abcdefghijklmnopqrst", 1)])
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("doc_id"), text.alias("text"))
    assert chunk_dedup.dedup_passages(rows).where("n_removed > 0").count() > 10_000
    long = " ".join(f"w{i}" for i in range(100_000))
    two = spark.createDataFrame([(1, long), (2, long.replace("w5 ", "new ") + " end")], "doc_id long, text string")
    assert chunk_dedup.dedup_passages(two).where("doc_id = 2").first().n_removed > 99_000


def test_keep_one_and_queries_are_registered(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "d e f g"), (3, "a b c")], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 2
    assert {"op11_lexical_search", "op12_collocations", "op13_packing"} <= set(queries.QUERIES)
