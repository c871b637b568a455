"""The stages in order, each against a brute-force reading of its input and output."""

import corpus_pipeline
import pytest

from tallywatch.functions.scale import written
from tallywatch.llm import simhash
from tests.llm.test_operators import EDGE, plain_components, plain_contamination, plain_fingerprint

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), name.replace(" ", "-"))
        found.append(docs.collect())
    return found


def test_stages(spark, outputs):
    raw, civil, single, cut, clean, mixed = outputs
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    gone = {r.doc_id for r in raw} - {r.doc_id for r in civil}
    assert all(labels.get(d, 1) == 1 for d in gone)
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in civil]
    assert sorted(r.doc_id for r in single) == sorted(set(plain_components(prints)))
    assert sorted(r.doc_id for r in cut) == sorted(r.doc_id for r in single)
    assert all(r.n_chars == len(r.text) for r in cut)
    items = [
        (r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    ]
    good = []
    for r in cut:
        n, hit, _ = plain_contamination(r.text, items)
        if not (hit and 20 * hit >= n):
            good.append(r)
    assert sorted(good) == sorted(clean)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    assert max(r["copy"] for r in mixed) <= 2


def test_run_is_the_stages(spark, outputs):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(rows) == sorted(outputs[-1])


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(
        [(r[0], r[1], r[2], "en", 1, "x") for r in EDGE],
        "doc_id long, text string, source string, lang string, n_chars long, copies string",
    )
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, df, SMALL), name.replace(" ", "-"))
            assert out.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, df, SMALL).collect()
    assert simhash.keep_one(docs).count() == 5
