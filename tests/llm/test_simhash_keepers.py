"""Which rows `keep_one` leaves where ids are missing or shared."""

from tallywatch.llm import simhash

KIND = "doc_id long, text string"


def text(name, n=40):
    return " ".join(f"{name}{i}x{i * i}" for i in range(n))


def test_unrelated_rows_without_id_all_stay(spark):
    rows = [(None, text(f"n{i}")) for i in range(30)] + [(None, text("n3")), (None, text("n3"))]
    rows += [(7, text("known")), (None, text("known"))]
    docs = spark.createDataFrame(rows, KIND)
    for df in (docs, docs.repartition(5)):
        kept = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
        assert sorted(kept, key=str) == sorted({*rows[:30], rows[32]}, key=str)


def test_one_id_of_two_unrelated_texts(spark):
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (3, text("a")), (4, text("c"))]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, KIND)).collect()]
    assert sorted(kept) == [rows[0], rows[1], rows[4]]


def test_near_copies_without_id_are_one_group(spark):
    far = 7 << 40
    prints = spark.createDataFrame([(None, 8), (None, 9), (None, far)], "doc_id long, fingerprint long")
    got = {r.fingerprint: (r.root, r.component_id) for r in simhash.components(prints).collect()}
    assert got == {8: (8, None), 9: (8, None), far: (far, None)}
