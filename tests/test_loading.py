"""Records that do not fit, stored summaries, and tables kept up to date."""

import datetime as dt
import gzip
import statistics

import pytest
from pyspark.sql import functions as F

from tallywatch.functions import row_windows, sketches
from tallywatch.operators import aggregate, clean, geo, rollups, temporal
from tallywatch.plans import incremental
from tallywatch.sources import enrolment

HEAD = "date,state,district,pincode,age_0_5,age_5_17,age_18_greater"


def reasons(loaded):
    return {r.line: r.reasons for r in loaded.rejects.collect()}


def test_bad_lines_are_set_aside(spark, tmp_path):
    lines = [
        HEAD,
        "02-03-2025,Goa,North,403001,1,2,3",
        "02-03-2025,Goa,North,403001,1,2",
        "02-03-2025,Goa,North,403001,1,2,3,4",
        "02-03-2025,Goa,North,403001,one,2,3.5",
        "nodate,Goa,North,403001,1,2,3",
        "nodate,Goa,North,403001,x,2,3",
        ",Goa,,403001,,2,3",
        '03-03-2025,"Goa, old",North,403001,1,2,3',
    ]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    loaded = enrolment.load_checked(spark, str(tmp_path))
    got = sorted(map(tuple, loaded.records.collect()), key=str)
    assert got == sorted(
        [
            (dt.date(2025, 3, 2), "Goa", "North", "403001", 1, 2, 3),
            (None, "Goa", None, "403001", None, 2, 3),
            (dt.date(2025, 3, 3), "Goa, old", "North", "403001", 1, 2, 3),
        ],
        key=str,
    )
    assert reasons(loaded) == {
        lines[2]: ["wrong number of fields"],
        lines[3]: ["wrong number of fields"],
        lines[4]: ["age_0_5 is not a whole number", "age_18_greater is not a whole number"],
        lines[5]: ["date not understood"],
        lines[6]: ["age_0_5 is not a whole number", "date not understood"],
    }
    assert all(r.file.endswith("a.csv") for r in loaded.rejects.collect())
    assert loaded.records.count() == 3 and loaded.rejects.count() == 5
    report = clean.validate_data(loaded.records, loaded.rejects).first()
    assert (report.rejected_lines, report.unparsed_dates) == (5, 2)
    assert "5 lines set aside" in report.warnings
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        enrolment.read_records(spark, str(tmp_path)).collect()


def test_files_of_a_folder_order_their_columns(spark, tmp_path):
    names = HEAD.split(",")
    row = dict(zip(names, ["02-03-2025", "Goa", "North", "403001", "1", "2", "3"]))
    orders = [names, names[::-1], ["extra", *names[2:], *names[:2]]]
    for i, order in enumerate(orders):
        text = ",".join(order) + "\n" + ",".join(row.get(c, "z") for c in order) + "\n"
        (tmp_path / f"p {i}.csv").write_text(text)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress((HEAD + "\n" + ",".join(row.values()) + "\n").encode()))
    want = (dt.date(2025, 3, 2), "Goa", "North", "403001", 1, 2, 3)
    assert [tuple(r) for r in enrolment.read_records(spark, str(tmp_path)).collect()] == [want] * 4
    loaded = enrolment.load_checked(spark, str(tmp_path))
    assert [tuple(r) for r in loaded.records.collect()] == [want] * 4
    assert loaded.rejects.count() == 0


def test_file_without_a_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "\n02-03-2025,Goa,North,403001,1,2,3\n")
    (tmp_path / "b.csv").write_text("date,state\n02-03-2025,Goa\n\n03-03-2025,Goa\n")
    with pytest.raises(ValueError, match="district"):
        enrolment.read_records(spark, str(tmp_path))
    loaded = enrolment.load_checked(spark, str(tmp_path))
    assert loaded.records.count() == 1
    assert set(reasons(loaded)) == {"02-03-2025,Goa", "03-03-2025,Goa"}
    assert reasons(loaded)["02-03-2025,Goa"][0] == "no column district"


def test_load_all_writes_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEAD + "\nx,Goa,North,403001,1,2,3\n02-03-2025,Goa,N,403001,1,2,3\n")
    out = str(tmp_path / "rejects")
    df = enrolment.load_all(spark, str(tmp_path / "in"), ["a.csv"], rejects_path=out)
    assert df.count() == 1 and spark.read.parquet(out).count() == 1
    (tmp_path / "in" / "b.csv").write_text("")
    nothing = enrolment.load_checked(spark, str(tmp_path / "in" / "b.csv"))
    assert nothing.records.count() == nothing.rejects.count() == 0


def test_deviation_of_large_totals(spark):
    big = spark.range(1000).select(
        F.lit(dt.date(2025, 1, 1)).alias("date"),
        F.lit("A").alias("state"),
        F.concat(F.lit("d"), F.col("id") % 7).alias("district"),
        (F.col("id") % 13).cast("string").alias("pincode"),
        (F.lit(10**9) + F.col("id") % 2).alias("age_0_5"),
        F.lit(0).cast("long").alias("age_5_17"),
        F.lit(0).cast("long").alias("age_18_greater"),
    )
    row = enrolment.data_summary(big).first()
    assert row.std_total == pytest.approx(statistics.stdev([0, 1] * 500), rel=1e-12)
    far = big.withColumn("age_5_17", F.col("age_0_5") * 10**4)
    totals = [(10**9 + i % 2) * (10**4 + 1) for i in range(1000)]
    assert enrolment.data_summary(far).first().std_total == pytest.approx(statistics.stdev(totals), rel=1e-9)


@pytest.fixture(scope="module")
def records(spark):
    day = F.date_add(F.lit(dt.date(2025, 1, 1)), (F.col("id") % 5).cast("int"))
    counts = [(F.col("id") % k).alias(c) for k, c in ((7, "age_0_5"), (13, "age_5_17"), (29, "age_18_greater"))]
    return spark.range(40_000).select(
        day.alias("date"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("state"),
        F.concat(F.lit("d"), F.col("id") % 40).alias("district"),
        F.when(F.col("id") % 10 > 0, (F.col("id") % 9001).cast("string")).alias("pincode"),
        *counts,
    )


def test_summaries_roll_up(records):
    days = rollups.summarise_days(records)
    rolled = {r.state: r for r in rollups.roll_up(days, ["state"]).collect()}
    exact = records.groupBy("state").agg(
        F.count("*").alias("records"), F.sum("age_5_17").alias("age_5_17"),
        F.count_distinct("district").alias("d"), F.count_distinct("pincode").alias("p"),
    )
    for want in exact.collect():
        row = rolled[want.state]
        assert (row.records, row.age_5_17, row.district_count) == (want.records, want.age_5_17, want.d)
        assert abs(row.pincode_count - want.p) <= 3 * sketches.distinct_error() * want.p
    whole = rollups.summary_row(days).first()
    assert (whole.records, whole.states, whole.date_end) == (40_000, 2, dt.date(2025, 1, 5))
    none = rollups.summary_row(days.limit(0)).first()
    assert (none.districts, none.records) == (0, None)


def test_quantile_sketches(records):
    found = sketches.approx_quantiles(records, {"lo": ("age_18_greater", 0.1), "hi": ("age_18_greater", 0.9)}, ["state"])
    ranks = sketches.rank_bounds(records, found, "age_18_greater", ["lo", "hi"], ["state"])
    for row in ranks.collect():
        for name, p in (("lo", 0.1), ("hi", 0.9)):
            assert row[f"{name}_below"] <= p + sketches.rank_error()
            assert row[f"{name}_upto"] >= p - sketches.rank_error()
    gaps = records.select("state", F.when(F.col("state") == "A", float("nan")).alias("v"))
    empty = sketches.approx_quantiles(gaps, {"m": ("v", 0.5)}, ["state"])
    assert [r.m for r in empty.collect()] == [None, None]


def test_refresh_computes_changed_days_only(spark, records, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    records.where("date < '2025-01-05'").repartition("date").write.partitionBy("date").parquet(source)
    assert len(incremental.refresh(spark, source, target).computed) == 4
    assert incremental.refresh(spark, source, target) == incremental.Refresh([], [])
    late = records.where("date = '2025-01-05'")
    late.write.mode("append").partitionBy("date").parquet(source)
    assert incremental.refresh(spark, source, target).computed == [dt.date(2025, 1, 5)]

    def same(name, build):
        got = incremental.read_table(spark, target, name)
        want = build(spark.read.parquet(source))
        return sorted(got.select(want.columns).collect()) == sorted(want.collect())

    assert same("state_daily", aggregate.aggregate_by_state)
    assert same("district_daily", aggregate.aggregate_by_district)
    # A day that grows is replaced, one that is gone goes.
    records.where("date = '2025-01-02'").limit(50).write.mode("append").partitionBy("date").parquet(source)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/date=2025-01-03")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    done = incremental.refresh(spark, source, target)
    assert done == incremental.Refresh([dt.date(2025, 1, 2)], [dt.date(2025, 1, 3)])
    assert same("state_daily", aggregate.aggregate_by_state)
    assert same("daily_totals", aggregate.daily_totals)


def test_refresh_reads_the_changed_days(spark, records, tmp_path):
    source = str(tmp_path / "in")
    records.repartition("date").write.partitionBy("date").parquet(source)
    days = spark.read.parquet(source).withColumn("date", F.col("date").cast("date"))
    one = aggregate.aggregate_by_state(days.where(F.col("date").isin([dt.date(2025, 1, 2)])))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "PartitionFilters: [(date" in plan
    listing = incremental.source_days(days)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in listing


def test_grid_of_many_regions(spark):
    n = 20_000
    df = spark.range(n).select(
        F.date_add(F.lit(dt.date(2025, 1, 1)), (F.col("id") % 3).cast("int")).alias("date"),
        F.concat(F.lit("r"), "id").alias("state"),
        (F.col("id") / 10.0).alias("risk_score"),
    )
    grid = geo.risk_grid_rows(df.unionAll(df.limit(10).withColumn("state", F.lit(None).cast("string"))))
    row = grid.agg(F.count("*"), F.sum("risk_score"), F.count_if(F.col("risk_score") == 0)).first()
    assert (row[0], row[2]) == (3 * n, 2 * n + 1)
    assert row[1] == pytest.approx(sum(range(n)) / 10)


def test_chunks_follow_the_data(spark):
    """Ten times the rows are ten times the chunks, also where all rows tie."""
    spark.conf.set(row_windows.CHUNK_CONF, str(64 * 1024))
    try:
        largest = {}
        for n in (60_000, 600_000):
            ties = spark.range(n).select(F.lit(1).alias("day"), F.rand(3).alias("v"))
            chunks = row_windows.with_chunks(ties, [], ["day"]).groupBy("_chunk").count()
            largest[n] = chunks.agg(F.max("count"), F.count("*")).first()
        assert largest[600_000][1] > 5 * largest[60_000][1]
        assert largest[600_000][0] < 2 * largest[60_000][0] < 60_000
        days = spark.range(30_000).select(
            F.date_add(F.lit(dt.date(1990, 1, 1)), F.col("id").cast("int")).alias("date"),
            (F.col("id") % 11).alias("total_enrolments"),
        )
        whole, cut = (
            temporal.rolling_mean(days, split=split).agg(F.sum("rolling_mean")).first()[0] for split in (False, True)
        )
        assert cut == pytest.approx(whole)
    finally:
        spark.conf.unset(row_windows.CHUNK_CONF)


