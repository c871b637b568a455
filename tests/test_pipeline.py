"""Sources, whole pipelines, plans, and every registered query."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as driver
from catalog.tables import Tables
from tallywatch.functions import scale
from tallywatch.operators import aggregate, outliers, temporal
from tallywatch.plans import pipeline
from tallywatch.plans.dashboard import dashboard_tables
from tallywatch.plans.pipeline import run_full_analysis, state_risk
from tallywatch.sources import enrolment

SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DUCK = duckdb.connect()
for _t in TABLES:
    DUCK.execute(f"CREATE VIEW {_t} AS SELECT * FROM '{SMALL}/{_t}.parquet'")
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def records(spark):
    return Tables(spark, SMALL).enrol_events


def test_load_all(spark, tmp_path):
    head = "date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n"
    (tmp_path / "a.csv").write_text(head + "02-03-2025,Goa,North Goa,403001,1,2,3\n")
    (tmp_path / "b.csv").write_text(head + "15/03/2025,Goa,South Goa,040302,4,5,6\nbad,Goa,X,1,0,0,0\n")
    df = enrolment.load_all(spark, str(tmp_path), ["a.csv", "none.csv", "b.csv"])
    rows = df.orderBy("age_0_5").collect()
    assert [r.date for r in rows] == [None, dt.date(2025, 3, 2), dt.date(2025, 3, 15)]
    assert rows[2].pincode == "040302"
    again = enrolment.load_all(spark, str(tmp_path / "gone"), ["a.csv"], str(tmp_path))
    assert again.count() == 1
    with pytest.raises(FileNotFoundError):
        enrolment.load_all(spark, str(tmp_path), ["none.csv"])


PLACES = [
    (1, "A", "x", "1", 1, 2, 3),
    (1, "A", "x", "1", 4, 0, 1),
    (1, "A", "y", "1", 2, 2, 2),
    (1, "A", "y", None, 0, 0, 9),
    (1, "A", None, "2", 5, 5, 5),
    (1, "A", "z", None, 1, None, 1),
    (2, "A", "x", "3", 0, 0, 0),
    (1, "B", None, None, 7, 7, 7),
]
PLACE_SCHEMA = (
    "day int, state string, district string, pincode string, "
    "age_0_5 bigint, age_5_17 bigint, age_18_greater bigint"
)


@pytest.fixture
def places(spark):
    df = spark.createDataFrame(PLACES, PLACE_SCHEMA)
    return df.selectExpr("date_add(date '2025-01-01', day) AS date", "*").drop("day")


def test_distinct_counts_leave_nulls_out(places):
    rows = aggregate.aggregate_by_state(places).collect()
    found = {(r.date.day, r.state): (r.district_count, r.pincode_count, r.age_0_5) for r in rows}
    assert found == {(2, "A"): (3, 2, 13), (3, "A"): (1, 1, 0), (2, "B"): (0, 0, 7)}
    rough = aggregate.aggregate_by_state(places, approximate=True).collect()
    assert sorted(rough) == sorted(rows)
    assert "Expand" not in plan_of(aggregate.aggregate_by_state(places))
    sums = aggregate.aggregate_by_state(places, counts=False)
    assert plan_of(sums).count("Exchange") == 1  # asked before a run adds the final plan
    whole = aggregate.aggregate_by_state(places).select(sums.columns)
    assert sorted(sums.collect()) == sorted(whole.collect())


def test_data_summary_matches_pandas(places):
    frame = places.toPandas()
    total = frame["age_0_5"] + frame["age_5_17"] + frame["age_18_greater"]
    for rough in (False, True):
        row = enrolment.data_summary(places, approximate=rough).first()
        assert (row.total_records, row.states, row.districts, row.pincodes) == (8, 2, 3, 3)
        assert (row.age_5_17, row.total_enrolments, row.min_total) == (16, total.sum(), 0)
        assert row.mean_total == pytest.approx(total.mean())
        assert row.std_total == pytest.approx(total.std())
    one = enrolment.data_summary(places.where("state = 'B'")).first()
    assert (one.total_records, one.mean_total, one.std_total) == (1, 21.0, None)
    none = enrolment.data_summary(places.where("state = 'C'")).first()
    assert (none.total_records, none.states, none.total_enrolments, none.std_total) == (0, 0, None, None)
    scan = plan_of(enrolment.data_summary(places)).split("Expand")[-1]
    assert "HashAggregate" in scan  # what is expanded are combinations, not records


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "age_5_17,date,district,state,extra,age_18_greater,age_0_5,pincode\n2,1-3-2025,North,Goa,x,3,1,0403\n"
    )
    (tmp_path / "b.csv").write_text(
        "date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n2025/03/02,Goa,South,1,4,5,6\n"
    )
    with pytest.warns(UserWarning, match="none.csv"):
        df = enrolment.load_all(spark, str(tmp_path), ["a.csv", "b.csv", "none.csv"])
    rows = sorted(map(tuple, df.collect()))
    assert rows == [
        (dt.date(2025, 3, 1), "Goa", "North", "0403", 1, 2, 3),
        (dt.date(2025, 3, 2), "Goa", "South", "1", 4, 5, 6),
    ]
    (tmp_path / "c.csv").write_text("date,state\n1-1-2025,Goa\n")
    with pytest.raises(ValueError, match="district"):
        enrolment.read_records(spark, str(tmp_path / "c.csv"))


def test_date_forms(spark, tmp_path):
    good = ["1-3-2025", "01-03-2025", "01.03.2025", "01-Mar-2025", "2025/03/01", "01-03-25",
            "01-03-2025 00:00:00", "1 Mar 2025", "2025-03-01T10:00:00", "01/03/2025"]
    bad = ["03-31-2025", "soon", "31-02-2025", "soon"]
    head = "date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n"
    (tmp_path / "a.csv").write_text(head + "".join(f"{d},S,D,1,1,1,1\n" for d in good + bad))
    dates = [r.date for r in enrolment.read_records(spark, str(tmp_path)).collect()]
    assert dates == [dt.date(2025, 3, 1)] * len(good) + [None] * len(bad)
    lost = {r.date: r.records for r in enrolment.unparsed_dates(spark, str(tmp_path)).collect()}
    assert lost == {"03-31-2025": 1, "soon": 2, "31-02-2025": 1}


def test_parquet_output_prunes_partitions(spark, tmp_path, records):
    path = enrolment.write_parquet(records, str(tmp_path / "p"), ["state"])
    plan = plan_of(spark.read.parquet(path).where("state = 'view'").select("age_0_5"))
    assert "PartitionFilters: [isnotnull(state" in plan


def test_full_analysis(spark, tmp_path, records):
    result = run_full_analysis(records, output_dir=str(tmp_path / "out"))
    states = result.state_analysis
    wanted = {"growth_rate", "trend_direction", "is_anomaly", "risk_level", "child_dominance"}
    assert wanted <= set(states.columns)
    assert result.anomaly_summary.first().anomaly_count > 0
    assert result.validation.first().is_valid
    assert sum(r["count"] for r in result.risk_distribution.collect()) == states.count()
    written = spark.read.option("header", True).csv(str(tmp_path / "out" / "state_analysis"))
    assert written.count() == states.count()


@pytest.fixture
def stored(monkeypatch):
    """(label, plan) of the tables that the pipelines store."""
    seen, real = [], pipeline.written

    def spy(df, label):
        seen.append((label, plan_of(df)))
        return real(df, label)

    monkeypatch.setattr(pipeline, "written", spy)
    return seen


def test_full_analysis_reads_the_raw_rows_once(records, stored):
    result = run_full_analysis(records)
    assert [label for label, plan in stored if "events.parquet" in plan] == ["clean-records"]
    for table in vars(result).values():
        assert "events.parquet" not in plan_of(table)


def test_dashboard(records):
    tables = dashboard_tables(records)
    assert tables["kpis"].first().anomaly_rate > 0
    assert tables["forecast"].count() == 30
    assert tables["alerts"].count() <= 20
    assert "anomaly_map" not in dashboard_tables(records, run_anomaly=False)


def test_entry(spark):
    out = driver.entry(spark)
    assert out.count() > 0
    assert {"risk_score", "risk_level"} <= set(out.columns)


def test_stored_tables_can_be_removed(spark, records):
    before = scale.written(records, "kept")
    assert before.count() == 1000
    path = before.inputFiles()[0]
    assert spark.sparkContext.applicationId in path
    scale.remove_written(spark)
    assert not enrolment.path_exists(spark, path)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    """The query at the smallest scale, against its SQL where there is one."""
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name not in ORACLES:
        return
    result = DUCK.execute(ORACLES[name])
    assert df.columns == [d[0] for d in result.description]
    assert sorted(map(str, rows)) == sorted(map(str, result.fetchall()))


def test_aggregation_combines_before_the_shuffle(spark, records):
    plan = plan_of(aggregate.daily_totals(records))
    assert "partial_sum" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_pipeline_windows_share_one_sort(spark, records):
    daily = scale.written(aggregate.aggregate_by_state(records), "plan-test")
    out = temporal.trends(
        temporal.volatility(temporal.growth_rate(daily, group_cols=["state"]), group_cols=["state"]),
        group_cols=["state"],
    )
    plan = plan_of(out)
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_flagship_scans_the_records_once(records, stored):
    plan = plan_of(state_risk(records))
    assert "events.parquet" not in plan
    assert [p.count("events.parquet") for _, p in stored] == [1]


def test_global_statistics_use_no_window(spark, records):
    scored = outliers.zscore_analysis(records, "age_5_17")
    assert "Window" not in plan_of(scored)


def test_group_statistics_are_not_broadcast_unchecked(spark, records, large_paths):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(outliers.zscore_analysis(records, "age_5_17", group_cols=["state"]))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
