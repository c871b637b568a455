"""Outliers, quantiles, ranks and split windows against brute force."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywatch.functions import ranks, row_windows, scale
from tallywatch.functions.columns import nan_to_null
from tallywatch.functions.ranks import exact_quantiles
from tallywatch.functions.normal import normal_quantile, normal_upper_tail
from tallywatch.operators import outliers, temporal


def values(kind: str) -> np.ndarray:
    rng = np.random.default_rng(7)
    return {
        "normal": rng.normal(100, 15, 500),
        "hot": np.where(rng.random(500) < 0.4, 3.0, rng.exponential(50, 500)),
        "tiny": rng.normal(0, 1e-9, 300),
        "close": 1e6 + rng.random(400) / 1000,
        "signs": rng.integers(-20, 20, 500).astype(float),
        "constant": np.full(50, 4.25),
        "one": np.array([2.5]),
    }[kind]


KINDS = ["normal", "hot", "tiny", "close", "signs", "constant", "one"]


@pytest.mark.parametrize("kind", KINDS)
def test_large_quantiles_are_exact(spark, large_paths, kind):
    data = values(kind)
    df = spark.createDataFrame(pd.DataFrame({"v": data}))
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    row = exact_quantiles(df, {f"q{i}": ("v", p) for i, p in enumerate(probs)}).first()
    assert list(row) == pytest.approx(list(np.quantile(data, probs)), rel=1e-12, abs=1e-15)


def test_large_quantiles_by_group_with_nulls(spark, large_paths):
    frame = pd.DataFrame(
        {"g": ["a"] * 300 + ["b"] * 100 + ["c"], "v": np.r_[values("tiny"), values("normal")[:100], 1.0]}
    )
    frame.loc[frame.index[::7], "v"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "g string, v double")
    df = df.unionByName(spark.createDataFrame([("empty", None)], "g string, v double"))
    found = {r.g: r.q for r in exact_quantiles(df, {"q": ("v", 0.3)}, ["g"]).collect()}
    expected = frame.groupby("g")["v"].quantile(0.3)
    assert found.pop("empty") is None
    for g, q in found.items():
        assert q == pytest.approx(expected[g])


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("kind", KINDS)
def test_percentile_rank(spark, kind, large, request):
    if large:
        request.getfixturevalue("large_paths")
    data = pd.DataFrame({"i": range(len(values(kind))), "v": values(kind)})
    df = spark.createDataFrame(data)
    got = outliers.percentile_rank(df, "v").toPandas().set_index("i")["percentile_rank"].sort_index()
    expected = data["v"].rank(pct=True) * 100
    assert got.to_numpy() == pytest.approx(expected.to_numpy())


def test_nan_from_outside_becomes_null(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "v double, i int")
    rows = nan_to_null(df).orderBy("i").collect()
    assert [r.v for r in rows] == [1.0, None, None]
    flags = outliers.zscore_analysis(nan_to_null(df), "v").collect()
    assert not any(r.zscore_outlier for r in flags)


def test_zscore_constant_group_has_no_score(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    rows = outliers.zscore_analysis(df, "v", 0.9, ["g"]).orderBy("g", "v").collect()
    assert [r.zscore for r in rows] == [None, None, -1.0, 1.0]
    assert [r.zscore_direction for r in rows] == ["normal", "normal", "low", "high"]
    assert [r.zscore_outlier for r in rows] == [False, False, True, True]


@pytest.mark.parametrize("large", [False, True])
def test_planted_outliers(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    rng = np.random.default_rng(1618)
    parts = [("A", 60.0, [-40.0, -25.0, 160.0, 175.0, 190.0]), ("B", 900.0, [10.0, 2100.0, 2250.0, 2400.0, 2600.0])]
    frame = pd.concat(
        pd.DataFrame({"state": s, "value": np.r_[m * (1 + rng.uniform(-0.2, 0.2, 70)), planted]})
        for s, m, planted in parts
    ).reset_index(drop=True)
    df = spark.createDataFrame(frame)
    got = outliers.iqr_analysis(df, "value", group_cols=["state"]).toPandas()
    for state, rows in frame.groupby("state"):
        q1, q3 = rows["value"].quantile([0.25, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        expected = int(((rows["value"] < low) | (rows["value"] > high)).sum())
        assert expected >= 5
        assert int(got[got["state"] == state]["iqr_outlier"].sum()) == expected
    both = outliers.statistical_outliers(df, ["value", "missing"]).toPandas()
    assert (both["any_outlier"] == (both["outlier_count"] > 0)).all()


def test_distribution_stats_match_pandas(spark):
    data = pd.Series(values("normal"))
    row = outliers.distribution_stats(spark.createDataFrame(pd.DataFrame({"v": data})), "v").first()
    assert row["count"] == 500
    assert row.skewness == pytest.approx(data.skew())
    assert row.kurtosis == pytest.approx(data.kurtosis())
    assert row["median"] == pytest.approx(data.median())
    assert row.iqr == pytest.approx(data.quantile(0.75) - data.quantile(0.25))
    assert row.is_normal


def test_distribution_stats_short_and_constant(spark):
    short = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    row = outliers.distribution_stats(short, "v").first()
    assert row.skewness is None and row.kurtosis is None and row.normality_pvalue is None
    constant = spark.createDataFrame([(1.0,)] * 9, "v double")
    plain = outliers.distribution_stats(constant, "v", "jarque_bera").first()
    assert plain.skewness == 0 and plain.normality_pvalue is None
    row = outliers.distribution_stats(constant, "v").first()
    assert row.skewness == 0 and row.normality_pvalue is None


# Samples whose statistic and p-value are published with statistics packages.
UNEVEN = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75,
          0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]
EVEN = [1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10,
        0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49]
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


@pytest.mark.parametrize(
    ("data", "w", "p"),
    [(UNEVEN, 0.900473, 0.042090), (EVEN, 0.959027, 0.524598), (WEIGHTS, 0.78881, 0.006704)],
)
def test_shapiro_wilk_known_cases(spark, data, w, p):
    df = spark.createDataFrame([(float(v),) for v in data] + [(None,), (float("nan"),)], "v double")
    row = outliers.shapiro_wilk(df, "v").first()
    assert row.n_tested == len(data)
    assert row.w_statistic == pytest.approx(w, abs=2e-5)
    assert row.normality_pvalue == pytest.approx(p, abs=2e-5)


def test_shapiro_wilk_samples_and_limits(spark):
    rng = np.random.default_rng(8)
    normal = spark.createDataFrame(pd.DataFrame({"v": rng.normal(1e6, 1, 30_000)}))
    row = outliers.shapiro_wilk(normal, "v").first()
    assert row.n_tested == 5000 and row.normality_pvalue > 0.01
    skewed = normal.select(F.pow(F.col("v") - 1e6 + 6, 3).alias("v"))
    row = outliers.distribution_stats(skewed, "v").first()
    assert row.n_tested == 5000 and row.normality_pvalue < 1e-6 and not row.is_normal
    assert outliers.shapiro_wilk(normal.repartition(3), "v").first() == outliers.shapiro_wilk(normal, "v").first()
    for bad in (normal.limit(0), normal.limit(7), normal.select(F.lit(2.0).alias("v")).limit(9)):
        row = outliers.shapiro_wilk(bad, "v").first()
        assert row.w_statistic is None and row.normality_pvalue is None
    with pytest.raises(ValueError):
        outliers.shapiro_wilk(normal, "v", max_rows=6000)


def test_normal_quantile_and_tail(spark):
    rows = [(p,) for p in (0.0, 1e-12, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-9, 1.0, -0.1, 1.1)]
    got = spark.createDataFrame(rows, "p double").select(normal_quantile(F.col("p"))).collect()
    for (p,), (q,) in zip(rows, got):
        if not 0 < p < 1:
            assert q == {0.0: float("-inf"), 1.0: float("inf")}.get(p)
        else:
            assert q == pytest.approx(NormalDist().inv_cdf(p), rel=1e-8, abs=1e-9)
    zs = [(z,) for z in (-9.0, -7.2, -2.0, 0.0, 0.4, 3.0, 7.0, 7.5, 12.0)]
    got = spark.createDataFrame(zs, "z double").select(normal_upper_tail(F.col("z"))).collect()
    for (z,), (p,) in zip(zs, got):
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-7)


def record_frame(n=700):
    """Records in two groups; one day holds over a third of them, with gaps."""
    rng = np.random.default_rng(3)
    hot = rng.random(n) < 0.4
    offsets = np.where(hot, 5, rng.integers(0, 400, n))
    return pd.DataFrame(
        {
            "date": [dt.date(2024, 1, 1) + dt.timedelta(days=int(o)) for o in offsets],
            "state": np.where(rng.random(n) < 0.7, "big", "small"),
            "event_id": rng.permutation(n) * 37 - 900,
            "total_enrolments": np.where(rng.random(n) < 0.3, np.nan, rng.integers(1, 50, n)),
        }
    )


@pytest.mark.parametrize("group", [None, ["state"]])
@pytest.mark.parametrize("order", [["date", "event_id"], ["event_id"]])
def test_split_windows_equal_plain_windows(spark, group, order):
    frame = record_frame()
    df = spark.createDataFrame(frame).withColumn(
        "total_enrolments", F.when(~F.isnan("total_enrolments"), F.col("total_enrolments"))
    )

    def run(split):
        shared = dict(group_cols=group, order_cols=order, split=split)
        out = temporal.growth_rate(df, periods=3, **shared)
        out = temporal.volatility(out, window=5, **shared)
        out = temporal.trends(out, window=4, **shared)
        return out.toPandas().set_index("event_id").sort_index()

    pd.testing.assert_frame_equal(run(True), run(False), check_like=True)


def test_split_windows_of_a_daily_series(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(150)]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, total_enrolments int")
    split, plain = (
        temporal.rolling_mean(df, split=s).orderBy("date").collect() for s in (True, False)
    )
    assert split == plain


def test_series_features_equal_their_parts(spark):
    frame = record_frame()
    df = spark.createDataFrame(frame).withColumn(
        "total_enrolments", F.when(~F.isnan("total_enrolments"), F.col("total_enrolments"))
    )
    shared = dict(group_cols=["state"], order_cols=["date", "event_id"])
    parts = temporal.growth_rate(df, split=False, **shared)
    parts = temporal.volatility(parts, split=False, **shared)
    parts = temporal.trends(parts, split=False, **shared)
    want = parts.toPandas().set_index("event_id").sort_index()
    for split in (True, False):
        got = temporal.series_features(df, split=split, **shared)
        got = got.toPandas().set_index("event_id").sort_index()
        pd.testing.assert_frame_equal(got, want, check_like=True)


@pytest.fixture
def eight_chunks(spark):
    """Chunks as on a large table, where adaptive execution does not merge them."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {n: spark.conf.get(n) for n in names}
    for name, value in zip(names, ("8", "false")):
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("group", [[], ["state"], ["event_id"]])
def test_chunks_are_even_and_halos_few(spark, eight_chunks, group):
    """Whatever the groups are: one hot group, two, or one for each row."""
    df = spark.createDataFrame(record_frame(4000))
    order, lookback = ["date", "event_id"], 5
    chunked = row_windows.with_chunks(df, group, order)
    sizes = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 2 * 4000 / len(sizes)
    padded = row_windows.with_halo(chunked, group, order, lookback)
    assert padded.where("_halo").count() <= lookback * (len(sizes) - 1)
    plan = padded._jdf.queryExecution().executedPlan().toString()
    # Without groups one task orders the chunks, of which it sees one row each.
    assert plan.count("SinglePartition") <= (0 if group else 2)


def test_rows_that_an_explode_multiplies_are_not_small(spark):
    few = spark.range(10).withColumn("v", F.lit(1.5))
    assert scale.is_small(few)
    assert not scale.is_small(few.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10**7)))))


def test_well_compressed_rows_are_not_small(spark, tmp_path, monkeypatch):
    spark.range(1000).select(F.lit(1.5).alias("v")).write.parquet(str(tmp_path / "same"))
    df = spark.read.parquet(str(tmp_path / "same"))
    assert scale.is_small(df)
    monkeypatch.setattr(scale, "SMALL_INPUT_ROWS", 999)
    assert not scale.is_small(df)
    assert not scale.is_small(df.where("v > 1").groupBy("v").count())


def test_ranks_of_close_values_and_one_far_away(spark, large_paths, eight_chunks):
    """Many values within a thousandth, and one that is not: no task gets them all."""
    rng = np.random.default_rng(8)
    values = np.append(1e6 + rng.random(20_000) / 1000, 1e6 + 200)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    row = ranks.exact_quantiles(df, {"mid": ("v", 0.5), "high": ("v", 0.95)}).first()
    assert row.mid == np.quantile(values, 0.5)
    assert row.high == pytest.approx(np.quantile(values, 0.95), rel=1e-15)
    found = ranks.average_ranks(df, "v").toPandas()
    want = dict(zip(values, pd.Series(values).rank()))
    assert dict(zip(found["_value"], found["_rank"])) == want
    counts = df.groupBy(F.col("v").alias("_v")).agg(F.count("*").alias("_n"))
    chunked, sums = ranks._placed(counts, [], "_v")
    sizes = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    assert max(sizes) < 2 * len(values) / len(sizes) and len(sizes) == sums.count() > 2


@pytest.mark.parametrize("large", [False, True])
def test_quantiles_of_rows_without_a_group(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0)], "g string, v double")
    rows = ranks.exact_quantiles(df, {"mid": ("v", 0.5)}, ["g"]).collect()
    assert {(r.g, r.mid) for r in rows} == {("a", 1.0), (None, 3.0)}


@pytest.mark.parametrize("large", [False, True])
def test_nan_is_missing_in_quantiles_and_ranks(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    rows = [(float(v),) for v in range(-5, 6)] + [(float("nan"),)] * 5 + [(None,)]
    df = spark.createDataFrame(rows, "v double")
    row = ranks.exact_quantiles(df, {"mid": ("v", 0.5), "high": ("v", 0.95)}).first()
    assert (row.mid, row.high) == (0.0, 4.5)
    found = {r._value: r._rank for r in ranks.average_ranks(df, "v").collect()}
    assert found == {float(v): v + 6 for v in range(-5, 6)}
