"""Risk scores, outliers, forest and forecasts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.core import Query
from catalog.forest_sql import importance_sql, nodes_sql, scores_sql
from catalog.normality_sql import shapiro_sql
from catalog.tables import ALL_WEIGHTS, PIPELINE_WEIGHTS, Tables, risk_sql
from tallywatch.functions.ranks import exact_quantiles
from tallywatch.functions.scale import written
from tallywatch.operators import forecast, iforest, outliers, risk, temporal
from tallywatch.plans.pipeline import score_states, state_risk
from tallywatch.schema import PIPELINE_FEATURES

_RISK = "date state risk_score:d risk_level risk_tier:i"


def _full_risk(t: Tables) -> DataFrame:
    return score_states(temporal.seasonal_indicator(t.features))


EXPLAIN_SQL = """
    SELECT *, coalesce(nullif(concat_ws('; ',
        CASE WHEN volatility_cv > 0.5
             THEN 'High volatility (CV: ' || printf('%.2f', volatility_cv) || ')' END,
        CASE WHEN demographic_imbalance > 0.15 THEN 'Demographic imbalance detected ('
             || printf('%.2f', demographic_imbalance) || ')' END,
        CASE WHEN abs(growth_rate) > 0.5
             THEN 'Unusual enrolment ' || CASE WHEN growth_rate > 0 THEN 'surge' ELSE 'drop' END
                  || ' (' || printf('%.1f', growth_rate * 100) || '%)' END), ''),
        'No significant risk factors identified') AS risk_explanation
    FROM """
DISTRICT_MEANS = """
    (SELECT state, district, sum(total_enrolments) AS total_enrolments,
            avg(volatility_cv) AS volatility_cv, avg(growth_rate) AS growth_rate,
            avg(demographic_imbalance) AS demographic_imbalance
     FROM scored_districts GROUP BY state, district)"""
_DISTRICT_RISK = risk_sql(DISTRICT_MEANS, PIPELINE_WEIGHTS)

RISK = [
    Query(
        "state_risk",
        f"{_RISK} total_enrolments:l growth_rate:d volatility_cv:d trend_direction "
        "demographic_imbalance:d",
        lambda t: state_risk(t.enrol_events),
        "SELECT * FROM risky",
    ),
    Query(
        "state_risk_orders",
        "date state risk_score:d risk_level",
        lambda t: state_risk(t.enrol_orders),
        risk_sql("order_features", PIPELINE_WEIGHTS),
    ),
    Query(
        "normalize_minmax",
        "date state normalized:d",
        lambda t: risk.normalize_feature(t.event_sums, "total_enrolments"),
        "SELECT date, state, (total_enrolments - min(total_enrolments) OVER ()) / "
        "nullif(max(total_enrolments) OVER () - min(total_enrolments) OVER (), 0)::DOUBLE "
        "AS normalized FROM event_states",
    ),
    Query(
        "normalize_zscore",
        "date state normalized:d",
        lambda t: risk.normalize_feature(t.event_sums, "total_enrolments", "zscore"),
        "SELECT date, state, (total_enrolments - avg(total_enrolments) OVER ()) / "
        "stddev_samp(total_enrolments) OVER () AS normalized FROM event_states",
    ),
    Query(
        "risk_score_four_features",
        _RISK,
        _full_risk,
        risk_sql("four_features", ALL_WEIGHTS),
    ),
    Query(
        "risk_score_custom_weights",
        "date state risk_score:d",
        lambda t: risk.risk_score(
            t.features,
            {"growth_rate": 0.6, "volatility_cv": 0.4},
            ["growth_rate", "volatility_cv", "not_there"],
        ),
        risk_sql("features", {"growth_rate": 0.6, "volatility_cv": 0.4}),
    ),
    Query(
        "classify_risk_custom_thresholds",
        "date state risk_level risk_tier:i",
        lambda t: risk.classify_risk(
            t.scored, thresholds={"low": 0.1, "medium": 0.2, "high": 0.4}
        ),
        """
        SELECT date, state,
               CASE WHEN risk_score <= 0.1 THEN 'Low' WHEN risk_score <= 0.2 THEN 'Medium'
                    WHEN risk_score <= 0.4 THEN 'High' WHEN risk_score > 0.4 THEN 'Critical'
                    ELSE 'Unknown' END AS risk_level,
               CASE WHEN risk_score <= 0.1 THEN 1 WHEN risk_score <= 0.2 THEN 2
                    WHEN risk_score <= 0.4 THEN 3 WHEN risk_score > 0.4 THEN 4
                    ELSE 0 END AS risk_tier
        FROM scored""",
    ),
    Query(
        "explain_risk",
        "date state risk_explanation",
        lambda t: risk.explain_risk(t.features),
        EXPLAIN_SQL + "features",
    ),
    Query(
        "high_risk_districts",
        "district risk_score:d total_enrolments:l",
        lambda t: risk.high_risk_regions(t.scored_districts, top_n=5),
        "SELECT district, avg(risk_score) AS risk_score, sum(total_enrolments) AS total_enrolments "
        "FROM scored_districts GROUP BY district ORDER BY 2 DESC, 1 LIMIT 5",
    ),
    Query(
        "high_risk_states",
        "state risk_score:d total_enrolments:l",
        lambda t: risk.high_risk_regions(t.scored, top_n=3, group_col="state"),
        "SELECT state, avg(risk_score) AS risk_score, sum(total_enrolments) AS total_enrolments "
        "FROM scored GROUP BY state ORDER BY 2 DESC, 1 LIMIT 3",
    ),
    Query(
        "district_risk_score",
        "state district total_enrolments:l volatility_cv:d growth_rate:d demographic_imbalance:d "
        "risk_score:d risk_level risk_tier:i risk_explanation",
        lambda t: risk.district_risk_score(t.scored_districts),
        EXPLAIN_SQL + f"({_DISTRICT_RISK}) AS r",
    ),
]


def _z_sql(value: str, source: str, group: str = "", threshold: float = 3, prefix: str = "") -> str:
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    z = f"(({value} - avg({value}) {over}) / nullif(stddev_pop({value}) {over}, 0))"
    return f"""
    SELECT *, coalesce(abs({prefix}zscore) > {threshold}, false) AS {prefix}zscore_outlier,
           CASE WHEN {prefix}zscore > {threshold} THEN 'high'
                WHEN {prefix}zscore < -{threshold} THEN 'low' ELSE 'normal' END
             AS {prefix}zscore_direction
    FROM (SELECT *, {z} AS {prefix}zscore FROM {source}) AS z"""


def _iqr_sql(value: str, source: str, group: str = "", factor: float = 1.5, prefix: str = "") -> str:
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    return f"""
    SELECT *, coalesce({value} < {prefix}iqr_lower OR {value} > {prefix}iqr_upper, false)
                AS {prefix}iqr_outlier,
           CASE WHEN {value} > {prefix}iqr_upper THEN 'high'
                WHEN {value} < {prefix}iqr_lower THEN 'low' ELSE 'normal' END
             AS {prefix}iqr_direction
    FROM (SELECT *, q1 - {factor} * (q3 - q1) AS {prefix}iqr_lower,
                 q3 + {factor} * (q3 - q1) AS {prefix}iqr_upper
          FROM (SELECT * EXCLUDE (q1, q3), q1, q3 FROM
                (SELECT *, quantile_cont({value}::DOUBLE, 0.25) {over} AS q1,
                        quantile_cont({value}::DOUBLE, 0.75) {over} AS q3 FROM {source}) AS a) AS b
         ) AS q"""


_Z = "zscore:d zscore_outlier zscore_direction"
_I = "iqr_lower:d iqr_upper:d iqr_outlier iqr_direction"
_TOTALLED = "(SELECT *, age_0_5 + age_5_17 + age_18_greater AS total FROM enrol_events) AS e"


def _with_total(t: Tables) -> DataFrame:
    total = F.col("age_0_5") + F.col("age_5_17") + F.col("age_18_greater")
    return t.enrol_events.withColumn("total", total)


def _prefixed(columns: str, prefix: str) -> str:
    return " ".join(prefix + c for c in columns.split())


def _both_sql() -> str:
    sql = "orders"
    for col in ("o_totalprice", "o_custkey"):
        sql = f"({_z_sql(col, sql, prefix=col + '_')}) AS a_{col}"
        sql = f"({_iqr_sql(col, sql, prefix=col + '_')}) AS b_{col}"
        sql = sql.replace("SELECT *, q1 -", "SELECT * EXCLUDE (q1, q3), q1 -")
    flags = [f"{c}_{m}_outlier" for c in ("o_totalprice", "o_custkey") for m in ("zscore", "iqr")]
    total = " + ".join(f"{f}::INT" for f in flags)
    return f"SELECT *, {total} AS outlier_count, ({total}) > 0 AS any_outlier FROM {sql}"


def _rank_sql(value: str, source: str, group: str = "") -> str:
    part = f"PARTITION BY {group}" if group else ""
    both = f"PARTITION BY {group + ', ' if group else ''}{value}"
    return f"""
    SELECT *, CASE WHEN {value} IS NOT NULL THEN
           (rank() OVER ({part} ORDER BY {value} NULLS LAST) + (count(*) OVER ({both}) - 1) / 2.0)
           / count({value}) OVER ({part}) * 100 END AS percentile_rank FROM {source}"""


OUTLIERS = [
    Query(
        "zscore_global",
        f"event_id:l total:l {_Z}",
        lambda t: outliers.zscore_analysis(_with_total(t), "total", threshold=1.5),
        _z_sql("total", _TOTALLED, threshold=1.5),
    ),
    Query(
        "zscore_by_state",
        f"event_id:l state total:l {_Z}",
        lambda t: outliers.zscore_analysis(_with_total(t), "total", 1.5, ["state"]),
        _z_sql("total", _TOTALLED, "state", 1.5),
    ),
    Query(
        "iqr_global",
        f"o_orderkey:l o_totalprice:d {_I}",
        lambda t: outliers.iqr_analysis(t.read("orders"), "o_totalprice", 0.5),
        _iqr_sql("o_totalprice", "orders", factor=0.5),
    ),
    Query(
        "iqr_by_state",
        f"event_id:l state total:l {_I}",
        lambda t: outliers.iqr_analysis(_with_total(t), "total", 0.5, ["state"]),
        _iqr_sql("total", _TOTALLED, "state", 0.5),
    ),
    Query(
        "statistical_outliers",
        "o_orderkey:l "
        + " ".join(_prefixed(f"{_Z} {_I}", c + "_") for c in ("o_totalprice", "o_custkey"))
        + " outlier_count:i any_outlier",
        lambda t: outliers.statistical_outliers(
            t.read("orders"), ["o_totalprice", "o_custkey", "not_there"]
        ),
        _both_sql(),
    ),
    Query(
        "percentile_rank",
        "event_id:l total:l percentile_rank:d",
        lambda t: outliers.percentile_rank(_with_total(t), "total"),
        _rank_sql("total", _TOTALLED),
    ),
    Query(
        "percentile_rank_by_state",
        "event_id:l state age_5_17:l percentile_rank:d",
        lambda t: outliers.percentile_rank(
            t.enrol_events.withColumn(
                "age_5_17", F.when(F.col("age_5_17") > 2, F.col("age_5_17"))
            ),
            "age_5_17",
            ["state"],
        ),
        _rank_sql(
            "age_5_17",
            "(SELECT * REPLACE (CASE WHEN age_5_17 > 2 THEN age_5_17 END AS age_5_17) "
            "FROM enrol_events) AS e",
            "state",
        ),
    ),
    Query(
        "distribution_stats",
        "count:l mean:d std:d min:d max:d median:d q1:d q3:d iqr:d skewness:d kurtosis:d "
        "normality_pvalue:d is_normal",
        lambda t: outliers.distribution_stats(_with_total(t), "total", "jarque_bera"),
        f"""
        SELECT *, q3 - q1 AS iqr, exp(-n / 6 * (g1 * g1 + g2 * g2 / 4) / 2) AS normality_pvalue,
               exp(-n / 6 * (g1 * g1 + g2 * g2 / 4) / 2) > 0.05 AS is_normal
        FROM (SELECT count(total) AS count, count(total)::DOUBLE AS n, avg(total) AS mean,
                     stddev_samp(total) AS std, min(total) AS min, max(total) AS max,
                     median(total) AS median, quantile_cont(total::DOUBLE, 0.25) AS q1,
                     quantile_cont(total::DOUBLE, 0.75) AS q3, skewness(total) AS skewness,
                     kurtosis(total) AS kurtosis, kurtosis_pop(total) AS g2,
                     skewness(total) * (count(total) - 2)
                       / sqrt(count(total)::DOUBLE * (count(total) - 1)) AS g1
              FROM {_TOTALLED}) AS s""",
    ),
    Query(
        "quantiles_with_nan",
        "state q1:d q2:d q3:d",
        lambda t: exact_quantiles(
            _with_total(t).withColumn(
                "total",
                F.when(F.col("event_id") % 7 == 0, float("nan")).when(
                    F.col("event_id") % 5 > 0, F.col("total").cast("double")
                ),
            ),
            {f"q{i}": ("total", i / 4) for i in (1, 2, 3)},
            ["state"],
        ),
        f"""
        SELECT state, quantile_cont(total, 0.25) AS q1, median(total) AS q2,
               quantile_cont(total, 0.75) AS q3
        FROM (SELECT state, CASE WHEN event_id % 7 > 0 AND event_id % 5 > 0 THEN total::DOUBLE END
                AS total FROM {_TOTALLED}) AS g GROUP BY state""",
    ),
    Query(
        "shapiro_wilk",
        "n_tested:l w_statistic:d normality_pvalue:d",
        lambda t: outliers.shapiro_wilk(_with_total(t), "total"),
        shapiro_sql("total", _TOTALLED),
    ),
    Query(
        "distribution_stats_shapiro",
        "count:l mean:d std:d median:d n_tested:l w_statistic:d normality_pvalue:d is_normal",
        lambda t: outliers.distribution_stats(t.event_sums, "total_enrolments"),
        f"""
        SELECT s.*, t.*, normality_pvalue > 0.05 AS is_normal
        FROM (SELECT count(total_enrolments) AS count, avg(total_enrolments) AS mean,
                     stddev_samp(total_enrolments) AS std, median(total_enrolments) AS median
              FROM event_states) AS s,
             ({shapiro_sql("total_enrolments", "event_states")}) AS t""",
    ),
]


def _daily_features(t: Tables) -> DataFrame:
    return written(t.features, "state-features")


def _detector(t: Tables) -> tuple[iforest.IsolationForestModel, DataFrame]:
    df = _daily_features(t)
    return iforest.IsolationForest().fit(df, PIPELINE_FEATURES), df


def _scaled_features(t: Tables) -> DataFrame:
    df = t.features
    scaling = iforest.fit_scaling(df, PIPELINE_FEATURES)
    return df.select("date", "state", *scaling.columns())


def _scale_sql(cols) -> str:
    stats = ", ".join(f"median({c}) AS m_{c}" for c in cols)
    moments = ", ".join(
        f"avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}" for c in cols
    )
    out = ", ".join(f"(coalesce({c}, m_{c}) - a_{c}) / s_{c} AS scaled_{c}" for c in cols)
    medians = f"(SELECT {stats} FROM features) AS m"
    return (
        f"SELECT date, state, {out} FROM features, {medians}, "
        f"(SELECT {moments} FROM features, {medians}) AS a"
    )


# Two small trees with given cuts, so that SQL can walk them. The share of the
# rows in each leaf is what its size says; only the walk is under test.
_PLANTED_NODES = [
    # tree, node, feature, threshold, left, right, size, depth
    (0, 0, 0, 0.5, 1, 2, 256, 0),
    (0, 1, -1, 0.0, -1, -1, 200, 1),
    (0, 2, 1, 0.25, 3, 4, 56, 1),
    (0, 3, -1, 0.0, -1, -1, 40, 2),
    (0, 4, -1, 0.0, -1, -1, 16, 2),
    (1, 0, 1, -0.75, 1, 2, 256, 0),
    (1, 1, -1, 0.0, -1, -1, 2, 1),
    (1, 2, -1, 0.0, -1, -1, 254, 1),
]


def _gappy_totals(t: Tables) -> DataFrame:
    total = F.when(F.col("event_id") % 5 != 0, F.col("total"))
    return _with_total(t).withColumn("total", total)


def _planted_forest() -> iforest.IsolationForestModel:
    scaling = iforest.Scaling(("total", "age_0_5"), (0.0, 0.0), (20.0, 3.0), (10.0, 2.0))
    names = [f.split()[0] for f in iforest.NODE_SCHEMA.split(", ")]
    nodes = pd.DataFrame(_PLANTED_NODES, columns=names)
    return iforest.IsolationForestModel(scaling, nodes, 256, 0.5, (0.0, 1.0))


def _path(depth: int, size: int) -> str:
    """Depth of a leaf and the mean depth of a search among its points."""
    if size == 2:
        return f"({depth} + 1.0)"
    return f"({depth} + 2 * (ln({size - 1}.0) + 0.5772156649015329) - 2 * {size - 1} / {size}::DOUBLE)"


_PLANTED_SQL = f"""
    SELECT event_id, f0, f1, score > 0.5 AS is_anomaly, score - 0.5 AS anomaly_score,
           (score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0)
             AS anomaly_score_normalized
    FROM (
      SELECT event_id, f0, f1, pow(2.0, -(
               CASE WHEN f0 <= 0.5 THEN {_path(1, 200)} WHEN f1 <= 0.25 THEN {_path(2, 40)}
                    ELSE {_path(2, 16)} END
               + CASE WHEN f1 <= -0.75 THEN {_path(1, 2)} ELSE {_path(1, 254)} END
             ) / 2 / {_path(0, 256)}) AS score
      FROM (SELECT event_id, (coalesce(total, middle) - 20) / 10::DOUBLE AS f0,
                   (age_0_5 - 3) / 2::DOUBLE AS f1
            FROM (SELECT event_id, age_0_5, CASE WHEN event_id % 5 <> 0 THEN total END AS total
                  FROM {_TOTALLED}) AS g,
                 (SELECT median(total) AS middle FROM {_TOTALLED} WHERE event_id % 5 <> 0) AS m) AS f
    ) AS s"""


_PLANTED_VISITS = f"""
    SELECT tree, node, count(*) AS visits
    FROM (SELECT unnest([0, 0, 0, 1, 1]) AS tree,
                 unnest([0, CASE WHEN f0 <= 0.5 THEN 1 ELSE 2 END,
                         CASE WHEN f0 <= 0.5 THEN NULL WHEN f1 <= 0.25 THEN 3 ELSE 4 END,
                         0, CASE WHEN f1 <= -0.75 THEN 1 ELSE 2 END]) AS node
          FROM ({_PLANTED_SQL}) AS p WHERE is_anomaly) AS passed
    WHERE node IS NOT NULL GROUP BY tree, node"""
_PLANTED_IMPORTANCE = f"""
    SELECT feature, weight / sum(weight) OVER () AS importance
    FROM (SELECT unnest(['total', 'age_0_5']) AS feature,
                 unnest([sum(log2(256 / CASE WHEN f0 <= 0.5 THEN 200 ELSE 56 END::DOUBLE)),
                         sum(coalesce(log2(56 / CASE WHEN f0 <= 0.5 THEN NULL WHEN f1 <= 0.25 THEN 40
                                                ELSE 16 END::DOUBLE), 0) / 2
                             + log2(256 / CASE WHEN f1 <= -0.75 THEN 2 ELSE 254 END::DOUBLE))]) AS weight
          FROM ({_PLANTED_SQL}) AS p WHERE is_anomaly) AS w"""


def _tree_shapes(t: Tables) -> DataFrame:
    """Per fitted tree: rows at the root and in the leaves, and whether its form is sound."""
    is_leaf = F.col("feature") == iforest.LEAF
    return (
        _detector(t)[0]
        .tree_table(t.spark)
        .groupBy("tree")
        .agg(
            F.max(F.when(F.col("node") == 0, F.col("size"))).alias("root_size"),
            F.sum(F.when(is_leaf, F.col("size"))).alias("leaf_size"),
            (F.count("*") == 2 * F.count_if(is_leaf) - 1).alias("is_binary"),
            (F.max("depth") <= 8).alias("is_bounded"),
            F.count_if((F.col("size") > 1) & is_leaf & (F.col("depth") < 7)).alias("n_early"),
        )
    )


FOREST = [
    Query(
        "forest_planted_scores",
        "event_id:l is_anomaly anomaly_score:d anomaly_score_normalized:d",
        lambda t: _planted_forest().transform(_gappy_totals(t)),
        _PLANTED_SQL,
    ),
    Query(
        "forest_tree_shapes",
        "tree:l root_size:l leaf_size:l is_binary is_bounded n_early:l",
        _tree_shapes,
        """
        SELECT unnest(range(100)) AS tree, n AS root_size, n AS leaf_size, true AS is_binary,
               true AS is_bounded, 0 AS n_early
        FROM (SELECT least(256, count(*)) AS n FROM features) AS f""",
    ),
    Query(
        "forest_flagged_share",
        "flagged:l rows:l lowest_above:b",
        lambda t: iforest.detect_anomalies(_daily_features(t), PIPELINE_FEATURES, 0.1).agg(
            F.count_if("is_anomaly").alias("flagged"),
            F.count("*").alias("rows"),
            (
                F.min(F.when(F.col("is_anomaly"), F.col("anomaly_score")))
                > F.max(F.when(~F.col("is_anomaly"), F.col("anomaly_score")))
            ).alias("lowest_above"),
        ),
        "SELECT count(*) - 1 - floor((count(*) - 1) * 0.9) AS flagged, count(*) AS rows, "
        "true AS lowest_above FROM features",
    ),
    Query(
        "forest_importance_total",
        "total:d n_out_of_range:l",
        lambda t: iforest.feature_importance(_detector(t)[0], t.spark).agg(
            F.sum("importance").alias("total"),
            F.count_if(~F.col("importance").between(0, 1)).alias("n_out_of_range"),
        ),
        "SELECT CASE WHEN count(*) > 1 THEN 1.0 END AS total, 0 AS n_out_of_range FROM features",
    ),
    Query(
        "forest_feature_scaling",
        "date state " + " ".join(f"scaled_{c}:d" for c in PIPELINE_FEATURES),
        _scaled_features,
        _scale_sql(PIPELINE_FEATURES),
    ),
    Query(
        "forest_fit_trees",
        "tree:i node:i feature:i threshold:d left:i right:i size:i depth:i",
        lambda t: _detector(t)[0].tree_table(t.spark),
        nodes_sql("features", PIPELINE_FEATURES),
    ),
    Query(
        "forest_predict",
        "date state is_anomaly anomaly_score:d anomaly_score_normalized:d",
        lambda t: (lambda model, df: model.transform(df))(*_detector(t)),
        scores_sql("features", PIPELINE_FEATURES, 0.05),
    ),
    Query(
        "detect_anomalies",
        "date state total_enrolments:l is_anomaly anomaly_score:d anomaly_score_normalized:d",
        lambda t: iforest.detect_anomalies(_daily_features(t), PIPELINE_FEATURES, 0.1),
        scores_sql("features", PIPELINE_FEATURES, 0.1),
    ),
    Query(
        "detect_anomalies_too_few_features",
        "date state is_anomaly anomaly_score:d",
        lambda t: iforest.detect_anomalies(
            t.event_sums.select("date", "state", "total_enrolments")
        ),
        "SELECT date, state, false AS is_anomaly, 0.0 AS anomaly_score FROM event_states",
    ),
    Query(
        "detect_record_anomalies",
        "event_id:l is_anomaly anomaly_score:d",
        lambda t: iforest.detect_anomalies(
            _with_total(t), ["total", "age_0_5", "age_5_17", "age_18_greater"]
        ),
        scores_sql(_TOTALLED, ["total", "age_0_5", "age_5_17", "age_18_greater"], 0.05),
    ),
    Query(
        "forest_record_trees",
        "tree:i node:i feature:i threshold:d left:i right:i size:i depth:i",
        lambda t: iforest.IsolationForest()
        .fit(_with_total(t), ["total", "age_0_5", "age_18_greater"])
        .tree_table(t.spark),
        nodes_sql(_TOTALLED, ["total", "age_0_5", "age_18_greater"]),
    ),
    Query(
        "forest_feature_importance",
        "feature importance:d",
        lambda t: iforest.feature_importance(_detector(t)[0], t.spark),
        importance_sql("features", PIPELINE_FEATURES),
    ),
    Query(
        "forest_anomaly_importance",
        "feature importance:d",
        lambda t: iforest.anomaly_importance(_planted_forest(), _gappy_totals(t)),
        _PLANTED_IMPORTANCE,
    ),
    Query(
        "forest_anomaly_visits",
        "tree:i node:i visits:l",
        lambda t: iforest.anomaly_visits(_planted_forest(), _gappy_totals(t)),
        _PLANTED_VISITS,
    ),
]

_FORECAST = (
    "date predicted:d lower_bound:d upper_bound:d trend:d seasonal_factor:d volatility_ratio:d "
    "high_uncertainty trend_change:d anomaly_risk"
)


def _forecast_sql(key: str, source: str, periods: int) -> str:
    """Trend times weekday factor with bounds, per key."""
    weekdays = ", ".join(
        f"avg(value) FILTER (isodow(date) = {d + 1}) / nullif(avg(value), 0) AS w{d}" for d in range(7)
    )
    factor = " ".join(f"WHEN {d} THEN w{d}" for d in range(7))
    return f"""
    SELECT *, coalesce(volatility_ratio > 0.3, false) AS high_uncertainty,
           coalesce(trend_change > 0.2, false) OR coalesce(volatility_ratio > 0.3, false)
             AS anomaly_risk
    FROM (
      SELECT *, (upper_bound - lower_bound) / nullif(mean, 0) AS volatility_ratio,
             abs(predicted / nullif(lag(predicted) OVER (PARTITION BY key ORDER BY date), 0) - 1)
               AS trend_change
      FROM (
        SELECT *, greatest(0, trend * seasonal_factor) AS predicted,
               greatest(0, trend * seasonal_factor - 1.96 * sd * sqrt(h)) AS lower_bound,
               trend * seasonal_factor + 1.96 * sd * sqrt(h) AS upper_bound
        FROM (
          SELECT *, intercept + slope * (days - 1 + h) AS trend,
                 coalesce(CASE isodow(date) - 1 {factor} END, 1.0) AS seasonal_factor
          FROM (
            SELECT *, CAST(last_date + h::INTEGER AS DATE) AS date
            FROM (
              SELECT key, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept,
                     max(date) AS last_date, count(*) AS days, avg(value) AS mean,
                     stddev_samp(value) FILTER (recency <= 14) AS sd, sum(n) AS records, {weekdays}
              FROM (
                SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS x,
                       row_number() OVER (PARTITION BY key ORDER BY date DESC) AS recency
                FROM (SELECT {key} AS key, date, sum(total_enrolments)::DOUBLE AS value,
                             count(*) AS n
                      FROM {source} GROUP BY 1, 2) AS daily
              ) AS indexed GROUP BY key HAVING count(*) >= 2 AND sum(n) >= 7
            ) AS model, (SELECT unnest(generate_series(1, {periods})) AS h) AS horizon
          ) AS dated
        ) AS components
      ) AS bounds
    ) AS flagged"""


def _holt_sql(source: str, periods: int) -> str:
    return f"""
    SELECT state, h, CAST(last_date + h::INTEGER AS DATE) AS date, level + h * trend AS predicted,
           level, trend
    FROM (
      WITH RECURSIVE days AS (
        SELECT state, date, total_enrolments::DOUBLE AS v,
               row_number() OVER (PARTITION BY state ORDER BY date) AS r,
               lead(total_enrolments) OVER (PARTITION BY state ORDER BY date) AS next
        FROM {source}),
      holt AS (
        SELECT state, r, v AS level, coalesce(next - v, 0)::DOUBLE AS trend FROM days WHERE r = 1
        UNION ALL
        SELECT d.state, d.r, 0.3 * d.v + 0.7 * (h.level + h.trend),
               0.1 * (0.3 * d.v + 0.7 * (h.level + h.trend) - h.level) + 0.9 * h.trend
        FROM holt AS h JOIN days AS d ON d.state = h.state AND d.r = h.r + 1)
      SELECT holt.state, level, trend, last_date
      FROM holt JOIN (SELECT state, max(r) AS r, max(date) AS last_date FROM days GROUP BY state)
        AS ends USING (state, r)
    ) AS model, (SELECT unnest(generate_series(1, {periods})) AS h) AS horizon"""


def _holt(t: Tables) -> DataFrame:
    series = forecast.daily_series(t.event_sums, ["state"])
    return forecast.holt_fit(series, ["state"])


def _record_series(t: Tables) -> DataFrame:
    """Every record a step, so that a state's series is as long as its records are many."""
    series = t.enrol_events.withColumn("value", F.col("age_5_17"))
    return forecast.holt_fit(series, ["state"], order_cols=["date", "event_id"], split=True)


FORECASTS = [
    Query(
        "forecast_model",
        "state slope:d intercept:d last_date days:l mean:d spread:d",
        lambda t: forecast.fit(forecast.daily_series(t.order_sums, ["state"]), ["state"]),
        """
        SELECT state, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept,
               max(date) AS last_date, count(*) AS days, avg(v) AS mean,
               stddev_samp(v) FILTER (recency <= 14) AS spread
        FROM (SELECT state, date, total_enrolments::DOUBLE AS v,
                     row_number() OVER (PARTITION BY state ORDER BY date) - 1 AS x,
                     row_number() OVER (PARTITION BY state ORDER BY date DESC) AS recency
              FROM order_states) AS s
        GROUP BY state HAVING count(*) >= 2""",
    ),
    Query(
        "forecast_by_state",
        "state " + _FORECAST,
        lambda t: forecast.forecast_by_state(t.event_sums),
        "SELECT *, key AS state FROM (" + _forecast_sql("state", "event_states", 7) + ") AS f",
    ),
    Query(
        "forecast_total",
        _FORECAST,
        lambda t: forecast.forecast_total(t.event_sums)[1],
        _forecast_sql("1", "event_states", 14),
    ),
    Query(
        "forecast_dashboard",
        _FORECAST,
        lambda t: forecast.forecast_total(t.enrol_events, 30)[1],
        _forecast_sql("1", "event_states", 30),
    ),
    Query(
        "forecast_history",
        "date total_enrolments:d",
        lambda t: forecast.forecast_total(t.enrol_events, 30)[0],
        "SELECT date, sum(total_enrolments) AS total_enrolments FROM event_states GROUP BY date",
    ),
    Query(
        "holt_fit",
        "state level:d trend:d",
        _holt,
        "SELECT DISTINCT state, level, trend FROM (" + _holt_sql("event_states", 1) + ") AS h",
    ),
    Query(
        "holt_predict",
        "state h:i date predicted:d",
        lambda t: forecast.holt_predict(_holt(t), ["state"]),
        _holt_sql("event_states", 7),
    ),
    Query(
        "holt_record_series",
        "state level:d trend:d last_date",
        _record_series,
        """
        SELECT state, level, trend, last_date
        FROM (
          WITH RECURSIVE records AS (
            SELECT state, age_5_17::DOUBLE AS v, date,
                   row_number() OVER (PARTITION BY state ORDER BY date, event_id) AS r,
                   lead(age_5_17) OVER (PARTITION BY state ORDER BY date, event_id) AS next
            FROM enrol_events),
          holt AS (
            SELECT state, r, v AS level, coalesce(next - v, 0)::DOUBLE AS trend FROM records WHERE r = 1
            UNION ALL
            SELECT d.state, d.r, 0.3 * d.v + 0.7 * (h.level + h.trend),
                   0.1 * (0.3 * d.v + 0.7 * (h.level + h.trend) - h.level) + 0.9 * h.trend
            FROM holt AS h JOIN records AS d ON d.state = h.state AND d.r = h.r + 1)
          SELECT holt.state, level, trend, last_date
          FROM holt JOIN (SELECT state, max(r) AS r, max(date) AS last_date FROM records GROUP BY state)
            AS ends USING (state, r)
        ) AS model""",
    ),
]

QUERIES = [*RISK, *OUTLIERS, *FOREST, *FORECASTS]
