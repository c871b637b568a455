"""The given tables as enrolment records, in Spark and in SQL.

Each property of `Tables` has a CTE of the same name with the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.functions.columns import flag
from tallywatch.functions.scale import written
from tallywatch.operators import aggregate, demographic, outliers, risk, temporal
from tallywatch.plans.pipeline import score_states, state_features

AGES = ("age_0_5", "age_5_17", "age_18_greater")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def enrol_events(self) -> DataFrame:
        """Events as records: event type as state, user as pincode."""
        band = F.floor("value").cast("bigint")
        return self.read("events").select(
            "event_id",
            F.col("ts").cast("date").alias("date"),
            F.col("event_type").alias("state"),
            F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string")).alias("district"),
            F.lpad(F.col("user_id").cast("string"), 6, "0").alias("pincode"),
            (band % 7).alias("age_0_5"),
            (band % 13).alias("age_5_17"),
            (band % 29).alias("age_18_greater"),
        )

    @cached_property
    def enrol_orders(self) -> DataFrame:
        """Order lines as records: nation as state, segment as district."""
        quantity = F.col("l_quantity").cast("bigint")

        def band(flag_value: str):
            return F.when(F.col("l_returnflag") == flag_value, quantity).otherwise(F.lit(0))

        return (
            self.read("lineitem")
            .join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("date"),
                F.col("n_name").alias("state"),
                F.col("c_mktsegment").alias("district"),
                F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("pincode"),
                band("A").alias("age_0_5"),
                band("N").alias("age_5_17"),
                band("R").alias("age_18_greater"),
            )
        )

    @cached_property
    def enrol_dirty(self) -> DataFrame:
        """`enrol_events` with defects of every kind; all rows are kept."""
        e = self.enrol_events
        i = F.col("event_id")
        copies = F.when(i % 29 == 0, 2).otherwise(1)
        return e.select(
            F.when(F.col("date") == F.lit("2024-01-11").cast("date"), F.date_sub("date", 1))
            .otherwise(F.col("date"))
            .alias("date"),
            F.when(i % 37 == 0, F.lit(None).cast("string"))
            .when(i % 11 == 0, F.concat(F.lit("  north-"), "state", F.lit("'s aREA\t")))
            .otherwise(F.col("state"))
            .alias("state"),
            "district",
            F.when(i % 19 == 0, F.lit(None).cast("string"))
            .when(i % 7 == 0, F.substring("pincode", 2, 5))
            .when(i % 3 == 0, F.concat(F.lit(" "), "pincode", F.lit("\t")))
            .otherwise(F.col("pincode"))
            .alias("pincode"),
            F.when(i % 13 == 0, -F.col("age_0_5")).otherwise(F.col("age_0_5")).alias("age_0_5"),
            F.when(i % 5 != 0, F.col("age_5_17")).alias("age_5_17"),
            "age_18_greater",
            F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
        ).drop("copy")

    @cached_property
    def event_states(self) -> DataFrame:
        return aggregate.aggregate_by_state(self.enrol_events)

    @cached_property
    def event_sums(self) -> DataFrame:
        """`event_states` without the distinct counts, for queries that leave them out."""
        return aggregate.aggregate_by_state(self.enrol_events, counts=False)

    @cached_property
    def event_districts(self) -> DataFrame:
        return aggregate.aggregate_by_district(self.enrol_events)

    @cached_property
    def order_states(self) -> DataFrame:
        return aggregate.aggregate_by_state(self.enrol_orders)

    @cached_property
    def order_sums(self) -> DataFrame:
        return aggregate.aggregate_by_state(self.enrol_orders, counts=False)

    @cached_property
    def order_daily(self) -> DataFrame:
        """`order_states`, stored once as a daily table."""
        return written(self.order_states, "state-daily")

    @cached_property
    def gappy(self) -> DataFrame:
        """Daily totals per state, missing on Sundays."""
        return self.event_states.select(
            "date",
            "state",
            F.when(F.weekday("date") != 6, F.col("total_enrolments")).alias("total_enrolments"),
        )

    @cached_property
    def features(self) -> DataFrame:
        return state_features(written(self.event_states, "state-daily"))

    @cached_property
    def scored(self) -> DataFrame:
        """Scored daily states, with |z| above 2 as the anomaly rule."""
        z = outliers.zscore_analysis(score_states(self.features), "total_enrolments")
        return z.withColumns(
            {"anomaly_score": F.abs("zscore"), "is_anomaly": flag(F.abs("zscore") > 2)}
        ).drop("zscore", "zscore_outlier", "zscore_direction")

    @cached_property
    def scored_districts(self) -> DataFrame:
        keys = ["state", "district"]
        return (
            temporal.growth_rate(written(self.event_districts, "district-daily"), group_cols=keys)
            .transform(temporal.volatility, group_cols=keys)
            .transform(demographic.age_imbalance)
            .transform(risk.risk_score)
            .transform(risk.classify_risk)
        )


def daily_sql(source: str, keys: str, distinct: str) -> str:
    return f"""
    SELECT *, (age_0_5 + age_5_17) / nullif(total_enrolments, 0)::DOUBLE AS child_ratio,
           age_18_greater / nullif(total_enrolments, 0)::DOUBLE AS adult_ratio
    FROM (
      SELECT {keys}, {distinct},
             sum(age_0_5)::BIGINT AS age_0_5, sum(age_5_17)::BIGINT AS age_5_17,
             sum(age_18_greater)::BIGINT AS age_18_greater,
             sum(age_0_5 + age_5_17 + age_18_greater)::BIGINT AS total_enrolments
      FROM {source} GROUP BY {keys}
    ) AS sums"""


def features_sql(source: str, group: str) -> str:
    """Growth, volatility and trend columns per group."""
    return f"""
    SELECT *, (ma_short - ma_long) / nullif(ma_long, 0) AS trend_strength,
           CASE WHEN (ma_short - ma_long) / nullif(ma_long, 0) > 0.05 THEN 'upward'
                WHEN (ma_short - ma_long) / nullif(ma_long, 0) < -0.05 THEN 'downward'
                ELSE 'stable' END AS trend_direction
    FROM (
      SELECT *, total_enrolments / nullif(lag(total_enrolments) OVER g, 0)::DOUBLE - 1 AS growth_rate,
             stddev_samp(total_enrolments) OVER w14 AS volatility,
             stddev_samp(total_enrolments) OVER w14
               / nullif(avg(total_enrolments) OVER w14, 0) AS volatility_cv,
             avg(total_enrolments) OVER w7 AS ma_short,
             avg(total_enrolments) OVER w14 AS ma_long
      FROM {source}
      WINDOW g AS (PARTITION BY {group} ORDER BY date),
             w7 AS (PARTITION BY {group} ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
             w14 AS (PARTITION BY {group} ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
    ) AS windows"""


def demographic_sql(source: str) -> str:
    """Age ratios, deviations, imbalance, adult to child ratio and dominance."""
    return f"""
    SELECT *, CASE WHEN adult_child_ratio < 0.5 THEN 'high'
                   WHEN adult_child_ratio > 2 THEN 'low' ELSE 'normal' END AS child_dominance
    FROM (
      SELECT *, (dev_0_5 + dev_5_17 + dev_18_greater) / 3 AS demographic_imbalance,
             CASE WHEN raw_ratio > 100 THEN 100.0 ELSE raw_ratio END AS adult_child_ratio
      FROM (
        SELECT *, abs(ratio_0_5 - 0.10) AS dev_0_5, abs(ratio_5_17 - 0.25) AS dev_5_17,
               abs(ratio_18_greater - 0.65) AS dev_18_greater,
               age_18_greater / nullif(total_children, 0)::DOUBLE AS raw_ratio
        FROM (
          SELECT *, age_0_5 / nullif(total_enrolments, 0)::DOUBLE AS ratio_0_5,
                 age_5_17 / nullif(total_enrolments, 0)::DOUBLE AS ratio_5_17,
                 age_18_greater / nullif(total_enrolments, 0)::DOUBLE AS ratio_18_greater,
                 age_0_5 + age_5_17 AS total_children
          FROM {source}
        ) AS ratios
      ) AS deviations
    ) AS capped"""


def risk_sql(source: str, features: dict[str, float]) -> str:
    """Risk score from weighted features, by way of a statistics row."""
    stats = ", ".join(f"median({f}) AS m_{f}" for f in features)
    ends = ", ".join(
        f"min(abs(coalesce({f}, m_{f}))) AS lo_{f}, max(abs(coalesce({f}, m_{f}))) AS hi_{f}"
        for f in features
    )
    terms = " + ".join(
        f"{w} * CASE WHEN lo_{f} = hi_{f} THEN 0.5 "
        f"ELSE (abs(coalesce({f}, m_{f})) - lo_{f}) / nullif(hi_{f} - lo_{f}, 0) END"
        for f, w in features.items()
    )
    total = " + ".join(str(w) for w in features.values())
    level = [
        ("Low", 1, "risk_score <= 0.3"),
        ("Medium", 2, "risk_score <= 0.6"),
        ("High", 3, "risk_score <= 0.8"),
        ("Critical", 4, "risk_score > 0.8"),
    ]
    names = " ".join(f"WHEN {c} THEN '{n}'" for n, _, c in level)
    tiers = " ".join(f"WHEN {c} THEN {t}" for _, t, c in level)
    return f"""
    SELECT *, CASE {names} ELSE 'Unknown' END AS risk_level,
           CASE {tiers} ELSE 0 END AS risk_tier
    FROM (
      SELECT s.*, least(1.0, greatest(0.0, ({terms}) / ({total}))) AS risk_score
      FROM {source} AS s,
           (SELECT {stats} FROM {source}) AS medians,
           (SELECT {ends} FROM {source}, (SELECT {stats} FROM {source}) AS m) AS ranges
    ) AS scores"""


TITLE = (
    "array_to_string(list_transform(string_split({0}, ''), lambda ch, i: CASE WHEN i > 1 AND "
    "regexp_matches(substr({0}, CAST(i - 1 AS BIGINT), 1), '[A-Za-z]') "
    "THEN lower(ch) ELSE upper(ch) END), '')"
)
STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"

PIPELINE_WEIGHTS = {"volatility_cv": 0.2, "demographic_imbalance": 0.25, "growth_rate": 0.2}
ALL_WEIGHTS = {**PIPELINE_WEIGHTS, "seasonal_deviation": 0.15}

CTES = {
    "enrol_events": """
    SELECT event_id, CAST(ts AS DATE) AS date, event_type AS state,
           'd' || CAST(user_id % 10 AS VARCHAR) AS district,
           lpad(CAST(user_id AS VARCHAR), 6, '0') AS pincode,
           CAST(floor(value) AS BIGINT) % 7 AS age_0_5,
           CAST(floor(value) AS BIGINT) % 13 AS age_5_17,
           CAST(floor(value) AS BIGINT) % 29 AS age_18_greater
    FROM events""",
    "enrol_orders": """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, n_name AS state,
           c_mktsegment AS district, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS pincode,
           CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS age_0_5,
           CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS age_5_17,
           CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END
             AS age_18_greater
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "enrol_dirty": """
    SELECT CASE WHEN date = DATE '2024-01-11' THEN DATE '2024-01-10' ELSE date END AS date,
           CASE WHEN event_id % 37 = 0 THEN NULL
                WHEN event_id % 11 = 0 THEN '  north-' || state || '''s aREA' || chr(9)
                ELSE state END AS state,
           district,
           CASE WHEN event_id % 19 = 0 THEN NULL
                WHEN event_id % 7 = 0 THEN substr(pincode, 2, 5)
                WHEN event_id % 3 = 0 THEN ' ' || pincode || chr(9) ELSE pincode END AS pincode,
           CASE WHEN event_id % 13 = 0 THEN -age_0_5 ELSE age_0_5 END AS age_0_5,
           CASE WHEN event_id % 5 <> 0 THEN age_5_17 END AS age_5_17,
           age_18_greater
    FROM enrol_events, (SELECT unnest([1, 2]) AS copy) AS copies
    WHERE copy = 1 OR event_id % 29 = 0""",
    "event_states": daily_sql(
        "enrol_events",
        "date, state",
        "count(DISTINCT district) AS district_count, count(DISTINCT pincode) AS pincode_count",
    ),
    "order_states": daily_sql(
        "enrol_orders",
        "date, state",
        "count(DISTINCT district) AS district_count, count(DISTINCT pincode) AS pincode_count",
    ),
    "event_districts": daily_sql(
        "enrol_events", "date, state, district", "count(DISTINCT pincode) AS pincode_count"
    ),
    "gappy": """
    SELECT date, state, CASE WHEN isodow(date) <> 7 THEN total_enrolments END AS total_enrolments
    FROM event_states""",
    "windowed": features_sql("event_states", "state"),
    "features": demographic_sql("windowed"),
    "risky": risk_sql("features", PIPELINE_WEIGHTS),
    "scored": """
    SELECT s.*, abs((total_enrolments - m) / nullif(sd, 0)) AS anomaly_score,
           coalesce(abs((total_enrolments - m) / nullif(sd, 0)) > 2, false) AS is_anomaly
    FROM risky AS s, (SELECT avg(total_enrolments) AS m, stddev_pop(total_enrolments) AS sd
                      FROM risky) AS moments""",
    "four_features": """
    SELECT s.*, total_enrolments / nullif(mm, 0) - 1 AS seasonal_deviation
    FROM features AS s JOIN (SELECT month(date) AS m, avg(total_enrolments) AS mm
                             FROM features GROUP BY 1) AS months ON month(s.date) = m""",
    "order_windows": features_sql("order_states", "state"),
    "order_features": demographic_sql("order_windows"),
    "district_windows": features_sql("event_districts", "state, district"),
    "district_features": demographic_sql("district_windows"),
    "scored_districts": risk_sql("district_features", PIPELINE_WEIGHTS),
}
