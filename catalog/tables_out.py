"""Alerts, map tables, reports and dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.core import Query
from catalog.tables import Tables
from tallywatch.functions.scale import written
from tallywatch.operators import alerts, geo, reports
from tallywatch.plans.dashboard import latest_alerts

_ALERT = "type severity region value:d threshold:d timestamp:t rule"


def _rule_sql(name, kind, column, test, severity, threshold) -> str:
    limit = "NULL" if threshold is None else threshold
    return (
        f"SELECT '{kind}' AS type, '{severity}' AS severity, state AS region, "
        f"{column}::DOUBLE AS value, {limit}::DOUBLE AS threshold, date AS timestamp, "
        f"'{name}' AS rule FROM scored WHERE {test}"
    )


def _rules_sql(high=0.75, medium=0.5, imbalance=0.2, cv=0.5, spike=0.5, drop=-0.3, anomaly=True):
    rules = [
        ("high_risk_score", "high_risk", "risk_score", f"risk_score > {high}", "critical", high),
        (
            "medium_risk_score", "high_risk", "risk_score",
            f"risk_score > {medium} AND risk_score <= {high}", "warning", medium,
        ),
        (
            "demographic_imbalance", "demographic_imbalance", "demographic_imbalance",
            f"demographic_imbalance > {imbalance}", "warning", imbalance,
        ),
        ("high_volatility", "volatility_high", "volatility_cv", f"volatility_cv > {cv}", "warning", cv),
        ("enrolment_spike", "enrolment_spike", "growth_rate", f"growth_rate > {spike}", "warning", spike),
        ("enrolment_drop", "enrolment_drop", "growth_rate", f"growth_rate < {drop}", "warning", drop),
    ]
    if anomaly:
        rules.append(
            ("anomaly_detected", "anomaly_detected", "is_anomaly", "is_anomaly", "warning", None)
        )
    return " UNION ALL ".join(_rule_sql(*r) for r in rules)


ALERTS_SQL = _rules_sql()


def _named(found: DataFrame) -> DataFrame:
    return found.withColumn("rule", F.col("metadata")["rule"])


def _alerts(t: Tables) -> DataFrame:
    return _named(alerts.process(t.scored))


def _custom_rule(t: Tables) -> DataFrame:
    """The default rules without one, plus one of the caller's own in SQL text."""
    own = alerts.AlertRule(
        "low_child_share", "threshold_breach", "child_ratio", "child_ratio < 0.5", "info",
        "{region}: child share {value:.2f}", 0.5,
    )
    rules = alerts.add_rule(alerts.remove_rule(alerts.DEFAULT_RULES, "high_volatility"), own)
    return _named(alerts.process(t.scored, rules))


def _formatted_alerts(t: Tables) -> DataFrame:
    """Templates with the fields, fills, commas and kinds that format() knows."""

    def rule(name: str, column: str, message: str, threshold: float | None = None):
        return alerts.AlertRule(
            name, "threshold_breach", column, f"{column} IS NOT NULL", "info", message, threshold
        )

    rules = [
        rule("whole", "thousands", "{value:,} in {region:*<10} ({threshold:.2f})", 0.5),
        rule("share", "child_ratio", "{region:>10}|{value:>9.2%}|{region:.3}"),
        rule("flag", "is_anomaly", "flag {value}"),
        rule("exponent", "imbalance", "{value:,.2e} {value:+.1f}"),
    ]
    rows = t.scored.withColumns(
        {
            "thousands": F.col("total_enrolments") * 1000,
            "imbalance": F.col("demographic_imbalance") * 12345,
        }
    )
    return _named(alerts.process(rows, rules))


# All alert types.
_TYPES = [
    "enrolment_spike", "enrolment_drop", "high_risk", "anomaly_detected", "demographic_imbalance",
    "volatility_high", "threshold_breach",
]
_OWN_SQL = _rule_sql(
    "low_child_share", "threshold_breach", "child_ratio", "child_ratio < 0.5", "info", 0.5
)

ALERTS = [
    Query("alerts_default_rules", _ALERT, _alerts, ALERTS_SQL),
    Query(
        "alert_messages",
        "region timestamp:t rule message",
        _alerts,
        """
        SELECT state AS region, date AS timestamp, 'demographic_imbalance' AS rule,
               'Demographic imbalance detected: ' || printf('%.2f', demographic_imbalance * 100)
                 || '% deviation' AS message
        FROM scored WHERE demographic_imbalance > 0.2
        UNION ALL SELECT state, date, 'high_risk_score', 'High risk score detected: '
               || printf('%.3f', risk_score) || ' (threshold: 0.75)' FROM scored
        WHERE risk_score > 0.75
        UNION ALL SELECT state, date, 'medium_risk_score', 'Elevated risk score: '
               || printf('%.3f', risk_score) FROM scored WHERE risk_score > 0.5 AND risk_score <= 0.75
        UNION ALL SELECT state, date, 'anomaly_detected', 'Anomaly detected in enrolment patterns'
        FROM scored WHERE is_anomaly
        UNION ALL SELECT state, date, 'high_volatility', 'High enrolment volatility: CV = '
               || printf('%.2f', volatility_cv) FROM scored WHERE volatility_cv > 0.5
        UNION ALL SELECT state, date, 'enrolment_spike', 'Enrolment spike: '
               || printf('%.1f', growth_rate * 100) || '% increase' FROM scored
        WHERE growth_rate > 0.5
        UNION ALL SELECT state, date, 'enrolment_drop', 'Enrolment drop: '
               || printf('%.1f', growth_rate * 100) || '% decrease' FROM scored
        WHERE growth_rate < -0.3""",
    ),
    Query(
        "alert_message_formats",
        "region timestamp:t rule message",
        _formatted_alerts,
        """
        SELECT state AS region, date AS timestamp, 'whole' AS rule,
               format('{:,}', total_enrolments * 1000) || ' in ' || rpad(state, 10, '*')
                 || ' (0.50)' AS message
        FROM scored
        UNION ALL SELECT state, date, 'share',
               lpad(state, 10, ' ') || '|' || lpad(printf('%.2f', child_ratio * 100) || '%', 9, ' ')
                 || '|' || left(state, 3)
        FROM scored WHERE child_ratio IS NOT NULL
        UNION ALL SELECT state, date, 'flag', 'flag ' || CASE WHEN is_anomaly THEN 'True' ELSE 'False' END
        FROM scored
        UNION ALL SELECT state, date, 'exponent', printf('%.2e', imbalance) || ' ' || printf('%+.1f', imbalance)
        FROM (SELECT state, date, demographic_imbalance * 12345 AS imbalance FROM scored) AS i
        WHERE imbalance IS NOT NULL""",
    ),
    Query(
        "alerts_custom_thresholds",
        _ALERT,
        lambda t: _named(
            alerts.process(
                t.scored, alerts.threshold_rules(0.4, 0.2, 0.05, 0.1, 0.1, -0.1)
            )
        ),
        _rules_sql(0.4, 0.2, 0.05, 0.1, 0.1, -0.1, anomaly=False),
    ),
    Query(
        "alerts_own_rules",
        _ALERT,
        _custom_rule,
        f"SELECT * FROM ({ALERTS_SQL}) AS a WHERE rule <> 'high_volatility' UNION ALL {_OWN_SQL}",
    ),
    Query(
        "alerts_by_severity",
        _ALERT,
        lambda t: alerts.by_severity(_alerts(t), "warning"),
        f"SELECT * FROM ({ALERTS_SQL}) AS a WHERE severity = 'warning'",
    ),
    Query(
        "alerts_by_type",
        _ALERT,
        lambda t: alerts.by_type(_alerts(t), "enrolment_drop"),
        f"SELECT * FROM ({ALERTS_SQL}) AS a WHERE type = 'enrolment_drop'",
    ),
    Query(
        "alerts_by_region",
        _ALERT,
        lambda t: alerts.by_region(_alerts(t), "click"),
        f"SELECT * FROM ({ALERTS_SQL}) AS a WHERE region = 'click'",
    ),
    Query(
        "alert_summary",
        "total_alerts:l critical:l warnings:l info:l affected_regions:l",
        lambda t: alerts.summary(_alerts(t)),
        f"""
        SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'critical') AS critical,
               count(*) FILTER (severity = 'warning') AS warnings,
               count(*) FILTER (severity = 'info') AS info,
               count(DISTINCT region) AS affected_regions
        FROM ({ALERTS_SQL}) AS a""",
    ),
    Query(
        "alert_count_by_type",
        "type count:l",
        lambda t: alerts.count_by_type(_alerts(t)),
        f"""
        SELECT k.type, count(a.type) AS count
        FROM (SELECT unnest({_TYPES}) AS type) AS k
        LEFT JOIN ({ALERTS_SQL}) AS a ON a.type = k.type GROUP BY k.type""",
    ),
    Query(
        "latest_alerts",
        _ALERT,
        lambda t: _named(latest_alerts(alerts.process(t.scored))),
        f"SELECT * FROM ({ALERTS_SQL}) AS a ORDER BY timestamp, region, rule LIMIT 20",
    ),
    Query(
        "alert_regions",
        "region",
        lambda t: alerts.affected_regions(_alerts(t)),
        f"SELECT DISTINCT region FROM ({ALERTS_SQL}) AS a WHERE region <> ''",
    ),
]

# Region names for the name maps: some customers' nations are respelled as states.
_SPELLED = {
    "ALGERIA": " orissa",
    "BRAZIL": "delhi",
    "CHINA": "ANDAMAN & NICOBAR",
    "EGYPT": "Jammu and Kashmir",
    "FRANCE": "nct of delhi ",
    "INDIA": "Daman and Diu",
    "JAPAN": "Tamil Nadu",
}


def _customers(t: Tables) -> DataFrame:
    name = F.col("n_name")
    for nation, spelled in _SPELLED.items():
        name = F.when(F.col("n_name") == nation, F.lit(spelled)).otherwise(name)
    nations = t.read("nation")
    joined = t.read("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", name.alias("state"))


_CUSTOMERS_SQL = (
    "(SELECT c_custkey, CASE n_name "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SPELLED.items())
    + " ELSE n_name END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey) AS n"
)


def _map_sql(names: dict[str, str], key: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {key} {cases} ELSE {key} END"


# Only letters, spaces and ampersands occur in the names below.
_SIMPLE_TITLE = (
    "array_to_string(list_transform(string_split(trim(state), ' '), "
    "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
)
_NORMAL = _map_sql(geo.ALL_NAMES, _SIMPLE_TITLE)

MAPS = [
    Query(
        "normalize_state_name",
        "c_custkey state state_normalized",
        lambda t: _customers(t).withColumn("state_normalized", geo.normalize_state_name(F.col("state"))),
        f"SELECT *, {_NORMAL} AS state_normalized FROM {_CUSTOMERS_SQL}",
    ),
    Query(
        "normalize_state_name_spellings_only",
        "c_custkey state state_normalized",
        lambda t: _customers(t).withColumn(
            "state_normalized", geo.normalize_state_name(F.col("state"), geo.SPELLINGS)
        ),
        f"SELECT *, {_map_sql(geo.SPELLINGS, _SIMPLE_TITLE)} AS state_normalized "
        f"FROM {_CUSTOMERS_SQL}",
    ),
    Query(
        "shape_name",
        "c_custkey state shape",
        lambda t: _customers(t).withColumn("shape", geo.shape_name(F.col("state"))),
        f"SELECT *, {_map_sql(geo.SHAPE_NAMES, 'state')} AS shape FROM {_CUSTOMERS_SQL}",
    ),
    Query(
        "risk_map",
        "state risk_score:d total_enrolments:l state_normalized",
        lambda t: geo.risk_map(t.scored),
        f"SELECT *, {_NORMAL} AS state_normalized FROM (SELECT state, avg(risk_score) AS risk_score, "
        "sum(total_enrolments) AS total_enrolments FROM scored GROUP BY state) AS s",
    ),
    Query(
        "enrolment_map",
        "state total_enrolments:l log_enrolments:d state_normalized",
        lambda t: geo.enrolment_map(t.enrol_orders),
        f"SELECT *, log10(total_enrolments + 1) AS log_enrolments, {_NORMAL} AS state_normalized "
        "FROM (SELECT state, sum(age_0_5 + age_5_17 + age_18_greater) AS total_enrolments "
        "FROM enrol_orders GROUP BY state) AS s",
    ),
    Query(
        "anomaly_map",
        "state anomaly_count:l total_records:l anomaly_rate:d colour_cap:d",
        lambda t: geo.anomaly_map(t.scored),
        """
        SELECT *, (quantile_cont(anomaly_rate, 0.95) OVER ()) AS colour_cap
        FROM (SELECT state, count(*) FILTER (is_anomaly) AS anomaly_count,
                     count(*) AS total_records,
                     count(*) FILTER (is_anomaly) / count(*)::DOUBLE AS anomaly_rate
              FROM scored GROUP BY state) AS s""",
    ),
    Query(
        "child_ratio_map",
        "state age_0_5:l age_5_17:l age_18_greater:l total_enrolments:l child_ratio:d",
        lambda t: geo.child_ratio_map(t.enrol_orders),
        """
        SELECT *, (age_0_5 + age_5_17) / nullif(total_enrolments, 0)::DOUBLE AS child_ratio
        FROM (SELECT state, sum(age_0_5) AS age_0_5, sum(age_5_17) AS age_5_17,
                     sum(age_18_greater) AS age_18_greater,
                     sum(age_0_5 + age_5_17 + age_18_greater) AS total_enrolments
              FROM enrol_orders GROUP BY state) AS s""",
    ),
    Query(
        "choropleth",
        "state risk_score:d total_enrolments:l",
        lambda t: geo.choropleth(t.scored),
        "SELECT state, avg(risk_score) AS risk_score, sum(total_enrolments) AS total_enrolments "
        "FROM scored GROUP BY state",
    ),
    Query(
        "top_regions",
        "date state risk_score:d",
        lambda t: geo.top_regions(t.scored),
        "SELECT date, state, risk_score FROM scored ORDER BY risk_score DESC, state, date LIMIT 15",
    ),
    Query(
        "risk_grid",
        "date state risk_score:d",
        lambda t: geo.grid_rows(geo.risk_grid(written(t.scored, "scored"))),
        """
        SELECT date, state, coalesce(avg(risk_score), 0) AS risk_score
        FROM (SELECT DISTINCT date FROM scored) AS d CROSS JOIN (SELECT DISTINCT state FROM scored) AS x
        LEFT JOIN scored USING (date, state) GROUP BY date, state""",
    ),
    Query(
        "risk_grid_rows",
        "date state risk_score:d",
        lambda t: geo.risk_grid_rows(t.scored),
        """
        SELECT date, state, coalesce(avg(risk_score), 0) AS risk_score
        FROM (SELECT DISTINCT date FROM scored) AS d CROSS JOIN (SELECT DISTINCT state FROM scored) AS x
        LEFT JOIN scored USING (date, state) GROUP BY date, state""",
    ),
    Query(
        "district_bubbles",
        "state district total_enrolments:l risk_score:d",
        lambda t: geo.district_bubbles(t.scored_districts, n=20),
        "SELECT state, district, sum(total_enrolments) AS total_enrolments, "
        "avg(risk_score) AS risk_score FROM scored_districts GROUP BY state, district "
        "ORDER BY 3 DESC, 1, 2 LIMIT 20",
    ),
]

SUMMARY_SQL = """
    SELECT unnest(['Total Records', 'Date Range Start', 'Date Range End', 'Unique States',
                   'Unique Districts', 'Total Enrolments', 'Avg Risk Score', 'High Risk Records',
                   'Anomalies Detected']) AS metric,
           unnest([count(*)::VARCHAR, min(date)::VARCHAR, max(date)::VARCHAR,
                   count(DISTINCT state)::VARCHAR, 'N/A', sum(total_enrolments)::BIGINT::VARCHAR,
                   printf('%.3f', avg(risk_score)),
                   (count(*) FILTER (risk_level IN ('High', 'Critical')))::VARCHAR,
                   (count(*) FILTER (is_anomaly))::VARCHAR]) AS value
    FROM scored"""

REPORTS = [
    Query("report_summary_sheet", "metric value", lambda t: reports.summary_sheet(t.scored), SUMMARY_SQL),
    Query(
        "anomalies_report",
        "date state total_enrolments:l risk_score:d risk_level anomaly_score:d",
        lambda t: reports.anomalies_report(t.scored),
        "SELECT * FROM scored WHERE is_anomaly ORDER BY anomaly_score DESC, date, state LIMIT 100",
    ),
    Query(
        "anomalies_report_summary",
        "metric value",
        lambda t: reports.anomalies_summary(t.scored),
        """
        SELECT unnest(['Total Anomalies', 'Anomaly Rate', 'Avg Anomaly Score', 'States Affected'])
                 AS metric,
               unnest([(count(*) FILTER (is_anomaly))::VARCHAR,
                       printf('%.2f', avg(is_anomaly::INT) * 100) || '%',
                       coalesce(printf('%.3f', avg(anomaly_score) FILTER (is_anomaly)), 'nan'),
                       (count(DISTINCT state) FILTER (is_anomaly))::VARCHAR]) AS value
        FROM scored""",
    ),
    Query(
        "top_anomaly_states",
        "state count:l",
        lambda t: reports.top_anomaly_states(t.scored),
        "SELECT state, count(*) AS count FROM scored WHERE is_anomaly GROUP BY state "
        "ORDER BY 2 DESC, 1 LIMIT 5",
    ),
    Query(
        "top_risk_states",
        "state risk_score:d count:l",
        lambda t: reports.top_risk_states(t.scored),
        "SELECT state, avg(risk_score) AS risk_score, count(*) AS count FROM scored GROUP BY state "
        "ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    Query(
        "anomaly_table",
        "date state total_enrolments:l growth_rate:d risk_level anomaly_score:d is_anomaly",
        lambda t: reports.anomaly_table(t.scored),
        "SELECT * FROM scored WHERE is_anomaly ORDER BY anomaly_score DESC, date, state LIMIT 20",
    ),
    Query(
        "anomaly_summary",
        "total_records:l anomaly_count:l anomaly_rate:d avg_anomaly_score:d",
        lambda t: reports.anomaly_summary(t.scored),
        """
        SELECT count(*) AS total_records, count(*) FILTER (is_anomaly) AS anomaly_count,
               count(*) FILTER (is_anomaly) / count(*)::DOUBLE * 100 AS anomaly_rate,
               coalesce(avg(anomaly_score) FILTER (is_anomaly), 0) AS avg_anomaly_score
        FROM scored""",
    ),
    Query(
        "top_anomalies",
        "state anomaly_score:d",
        lambda t: reports.top_anomalies(t.scored),
        "SELECT state, anomaly_score FROM scored WHERE is_anomaly "
        "ORDER BY anomaly_score DESC, date, state LIMIT 10",
    ),
]

QUERIES = [*ALERTS, *MAPS, *REPORTS]
