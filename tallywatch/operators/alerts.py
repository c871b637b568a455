"""Rule-based alerts.

Conditions are column expressions, so a batch of rules is one projection that
Catalyst compiles; no Python runs on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities and alert types.
SEVERITIES = ("info", "warning", "critical")
ALERT_TYPES = (
    "enrolment_spike",
    "enrolment_drop",
    "high_risk",
    "anomaly_detected",
    "demographic_imbalance",
    "volatility_high",
    "threshold_breach",
)


_SPEC = re.compile(
    r"(?:(?P<fill>.)?(?P<align>[<>^]))?(?P<sign>[+ -]?)(?P<zero>0?)(?P<width>\d*)(?P<comma>,?)"
    r"(?:\.(?P<digits>\d+))?(?P<kind>[fFe%ds]?)"
)


_TEXT_SPEC = re.compile(r"(?:(?P<fill>.)?(?P<align>[<>^]))?(?P<width>[1-9]\d*)?(?:\.(?P<digits>\d+))?s?")


def _check_spec(name: str, spec: str, threshold: float | None) -> bool:
    """Whether a format for this field gives what Python's format() gives."""
    if name == "region":
        return bool(_TEXT_SPEC.fullmatch(spec))
    if name == "threshold":
        try:
            format(threshold, spec)
        except (TypeError, ValueError):
            return False
        return True
    m = _SPEC.fullmatch(spec)
    if not m or (m["digits"] and m["kind"] in ("", "d", "s")):
        return False
    # Python has no comma for text, and puts commas between padding zeros.
    return not (m["comma"] and (m["kind"] == "s" or m["zero"]))


@dataclass(frozen=True)
class AlertRule:
    """`condition` maps the checked column to a boolean column, or is SQL text."""

    name: str
    alert_type: str
    column: str
    condition: Callable[[Column], Column] | str
    severity: str
    message: str
    threshold: float | None = None

    def __post_init__(self):
        for _, name, spec, conversion in Formatter().parse(self.message):
            if name not in (None, "value", "region", "threshold"):
                raise ValueError(f"unknown field {name} in {self.message!r}")
            if conversion:
                raise ValueError(f"unsupported conversion !{conversion} in {self.message!r}")
            if spec and not _check_spec(name, spec, self.threshold):
                raise ValueError(f"unsupported format {spec!r} in {self.message!r}")

    def fires(self) -> Column:
        if isinstance(self.condition, str):
            test = F.expr(self.condition)
        else:
            test = self.condition(F.col(self.column))
        return F.col(self.column).isNotNull() & test


def above(limit: float) -> Callable[[Column], Column]:
    return lambda v: v > limit


def below(limit: float) -> Callable[[Column], Column]:
    return lambda v: v < limit


def between(low: float, high: float) -> Callable[[Column], Column]:
    """Above `low`, up to and including `high`."""
    return lambda v: (v > low) & (v <= high)


# The default rules, their limits and their wording.
DEFAULT_RULES = (
    AlertRule(
        "high_risk_score", "high_risk", "risk_score", above(0.75), "critical",
        "High risk score detected: {value:.3f} (threshold: {threshold})", 0.75,
    ),
    AlertRule(
        "medium_risk_score", "high_risk", "risk_score", between(0.5, 0.75), "warning",
        "Elevated risk score: {value:.3f}", 0.5,
    ),
    AlertRule(
        "anomaly_detected", "anomaly_detected", "is_anomaly", lambda v: v, "warning",
        "Anomaly detected in enrolment patterns",
    ),
    AlertRule(
        "demographic_imbalance", "demographic_imbalance", "demographic_imbalance", above(0.2),
        "warning", "Demographic imbalance detected: {value:.2%} deviation", 0.2,
    ),
    AlertRule(
        "high_volatility", "volatility_high", "volatility_cv", above(0.5), "warning",
        "High enrolment volatility: CV = {value:.2f}", 0.5,
    ),
    AlertRule(
        "enrolment_spike", "enrolment_spike", "growth_rate", above(0.5), "warning",
        "Enrolment spike: {value:.1%} increase", 0.5,
    ),
    AlertRule(
        "enrolment_drop", "enrolment_drop", "growth_rate", below(-0.3), "warning",
        "Enrolment drop: {value:.1%} decrease", -0.3,
    ),
)


def threshold_rules(
    risk_high: float = 0.75,
    risk_medium: float = 0.5,
    imbalance: float = 0.2,
    volatility: float = 0.5,
    growth_spike: float = 0.5,
    growth_drop: float = -0.3,
) -> tuple[AlertRule, ...]:
    """Six rules with chosen limits and short messages; no anomaly rule."""
    # The short wording.
    return (
        AlertRule(
            "high_risk_score", "high_risk", "risk_score", above(risk_high), "critical",
            "High risk score detected: {value:.3f}", risk_high,
        ),
        AlertRule(
            "medium_risk_score", "high_risk", "risk_score", between(risk_medium, risk_high),
            "warning", "Elevated risk score: {value:.3f}", risk_medium,
        ),
        AlertRule(
            "demographic_imbalance", "demographic_imbalance", "demographic_imbalance",
            above(imbalance), "warning", "Demographic imbalance: {value:.2%}", imbalance,
        ),
        AlertRule(
            "high_volatility", "volatility_high", "volatility_cv", above(volatility), "warning",
            "High volatility: CV = {value:.2f}", volatility,
        ),
        AlertRule(
            "enrolment_spike", "enrolment_spike", "growth_rate", above(growth_spike), "warning",
            "Enrolment spike: {value:.1%}", growth_spike,
        ),
        AlertRule(
            "enrolment_drop", "enrolment_drop", "growth_rate", below(growth_drop), "warning",
            "Enrolment drop: {value:.1%}", growth_drop,
        ),
    )


def add_rule(rules: Sequence[AlertRule], rule: AlertRule) -> tuple[AlertRule, ...]:
    return (*rules, rule)


def remove_rule(rules: Sequence[AlertRule], name: str) -> tuple[AlertRule, ...]:
    return tuple(r for r in rules if r.name != name)


def _padded(text: Column, m: re.Match, default: str) -> Column:
    """`text` filled up to the width of a format."""
    if not (width := int(m["width"] or 0)):
        return text
    gap = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    left = {"<": F.lit(0), ">": gap, "^": F.floor(gap / 2)}[m["align"] or default].cast("int")
    fill = F.lit(m["fill"] or " ")
    return F.concat(F.repeat(fill, left), text, F.repeat(fill, gap - left))


def _plain(value: Column, is_whole: bool) -> Column:
    """A number as Python's str() gives it: the shortest digits that name it."""
    text = value.cast("string")
    if is_whole:
        return text
    mantissa, power = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2))
    power = F.coalesce(F.try_to_number(power, F.lit("S999")).cast("int"), F.lit(0))
    scientific = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""),
        F.when(power < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    size = F.abs(value)
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    usual = F.regexp_replace(digits, r"\.$", ".0")
    in_range = (size == 0) | ((size >= 1e-4) & (size < 1e16))
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(size == 0, F.when(text.startswith("-"), "-0.0").otherwise("0.0"))
        .when(in_range, usual)
        .otherwise(scientific)
    )


def _formatted(value: Column, spec: str, is_whole: bool) -> Column:
    """A number as Python's format() gives it, but that `d` rounds and halves go up."""
    m = _SPEC.fullmatch(spec)
    kind, number = m["kind"], value.cast("double")
    comma = "," if m["comma"] and kind != "e" else ""
    flags, digits = m["sign"].strip("-") + comma, f".{m['digits'] or 6}"
    if kind in ("", "s"):
        text = _plain(value if is_whole else number, is_whole)
        if comma:
            whole = F.regexp_extract(text, r"^-?\d+", 0)
            grouped = F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1,")
            text = F.when(
                text.contains("e") | (F.length(whole) == 0), text
            ).otherwise(F.concat(grouped, F.substring(text, F.length(whole) + 1, F.length(text))))
        if m["sign"].strip("-"):
            text = F.when(number >= 0, F.concat(F.lit(m["sign"]), text)).otherwise(text)
    elif kind == "d":
        text = F.format_string(f"%{flags}d", F.rint(number).cast("long"))
    elif kind == "%":
        text = F.format_string(f"%{flags}{digits}f%%", number * 100)
    else:
        text = F.format_string(f"%{flags}{digits}{kind.lower()}", number)
    if m["zero"] and not m["align"] and m["width"]:  # zeros go after the sign
        gap = F.greatest(F.lit(int(m["width"])) - F.length(text), F.lit(0))
        sign = F.regexp_extract(text, "^[-+ ]?", 0)
        return F.concat(sign, F.repeat(F.lit("0"), gap), F.regexp_replace(text, "^[-+ ]", ""))
    return _padded(text, m, "<" if kind == "s" else ">")


def _message(rule: AlertRule, region: Column, kind: str) -> Column:
    """The template as a column; fields are value, region and threshold."""
    parts, value = [], F.col(rule.column)
    is_whole = kind not in ("double", "float")
    for text, name, spec, _ in Formatter().parse(rule.message):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if name == "region":
            m = _TEXT_SPEC.fullmatch(spec)
            cut = F.substring(region, 1, int(m["digits"])) if m["digits"] else region
            parts.append(_padded(cut, m, "<"))
        elif name == "threshold":
            parts.append(F.lit(format(rule.threshold, spec) if spec else str(rule.threshold)))
        elif kind == "boolean":
            as_text = F.when(value, "True").otherwise("False")
            parts.append(_formatted(value.cast("int"), spec, True) if spec else as_text)
        else:
            parts.append(_formatted(value, spec, is_whole) if spec else _plain(value, is_whole))
    return F.concat(*parts)


def process(
    df: DataFrame,
    rules: Sequence[AlertRule] = DEFAULT_RULES,
    region_col: str = "state",
    date_col: str = "date",
) -> DataFrame:
    """One row per row and firing rule, in a single pass without a shuffle."""
    region = F.col(region_col) if region_col in df.columns else F.lit("Unknown")
    stamp = F.col(date_col).cast("timestamp") if date_col in df.columns else F.current_timestamp()
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    entries = [
        F.when(
            r.fires(),
            F.struct(
                F.lit(r.alert_type).alias("type"),
                F.lit(r.severity).alias("severity"),
                _message(r, region.cast("string"), kinds[r.column]).alias("message"),
                region.cast("string").alias("region"),
                F.col(r.column).cast("double").alias("value"),
                F.lit(r.threshold).cast("double").alias("threshold"),
                stamp.alias("timestamp"),
                F.create_map(F.lit("rule"), F.lit(r.name)).alias("metadata"),
            ),
        )
        for r in rules
        if r.column in df.columns
    ]
    if not entries:
        return df.sparkSession.createDataFrame([], ALERT_SCHEMA)
    return df.select(F.inline(F.array_compact(F.array(*entries))))


ALERT_SCHEMA = (
    "type string, severity string, message string, region string, value double, "
    "threshold double, timestamp timestamp, metadata map<string,string>"
)


def by_severity(alerts: DataFrame, severity: str) -> DataFrame:
    return alerts.where(F.col("severity") == severity)


def by_type(alerts: DataFrame, alert_type: str) -> DataFrame:
    return alerts.where(F.col("type") == alert_type)


def by_region(alerts: DataFrame, region: str) -> DataFrame:
    return alerts.where(F.col("region") == region)


def summary(alerts: DataFrame) -> DataFrame:
    """One row: totals by severity and the number of regions concerned."""
    return alerts.agg(
        F.count("*").alias("total_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("info"),
        F.count_distinct(F.when(F.col("region") != "", F.col("region"))).alias("affected_regions"),
    )


def count_by_type(alerts: DataFrame) -> DataFrame:
    """One row per alert type, also for types without alerts."""
    counts = alerts.agg(*[F.count_if(F.col("type") == t).alias(t) for t in ALERT_TYPES])
    rows = [F.struct(F.lit(t).alias("type"), F.col(t).alias("count")) for t in ALERT_TYPES]
    return counts.select(F.inline(F.array(*rows)))


def affected_regions(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("region").isNotNull() & (F.col("region") != "")).select("region").distinct()
