"""Loading text that is not as it should be, and what the loader reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.core import Query
from catalog.tables import Tables
from tallywatch.functions.scale import new_path, written
from tallywatch.operators import clean
from tallywatch.schema import RECORD_COLS
from tallywatch.sources import enrolment

RECORDS = "date state district pincode age_0_5:l age_5_17:l age_18_greater:l"


def _each(n: int, rest: int = 0):
    """Every n-th record."""
    return F.col("event_id") % n == rest


def _text_rows(t: Tables) -> DataFrame:
    """Records with the date as day-first text; `event_id` stays to plant defects by."""
    return t.enrol_events.withColumn("date", F.date_format("date", "dd-MM-yyyy"))


def _reordered(t: Tables) -> DataFrame:
    """Files of one folder that order their columns in two ways, one with a further column."""
    folder = new_path(t.spark, "csv-reordered")
    rows = _text_rows(t)
    usual = rows.where(~_each(3)).select(*RECORD_COLS)
    other = rows.where(_each(3)).select("age_18_greater", "event_id", *RECORD_COLS[-2::-1])
    for part in (usual, other):
        enrolment.write_csv(part, folder, mode="append")
    return enrolment.read_records(t.spark, folder)


def _mixed_dates(t: Tables) -> DataFrame:
    forms = ["dd-MM-yyyy", "yyyy/MM/dd", "d.M.yyyy", "dd-MMM-yyyy", "dd/MM/yy", "yyyy-MM-dd 00:00:00"]
    date = F.coalesce(
        *[F.when(_each(len(forms), i), F.date_format("date", f)) for i, f in enumerate(forms)]
    )
    path = new_path(t.spark, "csv-dates")
    rows = t.enrol_events.withColumn("date", date).select(*RECORD_COLS)
    return enrolment.read_records(t.spark, enrolment.write_csv(rows, path))


def _unparsed(t: Tables) -> DataFrame:
    date = (
        F.when(_each(11), "soon").when(_each(13), "31-02-2024").otherwise(F.col("date"))
    )
    rows = _text_rows(t).withColumn("date", date).select(*RECORD_COLS)
    path = enrolment.write_csv(rows, new_path(t.spark, "csv-unparsed"))
    return enrolment.unparsed_dates(t.spark, path)


def _defective(t: Tables) -> str:
    """A folder of lines, some cut short, some with words for counts or no date."""
    cells = {c: F.col(c).cast("string") for c in RECORD_COLS}
    cells["date"] = F.when(_each(23), "n/a").otherwise(F.col("date"))
    cells["age_0_5"] = F.when(_each(19), "many").otherwise(cells["age_0_5"])
    whole = F.concat_ws(",", *cells.values())
    line = F.when(_each(17), F.concat_ws(",", *list(cells.values())[:5])).otherwise(whole)
    # The first row of every partition brings the header of its file.
    is_first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.lit(",".join(RECORD_COLS) + "\n")
    lines = _text_rows(t).select(F.when(is_first, F.concat(header, line)).otherwise(line).alias("value"))
    path = new_path(t.spark, "csv-defective")
    lines.write.text(path)
    return path


def _validated(t: Tables) -> DataFrame:
    loaded = enrolment.load_checked(t.spark, _defective(t))
    return clean.validate_data(loaded.records, written(loaded.rejects, "rejects"))


_LINES = """
    SELECT event_id, date, state, district, pincode, age_5_17, age_18_greater, age_0_5,
           CASE WHEN event_id % 23 = 0 THEN 'n/a' ELSE strftime(date, '%d-%m-%Y') END AS text_date,
           CASE WHEN event_id % 19 = 0 THEN 'many' ELSE age_0_5::VARCHAR END AS text_age,
           event_id % 17 = 0 AS short
    FROM enrol_events"""
_REJECTED = f"""
    SELECT text_date || ',' || state || ',' || district || ',' || pincode || ',' || text_age
             || CASE WHEN short THEN '' ELSE ',' || age_5_17 || ',' || age_18_greater END AS line,
           concat_ws('; ', CASE WHEN short THEN 'wrong number of fields' END,
                     CASE WHEN text_age = 'many' THEN 'age_0_5 is not a whole number' END,
                     CASE WHEN text_date = 'n/a' THEN 'date not understood' END) AS reasons
    FROM ({_LINES}) AS l WHERE short OR text_age = 'many' OR text_date = 'n/a'"""

QUERIES = [
    Query("load_reordered_columns", RECORDS, _reordered, "SELECT * FROM enrol_events"),
    Query("load_mixed_date_forms", RECORDS, _mixed_dates, "SELECT * FROM enrol_events"),
    Query(
        "load_unparsed_dates",
        "date records:l",
        _unparsed,
        """
        SELECT CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE '31-02-2024' END AS date,
               count(*) AS records
        FROM enrol_events WHERE event_id % 11 = 0 OR event_id % 13 = 0 GROUP BY 1""",
    ),
    Query(
        "load_quarantine",
        "line reasons",
        lambda t: enrolment.load_checked(t.spark, _defective(t)).rejects.withColumn(
            "reasons", F.array_join("reasons", "; ")
        ),
        _REJECTED,
    ),
    Query(
        "load_without_rejects",
        RECORDS,
        lambda t: enrolment.load_checked(t.spark, _defective(t)).records,
        "SELECT * FROM enrol_events WHERE event_id % 17 > 0 AND event_id % 19 > 0 AND event_id % 23 > 0",
    ),
    Query(
        "validate_with_rejects",
        "record_count:l rejected_lines:l unparsed_dates:l is_valid",
        _validated,
        f"""
        SELECT (SELECT count(*) FROM enrol_events) - count(*) AS record_count,
               count(*) AS rejected_lines,
               count(*) FILTER (reasons LIKE '%date not understood%') AS unparsed_dates,
               true AS is_valid
        FROM ({_REJECTED}) AS r""",
    ),
]
