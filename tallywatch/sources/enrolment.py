"""Reading enrolment records from CSV and writing results."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.functions.columns import age_total
from tallywatch.schema import AGE_COLS, CSV_SCHEMA, KEY_COLS

DATE_FORMATS = ("d-M-yyyy", "yyyy-M-d", "d-M-yy", "d-MMM-yyyy", "d-MMM-yy")
HEADER_THREADS = 16
_TIME = r"[ T]+\d{1,2}:\d{2}.*$"


def parse_date(text: Column) -> Column:
    """Day-first or year-first dates; NULL for anything else.

    Parts may be cut by `-`, `/`, `.` or spaces, months may be English short
    names, and a time of day is left out.
    """
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, _TIME, "")), r"[/.\s]+", "-")
    return F.coalesce(*[F.try_to_date(plain, f) for f in DATE_FORMATS])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works for any file system that Spark reads, not just local disk."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The column names in a file's first line, of any store and compression Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        plain = codec.createInputStream(stream) if codec else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
        line = reader.readLine()
    finally:
        stream.close()
    if not line or not line.strip():
        return ()
    return tuple(name.strip() for name in next(csv.reader([line.lstrip("\ufeff")])))


def _by_header(spark: SparkSession, paths: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files behind `paths` by their column names; files without a line are left out."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = sorted(spark.read.text(paths).inputFiles())
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        headers = list(pool.map(lambda f: _header(spark, f), files))
    found: dict[tuple[str, ...], list[str]] = {}
    for file, names in zip(files, headers, strict=True):
        if names:
            found.setdefault(names, []).append(unquote(file))
    return found


def _scan(spark: SparkSession, names: Sequence[str], files: list[str], mode: str) -> DataFrame:
    """Typed rows of files that share a header; kept lines that do not fit are in `_line`."""
    kinds = {f.name: f.dataType for f in CSV_SCHEMA}
    fields = [T.StructField(n, kinds.get(n, T.StringType())) for n in names]
    reader = spark.read.option("header", True).option("mode", mode)
    if mode == "PERMISSIVE":
        fields.append(T.StructField("_line", T.StringType()))
        # All columns are parsed, or a misfit in one that is not asked for would go unseen.
        reader = reader.option("columnNameOfCorruptRecord", "_line").option("columnPruning", False)
    return reader.schema(T.StructType(fields)).csv(files)


def read_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV columns by header name, the date as it stands, of files or folders.

    Every file may order its columns in its own way; files with the same order
    are one scan. Columns that records do not have are left out. A line that
    does not fit ends the read: `load_checked` sets such lines aside.
    """
    out = None
    for names, files in _by_header(spark, paths).items():
        missing = [f.name for f in CSV_SCHEMA if f.name not in names]
        if missing:
            raise ValueError(f"{files[0]} has no column {', '.join(missing)}")
        part = _scan(spark, names, files, "FAILFAST").select(*[f.name for f in CSV_SCHEMA])
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], CSV_SCHEMA) if out is None else out


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Typed CSV read of one or more files or folders."""
    return read_text(spark, paths).withColumn("date", parse_date(F.col("date")))


def unparsed_dates(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(date, records): the date texts that `read_records` makes NULL, and how often."""
    text = F.col("date")
    lost = read_text(spark, paths).where(text.isNotNull() & parse_date(text).isNull())
    return lost.groupBy("date").agg(F.count("*").alias("records"))


REJECT_SCHEMA = "file string, line string, reasons array<string>"


@dataclass(frozen=True)
class Loaded:
    """`records` as `read_records` types them, and `rejects` (file, line, reasons)."""

    records: DataFrame
    rejects: DataFrame


def _checked(part: DataFrame, names: Sequence[str]) -> DataFrame:
    """`part` with its reasons for rejection; none for a line that fits.

    Lines that Spark could not type are cut once more as text, to say what is wrong.
    """
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    text = F.from_csv("_line", f"{cells}, wrong string", {"columnNameOfCorruptRecord": "wrong"})
    reasons = [F.when(F.col("_cells.wrong").isNotNull(), F.lit("wrong number of fields"))]
    for c in AGE_COLS:
        cell = f"_cells.c{list(names).index(c)}"
        # Asking for the typed column makes Spark type it, whatever is read of the records.
        misfit = F.expr(f"{c} IS NULL AND {cell} IS NOT NULL AND try_cast(trim({cell}) AS bigint) IS NULL")
        reasons.append(F.when(misfit, F.lit(f"{c} is not a whole number")))
    date = F.col("date")
    unread = date.isNotNull() & parse_date(date).isNull()
    reasons.append(F.when(unread, F.lit("date not understood")))
    found = part.withColumn("_cells", F.when(F.col("_line").isNotNull(), text)).withColumn(
        "_reasons", F.array_compact(F.array(*reasons))
    )
    unknown = (F.size("_reasons") == 0) & F.col("_line").isNotNull()
    return found.withColumn(
        "_reasons", F.when(unknown, F.array(F.lit("does not fit"))).otherwise(F.col("_reasons"))
    )


def load_checked(spark: SparkSession, paths: str | Sequence[str]) -> Loaded:
    """Records that fit, and the lines that do not, each with its file and reasons.

    Reasons are a wrong number of fields, counts that are not whole numbers,
    date texts that are not understood, and columns that a file lacks; such a
    file's lines are all rejects. An empty date or count is missing, not wrong.
    Line breaks inside quotes are not supported. A reject of a wrong date alone
    is given as its cells joined by commas. Each table scans the files when it
    is used.
    """
    names = [f.name for f in CSV_SCHEMA]
    records = rejects = None
    for header, files in _by_header(spark, paths).items():
        missing = [c for c in names if c not in header]
        if missing:
            lines = spark.read.text(files).select(
                F.col("_metadata.file_path").alias("file"),
                F.col("value").alias("line"),
                F.array(*[F.lit(f"no column {c}") for c in missing]).alias("reasons"),
            )
            # The header is not a record.
            cells = F.split(F.trim(F.regexp_replace("line", "[\ufeff\"]", "")), r"\s*,\s*")
            is_record = (F.array_join(cells, ",") != ",".join(header)) & (F.trim("line") != "")
            bad = lines.where(is_record)
        else:
            part = _scan(spark, header, files, "PERMISSIVE")
            part = _checked(part.withColumn("_file", F.col("_metadata.file_path")), header)
            good = part.where(F.size("_reasons") == 0).select(*names)
            texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in header]
            cells = F.concat_ws(",", *texts)
            bad = part.where(F.size("_reasons") > 0).select(
                F.col("_file").alias("file"),
                F.coalesce("_line", cells).alias("line"),
                F.col("_reasons").alias("reasons"),
            )
            records = good if records is None else records.unionAll(good)
        rejects = bad if rejects is None else rejects.unionAll(bad)
    if records is None:
        records = spark.createDataFrame([], CSV_SCHEMA)
    if rejects is None:
        rejects = spark.createDataFrame([], REJECT_SCHEMA)
    return Loaded(records.withColumn("date", parse_date(F.col("date"))), rejects)


def load_all(
    spark: SparkSession,
    data_dir: str,
    names: Sequence[str],
    fallback_dir: str | None = None,
    rejects_path: str | None = None,
) -> DataFrame:
    """All rows of the named parts that exist.

    Falls back to another folder if the first is missing, and warns of parts
    that are. With `rejects_path`, lines that do not fit are written there as
    Parquet, with their reasons, and the load goes on; else they end it. Rows
    carry no global order: a consumer that needs one sorts, others are spared
    the shuffle.
    """
    if not path_exists(spark, data_dir) and fallback_dir is not None:
        data_dir = fallback_dir
    parts = [f"{data_dir.rstrip('/')}/{name}" for name in names]
    found = [p for p in parts if path_exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"No data files found in {data_dir}")
    if skipped := [p for p in parts if p not in found]:
        warnings.warn(f"skipped, not found: {', '.join(skipped)}", stacklevel=2)
    if rejects_path is None:
        return read_records(spark, found)
    loaded = load_checked(spark, found)
    loaded.rejects.write.mode("append").parquet(rejects_path)
    return loaded.records


def data_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of counts, date range, band sums and statistics of the row total.

    Records are summed per (state, district, pincode) first, and the distinct
    values counted among these; `approximate` estimates their number. Sums of
    squares are exact decimals, and only what is left of them beside the nearest
    whole mean becomes a double, so large totals that hardly differ keep their deviation.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    total = age_total()
    whole = total.cast("decimal(19,0)")
    places = df.groupBy("state", "district", "pincode").agg(
        F.count("*").alias("records"),
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
        *[F.sum(c).alias(c) for c in AGE_COLS],
        F.count(total).alias("totals"),
        F.sum(total).alias("total_enrolments"),
        F.sum(whole * whole).alias("squares"),
        F.min(total).alias("min_total"),
        F.max(total).alias("max_total"),
    )
    n, mean = F.col("totals"), F.col("total_enrolments") / F.nullif(F.col("totals"), F.lit(0))
    center = F.rint(mean).cast("decimal(19,0)")
    sum_, count = (F.col(c).cast("decimal(19,0)") for c in ("total_enrolments", "totals"))
    around = F.col("squares") - 2 * center * sum_ + count * center * center
    shift = (sum_ - count * center).cast("double")
    spread = F.greatest(around.cast("double") - shift * shift / n, F.lit(0.0))
    deviation = F.sqrt(spread / F.nullif(n - 1, F.lit(0)))
    sums = places.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        F.min("date_start").alias("date_start"),
        F.max("date_end").alias("date_end"),
        distinct("state").alias("states"),
        distinct("district").alias("districts"),
        distinct("pincode").alias("pincodes"),
        *[F.sum(c).alias(c) for c in (*AGE_COLS, "totals", "total_enrolments", "squares")],
        F.min("min_total").alias("min_total"),
        F.max("max_total").alias("max_total"),
    )
    return sums.select(
        "total_records",
        "date_start",
        "date_end",
        "states",
        "districts",
        "pincodes",
        *AGE_COLS,
        "total_enrolments",
        mean.alias("mean_total"),
        F.when(n > 1, deviation).alias("std_total"),
        "min_total",
        "max_total",
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write a result as a folder of CSV parts, one per task."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_parquet(
    df: DataFrame, path: str, partition_cols: Sequence[str] = (), mode: str = "errorifexists"
) -> str:
    writer = df.write.mode(mode)
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
    return path
