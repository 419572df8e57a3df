"""Readers and writers.

CSV files are read with every column as a string under the names of their own
header: executors read the header lines, then one scan takes each cell by its
place in its file's header, so files whose columns differ in order or name never
borrow another file's header.  Cells are then cast with ``try``: a malformed cell becomes NULL
and can be counted instead of ending the job.  Only a path that does not exist
gives an empty frame; every other failure is raised.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segcast.session import ensure_checkpoint_dir, store

HOURLY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("crash_count", T.IntegerType()),
    T.StructField("speed", T.DoubleType()),
    T.StructField("historical_average_speed", T.DoubleType()),
    T.StructField("reference_speed", T.DoubleType()),
    T.StructField("npmrds", T.DoubleType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("is_weekend", T.IntegerType()),
])

FORECAST_SCHEMA = T.StructType([
    T.StructField("week_start", T.StringType()),
    T.StructField("lambda", T.DoubleType()),
    T.StructField("predicted_lower", T.IntegerType()),
    T.StructField("predicted_upper", T.IntegerType()),
    T.StructField("ci_method", T.StringType()),
    T.StructField("model_uncertainty", T.DoubleType()),
    T.StructField("residual_uncertainty", T.DoubleType()),
    T.StructField("total_uncertainty", T.DoubleType()),
    T.StructField("most_likely_crashes", T.IntegerType()),
    T.StructField("probability_pct", T.DoubleType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("prob_0_crash", T.DoubleType()),
    T.StructField("prob_1_crash", T.DoubleType()),
    T.StructField("prob_2_crash", T.DoubleType()),
    T.StructField("prob_3_crash", T.DoubleType()),
    T.StructField("prob_ge4_crash", T.DoubleType()),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
])

# Source headers of the event-record CSV and our column names.
EVENT_HEADERS = {
    "Route": "route",
    "Segment ID": "segment_id",
    "Year Of Crash": "year_of_crash",
    "Date of Crash": "date_of_crash",
    "Hit and Run": "hit_and_run",
}


HEADER_NAMES = {"NPMRDS2": "npmrds", "NPMRDS2 2021": "npmrds"}
METRIC_HEADERS = {"model": "model", "mae": "mae", "rmse": "rmse", "r²": "r2", "r2": "r2", "r^2": "r2", "mape": "mape"}
#: Hash bucket that the bucketed writer adds as partition column; readers leave it out.
BUCKET = "segment_bucket"


def parse_timestamp(c: Column) -> Column:
    """Lenient timestamp parse: ISO or ``M/d/yyyy``, with or without a time (mixed files, Q30); bad → NULL.

    A cheap look at the first characters picks the format, so a value is parsed
    once.  The result is a wall-clock ``timestamp_ntz``.  Parsing passes through
    the session time zone and back, which is the identity except for local times
    that do not exist in a DST zone; run wall-clock data with a UTC session
    (as ``session.get_spark`` does).
    """
    s = F.trim(c.cast("string"))
    timed, slashed = s.contains(":"), s.contains("/")
    parsed = (F.when(slashed & timed, F.try_to_timestamp(s, F.lit("M/d/yyyy H:mm")))
               .when(slashed, F.try_to_timestamp(s, F.lit("M/d/yyyy")))
               .when(timed, F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")))
               .otherwise(F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))))
    return parsed.cast("timestamp_ntz")


def lenient(c: Column, to: T.DataType) -> Column:
    """A text cell as ``to``; NULL if it is not one. Whole numbers may be written as 1.0."""
    c = F.trim(c)
    if isinstance(to, (T.IntegerType, T.LongType)):
        number = c.try_cast("double")
        return F.when(number == F.floor(number), F.floor(number).try_cast(to))
    return c.try_cast(to)


def _is_missing(e: AnalysisException) -> bool:
    return (e.getCondition() or "").startswith("PATH_NOT_FOUND")


#: Files below this size are read whole for their header, many to a task; of a longer file only the first lines are read.
SMALL_FILE = 1 << 20
#: Larger than any file, so that each longer file is one task, which may stop after its first line.
ONE_FILE = 1 << 36


def _first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The split's first line if the split begins its file; asks for two small batches at most, so a long file is not read through."""
    for n, batch in enumerate(batches):
        if n:
            return
        if batch.num_rows and batch["start"][0].as_py() == 0:
            yield batch.select(["file_path", "header"]).slice(0, 1)


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, header line) of every file with a line, read by the executors and stored; the driver opens no file.

    The pass over longer files runs in a session of its own, whose file settings give each file its own task.
    """
    probe = spark.newSession()
    for key, value in (("maxPartitionBytes", ONE_FILE), ("openCostInBytes", ONE_FILE), ("maxPartitionNum", (1 << 31) - 1)):
        probe.conf.set(f"spark.sql.files.{key}", str(value))
    probe.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")

    def lines(session: SparkSession, sizes: Column) -> DataFrame:  # the size prunes the list of files
        text = session.read.option("recursiveFileLookup", True).text(path).where(sizes)
        return text.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("header"),
                           F.col("_metadata.file_block_start").alias("start"))

    size, schema = F.col("_metadata.file_size"), "file_path string, header string"
    stored = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store/headers-{uuid.uuid4().hex}"
    place = F.struct("start", F.monotonically_increasing_id().alias("line"))
    small = lines(spark, size < SMALL_FILE).withColumn("place", place).groupBy("file_path").agg(
        F.min_by("header", "place").alias("header"))
    small.write.parquet(stored)
    lines(probe, size >= SMALL_FILE).mapInArrow(_first_line, schema).hint("rebalance").write.mode("append").parquet(stored)
    return spark.read.schema(schema).parquet(stored)


def read_csv(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """All CSV files under ``path``, each by its own header, columns as strings; missing columns are NULL.

    ``names`` maps source headers to canonical ones (any case). The column ``file_path`` names the source.  One
    scan reads every file by position; the driver sees the different header lines only.  If there are several,
    the scan is joined with the (file, header) table and each column is taken from its place in that header:
    Spark broadcasts that table while it is small by its stored size (some 10⁵ files) and shuffles beyond.
    Of columns with the same name in a header the first counts.
    """
    headers = _headers(spark, path)
    lines = sorted(r["header"] for r in headers.select("header").distinct().collect())
    rename = {k.lower(): v for k, v in (names or {}).items()}
    spelled: dict[str, str] = {}  # lower-case name -> the spelling that comes first
    places: list[dict[str, int]] = []
    for line in lines:
        at: dict[str, int] = {}
        for i, cell in enumerate(next(csv.reader([line.lstrip("\ufeff")]), [])):
            name = rename.get(cell.strip().lower(), cell.strip())
            spelled.setdefault(name.lower(), name)
            at.setdefault(name.lower(), i)
        places.append(at)
    width = max((i + 1 for at in places for i in at.values()), default=0)
    if not width:
        return spark.createDataFrame([], "file_path string")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    cells = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    cells = cells.select("*", F.col("_metadata.file_path").alias("file_path"))
    if len(lines) > 1:
        number = F.array_position(F.array(*[F.lit(line) for line in lines]), F.col("header")).alias("header_no")
        cells = cells.join(headers.select("file_path", number), "file_path")

    def column(name: str) -> Column:
        at = [(n + 1, where[name]) for n, where in enumerate(places) if name in where]
        if len(at) == len(lines) and len({i for _, i in at}) == 1:
            return F.col(f"c{at[0][1]}")
        out = F.lit(None).cast("string")
        for i in sorted({i for _, i in at}):
            out = F.when(F.col("header_no").isin([n for n, j in at if i == j]), F.col(f"c{i}")).otherwise(out)
        return out

    return cells.select(*[column(k).alias(v) for k, v in spelled.items()], "file_path")


def _hourly_columns(df: DataFrame, bad_cells: str | None) -> list[Column]:
    """The hourly columns of a string frame, and on request the number of cells that hold no valid value."""
    def of(name: str) -> Column:
        return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")

    made = {f.name: parse_timestamp(of(f.name)) if f.name == "timestamp" else lenient(of(f.name), f.dataType)
            for f in HOURLY_SCHEMA.fields}
    cols = [c.alias(n) for n, c in made.items()]
    if bad_cells is not None:
        bad = [(F.coalesce(F.trim(of(n)), F.lit("")) != "") & c.isNull() for n, c in made.items()]
        cols.append(sum((b.cast("int") for b in bad[1:]), bad[0].cast("int")).alias(bad_cells))
    return cols


def read_hourly(spark: SparkSession, path: str, column_map: dict[str, str] | None = None,
                segment_id: str | None = None, bad_cells: str | None = None) -> DataFrame:
    """CSV scan of hourly observations with a source→canonical column mapping.

    ``bad_cells`` names a column that counts a row's malformed cells.
    """
    df = read_csv(spark, path, column_map or HEADER_NAMES)
    cols = _hourly_columns(df, bad_cells)
    if segment_id is not None:
        cols.insert(0, F.lit(segment_id).alias("segment_id"))
    return df.select(*cols)


def read_segments(spark: SparkSession, glob: str, registry: DataFrame | None = None,
                  pattern: str = r"([^/]+?)_traffic_crash_merged\.csv$",
                  column_map: dict[str, str] | None = None, bad_cells: str | None = None) -> DataFrame:
    """Many per-segment files → one panel; id from the file name, optionally mapped via a registry.

    One scan for each different header; the file path carries the source of each
    row.  The registry is a small dimension, joined by key.
    """
    df = read_csv(spark, glob, column_map or HEADER_NAMES)
    code = F.regexp_extract("file_path", pattern, 1)
    out = df.select(code.alias("route_segment"), *_hourly_columns(df, bad_cells))
    if registry is None:
        return out.withColumnRenamed("route_segment", "segment_id")
    return out.join(registry, "route_segment", "left").select(
        F.coalesce("segment_id", "route_segment").alias("segment_id"), *[c for c in out.columns if c != "route_segment"])


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """S3: forecast CSV with mixed date formats; a missing path yields an empty frame."""
    def typed(f: T.StructField, c: Column) -> Column:
        return (F.to_date(parse_timestamp(c)) if f.name == "week_start" else lenient(c, f.dataType)).alias(f.name)

    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        schema = T.StructType([T.StructField(f.name, T.DateType() if f.name == "week_start" else f.dataType)
                               for f in FORECAST_SCHEMA.fields] + [T.StructField("segment_id", T.StringType())])
        return spark.createDataFrame([], schema)
    df = df.withColumnsRenamed({"probability_%": "probability_pct"})
    known = set(FORECAST_SCHEMA.fieldNames()) | {BUCKET}
    cols = [typed(f, F.col(f.name)) for f in FORECAST_SCHEMA.fields if f.name in df.columns]
    return df.select(*cols, *[F.col(c) for c in df.columns if c not in known])


def read_weekly_history(spark: SparkSession, path: str) -> DataFrame:
    """Weekly history; an absent path gives an empty (week_start, total_crashes)."""
    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        return spark.createDataFrame([], "week_start date, total_crashes double")
    return df.select(F.to_date(parse_timestamp(F.col("week_start"))).alias("week_start"),
                     lenient(F.col("total_crashes"), T.DoubleType()).alias("total_crashes"),
                     *[F.col(c) for c in df.columns if c not in ("week_start", "total_crashes", BUCKET)])


def read_event_records(spark: SparkSession, path: str) -> DataFrame:
    """Event-record CSV; headers with spaces → snake_case, light column found by name (Q18)."""
    df = spark.read.option("header", True).csv(path)
    light = next((c for c in df.columns if "light" in c.lower()), None)
    ren = dict(EVENT_HEADERS)
    if light is not None:
        ren[light] = "light_condition"
    df = df.withColumnsRenamed(ren)
    if "year_of_crash" in df.columns:
        df = df.withColumn("year_of_crash", F.col("year_of_crash").cast("int"))
    return df


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Two-row metrics CSV (``Model, MAE, RMSE, R²`` in any order) → lower-case typed columns."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumnsRenamed({c: METRIC_HEADERS[c.strip().lower()] for c in df.columns if c.strip().lower() in METRIC_HEADERS})
    return df.select(F.col("model"), *[lenient(F.col(c), T.DoubleType()).alias(c)
                                       for c in ("mae", "rmse", "r2", "mape") if c in df.columns])


def write_partitioned(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                      segment: str = "segment_id", buckets: int = 64, directory_per_segment: bool = False) -> None:
    """Weekly panel / forecast / metrics, one directory per hash bucket of segments.

    The number of directories does not grow with the segments, and a segment's
    rows stay together.  ``directory_per_segment`` gives the reference's layout,
    for panels with few segments.
    """
    if directory_per_segment:
        df.repartition(segment).write.mode(mode).partitionBy(segment).format(fmt).option("header", True).save(path)
        return
    _write_buckets(df.withColumn(BUCKET, _bucket(segment, buckets)), path, fmt, mode)


def _bucket(segment: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(segment), F.lit(buckets)).cast("int")


def _write_buckets(bucketed: DataFrame, path: str, fmt: str, mode: str, overwrite: str = "static") -> None:
    (bucketed.repartition(BUCKET).write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy(BUCKET)
             .format(fmt).option("header", True).save(path))


def replace_segments(df: DataFrame, path: str, fmt: str = "parquet", segment: str = "segment_id", buckets: int = 64) -> None:
    """S7 for a re-run: the segments of ``df`` take the place of their earlier rows under ``path``.

    Only the hash buckets of those segments are read and written (dynamic partition overwrite); the files of all
    other buckets stay as they are.  The merged rows are stored under the checkpoint folder before anything is
    replaced.  ``buckets`` and the columns must be those of ``write_partitioned``; another bucket count is an error.
    Nothing written yet: a first write.  A segment without rows in ``df`` keeps its earlier ones.
    """
    new = store(df.withColumn(BUCKET, _bucket(segment, buckets)), "replacement")
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    try:
        old = new.sparkSession.read.schema(new.schema).format(fmt).option("header", True).load(path)
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        _write_buckets(new, path, fmt, "overwrite")
        return
    placed = F.when(F.col(BUCKET) == _bucket(segment, buckets), F.col(BUCKET)).otherwise(
        F.raise_error(F.lit(f"{path} was not written with {buckets} buckets")))
    here = new.select(F.col(segment).alias("_new")).distinct()
    kept = (old.where(F.col(BUCKET).isin(touched)).withColumn(BUCKET, placed)
               .join(here, F.col(segment).eqNullSafe(F.col("_new")), "left_anti"))
    _write_buckets(store(kept.unionByName(new), "merged-buckets"), path, fmt, "overwrite", "dynamic")


def write_summary(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Summary table, one row per segment, as CSV with header; as many files as the plan has tasks."""
    df.write.mode(mode).option("header", True).csv(path)


def export_display_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Formatted display table to CSV with header."""
    df.write.mode(mode).option("header", True).csv(path)


def profile(df: DataFrame, segment: str = "segment_id", ts: str = "timestamp", count: str = "crash_count") -> DataFrame:
    """One aggregation pass: rows, time range, event total and distinct hours per segment."""
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.sum(count).cast("bigint").alias("n_events"),
        F.count_distinct("hour").alias("n_hours"),
    )


def event_profile(df: DataFrame) -> DataFrame:
    """S10 for event records: rows, columns, distinct routes, years and segments, and the flag values, in one pass."""
    values = F.array_join(F.array_sort(F.collect_set(F.coalesce("hit_and_run", F.lit("")))), ",")  # a flag has few values
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                  F.count_distinct("route").alias("n_routes"), F.count_distinct("segment_id").alias("n_segments"),
                  F.count_distinct("year_of_crash").alias("n_years"), F.min("year_of_crash").alias("first_year"),
                  F.max("year_of_crash").alias("last_year"), values.alias("flag_values"))
