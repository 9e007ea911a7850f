"""File sources and sinks, the parameterised SQL entry, model persistence."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.operators.clean import drop_index_columns, validate_feedback, with_ingest_time
from ridelens.schemas import LOCATION_SCHEMA, RAW_SCHEMA


NULL_TEXT = ("", "nan", "null", "none")  # how a table writer spells a missing value


def read_bookings(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  fmt: str = "csv") -> DataFrame:
    """Read a bookings table.

    CSV columns are taken by their header names: the file is read as text, the
    ``schema``'s columns (default: the raw bookings layout) are selected by name
    and converted leniently, so a leaked row-index column, another column order
    or extra columns do no harm. A column the file lacks is NULL; a value that
    does not convert is NULL and counted by :func:`csv_rejects`. No inference
    pass over the data. Parquet keeps its own schema and gets predicate/column
    pushdown; its leaked index columns are dropped.
    """
    if fmt == "parquet":
        return nan_to_null(drop_index_columns(spark.read.parquet(path)))
    text, schema = _csv_text(spark, path), schema or RAW_SCHEMA
    return nan_to_null(text.select(*[_converted(text, f).alias(f.name) for f in schema.fields]))


def _csv_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _present(text: DataFrame, f: T.StructField):
    """The field's text, with the spellings of a missing value as NULL."""
    if f.name not in text.columns:
        return F.lit(None).cast("string")
    c = F.col(f"`{f.name}`")
    return F.when(~F.lower(F.trim(c)).isin(*NULL_TEXT), c)


def _converted(text: DataFrame, f: T.StructField):
    c = _present(text, f)
    if isinstance(f.dataType, T.IntegralType):  # "3.0" is a whole number, too
        return F.coalesce(F.trim(c).try_cast(f.dataType), F.trim(c).try_cast("double").try_cast(f.dataType))
    return c if isinstance(f.dataType, T.StringType) else F.trim(c).try_cast(f.dataType)


def csv_rejects(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """(column_name, n_rejected): values of a CSV file that are there but do not convert to the schema's type."""
    text, schema = _csv_text(spark, path), schema or RAW_SCHEMA
    bad = [F.count_if(_present(text, f).isNotNull() & _converted(text, f).isNull()) for f in schema.fields]
    row = text.agg(F.array(*bad).alias("n"))
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    return row.select(F.posexplode("n").alias("i", "n_rejected")).select(
        F.get(names, F.col("i")).alias("column_name"), "n_rejected")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN → NULL in every float/double column (pandas writes missing numbers as
    NaN; Spark would otherwise order NaN above every value and count it)."""
    cols = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
            for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(cols) if cols else df


def read_locations(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a location dimension (``location, latitude, longitude``) with a ``_line``
    column that follows the file order, so :func:`ridelens.operators.geo.location_lookup`
    (``order_col="_line"``) reproduces "first match in the file wins".

    ``monotonically_increasing_id`` grows with the split order and, inside a
    split, with the row order – file order for a file read split by split.
    """
    df = read_bookings(spark, path, LOCATION_SCHEMA if fmt == "csv" else None, fmt)
    return df.withColumn("_line", F.monotonically_increasing_id())


def load_tables(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
                schemas: Mapping[str, T.StructType] | None = None, verify: bool = False) -> tuple[dict, dict]:
    """Open several named tables; collect failures instead of stopping.

    Returns ``(tables, failures)``. A missing path and a file whose footer or header cannot be read while the schema is
    made are failures; no rows are scanned. ``verify`` reads the footers of all files of a Parquet table (a distributed
    job per table), so that one broken file among many is found here and not by a later action.
    """
    tables, failures = {}, {}
    for name, path in paths.items():
        try:
            if verify and fmt == "parquet":
                _ = spark.read.option("mergeSchema", True).parquet(path).schema
            tables[name] = read_bookings(spark, path, (schemas or {}).get(name), fmt)
        except (PySparkException, Py4JJavaError) as e:  # noqa: PERF203
            failures[name] = f"{type(e).__name__}: {str(e).splitlines()[0]}" if not isinstance(
                e, AnalysisException) else str(e).splitlines()[0]
    return tables, failures


def sql_report(spark: SparkSession, sql: str, args: Mapping | None = None,
               views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run parameterised SQL over named temp views (S3).

    ``args`` are bound as named parameters (``:name``), including table names
    through ``IDENTIFIER(:name)``, so no SQL text is assembled from user input.
    """
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(args or {}))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a table (S4): Parquet by default, no index column, optional partitioning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def persist_table(df: DataFrame, name: str, partition_by: list[str] | None = None,
                  base: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder (or ``base``) and
    read it back – cuts the lineage so lost executors recompute from files."""
    from ridelens.session import scratch_path

    spark = df.sparkSession
    path = f"{base.rstrip('/')}/{name}" if base else scratch_path(spark, name)
    write_table(df, path, "parquet", partition_by=partition_by)
    return spark.read.parquet(path)


def read_persisted(spark: SparkSession, *names: str) -> DataFrame:
    """A table that :func:`persist_table` wrote in the shared folder, or several with the same columns as one."""
    from ridelens.session import scratch_path

    return spark.read.parquet(*[scratch_path(spark, name) for name in names])


def drop_tables(spark: SparkSession, names: list[str]) -> None:
    """Remove intermediate tables written by :func:`persist_table` in the shared folder."""
    from ridelens.session import scratch_path

    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_bucketed(df: DataFrame, table: str, key: str | list[str], buckets: int,
                   path: str | None = None, sort: bool = True) -> DataFrame:
    """Save ``df`` as a catalog table bucketed (and sorted) by ``key`` and return it.

    Two tables bucketed the same way on the join key join without an exchange
    on either side – the way to co-locate a repeatedly used fact ⋈ dimension
    join (e.g. events ⋈ customer on the user key) that is too big to broadcast.
    ``path`` places the data in shared storage (an external table).
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys)
    if sort:
        w = w.sortBy(*keys)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return df.sparkSession.table(table)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Persist the cleaned bookings table (S4), partitioned by month for pruning."""
    write_table(df, path, fmt, partition_by=["month"] if "month" in df.columns and fmt == "parquet" else None)


def export_csv(df: DataFrame, path: str) -> None:
    """Export a table as headered CSV part files."""
    write_table(df, path, "csv")


def append_feedback(df: DataFrame, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Validate feedback rows, stamp them and append the valid ones.

    Returns ``(valid, rejected)`` so callers can report rejections. Appending a
    directory never rewrites earlier part files; with CSV each part file carries
    its own header.
    """
    valid, rejected = validate_feedback(df)
    stamped = with_ingest_time(valid)
    write_table(stamped.select("timestamp", "rating", "message", "email"), path, fmt, mode="append")
    return valid, rejected


def append_feedback_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Validate the feedback rows of one batch and append the valid ones once, however often the batch is sent.

    False if the batch is there already. Read with :func:`read_feedback`.
    """
    from ridelens.sources.batches import append_batch

    valid, _ = validate_feedback(df)
    return append_batch(with_ingest_time(valid).select("timestamp", "rating", "message", "email"), path, batch)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The feedback of all committed batches."""
    from ridelens.schemas import FEEDBACK_SCHEMA
    from ridelens.sources.batches import read_batches

    return read_batches(spark, path, FEEDBACK_SCHEMA)


def save_model(model, path: str) -> None:
    """Persist a fitted ``PipelineModel``."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Reload a ``PipelineModel`` saved by :func:`save_model`."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def load_models(paths: Mapping[str, str]) -> tuple[dict, dict]:
    """Load several models, collecting failures instead of stopping (S2 for models)."""
    models, failures = {}, {}
    for name, path in paths.items():
        try:
            models[name] = load_model(path)
        except Exception as e:  # noqa: BLE001
            failures[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return models, failures
