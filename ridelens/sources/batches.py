"""Appends that happen once: a table of batches with a commit ledger.

Layout under one folder:

    data/batch=<id>/attempt=<unique>/part-*.parquet      rows, written by any number of attempts
    commits/<hash of the id>                             one small file per batch, naming the attempt that counts

A writer stages its rows under an attempt of its own and commits by *creating* the batch's ledger file, which the file
system refuses if it exists (``create`` without overwrite; the folder must be on a file system on which that is atomic, such
as HDFS). So a batch sent twice, two writers of one batch, a writer that dies before its commit and its retry all
give the rows once. Readers go by the ledger: the data is joined with the committed (batch, attempt) pairs, which are also the
partition columns, so Spark skips the folders of attempts that do not count.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _file(spark: SparkSession, path: str):
    """(Hadoop file system, path) of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _ledger_file(spark: SparkSession, folder: str, batch: str):
    name = hashlib.sha256(batch.encode()).hexdigest()
    return _file(spark, f"{folder.rstrip('/')}/commits/{name}")


def is_committed(spark: SparkSession, folder: str, batch: str) -> bool:
    fs, p = _ledger_file(spark, folder, str(batch))
    return fs.exists(p)


def stage_batch(df: DataFrame, folder: str, batch: str) -> str:
    """Write the rows under a new attempt; returns its name. Nobody reads them before :func:`commit_batch`."""
    attempt = uuid.uuid4().hex
    named = df.withColumns({"batch": F.lit(str(batch)), "attempt": F.lit(attempt)})
    named.write.mode("append").partitionBy("batch", "attempt").parquet(f"{folder.rstrip('/')}/data")
    return attempt


def commit_batch(spark: SparkSession, folder: str, batch: str, attempt: str) -> bool:
    """Make ``attempt`` the one that counts; False if another one already does."""
    fs, p = _ledger_file(spark, folder, str(batch))
    fs.mkdirs(p.getParent())
    text = json.dumps({"batch": str(batch), "attempt": attempt})
    # the whole line stands under a hidden name before the ledger's name appears; a rename that finds its target fails
    hidden = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{attempt}")
    out = fs.create(hidden, False)
    out.write(bytearray((text + "\n").encode()))
    out.close()
    mine = not fs.exists(p) and fs.rename(hidden, p)
    if fs.exists(hidden):
        fs.delete(hidden, False)
    return bool(mine)


def append_batch(df: DataFrame, folder: str, batch: str) -> bool:
    """Append the rows of ``batch`` once; False if the batch is there already (nothing is written or read then)."""
    spark = df.sparkSession
    if is_committed(spark, folder, batch):
        return False
    return commit_batch(spark, folder, batch, stage_batch(df, folder, batch))


LEDGER_SCHEMA = T.StructType([T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())])


def read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The committed rows (``schema`` and ``batch``); an empty frame if nothing was committed yet."""
    base = folder.rstrip("/")
    fs, commits = _file(spark, f"{base}/commits")
    if not fs.exists(commits) or not fs.listStatus(commits):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.StringType())]))
    ledger = spark.read.schema(LEDGER_SCHEMA).json(f"{base}/commits").withColumnsRenamed({"batch": "b_", "attempt": "a_"})
    full = T.StructType([*schema.fields, *LEDGER_SCHEMA.fields])
    rows = spark.read.schema(full).parquet(f"{base}/data")
    counts = (F.col("batch") == F.col("b_")) & (F.col("attempt") == F.col("a_"))
    return rows.join(ledger, counts, "left_semi").drop("attempt")


def drop_stale_attempts(spark: SparkSession, folder: str) -> int:
    """Remove the rows of attempts that do not count, of batches that are committed; returns their number."""
    base = folder.rstrip("/")
    try:
        ledger = spark.read.schema(LEDGER_SCHEMA).json(f"{base}/commits")
    except AnalysisException:
        return 0
    gone = 0
    for batch, attempt in ledger.toLocalIterator():
        # the folder's name is written by Spark, which escapes some characters
        fs, data = _file(spark, f"{base}/data")
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)
        own = spark._jvm.org.apache.hadoop.fs.Path(data, f"batch={escaped}")
        for status in fs.listStatus(own) if fs.exists(own) else []:
            if status.getPath().getName() != f"attempt={attempt}":
                gone += bool(fs.delete(status.getPath(), True))
    return gone
