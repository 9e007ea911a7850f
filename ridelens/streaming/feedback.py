"""Feedback rows as a stream (S6, F9 on ``readStream`` input).

The reference appends one validated feedback row per form submit to an
external sheet. Here feedback arrives as files in a landing folder; a
Structured Streaming query validates every micro-batch with the same stateless
operator as the batch path and appends valid rows, either to a Parquet table (the file
sink plus the checkpoint give exactly-once appends across restarts and executor
loss) or to a batch table with a commit ledger, which also batch jobs append to; the cleaning operators are likewise stateless and run unchanged on
streaming input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.operators.clean import clean_bookings, validate_feedback
from ridelens.schemas import RAW_SCHEMA

FEEDBACK_INPUT_SCHEMA = T.StructType(
    [
        T.StructField("rating", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("email", T.StringType()),
    ]
)


def feedback_source(spark: SparkSession, landing: str, fmt: str = "parquet",
                    schema: T.StructType = FEEDBACK_INPUT_SCHEMA) -> DataFrame:
    """Streaming read of feedback files dropped into ``landing``."""
    r = spark.readStream.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    return r.format(fmt).load(landing)


def start_feedback_sink(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                        fmt: str = "parquet", available_now: bool = True):
    """Validate streaming feedback and append valid rows (stamped with the
    ingest time) to ``sink``; rejected rows go to ``sink + "_rejected"`` with
    their reason. Returns the two ``StreamingQuery`` handles."""
    rows = feedback_source(spark, landing, fmt)
    valid, rejected = validate_feedback(rows)
    stamped = valid.withColumn("timestamp", F.current_timestamp()).select("timestamp", "rating", "message", "email")
    trig = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    q1 = (stamped.writeStream.format("parquet").option("path", sink)
          .option("checkpointLocation", checkpoint.rstrip("/") + "/valid").outputMode("append")
          .trigger(**trig).start())
    q2 = (rejected.writeStream.format("parquet").option("path", sink.rstrip("/") + "_rejected")
          .option("checkpointLocation", checkpoint.rstrip("/") + "/rejected").outputMode("append")
          .trigger(**trig).start())
    return q1, q2


def start_feedback_batches(spark: SparkSession, landing: str, sink: str, checkpoint: str, name: str = "feedback",
                           fmt: str = "parquet", repeats_within: str = "1 hour", available_now: bool = True):
    """Append every micro-batch to the batch table ``sink`` once (see :mod:`ridelens.sources.batches`).

    A micro-batch that Spark repeats after a failure is staged again under the same batch id, and the ledger refuses it (it
    must not be skipped before: its rows pass the state). Feedback that is sent again (equal message and e-mail) is
    dropped with state under a watermark of ``repeats_within`` on the time of arrival. ``name`` keeps the batch ids of
    checkpoints apart: one name per checkpoint, a new one for a new checkpoint.
    """
    from ridelens.sources.batches import commit_batch, stage_batch

    valid, _ = validate_feedback(feedback_source(spark, landing, fmt))
    rows = valid.withColumn("timestamp", F.current_timestamp()).withWatermark("timestamp", repeats_within)
    rows = rows.dropDuplicatesWithinWatermark(["message", "email"])

    def append(batch: DataFrame, number: int) -> None:
        attempt = stage_batch(batch.select("timestamp", "rating", "message", "email"), sink, f"{name}-{number}")
        commit_batch(batch.sparkSession, sink, f"{name}-{number}", attempt)

    trig = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return (rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**trig).start())


def clean_stream(spark: SparkSession, landing: str, fmt: str = "csv") -> DataFrame:
    """Raw booking files arriving in ``landing`` → cleaned streaming rows."""
    r = spark.readStream.schema(RAW_SCHEMA)
    if fmt == "csv":
        r = r.option("header", True)
    return clean_bookings(r.format(fmt).load(landing))
