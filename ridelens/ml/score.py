"""Batch scoring of ride requests.

The reference scores one form row at a time; here a *table* of requests is
scored in one pass: geocode pickup/drop (broadcast-sized lookup, unknown → 0.0),
fill the remaining features with history modes and constants, align the columns
to what each fitted model was trained on, predict the wait, feed it to the value
model and label it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.functions import min_sec, month_to_num, parse_weekday, to_number
from ridelens.ml.features import NUMERIC_TYPES
from ridelens.operators.common import modes
from ridelens.operators.geo import file_order, geocode, location_lookup

# Defaults when the history has no usable value (reference scorer).
MODE_DEFAULTS = {"month": "January", "day": 1, "booking_status": "Completed", "payment_method": "UPI"}
CONSTANT_INPUTS = {"ride_distance": 0.0, "driver_rating": 0.0, "customer_rating": 0.0}
REASON_INPUTS = ["reason_for_cancelling_by_customer", "driver_cancellation_reason", "incomplete_rides_reason"]


def build_inputs(requests: DataFrame, history: DataFrame, locations: DataFrame) -> DataFrame:
    """Request rows → model input rows.

    History modes come from one stacked aggregate read as one scalar subquery; the
    geocoding joins use the reduced location lookup with default 0.0 (D15).
    """
    lk = location_lookup(locations, order_col=file_order(locations))
    df = geocode(geocode(requests, lk, "pickup_location", "pickup", 0.0), lk, "drop_location", "drop", 0.0)
    present = {c: d for c, d in MODE_DEFAULTS.items() if c in history.columns}
    cols = {c: F.lit(str(d)) for c, d in MODE_DEFAULTS.items() if c not in present}
    if present:
        m = modes(history, present).select(F.struct(*present)).scalar()  # one pass, one subquery
        cols.update({c: m[c] for c in present})
    for c, v in CONSTANT_INPUTS.items():
        cols[c] = F.lit(v)
    for c in REASON_INPUTS:
        cols[c] = F.lit(None).cast("string")
    return df.withColumns(cols)


def model_spec(train_df: DataFrame, features: list[str]) -> dict:
    """The feature list of a fitted model with each feature's training type."""
    types = {f.name: f.dataType.simpleString() for f in train_df.schema.fields}
    return {"features": [c for c in features if c in types], "types": {c: types[c] for c in features if c in types}}


def align_to_model(df: DataFrame, spec: dict, overrides: dict | None = None) -> DataFrame:
    """Give ``df`` exactly the model's feature columns with the training types.

    Missing features become NULL; ``overrides`` (column → Column) replace values;
    month / weekday names turn into numbers where the model was trained on
    numbers; other numeric features are coerced leniently, categorical ones cast
    to text.
    """
    out = {}
    for c in spec["features"]:
        t = spec["types"][c]
        src = (overrides or {}).get(c, F.col(c) if c in df.columns else F.lit(None))
        if t.startswith(NUMERIC_TYPES):
            if c == "month":
                v = F.coalesce(to_number(src), month_to_num(src).cast("double"))
            elif c == "weekday":
                v = parse_weekday(src).cast("double")
            else:
                v = to_number(src)
            out[c] = v.try_cast(t)
        else:
            out[c] = src.cast("string")
    return df.withColumns(out)


def save_scoring_model(model, spec: dict, path: str) -> None:
    """Persist a ``PipelineModel`` with its spec (JSON text written by Spark, so the
    path may be any shared file system)."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(
        path.rstrip("/") + "/ridelens_spec")


def load_scoring_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    spec = json.loads(spark.read.text(path.rstrip("/") + "/ridelens_spec").first()[0])
    return PipelineModel.load(path), spec


def score_requests(requests: DataFrame, history: DataFrame, locations: DataFrame,
                   wait_model, wait_spec: dict, value_model, value_spec: dict) -> DataFrame:
    """Chained scoring (M31): predicted wait → ``avg_vtat`` of the value model.

    Returns the request columns, the four coordinates, ``predicted_wait_min`` with
    its ``wait_minutes``/``wait_seconds``/``wait_label`` and ``predicted_value``.
    """
    base = build_inputs(requests, history, locations)
    keep = base.columns
    w = wait_model.transform(align_to_model(base, wait_spec)).select(
        *keep, F.col("prediction").alias("predicted_wait_min"))
    keep2 = keep + ["predicted_wait_min"]
    v_in = align_to_model(w, value_spec, overrides={"avg_vtat": F.col("predicted_wait_min")})
    v = value_model.transform(v_in).select(*keep2, F.col("prediction").alias("predicted_value"))
    ms = min_sec("predicted_wait_min")
    return v.withColumns({"wait_minutes": ms["minutes"], "wait_seconds": ms["seconds"], "wait_label": ms["label"]})
