"""ML data operators and model jobs.

Data operators (folds, weights, level grouping, metrics over rule-based
predictions) have SQL oracles; model training/scoring queries are checked on
rows only.
"""

from __future__ import annotations

import uuid

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ridelens.functions import pround, weekday_name
from ridelens.ml import evaluate as EV
from ridelens.ml import folds as FD
from ridelens.ml import score as SC
from ridelens.ml import train as TR
from ridelens.ml.features import level_counts
from ridelens.plans.oracle_views import with_views
from ridelens.plans.q_region import region
from ridelens.plans.registry import register
from ridelens.plans.sqltext import pr
from ridelens.sources.driver_views import bookings_clean, locations
from ridelens.sources.files import persist_table

# ---------------------------------------------------------------------------
# folds and weights
# ---------------------------------------------------------------------------
# the seeded id hash of the folds, written out for DuckDB
_HASH = "CAST('0x' || substr(md5('42:' || CAST(booking_id AS VARCHAR)), 1, 8) AS BIGINT)"


@register("stratified_folds", with_views(
    """SELECT booking_id, booking_status, CAST(rk % (SELECT k FROM kk) AS INTEGER) AS fold FROM r""",
    f"""r AS (SELECT booking_id, booking_status,
                    row_number() OVER (PARTITION BY booking_status ORDER BY {_HASH}, CAST(booking_id AS VARCHAR)) - 1 AS rk
             FROM B_clean),
    kk AS (SELECT greatest(2, least(5, min(c))) AS k FROM (SELECT count(*) AS c FROM B_clean GROUP BY booking_status))"""))
def stratified_folds(spark, sf):
    b = bookings_clean(spark, sf).select("booking_id", "booking_status")
    return FD.stratified_folds(b, "booking_status", "booking_id")


@register("stratified_folds_text_id", with_views(
    """SELECT booking_id, booking_status, CAST(rk % 4 AS INTEGER) AS fold FROM r""",
    """t AS (SELECT 'CNR' || lpad(CAST(booking_id AS VARCHAR), 7, '0') AS booking_id, booking_status FROM B_clean),
    r AS (SELECT booking_id, booking_status, row_number() OVER (PARTITION BY booking_status
            ORDER BY CAST('0x' || substr(md5('7:' || booking_id), 1, 8) AS BIGINT), booking_id) - 1 AS rk FROM t)"""))
def stratified_folds_text_id(spark, sf):
    """Folds on text ids, with a seed and many hash ranges per class."""
    b = bookings_clean(spark, sf).select(
        F.concat(F.lit("CNR"), F.lpad(F.col("booking_id").cast("string"), 7, "0")).alias("booking_id"), "booking_status")
    return FD.stratified_folds(b, "booking_status", "booking_id", k=4, seed=7, rows_per_range=500)


@register("kfold_sizes", with_views(
    f"SELECT CAST({_HASH} % 3 AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n FROM B_clean GROUP BY 1"))
def kfold_sizes(spark, sf):
    """Shuffled 3-fold assignment by id hash: rows per fold."""
    b = FD.kfold(bookings_clean(spark, sf).select("booking_id"), "booking_id", 3)
    return b.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("class_weights", with_views(
    f"""SELECT booking_status, CAST(n AS BIGINT) AS n,
               {pr("CAST((SELECT sum(n) FROM c) AS DOUBLE) / (CAST((SELECT count(*) FROM c) AS DOUBLE) * CAST(n AS DOUBLE))", 6)} AS weight
        FROM c""",
    "c AS (SELECT booking_status, count(*) AS n FROM B_clean GROUP BY 1)"))
def class_weights(spark, sf):
    w = FD.class_weights(bookings_clean(spark, sf), "booking_status")
    return w.withColumn("weight", pround("weight", 6))


_LEVEL_COLS = ["vehicle_type", "payment_method", "pickup_location", "hour"]


@register("infrequent_levels", with_views(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS level, CAST(count(*) AS BIGINT) AS n,
                   count(*) < 0.04 * (SELECT count(*) FROM B_clean) AS is_infrequent
            FROM B_clean WHERE {c} IS NOT NULL GROUP BY {c}""" for c in _LEVEL_COLS)))
def infrequent_levels(spark, sf):
    return level_counts(bookings_clean(spark, sf), _LEVEL_COLS, min_frequency=0.04)


# ---------------------------------------------------------------------------
# metrics over rule-based predictions
# ---------------------------------------------------------------------------
_RULE_SQL = """CASE WHEN avg_vtat = 0 THEN 'No Driver Found' WHEN payment_method = 'No payment' THEN 'Cancelled by Driver'
                    WHEN ride_distance > 30 THEN 'Incomplete' ELSE 'Completed' END"""


def _rule_predictions(spark, sf):
    b = bookings_clean(spark, sf)
    pred = (F.when(F.col("avg_vtat") == 0, "No Driver Found")
            .when(F.col("payment_method") == "No payment", "Cancelled by Driver")
            .when(F.col("ride_distance") > 30, "Incomplete").otherwise("Completed"))
    return b.select(F.col("booking_status").alias("label"), pred.alias("prediction"))


_PRED_CTE = f"p AS (SELECT booking_status AS label, {_RULE_SQL} AS prediction FROM B_clean)"


@register("confusion_matrix", with_views(
    """SELECT a.c AS actual, b2.c AS predicted, CAST(COALESCE(x.n, 0) AS BIGINT) AS n
       FROM lab a CROSS JOIN lab b2 LEFT JOIN x ON x.label = a.c AND x.prediction = b2.c""",
    _PRED_CTE + """, lab AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
    x AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2)"""))
def confusion_matrix(spark, sf):
    return EV.confusion_matrix(_rule_predictions(spark, sf))


_CR_SQL = with_views(
    f"""
SELECT class, {pr("precision", 6)} AS precision, {pr("recall", 6)} AS recall, {pr("f1", 6)} AS f1,
       CAST(support AS BIGINT) AS support FROM per
UNION ALL SELECT 'accuracy', {pr("acc", 6)}, {pr("acc", 6)}, {pr("acc", 6)}, CAST(tot AS BIGINT)
          FROM (SELECT CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS acc, sum(support) AS tot FROM per)
UNION ALL SELECT 'macro avg', {pr("avg(precision)", 6)}, {pr("avg(recall)", 6)}, {pr("avg(f1)", 6)},
          CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', {pr("sum(precision * support) / sum(support)", 6)},
          {pr("sum(recall * support) / sum(support)", 6)}, {pr("sum(f1 * support) / sum(support)", 6)},
          CAST(sum(support) AS BIGINT) FROM per
""",
    _PRED_CTE + """, lab AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
    cnt AS (SELECT lab.c AS class,
                   (SELECT count(*) FROM p WHERE p.label = lab.c AND p.prediction = lab.c) AS tp,
                   (SELECT count(*) FROM p WHERE p.label = lab.c) AS support,
                   (SELECT count(*) FROM p WHERE p.prediction = lab.c) AS npred FROM lab),
    pr0 AS (SELECT class, tp, support,
                   CASE WHEN npred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(npred AS DOUBLE) END AS precision,
                   CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) END AS recall
            FROM cnt),
    per AS (SELECT class, tp, support, precision, recall,
                   CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
            FROM pr0)""")


@register("classification_report", _CR_SQL)
def classification_report(spark, sf):
    return EV.classification_report(_rule_predictions(spark, sf))


@register("regression_report", with_views(
    f"""SELECT {pr("avg((y - p) * (y - p))", 4)} AS mse, {pr("sqrt(avg((y - p) * (y - p)))", 4)} AS rmse,
               {pr("1.0 - sum((y - p) * (y - p)) / sum((y - (SELECT avg(y) FROM q)) * (y - (SELECT avg(y) FROM q)))", 6)} AS r2,
               {pr("avg(abs(y - p))", 4)} AS mae, CAST(count(*) AS BIGINT) AS n FROM q""",
    """q AS (SELECT booking_value AS y, 20 + ride_distance * CAST(15 AS DOUBLE) AS p FROM B_clean
            WHERE booking_status = 'Completed')"""))
def regression_report(spark, sf):
    b = bookings_clean(spark, sf).where(F.col("booking_status") == "Completed")
    p = b.select(F.col("booking_value").alias("label"),
                 (F.lit(20) + F.col("ride_distance") * F.lit(15.0)).alias("prediction"))
    r = EV.regression_report(p, digits=None)
    return r.select(pround("mse", 4).alias("mse"), pround("rmse", 4).alias("rmse"), pround("r2", 6).alias("r2"),
                    pround("mae", 4).alias("mae"), "n")


# ---------------------------------------------------------------------------
# model jobs – rows-only checks
# ---------------------------------------------------------------------------
@register("cv_leaderboard")
def cv_leaderboard(spark, sf):
    """Booking-value leaderboard: 5 regressors, 3-fold CV on the region table (M26); the forest's row names its depth."""
    return TR.value_leaderboard(region(spark, sf), rf_depth=16)


@register("oof_status_matrix")
def oof_status_matrix(spark, sf):
    """Out-of-fold confusion matrix of the balanced status model."""
    oof = TR.oof_status(region(spark, sf))
    return EV.confusion_matrix(oof)


@register("wait_time_cv")
def wait_time_cv(spark, sf):
    """Wait-time RF: 3-fold MAE / RMSE / R²."""
    return TR.wait_cv(bookings_clean(spark, sf))


@register("wait_holdout")
def wait_holdout(spark, sf):
    """Wait-time RF on an 80/20 hash split: MAE, RMSE, R² of the test side."""
    return TR.wait_holdout(bookings_clean(spark, sf))


@register("score_requests")
def score_requests(spark, sf):
    """Score every region booking as a request (M29–M31): predicted wait and value."""
    # derived once and spread, for both models, the history's modes and the requests
    hist = persist_table(TR.spread(region(spark, sf), "booking_id"), f"score_{uuid.uuid4().hex[:12]}_rows")
    wait_train, wait_stages = TR._wait_rows(hist, "booking_id")
    wait_model = TR.fit_spread([*wait_stages, TR.wait_estimator()], wait_train, "booking_id")
    wait_spec = SC.model_spec(hist, [c for c in wait_train.columns if c not in ("label", "booking_id")])
    vt = TR.value_frame(hist)
    value_model = TR.fit_spread([*TR.value_stages(vt), LinearRegression(labelCol="label")], vt, "booking_id")
    feats = TR.VALUE_STANDARD + TR.VALUE_ROBUST + TR.VALUE_MINMAX + TR.VALUE_ONEHOT
    value_spec = SC.model_spec(vt, feats)
    req = hist.select(
        F.col("booking_id").alias("request_id"), "pickup_location", "drop_location",
        weekday_name("weekday").alias("weekday"), "hour", "vehicle_type")
    out = SC.score_requests(req, hist, locations(spark, sf), wait_model, wait_spec, value_model, value_spec)
    return out.select("request_id", "pickup_location", "drop_location",
                      pround("predicted_wait_min", 4).alias("predicted_wait_min"), "wait_label",
                      pround("predicted_value", 4).alias("predicted_value"))


@register("status_cv_metrics")
def status_cv_metrics(spark, sf):
    """Balanced status model: accuracy and macro F1, mean ± std over stratified folds."""
    return TR.status_cv_metrics(TR.oof_status(region(spark, sf)))


@register("train_test_split_sizes", with_views(
    f"""SELECT CASE WHEN {_HASH} % 10000 < 2000 THEN 'test' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n
        FROM B_region GROUP BY 1"""))
def train_test_split_sizes(spark, sf):
    """80/20 hash split of the region table on the booking id: rows per side (M9), one pass."""
    side = F.when(FD.in_test("booking_id", 0.2, seed=42), "test").otherwise("train")
    return region(spark, sf).groupBy(side.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@register("value_holdout_ols")
def value_holdout_ols(spark, sf):
    """Booking-value OLS on an 80/20 hash split: MSE, RMSE, R², MAE on the test side."""
    return TR.value_holdout_ols(region(spark, sf))
