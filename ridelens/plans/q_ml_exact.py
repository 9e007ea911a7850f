"""Model operators on problems whose answer SQL can state.

Scaled, encoded and imputed columns are compared value by value; linear models have one feature, so
their closed forms are the oracle; tree models learn a label that is an exact function of a few levels,
so their predictions must equal it.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ridelens.functions import pround, weekday_name
from ridelens.ml import evaluate as EV
from ridelens.ml import folds as FD
from ridelens.ml import score as SC
from ridelens.ml import train as TR
from ridelens.ml.features import preprocessor
from ridelens.plans.oracle_views import with_views
from ridelens.plans.q_region import region
from ridelens.plans.registry import register
from ridelens.plans.sqltext import pr
from ridelens.sources.driver_views import bookings, bookings_clean, locations


# ---------------------------------------------------------------------------
# feature columns (M1–M6)
# ---------------------------------------------------------------------------
@register("scaled_features", with_views(
    f"""SELECT booking_id, {pr('(avg_vtat - m) / s', 6)} AS wait_std, {pr('(ride_distance - q2) / (q3 - q1)', 6)} AS dist_robust,
               {pr('(driver_rating - lo) / (hi - lo)', 6)} AS rating_minmax
        FROM B_clean, st""",
    """st AS (SELECT avg(avg_vtat) AS m, stddev_samp(avg_vtat) AS s, quantile_disc(ride_distance, 0.25) AS q1,
                     quantile_disc(ride_distance, 0.5) AS q2, quantile_disc(ride_distance, 0.75) AS q3,
                     min(driver_rating) AS lo, max(driver_rating) AS hi FROM B_clean)"""))
def scaled_features(spark, sf):
    """Standard, robust (exact quantiles) and min-max scaling (M1–M3)."""
    b = bookings_clean(spark, sf).select("booking_id", "avg_vtat", "ride_distance", "driver_rating")
    stages = preprocessor(standard=["avg_vtat"], robust=["ride_distance"], minmax=["driver_rating"], relative_error=0.0)
    v = vector_to_array("features")
    out = Pipeline(stages=stages).fit(b).transform(b)
    return out.select("booking_id", *[pround(v[i], 6).alias(n) for i, n in enumerate(
        ("wait_std", "dist_robust", "rating_minmax"))])


@register("encoded_levels", with_views(
    """SELECT booking_id, CASE WHEN B_clean.vehicle_type = 'Bike' THEN 0 ELSE 1 END AS n_set,
              CASE WHEN B_clean.vehicle_type <> 'Bike' THEN CAST(p.pos AS INTEGER) ELSE -1 END AS slot
       FROM B_clean LEFT JOIN p ON p.vehicle_type = B_clean.vehicle_type""",
    """c AS (SELECT vehicle_type, CASE WHEN count(*) < 0.16 * (SELECT count(*) FROM B_clean WHERE vehicle_type <> 'Bike')
                    THEN '__infrequent__' ELSE vehicle_type END AS level
             FROM B_clean WHERE vehicle_type <> 'Bike' GROUP BY vehicle_type),
    slots AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS pos FROM (SELECT DISTINCT level FROM c)),
    p AS (SELECT c.vehicle_type, slots.pos FROM c JOIN slots USING (level))"""))
def encoded_levels(spark, sf):
    """One-hot slots with rare levels grouped; a level that training never saw is the zero vector (M4, M5)."""
    b = bookings_clean(spark, sf).select("booking_id", "vehicle_type")
    m = Pipeline(stages=preprocessor(onehot=["vehicle_type"], min_frequency=0.16)).fit(b.where("vehicle_type <> 'Bike'"))
    v = vector_to_array("features")
    return m.transform(b).select("booking_id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).cast("int").alias("n_set"),
                                 (F.array_position(v, F.lit(1.0)) - 1).cast("int").alias("slot"))


@register("imputed_features", with_views(
    """SELECT booking_id, COALESCE(avg_vtat, m) AS wait, CAST(p.pos AS INTEGER) AS payment_slot
       FROM B, st LEFT JOIN p ON p.payment = COALESCE(B.payment_method, st.mode)""",
    """st AS (SELECT quantile_disc(avg_vtat, 0.5) AS m,
                     (SELECT payment_method FROM B WHERE payment_method IS NOT NULL GROUP BY 1
                      ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM B),
    p AS (SELECT payment, row_number() OVER (ORDER BY payment) - 1 AS pos
          FROM (SELECT DISTINCT payment_method AS payment FROM B WHERE payment_method IS NOT NULL))"""))
def imputed_features(spark, sf):
    """Median imputation of numbers and mode imputation of categories (M6, M8)."""
    b = bookings(spark, sf).select("booking_id", "avg_vtat", "payment_method")
    stages = preprocessor(passthrough=["avg_vtat"], onehot=["payment_method"], impute_numeric=["avg_vtat"],
                          impute_categorical=True, relative_error=0.0)
    v = vector_to_array("features")
    out = Pipeline(stages=stages).fit(b).transform(b)
    return out.select("booking_id", v[0].alias("wait"),
                      (F.array_position(F.slice(v, 2, 100), F.lit(1.0)) - 1).cast("int").alias("payment_slot"))


@register("exact_scaled_imputed", with_views(
    f"""SELECT booking_id, {pr('(COALESCE(avg_vtat, m1) - m1) / (w3 - w1)', 6)} AS wait_robust,
               {pr('(COALESCE(booking_value, m2) - m2) / (v3 - v1)', 6)} AS value_robust,
               {pr('(COALESCE(ride_distance, m3) - m3) / CASE WHEN d3 = d1 THEN 1 ELSE d3 - d1 END', 6)} AS distance_robust
        FROM B, imp, st""",
    """imp AS (SELECT quantile_cont(avg_vtat, 0.5) AS m1, quantile_cont(booking_value, 0.5) AS m2,
                      quantile_cont(ride_distance, 0.5) AS m3 FROM B),
    st AS (SELECT quantile_cont(a, 0.25) AS w1, quantile_cont(a, 0.75) AS w3, quantile_cont(v, 0.25) AS v1,
                  quantile_cont(v, 0.75) AS v3, quantile_cont(d, 0.25) AS d1, quantile_cont(d, 0.75) AS d3
           FROM (SELECT COALESCE(avg_vtat, m1) AS a, COALESCE(booking_value, m2) AS v, COALESCE(ride_distance, m3) AS d
                 FROM B, imp))"""))
def exact_scaled_imputed(spark, sf):
    """Exact interpolated medians fill the gaps, exact quartiles scale the filled columns (M2, M6); the median of a
    filled column is the one it was filled with."""
    cols = ["avg_vtat", "booking_value", "ride_distance"]
    b = bookings(spark, sf).select("booking_id", *cols)
    out = Pipeline(stages=preprocessor(robust=cols, impute_numeric=cols)).fit(b).transform(b)
    v = vector_to_array("features")
    return out.select("booking_id", *[pround(v[i], 6).alias(n) for i, n in enumerate(
        ("wait_robust", "value_robust", "distance_robust"))])


# ---------------------------------------------------------------------------
# linear models in closed form
# ---------------------------------------------------------------------------
def _one_feature(spark, sf, x="ride_distance"):
    b = bookings_clean(spark, sf).where(F.col("booking_status") == "Completed")
    b = b.select("booking_id", F.col(x).alias("x"), F.col("booking_value").alias("label"))
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(b)


_XY = """q AS (SELECT booking_id, ride_distance AS x, booking_value AS y FROM B_clean WHERE booking_status = 'Completed')"""


@register("linear_closed_form", with_views(
    f"""SELECT model, {pr('slope', 3)} AS slope, {pr('my - slope * mx', 2)} AS intercept FROM (
          SELECT 'Linear' AS model, sxy / sxx AS slope, mx, my FROM s
          UNION ALL SELECT 'Ridge', sxy / (sxx + 1), mx, my FROM s
          UNION ALL SELECT 'Lasso', sign(sxy) * greatest(abs(sxy / n) - 0.001, 0) / (sxx / n), mx, my FROM s)""",
    _XY + """, s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) * count(*) AS sxy,
                            var_pop(x) * count(*) AS sxx FROM q)"""))
def linear_closed_form(spark, sf):
    """OLS, Ridge and Lasso of one feature against their closed forms."""
    d = _one_feature(spark, sf)
    models = TR.regressors("label", *TR._size_and_std(d))
    rows = []
    for name in ("Linear", "Ridge", "Lasso"):
        m = models[name].fit(d)
        rows.append((name, float(m.coefficients[0]), float(m.intercept)))
    out = spark.createDataFrame(rows, "model string, slope double, intercept double")
    return out.select("model", pround("slope", 3).alias("slope"), pround("intercept", 2).alias("intercept"))


_FOLDS = """f AS (SELECT x, y, CAST('0x' || substr(md5('42:' || CAST(booking_id AS VARCHAR)), 1, 8) AS BIGINT) % 3 AS fold FROM q),
    k AS (SELECT unnest([0, 1, 2]) AS k),
    fit AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f, k WHERE fold <> k GROUP BY k),
    e AS (SELECT k, avg((y - a - b * x) ** 2) AS mse, var_pop(y) AS v FROM f JOIN fit ON fold = k GROUP BY k)"""


@register("cv_one_feature", with_views(
    f"""SELECT 'Linear' AS model, {pr('avg(sqrt(mse))', 4)} AS rmse_mean, {pr('stddev_pop(sqrt(mse))', 4)} AS rmse_std,
               {pr('avg(1 - mse / v)', 6)} AS r2_mean, {pr('stddev_pop(1 - mse / v)', 6)} AS r2_std FROM e""",
    _XY + ", " + _FOLDS))
def cv_one_feature(spark, sf):
    """3-fold CV of one-feature OLS, mean and std over the folds."""
    d = _one_feature(spark, sf).drop("features")
    stages = [VectorAssembler(inputCols=["x"], outputCol="features")]
    lb = TR.cross_validate_regression(d, {"Linear": LinearRegression(labelCol="label", regParam=0.0)}, stages, 3)
    return lb.select("model", *[pround(c, n).alias(c) for c, n in (
        ("rmse_mean", 4), ("rmse_std", 4), ("r2_mean", 6), ("r2_std", 6))])


@register("holdout_one_feature", with_views(
    f"""SELECT {pr('avg((y - a - b * x) ** 2)', 3)} AS mse, {pr('avg(abs(y - a - b * x))', 4)} AS mae,
               {pr('1 - avg((y - a - b * x) ** 2) / var_pop(y)', 6)} AS r2, CAST(count(*) AS BIGINT) AS n
        FROM h, (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM h WHERE NOT test) WHERE test""",
    _XY + """, h AS (SELECT x, y, CAST('0x' || substr(md5('42:' || CAST(booking_id AS VARCHAR)), 1, 8) AS BIGINT)
                            % 10000 < 2000 AS test FROM q)"""))
def holdout_one_feature(spark, sf):
    """One-feature OLS on an 80/20 hash split."""
    train, test = FD.train_test_split(_one_feature(spark, sf), "booking_id", 0.2, seed=42)
    pred = LinearRegression(labelCol="label", regParam=0.0).fit(train).transform(test)
    r = TR.regression_report(pred, digits=None)
    return r.select(pround("mse", 3).alias("mse"), pround("mae", 4).alias("mae"), pround("r2", 6).alias("r2"), "n")


# ---------------------------------------------------------------------------
# tree models on an exact label
# ---------------------------------------------------------------------------
_CELL = "10.0 * (booking_id % 4) + CASE WHEN hour >= 12 THEN 3.0 ELSE 0.0 END"


@register("tree_models_exact_label", with_views(
    """SELECT label, CAST(count(*) AS BIGINT) AS n, label AS rf, label AS wait_rf, TRUE AS boosted_close
       FROM c GROUP BY label""",
    f"c AS (SELECT CAST({_CELL} AS DOUBLE) AS label FROM B_clean)"))
def tree_models_exact_label(spark, sf):
    """Both forests reproduce a label that is a function of two levels; boosting with step 0.05 comes within 2 %."""
    late = F.when(F.col("hour") >= 12, 1).otherwise(0)
    # one numeric feature: a split's random feature subset is then always that feature
    b = bookings_clean(spark, sf).select((F.col("booking_id") % 4 * 2 + late).cast("double").alias("code"),
                                         F.expr(_CELL).cast("double").alias("label"))
    d = VectorAssembler(inputCols=["code"], outputCol="features").transform(TR.spread(b, "code"))
    ms = TR.regressors("label")
    out = d
    for name, est in (("rf", ms["RF"]), ("wait_rf", TR.wait_estimator()), ("boosted", ms["HGB"])):
        out = est.setPredictionCol(name).fit(d).transform(out)
    near = F.max(F.abs(F.col("boosted") - F.col("label"))) <= 0.66
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), pround(F.avg("rf"), 6).alias("rf"),
                                    pround(F.avg("wait_rf"), 6).alias("wait_rf"), near.alias("boosted_close"))


# ---------------------------------------------------------------------------
# out-of-fold rows
# ---------------------------------------------------------------------------
@register("oof_rows", with_views(
    """SELECT booking_id, booking_status AS label, CAST(rk % (SELECT k FROM kk) AS INTEGER) AS fold, TRUE AS known_class
       FROM r""",
    """t AS (SELECT 'B' || CAST(booking_id AS VARCHAR) AS booking_id, booking_status FROM B_region),
    r AS (SELECT booking_id, booking_status, row_number() OVER (PARTITION BY booking_status
            ORDER BY CAST('0x' || substr(md5('42:' || booking_id), 1, 8) AS BIGINT), booking_id) - 1 AS rk FROM t),
    kk AS (SELECT greatest(2, least(5, min(c))) AS k FROM (SELECT count(*) AS c FROM B_region GROUP BY booking_status))"""))
def oof_rows(spark, sf):
    """Out-of-fold status predictions on text ids: every row once, in its fold, with a known class."""
    d = region(spark, sf).withColumn("booking_id", F.concat(F.lit("B"), F.col("booking_id").cast("string")))
    oof = TR.oof_status(d)
    classes = ["Completed", "Incomplete", "Cancelled by Driver", "Cancelled by Customer", "No Driver Found"]
    return oof.select("booking_id", "label", "fold", F.col("prediction").isin(*classes).alias("known_class"))


# ---------------------------------------------------------------------------
# the status model on a saturated design (M16, M20–M24, M27): one categorical feature and no penalty, so the weighted
# maximum-likelihood probabilities are the weighted class shares of each level
# ---------------------------------------------------------------------------
# a level that tells much, but not all, of the status
_SIGNAL = "CAST(CAST(floor(((booking_id * 7919) % 100 + hour) / 10.0) AS INTEGER) AS VARCHAR(9))"


def _signal_stages(df):
    return preprocessor(onehot=["signal"])


def _vehicle_stages(df):
    return preprocessor(onehot=["vehicle_type"])


def _signal_oof(spark, sf):
    d = region(spark, sf).select("booking_id", "booking_status", F.expr(_SIGNAL).alias("signal"))
    return TR.oof_status(d, stages=_signal_stages, penalty=0.0, tol=1e-9)


@register("status_saturated", with_views(
    f"""SELECT g.vehicle_type, c.booking_status AS class,
               {pr('(COALESCE(x.n, 0) / CAST(c.n AS DOUBLE)) / t.s', 4)} AS probability
        FROM (SELECT DISTINCT vehicle_type FROM B_region) g CROSS JOIN c
             LEFT JOIN x ON x.vehicle_type = g.vehicle_type AND x.booking_status = c.booking_status
             JOIN t ON t.vehicle_type = g.vehicle_type""",
    """c AS (SELECT booking_status, count(*) AS n FROM B_region GROUP BY 1),
    x AS (SELECT vehicle_type, booking_status, count(*) AS n FROM B_region GROUP BY 1, 2),
    t AS (SELECT x.vehicle_type, sum(x.n / CAST(c.n AS DOUBLE)) AS s FROM x JOIN c USING (booking_status) GROUP BY 1)"""))
def status_saturated(spark, sf):
    """Probability of every class per vehicle type of the balanced model without a penalty."""
    d = region(spark, sf).select("vehicle_type", "booking_status")
    model = TR.train_booking_status(d, stages=_vehicle_stages, penalty=0.0, tol=1e-9)
    levels = d.select("vehicle_type").distinct().withColumn("booking_status", F.lit(model.stages[0].labels[0]))
    out = TR.level_probabilities(model, levels, model.stages[0].labels)
    return out.select("vehicle_type", "class", pround("probability", 4).alias("probability"))


_OOF_CTES = f"""t AS (SELECT booking_id, booking_status AS label, {_SIGNAL} AS signal FROM B_region),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5('42:' || CAST(booking_id AS VARCHAR)),
            1, 8) AS BIGINT), CAST(booking_id AS VARCHAR)) - 1 AS rk FROM t),
    kk AS (SELECT greatest(2, least(5, min(c))) AS k FROM (SELECT count(*) AS c FROM t GROUP BY label)),
    f AS (SELECT booking_id, label, signal, CAST(rk % (SELECT k FROM kk) AS INTEGER) AS fold FROM r),
    folds AS (SELECT DISTINCT fold AS k FROM f),
    c AS (SELECT k, label, count(*) AS n FROM f, folds WHERE fold <> k GROUP BY 1, 2),
    x AS (SELECT k, signal, label, count(*) AS n FROM f, folds WHERE fold <> k GROUP BY 1, 2, 3),
    best AS (SELECT x.k, x.signal, arg_max(x.label, x.n / CAST(c.n AS DOUBLE)) AS prediction,
                    max(x.n / CAST(c.n AS DOUBLE)) / sum(x.n / CAST(c.n AS DOUBLE)) AS top
             FROM x JOIN c ON c.k = x.k AND c.label = x.label GROUP BY 1, 2),
    p AS (SELECT f.booking_id, f.label, f.fold, best.prediction, best.top
          FROM f JOIN best ON best.k = f.fold AND best.signal = f.signal)"""


@register("oof_saturated", with_views(
    f"SELECT booking_id, label, fold, prediction, {pr('top', 3)} AS probability FROM p", _OOF_CTES))
def oof_saturated(spark, sf):
    """Out-of-fold class and its probability of every row, balanced per fold's training rows."""
    return _signal_oof(spark, sf).select("booking_id", "label", "fold", "prediction",
                                         pround(F.array_max("probability"), 3).alias("probability"))


@register("oof_saturated_metrics", with_views(
    f"""SELECT {pr('avg(acc)', 6)} AS accuracy_mean, {pr('stddev_pop(acc)', 6)} AS accuracy_std, {pr('avg(f1)', 6)} AS f1_macro_mean,
               {pr('stddev_pop(f1)', 6)} AS f1_macro_std, CAST(count(*) AS BIGINT) AS n_folds
        FROM (SELECT per.fold, sum(tp) / CAST(sum(support) AS DOUBLE) AS acc, avg(2.0 * tp / (support + npred)) AS f1
              FROM per GROUP BY 1)""",
    _OOF_CTES + """, lab AS (SELECT fold, label AS c FROM p UNION SELECT fold, prediction FROM p),
    per AS (SELECT lab.fold, lab.c, count(*) FILTER (WHERE p.label = lab.c AND p.prediction = lab.c) AS tp,
                   count(*) FILTER (WHERE p.label = lab.c) AS support, count(*) FILTER (WHERE p.prediction = lab.c) AS npred
            FROM lab JOIN p ON p.fold = lab.fold GROUP BY 1, 2)"""))
def oof_saturated_metrics(spark, sf):
    """Accuracy and macro F1, mean and std over the folds, of the same training run."""
    m = TR.status_cv_metrics(_signal_oof(spark, sf))
    return m.select(*[pround(c, 6).alias(c) for c in m.columns if c != "n_folds"], "n_folds")


@register("oof_saturated_matrix", with_views(
    """SELECT a.c AS actual, b2.c AS predicted, CAST(COALESCE(x2.n, 0) AS BIGINT) AS n
       FROM lab a CROSS JOIN lab b2 LEFT JOIN x2 ON x2.label = a.c AND x2.prediction = b2.c""",
    _OOF_CTES + """, lab AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
    x2 AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2)"""))
def oof_saturated_matrix(spark, sf):
    """Out-of-fold confusion matrix of the same training run."""
    return EV.confusion_matrix(_signal_oof(spark, sf))


# ---------------------------------------------------------------------------
# scoring (M29–M31)
# ---------------------------------------------------------------------------
def _requests(spark, sf):
    return region(spark, sf).select(
        F.col("booking_id").alias("request_id"), F.upper("pickup_location").alias("pickup_location"),
        F.when(F.col("booking_id") % 5 == 0, "nowhere").otherwise(F.col("drop_location")).alias("drop_location"),
        weekday_name("weekday").alias("weekday"), "hour", "vehicle_type")


def _mode(col: str) -> str:
    return f"(SELECT CAST({col} AS VARCHAR) FROM B_region GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


@register("model_inputs", with_views(
    f"""SELECT b.booking_id AS request_id, CAST({_mode('month')} AS DOUBLE) AS month, b.weekday AS weekday_number,
               {_mode('payment_method')} AS payment_method, COALESCE(pu.latitude, 0.0) AS pickup_latitude,
               CASE WHEN b.booking_id % 5 = 0 THEN 0.0 ELSE COALESCE(dr.latitude, 0.0) END AS drop_latitude,
               CAST(0.0 AS DOUBLE) AS driver_rating
        FROM B_region b LEFT JOIN L1 pu ON lower(b.pickup_location) = pu.lkey
             LEFT JOIN L1 dr ON lower(b.drop_location) = dr.lkey"""))
def model_inputs(spark, sf):
    """Request rows as model input: modes, constants, geocodes with default 0, weekday names as numbers."""
    base = SC.build_inputs(_requests(spark, sf), region(spark, sf), locations(spark, sf))
    names = ["month", "weekday", "payment_method", "pickup_latitude", "drop_latitude", "driver_rating"]
    spec = {"features": names, "types": {"month": "double", "weekday": "int", "payment_method": "string",
                                         "pickup_latitude": "double", "drop_latitude": "double", "driver_rating": "double"}}
    out = SC.align_to_model(base, spec)
    return out.select("request_id", "month", F.col("weekday").alias("weekday_number"), *names[2:])


@register("chained_scoring", with_views(
    f"""SELECT booking_id AS request_id, {pr('a + b * hour', 4)} AS predicted_wait_min,
               {pr('c + d * (a + b * hour)', 4)} AS predicted_value
        FROM B_region, w, v""",
    """w AS (SELECT regr_slope(avg_vtat, hour) AS b, regr_intercept(avg_vtat, hour) AS a FROM B_region),
    v AS (SELECT regr_slope(booking_value, avg_vtat) AS d, regr_intercept(booking_value, avg_vtat) AS c FROM B_region)"""))
def chained_scoring(spark, sf):
    """The wait model's prediction feeds the value model; both are one-feature OLS here."""
    hist = region(spark, sf)

    def fit(x, y):
        d = hist.select(F.col(x).cast("double").alias(x), F.col(y).alias("label"))
        stages = [VectorAssembler(inputCols=[x], outputCol="features"), LinearRegression(labelCol="label", regParam=0.0)]
        return Pipeline(stages=stages).fit(d), {"features": [x], "types": {x: "double"}}

    out = SC.score_requests(_requests(spark, sf), hist, locations(spark, sf), *fit("hour", "avg_vtat"),
                            *fit("avg_vtat", "booking_value"))
    return out.select("request_id", pround("predicted_wait_min", 4).alias("predicted_wait_min"),
                      pround("predicted_value", 4).alias("predicted_value"))
