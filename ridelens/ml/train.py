"""Training jobs: estimators, cross-validation, leaderboard, out-of-fold
predictions and the three reference models (M10–M22, M26–M28).

Each fit is a distributed Spark ML job; the driver only loops over folds ×
models (k × m jobs, inherent to cross-validation) and collects one metrics row
per fold. A fit runs in as many tasks as its rows have partitions, pass after
pass, so training rows are dealt out evenly first (:func:`spread`).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.ml.evaluate import regression_report
from ridelens.ml.features import preprocessor
from ridelens.ml.folds import kfold, stratified_folds, with_class_weights
from ridelens.ml.grow import fit_boosted, fit_forest
from ridelens.operators.clean import null_as_category

# ---------------------------------------------------------------------------
# The reference's feature lists and model settings.
# ---------------------------------------------------------------------------
VALUE_STANDARD = ["avg_vtat", "pickup_latitude", "pickup_longitude", "drop_latitude", "drop_longitude"]
VALUE_ROBUST = ["ride_distance"]
VALUE_MINMAX = ["driver_rating", "customer_rating"]
VALUE_ONEHOT = ["month", "weekday", "day", "hour", "booking_status", "vehicle_type",
                "reason_for_cancelling_by_customer", "driver_cancellation_reason",
                "incomplete_rides_reason", "payment_method"]
VALUE_BOOKING_TIME_ONEHOT = ["month", "weekday", "day", "hour", "vehicle_type", "payment_method"]
REASON_COLS = ["reason_for_cancelling_by_customer", "driver_cancellation_reason", "incomplete_rides_reason"]
STATUS_NUMERIC = ["pickup_latitude", "pickup_longitude", "drop_latitude", "drop_longitude"]
STATUS_ONEHOT = ["hour", "weekday", "day", "month", "vehicle_type", "payment_method"]
WAIT_DROP = ["booking_status", "reason_for_cancelling_by_customer", "driver_cancellation_reason",
             "incomplete_rides_reason", "booking_value", "ride_distance", "booking_id", "customer_id",
             "driver_rating", "customer_rating"]
STATUS_LEAKY = ["driver_cancellation_reason", "reason_for_cancelling_by_customer", "incomplete_rides_reason",
                "ride_distance", "avg_vtat", "booking_value", "driver_rating", "customer_rating"]


# rows that are worth a task of their own, tasks of a small input at most, rows of a task at most
ROWS_WORTH_A_TASK, FEW_TASKS, TASK_ROWS = 6_000, 24, 250_000
# forests that a forest on few rows is grown as, times the tasks of each; rows of such a task. The statistics of a node
# are made, sent and merged once for every task: fewer tasks a forest and more forests are less of that work
FORESTS, FOREST_TASK_ROWS = 16, 150_000
# rows from which trees are grown where their rows are (ml/grow.py)
GROWN_ROWS = 300_000


def _present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]


def fit_tasks(n: int) -> int:
    """Tasks for ``n`` training rows. Every task of a forest's pass sends its own statistics of all open nodes, so more
    than ``FEW_TASKS`` only pay once each has ``TASK_ROWS`` rows."""
    return max(1, min(n // ROWS_WORTH_A_TASK, FEW_TASKS), -(-n // TASK_ROWS))


def spread(df: DataFrame, id_col: str, n: int | None = None, within: tuple = ()) -> DataFrame:
    """The rows dealt out evenly over :func:`fit_tasks` tasks, whatever files, joins or windows they come from.

    A compressed table of one file, or a shuffle that Spark coalesced by its bytes, is a few tasks; each pass of a fit
    over it would use as few cores. Dealing is by turns, so ids that repeat or are null are spread like any other.
    The rows of a task are in the order of the id, after that of the columns ``within``.
    """
    tasks = fit_tasks(df.count() if n is None else n)
    return df if tasks == 1 else df.repartition(tasks).sortWithinPartitions(*within, id_col)


def regressors(label: str = "label", n: int | None = None, label_std: float | None = None,
               rf_depth: int = 30) -> dict:
    """The five booking-value regressors.

    Ridge's ``alpha = 1`` becomes ``regParam = alpha * label_std / n`` so that
    Spark's objective (L2 penalty scaled by the label std, loss averaged over n)
    matches the closed form; Lasso's ``alpha`` carries over unchanged. The
    reference's forest grows without a depth limit: ``rf_depth`` is Spark's own
    limit of 30, and a forest fitted with less says so in its name. Its boosted
    trees are limited to 31 leaves, not in depth; Spark has no leaf limit, so
    depth 5 (at most 32 leaves) stands in.
    """
    ridge_reg = 1.0 * (label_std or 1.0) / float(n or 1)
    return {
        "Linear": LinearRegression(labelCol=label, regParam=0.0),
        "Ridge": LinearRegression(labelCol=label, regParam=ridge_reg, elasticNetParam=0.0, standardization=False),
        "Lasso": LinearRegression(labelCol=label, regParam=0.001, elasticNetParam=1.0, maxIter=5000,
                                  standardization=False),
        "RF" if rf_depth >= 30 else f"RF (depth {rf_depth})": RandomForestRegressor(
            labelCol=label, numTrees=200, maxDepth=rf_depth, seed=20,
            cacheNodeIds=True, checkpointInterval=10),
        "HGB": GBTRegressor(labelCol=label, stepSize=0.05, maxBins=255, maxIter=100, maxDepth=5, seed=20,
                            checkpointInterval=10),
    }


def fit_model(est, train: DataFrame, n: int | None = None):
    """``est`` fitted on assembled rows. A forest on few rows is grown as several forests that share out its trees; on
    many rows trees are grown in the tasks that have their rows (:mod:`ridelens.ml.grow`).

    A task of a forest's pass sends its statistics of every open node of every tree, whatever rows it has; with few
    rows those cost more than the rows, and more tasks only send more of them. Trees are independent, so their forests
    are fitted concurrently, each in the few tasks its rows need, and the prediction is the mean over all trees.
    """
    from concurrent.futures import ThreadPoolExecutor

    trees = isinstance(est, (RandomForestRegressor, GBTRegressor))
    n = train.count() if n is None and trees else n
    if trees and n > GROWN_ROWS:
        grown = fit_forest(est, train, n) if isinstance(est, RandomForestRegressor) else fit_boosted(est, train, n)
        if grown is not None:
            return grown
    if not isinstance(est, RandomForestRegressor) or fit_tasks(n) == 1:
        return est.copy().fit(train)
    tasks = -(-n // FOREST_TASK_ROWS)
    trees, parts = est.getNumTrees(), max(1, FORESTS // tasks)
    if parts == 1:
        return est.copy().fit(train)
    sizes = [trees // parts + (i < trees % parts) for i in range(min(parts, trees))]
    names = [f"{est.getPredictionCol()}_{i}" for i in range(len(sizes))]
    few = train.coalesce(tasks)

    def grown(i: int):
        return est.copy().setNumTrees(sizes[i]).setSeed(est.getSeed() + i).setPredictionCol(names[i]).fit(few)

    with ThreadPoolExecutor(max_workers=len(sizes)) as pool:
        forests = list(pool.map(grown, range(len(sizes))))
    mean = " + ".join(f"{s} * `{c}`" for s, c in zip(sizes, names, strict=True))
    return PipelineModel(stages=[*forests, SQLTransformer(
        statement=f"SELECT * EXCEPT ({', '.join(f'`{c}`' for c in names)}), "
                  f"({mean}) / {trees} AS `{est.getPredictionCol()}` FROM __THIS__")])


def fit_spread(stages: list, train: DataFrame, id_col: str) -> PipelineModel:
    """Feature stages and a regressor fitted on the training rows. Rows and features are spread and written to the shared
    folder once, so that no stage derives them again."""
    import uuid

    from ridelens.sources.files import drop_tables, persist_table

    *prepare, est = stages
    tag, n = uuid.uuid4().hex[:12], train.count()
    rows = persist_table(spread(train, id_col, n), f"fit_{tag}_rows")
    prep = Pipeline(stages=prepare).fit(rows)
    features = persist_table(prep.transform(rows).select(est.getFeaturesCol(), est.getLabelCol()), f"fit_{tag}_features")
    model = PipelineModel(stages=[*prep.stages, fit_model(est, features, n)])
    drop_tables(train.sparkSession, [f"fit_{tag}_rows", f"fit_{tag}_features"])
    return model


def value_frame(df: DataFrame, feature_set: str = "reference") -> DataFrame:
    """Booking-value training rows: ids / locations dropped, reasons as text with
    NULL → ``"nan"`` (P8); ``feature_set="booking_time"`` drops leaky columns (D17)."""
    d = null_as_category(df, _present(df, REASON_COLS))
    d = d.drop(*[c for c in ("customer_id", "pickup_location", "drop_location") if c in d.columns])
    return d.withColumn("label", F.col("booking_value").cast("double"))


def value_stages(df: DataFrame, feature_set: str = "reference", min_frequency: float = 0.01,
                 unseen: str = "keep") -> list:
    """Preprocessing of the booking-value models; ``min_frequency=0, unseen="error"`` is the plain
    OLS pipeline (one-hot without grouping, an unseen level is an error)."""
    onehot = VALUE_ONEHOT if feature_set == "reference" else VALUE_BOOKING_TIME_ONEHOT
    return preprocessor(standard=_present(df, VALUE_STANDARD), robust=_present(df, VALUE_ROBUST),
                        minmax=_present(df, VALUE_MINMAX), onehot=_present(df, onehot),
                        min_frequency=min_frequency, unseen=unseen)


def cross_validate_regression(df: DataFrame, models, stages: list, k: int = 3,
                              id_col: str = "booking_id", seed: int = 42,
                              metrics=("rmse", "r2"), persist: bool = True,
                              parallelism: int = 6) -> DataFrame:
    """k-fold CV of several regressors sharing one preprocessing.

    ``models`` is a dictionary of estimators, or a function of (row count, label
    std) giving one: penalties that depend on the sample size then follow each
    fold's training rows. Returns a leaderboard ``(model, <metric>_mean, <metric>_std)`` sorted by the
    first metric (M18). Per fold, the preprocessing is fitted once on the
    training split only, the transformed training/test features are written to
    the shared checkpoint folder (``persist``: lineage cut, re-read by every
    model, recomputed from files after an executor loss), and the models of all
    folds are fitted concurrently (``parallelism`` driver threads submitting
    independent Spark jobs), as boosting is a long chain of short jobs.
    """
    import uuid
    from concurrent.futures import ThreadPoolExecutor

    from ridelens.sources.files import drop_tables, persist_table

    spark = df.sparkSession
    folded = kfold(spread(df, id_col), id_col, k, seed)
    tag = uuid.uuid4().hex[:12]
    if persist:
        folded = persist_table(folded, f"cv_input_{tag}")

    def prepared(f: int) -> tuple:
        train, test = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        prep = Pipeline(stages=[s.copy() for s in stages]).fit(train)
        tr = prep.transform(train).select("features", "label")
        te = prep.transform(test).select("features", "label")
        if persist:
            tr = persist_table(tr, f"cv_{tag}_train{f}")
            te = persist_table(te, f"cv_{tag}_test{f}")
        return tr, te, models(*_size_and_std(tr)) if callable(models) else models

    def fit_eval(job: tuple) -> tuple:
        name, est, tr, te = job
        rep = regression_report(fit_model(est, tr).transform(te), "label", "prediction", digits=None).first()
        return name, rep

    vals: dict = {}
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        folds = list(pool.map(prepared, range(k)))
        jobs = [(name, est, tr, te) for tr, te, fold_models in folds for name, est in fold_models.items()]
        # boosting is the longest chain of steps, on one core if its rows fit: it starts first
        jobs.sort(key=lambda job: not isinstance(job[1], GBTRegressor))
        for name, rep in pool.map(fit_eval, jobs):
            for m in metrics:
                vals.setdefault(name, {}).setdefault(m, []).append(
                    float(rep[m]) if rep[m] is not None else float("nan"))
    if persist:
        drop_tables(spark, [f"cv_input_{tag}", *(f"cv_{tag}_{s}{f}" for f in range(k) for s in ("train", "test"))])
    rows = []
    for name in vals:
        row = {"model": name}
        for m in metrics:
            v = vals[name][m]
            mean = sum(v) / len(v)
            row[f"{m}_mean"] = mean
            row[f"{m}_std"] = (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5
        rows.append(row)
    cols = ["model"] + [f"{m}_{s}" for m in metrics for s in ("mean", "std")]
    lb = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows],
                               ", ".join(["model string"] + [f"{c} double" for c in cols[1:]]))
    first = f"{metrics[0]}_mean"
    return lb.orderBy(F.col(first).asc() if metrics[0] in ("rmse", "mae", "mse") else F.col(first).desc())


def _save(model, train_df: DataFrame, features: list[str], save_path: str | None) -> None:
    """Persist a refitted model with its feature spec (S7), if asked."""
    if save_path:
        from ridelens.ml.score import model_spec, save_scoring_model

        save_scoring_model(model, model_spec(train_df, features), save_path)


def _size_and_std(df: DataFrame, label: str = "label") -> tuple[int, float]:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s")).first()
    return r["n"], r["s"]


def value_leaderboard(df: DataFrame, feature_set: str = "reference", k: int = 3, rf_depth: int = 30) -> DataFrame:
    """CV leaderboard of the five booking-value regressors (M17, M18), penalties per fold."""
    d = value_frame(df, feature_set)
    return cross_validate_regression(d, lambda n, s: regressors("label", n, s, rf_depth),
                                     value_stages(d, feature_set), k)


def train_booking_value(df: DataFrame, feature_set: str = "reference", k: int = 3,
                        models: dict | None = None, save_path: str | None = None):
    """Booking-value job (M26): CV leaderboard, best model refitted on all rows,
    optionally saved with its feature spec (S7).

    Returns ``(leaderboard, best_pipeline_model)``.
    """
    d = value_frame(df, feature_set)
    stages = value_stages(d, feature_set)
    per_fold = models or (lambda n, s: regressors("label", n, s))
    lb = cross_validate_regression(d, per_fold, stages, k)
    best = (models or regressors("label", *_size_and_std(d)))[lb.first()["model"]]
    model = Pipeline(stages=list(stages) + [best]).fit(d)
    onehot = VALUE_ONEHOT if feature_set == "reference" else VALUE_BOOKING_TIME_ONEHOT
    _save(model, d, VALUE_STANDARD + VALUE_ROBUST + VALUE_MINMAX + onehot, save_path)
    return lb, model


def value_holdout_ols(df: DataFrame, id_col: str = "booking_id", test_fraction: float = 0.2,
                      seed: int = 42) -> DataFrame:
    """Plain OLS pipeline on a hold-out split (M9, M10, M25): test-side MSE, RMSE, R², MAE."""
    from ridelens.ml.folds import train_test_split

    train, test = train_test_split(value_frame(df), id_col, test_fraction, seed)
    stages = value_stages(train, min_frequency=0.0, unseen="error")
    m = Pipeline(stages=[*stages, LinearRegression(labelCol="label", regParam=0.0)]).fit(train)
    return regression_report(m.transform(test), "label", "prediction", digits=6)


# rows that a fit takes through its matrices at a time: their features and margins stay in a core's own cache
BLOCK_MB = 0.02


def status_stages(df: DataFrame) -> list:
    return preprocessor(standard=_present(df, STATUS_NUMERIC), onehot=_present(df, STATUS_ONEHOT))


def status_estimator(label: str = "label_idx", weight: str = "weight", n_weight: float | None = None,
                     penalty: float = 1.0, tol: float = 1e-6):
    """Balanced multinomial logistic regression (M16): C = 1 / penalty ⇒ ``regParam = penalty / Σw``."""
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight, family="multinomial",
                              maxIter=1000, regParam=penalty / float(n_weight or 1.0), standardization=False, tol=tol,
                              maxBlockSizeInMB=BLOCK_MB)


def status_frame(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in STATUS_LEAKY if c in df.columns])


# rows for each distinct one from which a fit is worth counting them first
ROWS_A_KIND = 20


def _rows_and_kinds(train: DataFrame) -> dict:
    """Rows, different rows (an estimate) and the sum of the weights, in one pass."""
    return train.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("features", "label_idx")).alias("k"),
                     F.sum("weight").alias("w")).first().asDict()


def equal_rows_as_one(train: DataFrame, name: str, counted: dict | None = None) -> DataFrame:
    """Assembled rows with equal features and label as one row of their summed weight, if there are few kinds of them.

    The weighted likelihood is the same sum, whatever the number of rows; every pass of the fit reads the kinds only. A
    design of some categorical features has few; one estimate says whether there are.
    """
    from ridelens.sources.files import persist_table

    n = counted or _rows_and_kinds(train)
    if n["n"] < ROWS_WORTH_A_TASK or n["k"] * ROWS_A_KIND > n["n"]:
        return train
    return persist_table(train.groupBy("features", "label_idx").agg(F.sum("weight").alias("weight")), name)


# (application, input and settings) -> folder names of the folds' scored rows; names per training run
_OOF_RUNS: dict[tuple, list[str]] = {}


def _content(df: DataFrame) -> tuple:
    """Row count and the sum of row hashes: equal for equal rows in any order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return (df.schema.simpleString(), row["n"], str(row["h"]))


def oof_status(df: DataFrame, label: str = "booking_status", id_col: str = "booking_id",
               k: int | None = None, stages=status_stages, penalty: float = 1.0, tol: float = 1e-6,
               parallelism: int = 5) -> DataFrame:
    """Out-of-fold status predictions over stratified folds.

    Returns ``(id, label, prediction, probability, classes, fold)`` for every row exactly once; ``probability`` is an
    array in the order of ``classes``. ``stages(train)`` gives the preprocessing. Folds, and per fold the assembled features with
    their weights, are written once to the shared folder and read by everything after; the folds are fitted
    concurrently. A run is known by its settings and its input rows, so reports on the same rows share one
    training run of the session.
    """
    import uuid
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import vector_to_array

    from ridelens.sources.files import drop_tables, persist_table, read_persisted

    spark, tag = df.sparkSession, uuid.uuid4().hex[:12]
    # derived once: the run's name reads the rows once, the folds read them three times
    d = persist_table(status_frame(df), f"oof_rows_{tag}")
    run = (spark.sparkContext.applicationId, _content(d), label, id_col, k, f"{stages.__module__}.{stages.__qualname__}",
           penalty, tol)
    if run in _OOF_RUNS:
        drop_tables(spark, [f"oof_rows_{tag}"])
        return read_persisted(spark, *_OOF_RUNS[run])
    # a folder for each fold: its scoring reads this one, its training the others
    folds = stratified_folds(d, label, id_col, k)
    d = persist_table(spread(folds, id_col, run[1][1], ("fold",)), f"oof_input_{tag}", ["fold"])
    k_used = d.agg(F.max("fold")).first()[0] + 1
    indexer = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc").fit(d)
    classes = F.array(*[F.lit(c) for c in indexer.labels])

    def scored(f: int) -> str:
        # weights and penalty from the fold's training rows only
        train = with_class_weights(d.where(F.col("fold") != f), label, bounded=True)
        prep = Pipeline(stages=[indexer, *stages(train)]).fit(train)
        tr = persist_table(prep.transform(train).select("features", "label_idx", "weight"), f"oof_{tag}_train{f}")
        counted = _rows_and_kinds(tr)
        tr = equal_rows_as_one(tr, f"oof_{tag}_kinds{f}", counted)
        m = status_estimator(n_weight=counted["w"], penalty=penalty, tol=tol).fit(tr)
        out = m.transform(prep.transform(d.where(F.col("fold") == f)))
        persist_table(out.select(
            id_col, F.col(label).alias("label"), F.get(classes, F.col("prediction").cast("int")).alias("prediction"),
            vector_to_array("probability").alias("probability"), classes.alias("classes"), "fold"), f"oof_{tag}_scored{f}")
        return f"oof_{tag}_scored{f}"

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        parts = list(pool.map(scored, range(k_used)))
    drop_tables(spark, [f"oof_rows_{tag}", f"oof_input_{tag}",
                        *(f"oof_{tag}_{s}{f}" for f in range(k_used) for s in ("train", "kinds"))])
    _OOF_RUNS[run] = parts
    return read_persisted(spark, *parts)


def level_probabilities(model, levels: DataFrame, classes: list[str]) -> DataFrame:
    """Probability of every class for each row of ``levels``: (its columns, class, probability)."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(levels).select(*levels.columns, vector_to_array("probability").alias("p"))
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select(*levels.columns, F.posexplode("p").alias("i", "probability")).select(
        *levels.columns, F.get(names, F.col("i")).alias("class"), "probability")


def status_cv_metrics(oof: DataFrame) -> DataFrame:
    """Accuracy / macro F1 mean ± std (population) over folds (M21), one aggregate."""
    from ridelens.ml.evaluate import cv_classification_metrics

    return cv_classification_metrics(oof, "fold", "label", "prediction")


def train_booking_status(df: DataFrame, label: str = "booking_status", save_path: str | None = None,
                         stages=status_stages, penalty: float = 1.0, tol: float = 1e-6):
    """Fit the balanced status model on all rows (M27 refit), optionally saved."""
    from pyspark.ml.feature import StringIndexer

    d = with_class_weights(status_frame(df), label)
    n_weight = d.agg(F.sum("weight")).first()[0]
    idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc")
    model = Pipeline(stages=[idx, *stages(d), status_estimator(n_weight=n_weight, penalty=penalty, tol=tol)]).fit(d)
    _save(model, d, _present(d, STATUS_NUMERIC + STATUS_ONEHOT), save_path)
    return model


def wait_frame(df: DataFrame) -> DataFrame:
    d = df.drop(*[c for c in WAIT_DROP if c in df.columns])
    return d.withColumn("label", F.col("avg_vtat").cast("double")).drop("avg_vtat")


def wait_stages(df: DataFrame) -> list:
    """Median-imputed numerics passed through, mode-imputed categoricals with levels
    seen fewer than 50 times grouped, then one-hot (M5, M6, M8)."""
    from ridelens.ml.features import feature_groups

    num, cat = feature_groups(df, exclude=("label",))
    return preprocessor(passthrough=num, onehot=cat, min_count=50, impute_numeric=num, impute_categorical=True)


def wait_estimator(label: str = "label"):
    """RF wait-time model: 200 trees, depth 16, leaf ≥ 10, 50 % features, 70 % rows."""
    return RandomForestRegressor(labelCol=label, numTrees=200, maxDepth=16, minInstancesPerNode=10,
                                 featureSubsetStrategy="0.5", subsamplingRate=0.7, seed=42,
                                 cacheNodeIds=True, checkpointInterval=10)


def _wait_rows(df: DataFrame, id_col: str) -> tuple[DataFrame, list]:
    d = wait_frame(df.withColumn("_rid", F.col(id_col))).withColumnRenamed("_rid", id_col)
    return d, wait_stages(d.drop(id_col))


def wait_cv(df: DataFrame, k: int = 3, id_col: str = "booking_id") -> DataFrame:
    """3-fold MAE / RMSE / R² mean ± std of the wait model."""
    d, stages = _wait_rows(df, id_col)
    return cross_validate_regression(d, {"RF": wait_estimator()}, stages, k, id_col, metrics=("mae", "rmse", "r2"))


def wait_holdout(df: DataFrame, id_col: str = "booking_id", test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """MAE, RMSE, R² of the wait model on a hold-out split."""
    from ridelens.ml.folds import train_test_split

    d, stages = _wait_rows(df, id_col)
    train, test = train_test_split(d, id_col, test_fraction, seed)
    m = fit_spread([*stages, wait_estimator()], train, id_col)
    return regression_report(m.transform(test), "label", "prediction", digits=6)


def train_wait_time(df: DataFrame, k: int = 3, id_col: str = "booking_id", save_path: str | None = None):
    """Wait-time job (M28): 3-fold MAE mean ± std, then refit on all rows,
    optionally saved with its feature spec (S7)."""
    d, stages = _wait_rows(df, id_col)
    cv = wait_cv(df, k, id_col)
    model = fit_spread([*stages, wait_estimator()], d, id_col)
    _save(model, d, [c for c in d.columns if c not in ("label", id_col)], save_path)
    return cv, model
