"""Model evaluation as DataFrame aggregates.

All metrics are one pass of conditional aggregates over ``(label, prediction)``
rows; per-class tables are bounded by the number of classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.functions import pround


def regression_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                      digits: int | None = 6) -> DataFrame:
    """MSE, RMSE, R², MAE in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    k = pred.agg(
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        # total sum of squares from the numerically stable central moment
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.count(F.lit(1)).alias("n"),
    )
    r2 = F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))
    cols = {"mse": F.col("mse"), "rmse": F.sqrt("mse"), "r2": r2, "mae": F.col("mae")}
    return k.select(*[(pround(v, digits) if digits is not None else v).alias(n) for n, v in cols.items()], "n")


MAX_CLASSES = 10_000


def pair_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n): the one pass over the predictions that every class metric is read from."""
    return pred.groupBy(F.col(label).cast("string").alias("actual"),
                        F.col(prediction).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """All counted pairs as one row's array: at most ``MAX_CLASSES``² small entries, which is what
    a confusion matrix is. More distinct labels than ``MAX_CLASSES`` are no classes; the query then fails."""
    row = pair_counts(pred, label, prediction).agg(
        F.collect_list(F.struct("actual", "predicted", "n")).alias("p"), F.count_distinct("actual").alias("k"))
    too_many = F.raise_error(F.lit(f"more than {MAX_CLASSES} distinct labels: not a classification"))
    none = F.array().cast("array<struct<actual:string,predicted:string,n:bigint>>")
    return row.select(F.when(F.col("k") > MAX_CLASSES, too_many.cast(
        "array<struct<actual:string,predicted:string,n:bigint>>")).otherwise(F.coalesce("p", none)).alias("p"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long confusion matrix ``(actual, predicted, n)`` over every pair of labels seen,
    zeros included (M23). One aggregate over the predictions; the grid is generated from its pairs."""
    row = _pairs(pred, label, prediction)
    classes = F.array_sort(F.array_compact(F.array_distinct(F.concat("p.actual", "p.predicted"))))
    counted = F.map_from_entries(F.transform(
        F.filter("p", lambda x: x["actual"].isNotNull() & x["predicted"].isNotNull()),
        lambda x: F.struct(F.struct(x["actual"], x["predicted"]), x["n"])))
    grid = row.select(classes.alias("c"), counted.alias("m"))
    grid = grid.select("c", "m", F.explode("c").alias("actual")).select(
        "m", "actual", F.explode("c").alias("predicted"))
    n = F.try_element_at("m", F.struct("actual", "predicted"))
    return grid.select("actual", "predicted", F.coalesce(n, F.lit(0).cast("long")).alias("n"))


def class_counts(pred: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """(by, class, support, tp, npred) from one aggregate over the predictions: each counted pair is a support
    of its label and a prediction of its class."""
    by = by or []
    pairs = pred.groupBy(*by, F.col(label).cast("string").alias("a"), F.col(prediction).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("a").alias("class"), F.col("n").alias("support"), hit.alias("tp"), zero.alias("npred")),
        F.struct(F.col("p").alias("class"), zero.alias("support"), zero.alias("tp"), F.col("n").alias("npred")))
    return pairs.select(*by, F.inline(sides)).where(F.col("class").isNotNull()).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("npred").alias("npred"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          digits: int = 6) -> DataFrame:
    """Per-class precision / recall / F1 / support, plus ``accuracy``, ``macro avg``
    and ``weighted avg`` rows; zero division gives 0 (M24). One aggregate over the
    predictions; the summary rows come from grouping sets over its per-class table."""
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    per = class_counts(pred, label, prediction).select(
        "class", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "support", "tp")
    w = F.col("support").cast("double")
    means = [F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")]
    weighted = [F.try_divide(F.sum(F.col(c) * w), F.sum(w)).alias(f"w_{c}") for c in ("precision", "recall", "f1")]
    sums = per.rollup("class").agg(
        F.grouping("class").alias("g"), F.sum("support").alias("s"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("support").cast("double")).alias("acc"), *means, *weighted)

    def line(name: Column, p: str, r: str, f: str) -> Column:
        return F.struct(name.alias("class"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                        F.col(f).alias("f1"), F.col("s").cast("long").alias("support"))

    total = F.array(line(F.lit("accuracy"), "acc", "acc", "acc"),
                    line(F.lit("macro avg"), "m_precision", "m_recall", "m_f1"),
                    line(F.lit("weighted avg"), "w_precision", "w_recall", "w_f1"))
    own = F.array(line(F.col("class"), "m_precision", "m_recall", "m_f1"))
    out = sums.select(F.inline(F.when(F.col("g") == 1, total).otherwise(own)))
    return out.select("class", *[pround(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")


def accuracy_macro_f1(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and macro F1 (M21). Spark's ``f1`` metric is *weighted*,
    so macro F1 is computed here from the per-class report."""
    rep = classification_report(pred, label, prediction, digits=12)
    return rep.agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "macro avg", F.col("f1"))).alias("f1_macro"),
    )


def cv_classification_metrics(pred: DataFrame, fold: str = "fold", label: str = "label",
                              prediction: str = "prediction") -> DataFrame:
    """Accuracy and macro F1 per fold, then mean ± population std over folds (M21),
    all in one lazy plan: per ``(fold, class)`` counts → per-fold metrics → one row.
    Classes are those seen as label or prediction within the fold (zero division → 0)."""
    per = class_counts(pred, label, prediction, [fold])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    by_fold = per.groupBy(fold).agg(
        (F.sum("tp").cast("double") / F.sum("support").cast("double")).alias("accuracy"),
        F.avg(f1).alias("f1_macro"))
    return by_fold.agg(
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("f1_macro").alias("f1_macro_mean"), F.stddev_pop("f1_macro").alias("f1_macro_std"),
        F.count(F.lit(1)).alias("n_folds"))
