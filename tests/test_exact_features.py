"""Exact scaler and imputer, the checked classifier's training run, box statistics."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ridelens.ml import features as FT
from ridelens.ml import train as TR
from ridelens.operators import bins as BN


@pytest.fixture(scope="module")
def uneven(spark):
    """A third of the rows share one value, the rest are spread over many magnitudes; every tenth is missing."""
    i = F.col("id")
    x = F.when(i % 3 == 0, 7.0).otherwise(F.exp((F.hash("id") % 1_000) / 100.0))
    return spark.range(60_000).select(F.when(i % 10 != 0, x).alias("x"), (F.hash("id", F.lit(2)) % 10_007 / 8.0).alias("y"),
                                      F.lit(4.0).alias("flat"), F.when(i % 2 == 0, F.lit(float("nan"))).otherwise(
                                          i.cast("double")).alias("n"), F.lit(None).cast("double").alias("none"))


def test_exact_scaler_equals_numpy(uneven):
    cols = ["x", "y", "flat", "n", "none"]
    m = FT.ExactRobustScaler(inputCols=cols, outputCols=[f"{c}_s" for c in cols]).fit(uneven)
    rows = uneven.toPandas()
    for c in cols[:4]:
        v = rows[c].to_numpy(float)
        q1, q2, q3 = np.nanpercentile(v, [25, 50, 75])
        assert m.numbers()[c] == pytest.approx([q2, (q3 - q1) or 1.0], abs=1e-12)
    assert m.numbers()["none"] == [0.0, 1.0]


def test_no_task_holds_a_whole_column(uneven, spark):
    from ridelens.operators import common as CM

    long = uneven.select(F.lit("x").alias("c"), "x")
    stats = CM._brackets(long.select("c", F.col("x").alias("_v")), ["c"], [0.25, 0.5, 0.75], 10_000, [])
    rows = long.select("c", F.col("x").alias("_v")).join(stats, "c")
    held = CM._bracketed(rows, ["c"], 3).where("_i >= 0").agg(F.sum("_f"), F.count("*")).first()
    # the heavy value is one entry, the rest of the brackets a few hundred
    assert held[1] <= 1_000


def test_exact_imputer_and_round_trip(uneven, tmp_dir):
    stages = FT.preprocessor(robust=["x"], passthrough=["y"], impute_numeric=["x", "y"])
    model = Pipeline(stages=stages).fit(uneven)
    model.write().overwrite().save(f"{tmp_dir}/m")
    again = PipelineModel.load(f"{tmp_dir}/m")
    a, b = (m.transform(uneven).select(vector_to_array("features").alias("f")).toPandas()["f"].tolist()
            for m in (model, again))
    assert np.array_equal(np.array(a), np.array(b))
    median = np.nanmedian(uneven.toPandas()["x"])
    assert model.stages[0].numbers()["x"] == pytest.approx(median, abs=1e-12)


def test_imputer_refuses_an_empty_column(uneven):
    with pytest.raises(ValueError, match="none"):
        FT.ExactMedianImputer(inputCols=["x", "none"], outputCols=["x", "none"]).fit(uneven)


def _status_rows(spark):
    status = F.element_at(F.array(*[F.lit(s) for s in ("Completed", "Incomplete", "No Driver Found")]),
                          F.when(F.col("id") % 10 < 6, 1).when(F.col("id") % 10 < 8, 2).otherwise(3))
    return spark.range(600).select(F.col("id").alias("booking_id"), status.alias("booking_status"),
                                   (F.floor((F.col("id") % 10 + F.col("id") % 3) / 3)).cast("string").alias("signal"))


def _stages(df):
    return FT.preprocessor(onehot=["signal"])


def test_saturated_probabilities_are_weighted_shares(spark):
    d = _status_rows(spark)
    model = TR.train_booking_status(d, stages=_stages, penalty=0.0, tol=1e-9)
    classes = model.stages[0].labels
    levels = d.select("signal").distinct().withColumn("booking_status", F.lit(classes[0]))
    got = {(r["signal"], r["class"]): r["probability"] for r in TR.level_probabilities(model, levels, classes).collect()}
    rows = d.toPandas()
    share = rows.groupby("booking_status").size()
    for signal, g in rows.groupby("signal"):
        w = (g.groupby("booking_status").size() / share).fillna(0.0)
        for c in classes:
            assert got[signal, c] == pytest.approx(w[c] / w.sum(), abs=1e-4)


def test_reports_on_the_same_rows_share_a_training_run(spark):
    d = _status_rows(spark)
    first = TR.oof_status(d, stages=_stages, penalty=0.0, k=2)
    runs = len(TR._OOF_RUNS)
    again = TR.oof_status(d.repartition(3), stages=_stages, penalty=0.0, k=2)
    assert len(TR._OOF_RUNS) == runs and first.inputFiles() == again.inputFiles()
    TR.oof_status(d.where("booking_id < 500"), stages=_stages, penalty=0.0, k=2)
    TR.oof_status(d, stages=_stages, penalty=1.0, k=2)
    assert len(TR._OOF_RUNS) == runs + 2
    assert first.count() == first.select("booking_id").distinct().count() == 600
    worst = first.select(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1).alias("e"))
    assert worst.agg(F.max("e")).first()[0] < 1e-9


@pytest.mark.parametrize("rows", [3, 700, 60_000])
def test_box_stats_equals_numpy(spark, rows):
    rng = np.random.default_rng(rows)
    v = np.round(np.concatenate([rng.normal(0, 1, rows - rows // 10), rng.normal(0, 30, rows // 10)]), 3)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double")
    r = BN.box_stats(df, "x").first()
    q1, q2, q3 = np.percentile(v, [25, 50, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = v[(v >= lo) & (v <= hi)]
    assert (r.q1, r.median, r.q3) == pytest.approx((q1, q2, q3), abs=1e-9)
    assert (r.whisker_low, r.whisker_high, r.n_outliers, r.n) == (inside.min(), inside.max(), rows - len(inside), rows)


def test_box_stats_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(None,)], "x double")
    r = BN.box_stats(df, "x").first()
    assert (r.q1, r.whisker_low, r.n_outliers, r.n) == (None, None, 0, 0)
    r = BN.box_stats(spark.range(9).select(F.lit(2.5).alias("x")), "x").first()
    assert (r.q1, r.whisker_low, r.whisker_high, r.n_outliers, r.n) == (2.5, 2.5, 2.5, 0, 9)
