"""Trees grown in the tasks that have their rows, against Spark's own."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from ridelens.ml import grow as G
from ridelens.ml import train as TR

COLS = ["a", "b", "c0", "c1", "c2", "c3"]


def _rows(spark, n=4_000):
    """Two numeric features (one negative), a one-hot block of four levels of five; some rows come twice."""
    d = spark.range(0, n, 1, 3).withColumn("i", F.col("id") - F.col("id") % 10 % 2)
    d = d.select((F.col("i") * 7 % 23).cast("double").alias("a"), (F.col("i") * 13 % 19 - 9).cast("double").alias("b"),
                 *[(F.col("i") * 31 % 5 == k).cast("double").alias(f"c{k}") for k in range(4)], "i")
    label = F.col("a") * 2 + F.col("b") * F.col("c1") - F.col("c3") * 5 + F.pmod(F.xxhash64("i"), F.lit(100_003)) / 60_000
    return VectorAssembler(inputCols=COLS, outputCol="features").transform(d.withColumn("label", label)).select("features", "label")


def _predictions(model, d):
    rows = model.transform(d).select("features", "label", "prediction").collect()
    return np.array([r["prediction"] for r in sorted(rows, key=lambda r: (*r["features"].toArray().tolist(), r["label"]))])


def _one_tree(**kw):
    return RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="all", seed=1, **kw)


def test_one_hot_columns_share_a_slot_and_splits_follow_the_values(spark):
    d = _rows(spark)
    lay = G.feature_layout(d, "features", 32)
    assert [[f for f, _ in s] for s in lay.slots] == [[0], [1], [2, 3, 4, 5]] and lay.dtype == np.uint8
    x = np.array([r["features"].toArray() for r in d.collect()])
    codes = lay.codes(x)
    for s in range(len(lay.feature)):
        want = x[:, lay.feature[s]] > lay.thresholds[lay.feature[s]][lay.bin[s]]
        assert (lay.goes_right(codes, np.full(len(x), s)) == want).all()


def test_neighbours_with_values_other_than_one_share_a_slot_too():
    x = np.array([[0, 0, 2.0], [3, 0, 0], [-4, 0, 0], [0, 5, 0], [0, -1, 0], [0, 0, 0], [1, 0, 0]])
    lay = G.Layout([G.thresholds_of(*np.unique(x[:, f], return_counts=True), 32) for f in range(3)], [3, 3, 3])
    assert len(lay.slots) == 1
    codes, y = lay.codes(x), np.arange(7.0)
    hn, hs = lay.statistics(codes, None, 1, None, y)
    for s in range(len(lay.feature)):
        right = x[:, lay.feature[s]] > lay.thresholds[lay.feature[s]][lay.bin[s]]
        assert (lay.goes_right(codes, np.full(7, s)) == right).all()
        c = np.concatenate([[0], hs[0].cumsum()])
        left = c[lay.cut[s]] - c[lay.lo[s]] + lay.rest[s] * (y.sum() - c[lay.hi[s]] + c[lay.lo[s]])
        assert abs(left - y[~right].sum()) < 1e-9


@pytest.mark.parametrize("task_rows", [4_000_000, 300])
def test_a_tree_on_all_rows_is_sparks_tree(spark, monkeypatch, task_rows):
    monkeypatch.setattr(G, "TASK_ROWS", task_rows)
    monkeypatch.setattr(G, "BLOCK_ROWS", 500)
    monkeypatch.setattr(G, "BATCH_BYTES", 20_000)
    d = _rows(spark)
    for kw in ({"maxDepth": 7, "minInstancesPerNode": 10}, {"maxDepth": 3}, {"maxDepth": 12, "minInfoGain": 0.05}):
        got, want = _predictions(G.fit_forest(_one_tree(**kw), d, 4_000), d), _predictions(_one_tree(**kw).fit(d), d)
        assert np.abs(got - want).max() < 1e-9


def test_boosted_trees_are_sparks(spark):
    d = _rows(spark, 1_500)
    est = GBTRegressor(maxIter=8, stepSize=0.05, maxDepth=5, maxBins=255, seed=20)
    got, want = _predictions(G.fit_boosted(est, d, 1_500), d), _predictions(est.fit(d), d)
    assert np.abs(got - want).max() < 1e-8


def test_too_many_rows_for_a_boosting_task_are_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(G, "BOOST_CODES", 1_000)
    assert G.fit_boosted(GBTRegressor(maxIter=2), _rows(spark, 600), 600) is None


def test_a_forest_on_many_rows_is_grown_where_its_rows_are(spark, monkeypatch):
    monkeypatch.setattr(TR, "GROWN_ROWS", 3_000)
    d = _rows(spark)
    est = RandomForestRegressor(numTrees=30, maxDepth=8, minInstancesPerNode=5, featureSubsetStrategy="0.5",
                                subsamplingRate=0.7, seed=3)
    want = est.fit(d)
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda *a: pytest.fail("grown by Spark, all open nodes from all tasks"))
    m = TR.fit_model(est, d)
    assert m.getNumTrees == 30 and len({len(t[1]) for t in m.trees}) > 1
    label = np.array([r["label"] for r in sorted(d.collect(), key=lambda r: (*r["features"].toArray().tolist(), r["label"]))])
    errors = [np.abs(_predictions(x, d) - label).mean() for x in (m, want)]
    assert abs(errors[0] - errors[1]) < 0.15 * errors[1]
    # the same rows and seed give the same forest, in waves as well
    monkeypatch.setattr(G, "SENT_BYTES", 100_000)
    assert np.abs(_predictions(TR.fit_model(est, d), d) - _predictions(m, d)).max() < 1e-9


def test_grown_trees_are_saved_and_loaded(spark, tmp_dir):
    from pyspark.ml import PipelineModel

    d = _rows(spark, 1_000)
    m = PipelineModel(stages=[G.fit_forest(RandomForestRegressor(numTrees=4, seed=5), d, 1_000)])
    m.write().overwrite().save(os.path.join(tmp_dir, "m"))
    loaded = PipelineModel.load(os.path.join(tmp_dir, "m"))
    assert (_predictions(loaded, d) == _predictions(m, d)).all()


def test_values_beyond_counting_are_cut_at_quantiles_and_missing_ones_are_largest(spark, monkeypatch):
    d = spark.range(0, 3_000, 1, 2).select(
        F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 7.0).alias("a"),
        (F.col("id") * 0.5).alias("b"), F.when(F.col("id") % 10 == 0, 50.0).otherwise(F.col("id") / 1000).alias("label"))
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(d).select("features", "label")
    monkeypatch.setattr(G, "COUNTED_VALUES", 100)
    lay = G.feature_layout(d, "features", 32)
    assert len(lay.thresholds[0]) == 7 and 29 <= len(lay.thresholds[1]) <= 31
    shares = np.diff(np.concatenate([[0.0], lay.thresholds[1], [1500.0]]))
    assert shares.max() < 1.5 * 1500 / 32
    m = G.fit_forest(_one_tree(maxDepth=6), d, 3_000)
    assert m.transform(d).where(F.abs(F.col("prediction") - F.col("label")) > 0.2).count() == 0


def test_a_missing_label_is_an_error(spark):
    d = _rows(spark, 100).withColumn("label", F.when(F.col("label") > 0, F.col("label")))
    with pytest.raises(Exception, match="label is null"):
        G.fit_forest(RandomForestRegressor(numTrees=2), d, 100)


def test_scored_requests_are_derived_once(spark, monkeypatch):
    from ridelens.plans import q_ml

    derived, region = spark.sparkContext.accumulator(0), q_ml.region

    @F.udf("long")
    def counted(i):
        derived.add(1)
        return i

    monkeypatch.setattr(q_ml, "region", lambda s, sf: region(s, sf).withColumn("booking_id", counted("booking_id")))
    monkeypatch.setattr(TR, "wait_estimator", lambda: RandomForestRegressor(numTrees=3, maxDepth=3, seed=4))
    out = q_ml.score_requests(spark, "/root/testdata/sf0.001")
    assert out.count() == region(spark, "/root/testdata/sf0.001").count() == derived.value


def test_boosting_starts_first(spark, monkeypatch):
    from pyspark.ml.regression import LinearRegression

    from ridelens.ml.features import preprocessor

    seen = []
    monkeypatch.setattr(TR, "fit_model", lambda est, tr: seen.append(type(est).__name__) or LinearRegression().fit(tr))
    d = spark.range(0, 90, 1, 2).select(F.col("id").alias("booking_id"), (F.col("id") % 7).cast("double").alias("x"),
                                        (F.col("id") % 7 * 2).cast("double").alias("label"))
    models = {"Linear": LinearRegression(), "RF": RandomForestRegressor(), "HGB": GBTRegressor()}
    lb = TR.cross_validate_regression(d, models, preprocessor(standard=["x"]), k=2, parallelism=1, persist=False)
    assert seen[:2] == ["GBTRegressor"] * 2 and sorted(r["model"] for r in lb.collect()) == sorted(models)
