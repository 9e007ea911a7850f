"""Training rows spread over tasks, forests grown in parts, equal rows as one."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from ridelens.ml import train as TR


def _rows(spark, n):
    # one task; half of the ids are null, a tenth repeat
    d = spark.range(0, n, 1, 1)
    return d.select(F.when(d.id % 2 == 0, F.when(d.id % 10 == 0, 7).otherwise(d.id)).alias("rid"),
                    (d.id % 50).cast("double").alias("x"), (d.id % 50 * 2 + d.id % 3).cast("double").alias("label"))


def _assembled(df):
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(df)


def test_tasks_follow_the_rows():
    assert [TR.fit_tasks(n) for n in (0, 11_999, 12_000, 100_000, 6_000_000, 36_000_000)] == [1, 1, 2, 16, 24, 144]


def test_rows_of_one_task_are_dealt_out_evenly(spark):
    d = _rows(spark, 24_000)
    assert d.rdd.getNumPartitions() == 1
    out = TR.spread(d, "rid")
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and all(abs(r["count"] - 6_000) <= 1 for r in sizes)
    assert out.exceptAll(d).count() == 0 and out.count() == 24_000


def test_wait_model_is_fitted_in_several_tasks(spark, monkeypatch):
    seen = []
    fit = LinearRegression.fit
    monkeypatch.setattr(LinearRegression, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    d = _rows(spark, 30_000)
    m = TR.fit_spread([VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression()], d, "rid")
    assert seen[0] > 1 and abs(m.stages[-1].coefficients[0] - 2.0) < 0.01


def test_forest_in_parts_has_all_its_trees(spark):
    d = _assembled(_rows(spark, 20_000))
    est = RandomForestRegressor(numTrees=9, maxDepth=6, minInstancesPerNode=10, seed=3)
    m = TR.fit_model(est, d)
    forests = m.stages[:-1]
    assert len(forests) == 9 and sum(f.getNumTrees for f in forests) == 9
    out = m.transform(d)
    assert out.columns == [*d.columns, "prediction"]
    few = d.limit(50)
    whole, parts = m.transform(few).collect(), [f.transform(few).collect() for f in forests]
    for i, r in enumerate(whole):
        assert abs(r["prediction"] - sum(p[i][f.getPredictionCol()] for p, f in zip(parts, forests, strict=True)) / 9) < 1e-9
    assert out.agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0] < 1.5


def test_forest_on_a_handful_of_rows_is_one(spark):
    m = TR.fit_model(RandomForestRegressor(numTrees=3, seed=3), _assembled(_rows(spark, 500)))
    assert m.getNumTrees == 3


def test_forests_take_few_tasks_each(spark, monkeypatch):
    seen = []
    fit = RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    d = _assembled(_rows(spark, 2_000)).repartition(4)
    est = RandomForestRegressor(numTrees=16, maxDepth=2, seed=3)
    for n, tasks, forests in ((120_000, 1, 16), (280_000, 2, 8)):
        seen.clear()
        m = TR.fit_model(est, d, n)
        assert seen == [tasks] * forests and sum(f.getNumTrees for f in m.stages[:-1]) == 16


def test_equal_rows_are_fitted_as_one(spark):
    d = spark.range(0, 20_000, 1, 3)
    d = d.select((d.id % 5).cast("double").alias("x"), ((d.id * 7) % 11 % 3).cast("double").alias("label_idx"),
                 (1.0 + d.id % 11 % 2).alias("weight"))
    d = _assembled(d).select("features", "label_idx", "weight")
    kinds = TR.equal_rows_as_one(d, "kinds_test")
    assert kinds.count() == 15
    want = TR.status_estimator(penalty=0.0, tol=1e-9).fit(d).coefficientMatrix.toArray()
    got = TR.status_estimator(penalty=0.0, tol=1e-9).fit(kinds).coefficientMatrix.toArray()
    assert abs(want - got).max() < 1e-4


def test_different_rows_stay(spark):
    d = spark.range(0, 20_000, 1, 2).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label_idx"),
                                            F.lit(1.0).alias("weight"))
    d = _assembled(d).select("features", "label_idx", "weight")
    assert TR.equal_rows_as_one(d, "kinds_none") is d


def _signal_stages(df):
    from ridelens.ml.features import preprocessor

    return preprocessor(onehot=["signal"])


def test_status_rows_are_derived_once_and_scored_by_fold(spark):
    derived = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def signal(i):
        derived.add(1)
        return f"s{i % 7 // 2}"

    d = spark.range(0, 600, 1, 3).select(
        F.col("id").alias("booking_id"), F.concat(F.lit("c"), (F.col("id") * 7 % 11 % 3).cast("string")).alias("booking_status"))
    out = TR.oof_status(d.withColumn("signal", signal("booking_id")), stages=_signal_stages)
    assert derived.value == 600
    assert out.columns == ["booking_id", "label", "prediction", "probability", "classes", "fold"]
    assert out.count() == 600 and out.select("booking_id").distinct().count() == 600
    # the scored rows of a fold are read where they were written
    per_file = out.groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_file) and dict(out.dtypes)["fold"] == "int"


def test_rows_are_in_order_within_their_task(spark):
    d = _rows(spark, 24_000).withColumn("fold", F.col("x") % 3)
    out = TR.spread(d, "rid", within=("fold",)).select(F.spark_partition_id().alias("p"), "fold", "rid").collect()
    for p in range(4):
        keys = [(r["fold"], r["rid"] is not None, r["rid"] or 0) for r in out if r["p"] == p]
        assert len(keys) == 6_000 and keys == sorted(keys)
