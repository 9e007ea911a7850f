"""ML data operators, evaluators, persistence, sources/sinks and streaming."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ridelens.ml import evaluate as EV
from ridelens.ml import folds as FD
from ridelens.ml.features import INFREQUENT, LevelGrouper, level_counts, onehot_block


def test_stratified_folds_balanced_and_complete(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(1, 301)]
    df = spark.createDataFrame(rows, "id long, y string")
    f = FD.stratified_folds(df, "y", "id", k=4, rows_per_range=30)
    assert f.count() == 300 and f.select("id").distinct().count() == 300
    per = {(r.y, r.fold): r.n for r in f.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    for y in ("a", "b"):
        sizes = [per[(y, k)] for k in range(4)]
        assert max(sizes) - min(sizes) <= 1
    # default k = max(2, min(5, smallest class))
    tiny = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b")], "id long, y string")
    assert FD.stratified_folds(tiny, "y", "id").agg(F.max("fold")).first()[0] == 1


def test_hash_split_is_repeatable_under_repartition(spark):
    df = spark.range(2000).withColumnRenamed("id", "rid")
    a_train, a_test = FD.train_test_split(df, "rid")
    b_train, b_test = FD.train_test_split(df.repartition(7), "rid")
    assert sorted(r.rid for r in a_test.collect()) == sorted(r.rid for r in b_test.collect())
    assert a_train.count() + a_test.count() == 2000
    assert 300 < a_test.count() < 500


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "y string")
    w = {r.y: r.weight for r in FD.class_weights(df, "y").collect()}
    assert abs(w["a"] - 8 / (2 * 6)) < 1e-12 and abs(w["b"] - 8 / (2 * 2)) < 1e-12


def test_confusion_and_report_zero_division(spark):
    p = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("z", "y")], "label string, prediction string")
    cm = {(r.actual, r.predicted): r.n for r in EV.confusion_matrix(p).collect()}
    assert len(cm) == 9 and cm[("z", "z")] == 0 and cm[("x", "y")] == 1
    rep = {r["class"]: r for r in EV.classification_report(p).collect()}
    assert rep["z"].precision == 0.0 and rep["z"].recall == 0.0 and rep["z"].f1 == 0.0
    assert rep["accuracy"].f1 == 0.5
    assert abs(rep["macro avg"].recall - (0.5 + 1.0 + 0.0) / 3) < 1e-6


def test_regression_report(spark):
    p = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)], "label double, prediction double")
    r = EV.regression_report(p).first()
    assert abs(r.mse - 2 / 3) < 1e-6 and abs(r.mae - 2 / 3) < 1e-6 and abs(r.r2 - 0.0) < 1e-6


def test_level_grouper_infrequent_unseen_and_nulls(spark, tmp_dir):
    from pyspark.ml import Pipeline, PipelineModel

    train = spark.createDataFrame([("a",)] * 10 + [("b",)] * 5 + [("rare",)] + [(None,)] * 2, "c string")
    lc = {r.level: r.is_infrequent for r in level_counts(train, ["c"], min_count=2).collect()}
    assert lc == {"a": False, "b": False, "rare": True}
    stages = [LevelGrouper(inputCols=["c"], outputCols=["c_g"], minCount=2, imputeMode=True)]
    st, vecs = onehot_block(["c_g"], "cat")
    model = Pipeline(stages=stages + st).fit(train)
    path = os.path.join(tmp_dir, "m")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    test = spark.createDataFrame([("a",), ("rare",), ("unseen",), (None,)], "c string")
    out = loaded.transform(test).collect()
    assert out[0].c_g == "a" and out[1].c_g == INFREQUENT
    assert out[3].c_g == "a"  # mode imputation
    assert out[0][vecs[0]].numNonzeros() == 1 and out[1][vecs[0]].numNonzeros() == 1
    assert out[2][vecs[0]].numNonzeros() == 0  # a level training never saw is no rare level
    # a missing value that is not imputed counts as a level, here a rare one
    alone = LevelGrouper(inputCols=["c"], outputCols=["c_g"], minCount=3).fit(train)
    assert [r.c_g for r in alone.transform(test).collect()] == ["a", INFREQUENT, "unseen", INFREQUENT]


def test_onehot_unseen_is_zero_vector(spark):
    from pyspark.ml import Pipeline

    train = spark.createDataFrame([("a",), ("b",)], "c string")
    st, vecs = onehot_block(["c"], "cat")
    m = Pipeline(stages=st).fit(train)
    v = m.transform(spark.createDataFrame([("a",), ("zzz",)], "c string")).collect()
    assert v[0][vecs[0]].size == 2 and v[0][vecs[0]].numNonzeros() == 1
    assert v[1][vecs[0]].numNonzeros() == 0


def test_linear_model_beats_mean_on_planted_signal(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    from ridelens.ml.features import preprocessor

    rows = [(float(i % 17), float(3 * (i % 17) + (i % 5) * 0.1), "k" + str(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, label double, cat string")
    m = Pipeline(stages=preprocessor(standard=["x"], onehot=["cat"]) + [LinearRegression()]).fit(df)
    r = EV.regression_report(m.transform(df)).first()
    assert r.r2 > 0.99


def test_sources_roundtrip_and_failures(spark, tmp_dir):
    from ridelens.schemas import RAW_SCHEMA
    from ridelens.sources import files as S
    from ridelens.sources.driver_views import bookings_raw

    raw = bookings_raw(spark, "/root/testdata/sf0.001").limit(50)
    path = os.path.join(tmp_dir, "raw_csv")
    S.export_csv(raw, path)
    back = S.read_bookings(spark, path, RAW_SCHEMA)
    assert back.count() == 50 and back.columns == [f.name for f in RAW_SCHEMA.fields]
    tables, failures = S.load_tables(spark, {"ok": path, "missing": os.path.join(tmp_dir, "nope")},
                                     fmt="csv", schemas={"ok": RAW_SCHEMA})
    assert set(tables) == {"ok"} and set(failures) == {"missing"}
    out = S.sql_report(spark, "SELECT COUNT(*) AS n FROM IDENTIFIER(:t)", {"t": "rl_raw"}, {"rl_raw": back})
    assert out.first().n == 50


def test_append_feedback_and_stream(spark, tmp_dir):
    from ridelens.sources import files as S
    from ridelens.streaming.feedback import FEEDBACK_INPUT_SCHEMA, start_feedback_sink

    rows = [(3, "good", "a@b.co"), (9, "x", "bad"), (1, "", "c@d.io")]
    df = spark.createDataFrame(rows, FEEDBACK_INPUT_SCHEMA)
    sink = os.path.join(tmp_dir, "fb")
    S.append_feedback(df, sink)
    S.append_feedback(df, sink)
    assert spark.read.parquet(sink).count() == 2

    landing = os.path.join(tmp_dir, "landing")
    df.write.parquet(landing)
    q1, q2 = start_feedback_sink(spark, landing, os.path.join(tmp_dir, "stream_out"), os.path.join(tmp_dir, "ck"))
    q1.awaitTermination(120)
    q2.awaitTermination(120)
    got = spark.read.parquet(os.path.join(tmp_dir, "stream_out"))
    assert got.count() == 1 and got.first().rating == 3
    assert spark.read.parquet(os.path.join(tmp_dir, "stream_out_rejected")).count() == 2


def test_data_dictionary(spark):
    from ridelens.schemas import data_dictionary

    d = data_dictionary(spark)
    assert d.count() == 21 and d.first().column_name == "Date"


def test_persisted_reports_match_catalogue(spark, tmp_dir):
    from ridelens.plans import catalog
    from ridelens.plans.persisted import build_tables, run_reports

    sf = "/root/testdata/sf0.001"
    tables = build_tables(spark, sf, base=tmp_dir)
    reps = run_reports(tables, ["value_distribution", "zone_kpis", "heatmap_weekday_hour", "column_profile"])
    qs = catalog.queries()
    for name, df in reps.items():
        a = sorted(map(tuple, df.collect()), key=repr)
        b = sorted(map(tuple, qs[name](spark, sf).select(*df.columns).collect()), key=repr)
        assert a == b, name


def test_cv_classification_metrics_matches_per_fold(spark):
    rows = [(0, "a", "a"), (0, "b", "a"), (0, "b", "b"), (1, "a", "a"), (1, "a", "b"), (1, "c", "c")]
    p = spark.createDataFrame(rows, "fold int, label string, prediction string")
    m = EV.cv_classification_metrics(p).first()
    per = [EV.accuracy_macro_f1(p.where(F.col("fold") == f)).first() for f in (0, 1)]
    import statistics

    accs = [r.accuracy for r in per]
    f1s = [r.f1_macro for r in per]
    assert abs(m.accuracy_mean - statistics.mean(accs)) < 1e-9
    assert abs(m.accuracy_std - statistics.pstdev(accs)) < 1e-9
    assert abs(m.f1_macro_mean - statistics.mean(f1s)) < 1e-9 and m.n_folds == 2


def test_level_grouper_all_null_column(spark):
    from pyspark.ml import Pipeline

    train = spark.createDataFrame([(None, "x"), (None, "y")], "c string, d string")
    st, vecs = onehot_block(["c_g"], "cat")
    m = Pipeline(stages=[LevelGrouper(inputCols=["c"], outputCols=["c_g"], imputeMode=True)] + st).fit(train)
    out = m.transform(spark.createDataFrame([(None, "x"), ("new", "y")], "c string, d string")).collect()
    assert out[0].c_g == "__missing__"
    assert out[0][vecs[0]].numNonzeros() == 1 and out[1][vecs[0]].numNonzeros() == 0


def test_scoring_model_roundtrip(spark, tmp_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    from ridelens.ml import score as SC
    from ridelens.ml.features import preprocessor

    train = spark.createDataFrame([(float(i), float(2 * i + 1), "m" + str(i % 2)) for i in range(30)],
                                  "avg_vtat double, label double, month string")
    m = Pipeline(stages=preprocessor(standard=["avg_vtat"], onehot=["month"]) + [LinearRegression()]).fit(train)
    spec = SC.model_spec(train, ["avg_vtat", "month"])
    path = os.path.join(tmp_dir, "scoring")
    SC.save_scoring_model(m, spec, path)
    m2, spec2 = SC.load_scoring_model(spark, path)
    assert spec2 == spec
    req = spark.createDataFrame([("3", "m1")], "avg_vtat string, month string")
    p = m2.transform(SC.align_to_model(req, spec2)).first().prediction
    assert abs(p - 7.0) < 1e-6


def test_bucketed_tables_join_without_exchange(spark, tmp_dir):
    from ridelens.sources.driver_views import table
    from ridelens.sources.files import write_bucketed

    sf = "/root/testdata/sf0.001"
    ev = write_bucketed(table(spark, sf, "events"), "rl_events_b", "user_id", 8, os.path.join(tmp_dir, "ev"))
    cu = write_bucketed(table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id"),
                        "rl_customer_b", "user_id", 8, os.path.join(tmp_dir, "cu"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = ev.join(cu, "user_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == table(spark, sf, "events").join(
            table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS rl_events_b")
        spark.sql("DROP TABLE IF EXISTS rl_customer_b")


def test_read_locations_first_match_and_nan(spark, tmp_dir):
    from ridelens.operators.geo import geocode, location_lookup
    from ridelens.sources.files import read_bookings, read_locations
    from ridelens.schemas import RAW_SCHEMA

    loc = os.path.join(tmp_dir, "loc.csv")
    with open(loc, "w") as f:
        f.write("location,latitude,longitude\nZeta,28.9,77.9\nzeta,28.1,77.1\nAlpha,NaN,77.0\n")
    locs = read_locations(spark, loc)
    lk = location_lookup(locs, order_col="_line")
    req = spark.createDataFrame([("ZETA",), ("alpha",)], "p string")
    got = {r.p: (r.pickup_latitude, r.pickup_longitude) for r in geocode(req, lk, "p", "pickup").collect()}
    assert got["ZETA"] == (28.9, 77.9)  # first line wins, whatever its spelling
    assert got["alpha"][0] is None  # NaN read as NULL
    raw = os.path.join(tmp_dir, "raw.csv")
    with open(raw, "w") as f:
        f.write(",".join(fl.name for fl in RAW_SCHEMA.fields) + "\n" + ",".join(["x"] * 8 + ["NaN"] + [""] * 12) + "\n")
    r = read_bookings(spark, raw, RAW_SCHEMA).first()
    assert r["Avg VTAT"] is None


def test_ridge_mapping_matches_closed_form(spark):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(3)
    n, alpha = 200, 1.0
    X = rng.normal(size=(n, 3)) * np.array([1.0, 5.0, 0.5])
    y = X @ np.array([2.0, -1.0, 4.0]) + 3.0 + rng.normal(scale=2.0, size=n)
    # closed form with an unpenalised intercept: centre, solve, recover the intercept
    xm, ym = X.mean(axis=0), y.mean()
    w = np.linalg.solve((X - xm).T @ (X - xm) + alpha * np.eye(3), (X - xm).T @ (y - ym))
    b = ym - xm @ w
    df = spark.createDataFrame([(float(a), float(c), float(d), float(t)) for (a, c, d), t in zip(X, y)],
                               "a double, c double, d double, label double")
    feats = VectorAssembler(inputCols=["a", "c", "d"], outputCol="features").transform(df)
    reg = alpha * float(np.std(y)) / n  # population std of the label
    m = LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False, tol=1e-12,
                         maxIter=1000).fit(feats)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-6)
    assert abs(m.intercept - b) < 1e-6


def test_model_deterministic_under_repartition(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    from ridelens.ml.features import preprocessor

    rows = [(i, float(i % 13), float((i * 7) % 11), "c" + str(i % 4), float(2 * (i % 13) - (i * 7) % 11 + i % 3))
            for i in range(600)]
    df = spark.createDataFrame(rows, "rid long, a double, b double, cat string, label double")
    coefs = []
    for d in (df, df.repartition(7, "cat"), df.repartition(3)):
        train, _ = FD.train_test_split(d, "rid", 0.2, seed=42)
        m = Pipeline(stages=preprocessor(standard=["a", "b"], onehot=["cat"]) + [LinearRegression()]).fit(train)
        coefs.append(m.stages[-1].coefficients.toArray())
    import numpy as np

    assert all(np.allclose(coefs[0], c, atol=1e-8) for c in coefs[1:])


def test_train_save_load_score(spark, tmp_dir):
    from pyspark.ml.regression import LinearRegression

    from ridelens.ml import score as SC
    from ridelens.ml import train as TR
    from ridelens.plans.q_region import region

    reg = region(spark, "/root/testdata/sf0.001")
    path = os.path.join(tmp_dir, "value_model")
    lb, model = TR.train_booking_value(reg, models={"Linear": LinearRegression(labelCol="label")}, save_path=path)
    assert lb.count() == 1
    loaded, spec = SC.load_scoring_model(spark, path)
    assert "avg_vtat" in spec["features"] and spec["types"]["avg_vtat"] == "double"
    vt = TR.value_frame(reg)
    a = [r.prediction for r in model.transform(vt).orderBy("booking_id").select("prediction").collect()]
    b = [r.prediction for r in loaded.transform(SC.align_to_model(vt, spec)).orderBy("booking_id")
         .select("prediction").collect()]
    assert len(a) == len(b) and all(abs(x - y) < 1e-9 for x, y in zip(a, b))
