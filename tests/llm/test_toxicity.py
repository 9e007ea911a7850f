from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.llm import toxicity as T

SF1 = "/root/testdata/sf0.1"


def test_cumulative_link_recovers_a_known_model():
    rng = np.random.default_rng(0)
    n, w, t = 6_000, np.array([2.0, -1.0, 0.0]), np.array([0.5, 2.0])
    x = rng.normal(size=(n, 3))
    latent = x @ w + rng.logistic(size=n)
    grades = (latent[:, None] > t).sum(1)
    rows, cols = np.repeat(np.arange(n), 3), np.tile(np.arange(3), n)
    got_w, got_t = T.fit_cumulative_link(rows, cols, x.ravel(), grades, 3)
    assert np.abs(got_w - w).max() < 0.15 and np.abs(got_t - t).max() < 0.15
    assert (np.diff(got_t) > 0).all()


@pytest.fixture(scope="module")
def held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2))
    model = T.fit_toxicity(docs, labels.where(half == 0))
    test = docs.join(labels.where(half == 1).select("doc_id", "toxic"), "doc_id")
    return model, T.with_severity(test, model).select("toxic", "severity").toPandas()


def test_held_out_accuracy(held_out):
    model, got = held_out
    rejected = got.severity >= T.REJECT_FROM
    assert rejected[got.toxic == 1].mean() > 0.85  # a tenth of the toxic labels here are noise
    assert rejected[got.toxic == 0].mean() < 0.01
    assert got.severity.between(0, 3).all() and (np.diff(model.thresholds) > 0).all()


def test_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (None, 1), (6, None), (7, 0), (999, 1)],
                                   "doc_id long, toxic int")
    model = T.fit_toxicity(edge_docs, labels)
    out = T.with_severity(edge_docs, model)
    assert out.columns == [*edge_docs.columns, "severity"] and out.count() == len(edge_rows)
    assert out.where("severity IS NULL").isEmpty()
    nothing = T.fit_toxicity(edge_docs, labels.where("toxic = 0"))
    assert T.with_severity(edge_docs, nothing).where("severity <> 0").isEmpty()
    assert T.drop_toxic(edge_docs, labels.limit(0)).count() == len(edge_rows)
    assert T.drop_toxic(no_docs, labels).count() == 0


def test_severity_labels_are_used_as_they_are(spark):
    rows = [(i, "bad worse worst fine good".split()[i % 5] + f" filler{i % 3}", [2, 2, 3, 0, 0][i % 5])
            for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, severity int")
    model = T.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "severity"))
    got = T.with_severity(df.select("doc_id", "text"), model, "s").join(df.select("doc_id", "severity"), "doc_id")
    by = {r["severity"]: r["s"] for r in got.groupBy("severity").agg(F.avg("s").alias("s")).collect()}
    assert by[0] < 0.5 < 1.5 < by[2] < by[3]
