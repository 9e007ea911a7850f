"""Once-only appends, distinct counts, duplicates by digest, heavy hitters."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ridelens.operators import common as CM
from ridelens.operators import profile as PF
from ridelens.sources import batches as B
from ridelens.sources import files as S

FEEDBACK = "rating int, message string, email string"


def rows(spark, *messages):
    return spark.createDataFrame([(5, m, "a@b.org") for m in messages], FEEDBACK)


def messages(spark, path):
    return sorted(r.message for r in S.read_feedback(spark, path).collect())


def test_a_batch_counts_once(spark, tmp_dir):
    path = f"{tmp_dir}/fb"
    assert messages(spark, path) == []
    assert S.append_feedback_batch(rows(spark, "x", "y", ""), path, "one")
    assert not S.append_feedback_batch(rows(spark, "x", "y"), path, "one")
    assert S.append_feedback_batch(rows(spark, "x"), path, "two/with=odd name%")
    assert messages(spark, path) == ["x", "x", "y"]


def test_a_writer_that_dies_before_its_commit(spark, tmp_dir):
    path, df = f"{tmp_dir}/fb", spark.range(4).select("id")
    B.stage_batch(df, path, "b")  # its writer is gone
    assert B.read_batches(spark, path, df.schema).count() == 0
    assert B.append_batch(df, path, "b")
    assert B.read_batches(spark, path, df.schema).count() == 4
    assert B.drop_stale_attempts(spark, path) == 1 and B.drop_stale_attempts(spark, path) == 0
    assert B.read_batches(spark, path, df.schema).count() == 4


def test_two_writers_of_one_batch(spark, tmp_dir):
    path, df = f"{tmp_dir}/fb", spark.range(4).select("id")
    attempts = [B.stage_batch(df, path, "b") for _ in range(2)]
    assert [B.commit_batch(spark, path, "b", a) for a in attempts] == [True, False]
    assert B.read_batches(spark, path, df.schema).count() == 4


def test_stream_appends_once_and_drops_repeats(spark, tmp_dir):
    from ridelens.streaming.feedback import FEEDBACK_INPUT_SCHEMA, start_feedback_batches

    landing, sink = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "sink")

    def send(*texts):
        spark.createDataFrame([(4, t, "a@b.org") for t in texts], FEEDBACK_INPUT_SCHEMA).coalesce(1).write.mode(
            "append").parquet(landing)

    def run(checkpoint):
        q = start_feedback_batches(spark, landing, sink, os.path.join(tmp_dir, checkpoint))
        q.awaitTermination(120)
        assert q.exception() is None

    send("a", "b", "b", " ")
    run("ck")
    send("b", "c")  # b again, in another batch
    run("ck")
    assert messages(spark, sink) == ["a", "b", "c"]
    # Spark does not know that its last batch was done, as after a failure, and repeats it
    for log, first in (("commits", 1), ("offsets", 2)):
        for name in os.listdir(os.path.join(tmp_dir, "ck", log)):
            if name != "metadata" and int(name.strip(".").removesuffix(".crc")) >= first:
                os.remove(os.path.join(tmp_dir, "ck", log, name))
    run("ck")
    assert messages(spark, sink) == ["a", "b", "c"] and B.drop_stale_attempts(spark, sink) == 1


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    df = spark.range(20_000).select(
        (i % 5_000 - 100).alias("dense"), (i * 10_000_019).alias("sparse"), (i % 7).cast("byte").alias("tiny"),
        F.when(i % 3 == 0, i.cast("string")).alias("text"), (i % 11 / 4).alias("real"),
        F.lit(None).cast("int").alias("nothing"), (i % 2 == 0).alias("flag"), F.lit(2**62).alias("big"),
        (i % 13).alias("a.b"))
    return S.persist_table(df, "test_distinct")


def test_distinct_counts(table):
    got = {r.position: r.n_unique for r in PF.distinct_counts(table).collect()}
    assert got == {1: 5_000, 2: 20_000, 3: 7, 4: 6_667, 5: 11, 6: 0, 7: 2, 8: 1, 9: 13}
    p = {r.column_name: r for r in PF.profile(table).collect()}
    assert p["text"].n_unique == 6_667 and p["text"].non_null == 6_667 and p["a.b"].total == 20_000
    plan = PF.profile(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Generate explode" not in plan and "bitmap_construct_agg" in plan


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert [(r.column_name, r.n_unique, r.total) for r in PF.profile(df).orderBy("position").collect()] == [
        ("a", 0, 0), ("b", 0, 0)]


def test_duplicates_by_digest(spark):
    data = [(1, "a", None), (1, "a", None), (1, None, "a"), (None, "1", "a"), (None, None, None), (None, None, None),
            (None, None, None), (0, "", ""), (0, "", None)]
    df = spark.createDataFrame(data, "x int, `y.z` string, w string")
    assert PF.duplicate_count(df).first()[0] == 3
    assert PF.duplicate_count(df, ["w"]).first()[0] == 6
    assert PF.duplicate_count(df.limit(0)).first()[0] == 0
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "d double")
    assert PF.duplicate_count(zeros).first()[0] == 2


def test_colliding_digests_are_compared_exactly(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") % 40).alias("x"), F.lit("same").alias("y"))
    real = PF._row_digest
    # all rows get one digest; the third hash tells them apart
    monkeypatch.setattr(PF, "_row_digest", lambda c: [F.lit(1).alias("_h1"), F.lit(2).alias("_h2"), real(c)[2]])
    assert PF.duplicate_count(df).first()[0] == 60


def test_heavy_hitters_are_exact(spark):
    i = F.col("id")
    df = spark.range(300_000).select(F.when(i % 3 == 0, i % 10).when(i % 50 == 1, i % 20).otherwise(i + 1_000).alias("v"),
                                     F.when(i % 2 == 0, F.concat(F.lit("s"), i)).otherwise("hot").alias("t"))
    want = [tuple(r) for r in CM.order_by_count(CM.value_counts(df, "v", dropna=True), "n", "v").limit(12).collect()]
    assert [tuple(r) for r in CM.top_values(df, "v", 12).collect()] == want
    assert [tuple(r) for r in CM.top_values(df, "t", 1).collect()] == [("hot", 150_000)]


def test_heavy_hitters_fall_back_without_a_proof(spark, monkeypatch):
    df = spark.range(50_000).select((F.col("id") % 9_000).alias("v"))
    counted = []
    real = CM.value_counts
    monkeypatch.setattr(CM, "value_counts", lambda *a, **k: counted.append(1) or real(*a, **k))
    assert [tuple(r) for r in CM.top_values(df, "v", 3, tracked=100).collect()] == [(0, 6), (1, 6), (2, 6)]
    assert counted
    few = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    assert [tuple(r) for r in CM.top_values(few, "v", 5).collect()] == [("a", 2), ("b", 1)]
    assert CM.top_values(few.limit(0), "v", 5).collect() == []


def test_the_recount_sends_candidates_only(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 4 == 0, 7).otherwise(F.col("id")).alias("v"))
    top = CM.top_values(df, "v", 1, tracked=1_000)
    # proven: the answer is a local table, nothing left to shuffle
    assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString() and top.first()[:] == (7, 50_001)


def test_broken_files_are_failures(spark, tmp_dir):
    spark.range(30).repartition(3).write.parquet(f"{tmp_dir}/good")
    spark.range(30).repartition(3).write.parquet(f"{tmp_dir}/mixed")
    # one file of three is no Parquet file; its name is the last, so the schema comes from another one
    with open(f"{tmp_dir}/mixed/part-99999-broken.snappy.parquet", "wb") as f:
        f.write(b"PAR1 this is no table PAR1")
    os.mkdir(f"{tmp_dir}/bad")
    with open(f"{tmp_dir}/bad/part-00000.parquet", "wb") as f:
        f.write(b"nothing")
    paths = {n: f"{tmp_dir}/{n}" for n in ("good", "mixed", "bad", "missing")}
    tables, failures = S.load_tables(spark, paths, verify=True)
    assert set(tables) == {"good"} and set(failures) == {"mixed", "bad", "missing"} and all(failures.values())
    tables, failures = S.load_tables(spark, paths)
    assert "good" in tables and {"bad", "missing"} <= set(failures)
