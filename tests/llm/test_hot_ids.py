"""A third of all rows under null or one repeated id, and one far id, are spread over ranges of about equal size."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ridelens.llm import common as C
from ridelens.llm import mixing as M
from ridelens.llm import sharding as S
from ridelens.llm import token_files as T


def hot(spark, kind, n=3_000):
    i = F.col("id")
    third = i % 3 == 0
    doc_id = {"null": F.when(~third, i), "repeated": F.when(third, 5).otherwise(i), "equal": F.when(third, 5).otherwise(i),
              "far": F.when(i == 7, F.lit(2**60)).otherwise(i)}[kind].cast("long")
    text = F.when(third, "one and the same").otherwise(F.concat(F.lit("text "), i)) if kind == "equal" else F.concat(
        F.lit("text "), F.repeat(F.lit("w "), (i % 5).cast("int")), i)
    return spark.range(n).select(doc_id.alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), i % 2).alias("source"))


KINDS = ["null", "repeated", "equal", "far"]


def spread(counts):
    counts = sorted(counts)
    return counts[-1] / counts[len(counts) // 2]


@pytest.mark.parametrize("kind", KINDS)
def test_queue_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 20)
    held = []
    real = M.sums_before
    monkeypatch.setattr(M, "sums_before", lambda parts, *a, **k: held.append(parts) or real(parts, *a, **k))
    sizes = M.sized(hot(spark, kind))
    counted = M.queue_documents(sizes, M.materialize(M.source_targets(sizes), "t")).collect()
    parts = held[0].select("source", *M.RANGE).collect()
    assert len(parts) > 100 and len(counted) == 3_000
    # ends are the running sums of sizes: all different inside a source but for empty texts
    for s in ("s0", "s1"):
        ends = sorted((r["upto"], r["size"]) for r in counted if r["source"] == s)
        total = 0
        for upto, size in ends:
            total += size
            assert upto == total


@pytest.mark.parametrize("kind", KINDS)
def test_largest_range_of_the_queue(spark, monkeypatch, kind):
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 50)
    sizes = M.sized(hot(spark, kind, 6_000))
    seen = {}
    real = M.top_bits
    monkeypatch.setattr(M, "top_bits", lambda *a: seen.setdefault(a[-1], real(*a)))
    M.queue_documents(sizes, M.materialize(M.source_targets(sizes), "t"))
    counts = [r["n"] for r in seen["copy"].groupBy("source", *M.RANGE).agg(F.count("*").alias("n")).collect()]
    assert max(counts) <= 8 * 50 and spread(counts) <= 12


@pytest.mark.parametrize("kind", KINDS)
def test_slots_are_gapless(spark, monkeypatch, kind):
    monkeypatch.setattr(S, "ROWS_PER_RANGE", 20)
    rows = S.shard_documents(hot(spark, kind), S.EIGHT, S.NINE).collect()
    assert len(rows) == 3_000
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("kind", KINDS)
def test_token_files_spread_a_hot_id(spark, tmp_dir, kind):
    import public_tokenizers

    docs = hot(spark, kind).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = T.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), tmp_dir, 2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    docs_of_part = Counter()
    for r in manifest:
        docs_of_part[r["part"]] += r["n_docs"]
    assert sum(docs_of_part.values()) == 3_000 and spread(docs_of_part.values()) <= 3
    ids = [x for r in sorted(manifest, key=lambda r: r["base"]) for x in T.TokenFile(r["path"]).doc_ids.all()]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_token_files_hold_no_table_of_ids(spark, tmp_dir):
    import os

    import public_tokenizers

    docs = spark.range(20_000).select((F.col("id") * 3 - 7_000).alias("doc_id"), F.lit("").alias("text")).coalesce(1)
    manifest = T.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), tmp_dir, 2).collect()
    size = sum(os.path.getsize(r["path"].removeprefix("file:")) for r in manifest)
    # 2 bytes of ids a document; ends and ids take a few bits each
    assert size <= 20_000 * (2 + 1.5) and sum(r["n_docs"] for r in manifest) == 20_000


@pytest.mark.parametrize("ids", [[-2**63, -1, 0, 2**63 - 1], [None, None], [None, -5, -5, 7], []])
def test_extreme_ids_round_trip(tmp_dir, ids):
    import numpy as np

    w = T.TokenFileWriter(tmp_dir, np.dtype("<u2"))
    for i in ids:
        w.add(i, b"\x02\x00")
    f = T.TokenFile(w.close()[0])
    assert f.doc_ids.all() == ids == [f.doc_ids[k] for k in range(len(ids))]


def test_sums_before_in_blocks(spark):
    rows = [(k % 3 if k % 7 else None, k, k * k) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, o long, v long")
    got = C.sums_before(df, ["g"], ["o"], "v", block=F.shiftright("o", 4)).collect()
    for r in got:
        assert r["first"] == sum(v for g, o, v in rows if g == r["g"] and o < r["o"])


@pytest.mark.parametrize("sizes", [(5, 10), (100, 200, 1000), (10,) * 6, (10, 20, 30), (4, 8, 0, 4)])
def test_mixing_sql_on_ties(spark, tmp_dir, sizes):
    rows = [(10 * k, "w " * n, f"s{k}") for k, n in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(
        f"{tmp_dir}/documents.parquet")
    got = sorted(map(tuple, M.op5_mix_sources(spark, tmp_dir).collect()))
    con = duckdb.connect()
    path = spark.read.parquet(f"{tmp_dir}/documents.parquet").inputFiles()[0].removeprefix("file://")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    assert got == sorted(con.execute(M.ORACLE_SQL).fetchall())
    con.close()
