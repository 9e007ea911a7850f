from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.llm import prefix_trie as T
from ridelens.llm.arrow_rows import in_tasks
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth string, digest string, part string"


def brute_force(rows, block, heads):
    def digest(role, text):
        return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()

    turns: dict = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (
            r[0], r[1] is not None, r[1] or 0, digest(r[2], r[3]))):
        turns.setdefault(c, []).append((r or "", x or ""))
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % (heads + 1) if block else 0
        rebuilt[c] = (turns.get(c - c % block, [])[:h] if block else []) + turns[c][h:]
    members: dict = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    children: dict = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        below, m = children.get(k, []), members[k]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + (len(m) - 1) * words
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(below), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert nodes(T.op13_prefix_trie(spark, SF)) == brute_force(rows, 20, 3)


RNG = np.random.default_rng(3)
EDGES = [
    *[(int(RNG.choice([0, 1, 2, 5, 20, 21, 25, 39, 40, -3, -20, 60, 79])), t, r, x) for t, r, x in zip(
        RNG.choice([None, 0, 1, 2, 3], 60), RNG.choice(["u", "a", None], 60),
        RNG.choice(["x y", "z", None, "", " \t", "x\u0085y"], 60), strict=True)],
    *[(100 + k, t, "u", ["a b", "c"][t % 2]) for k in range(30) for t in range(k % 7)],
    *[(200 + k, t, "user", "one and the same.") for k in range(40) for t in range(3)],
    (None, 0, "u", "no id"), (2**60 + 1, 2**60, "u", "far"), (2**60 + 3, 0, "u", "word " * 30_000),
    (7, 1, "a", "bc"), (8, 1, "ab", "c"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([r + ("x",) * 4 for r in EDGES], SCHEMA).repartition(3)


@pytest.mark.parametrize(("block", "heads"), [(20, 3), (20, 1), (None, 3)])
def test_edges(edges, block, heads):
    assert nodes(T.prefix_trie(edges, block, heads)) == brute_force(EDGES, block, heads)


def test_long_conversations_in_parts(edges):
    assert nodes(T.prefix_trie(edges, 20, 3, long_rows=2)) == brute_force(EDGES, 20, 3)


def test_a_small_sketch_changes_nothing(edges, monkeypatch):
    monkeypatch.setattr(T, "BAND", 64)
    monkeypatch.setattr(T, "COUNT_AT_ONCE", 5)
    assert nodes(T.prefix_trie(edges, 20, 3, max_cells=64)) == brute_force(EDGES, 20, 3)


def test_lists_of_ids_in_pieces(edges, monkeypatch):
    monkeypatch.setattr(T, "LIST_BYTES", 10)
    assert nodes(T.prefix_trie(edges, 20, 3)) == brute_force(EDGES, 20, 3)


def test_estimates_are_never_too_low_and_screen(spark):
    rows = spark.range(30_000).select((F.col("id") % 20_000).alias("k"))  # 10,000 digests twice, 10,000 once
    prefix = rows.select(F.lit(0).cast("long").alias("conv"), F.lit(1).cast("long").alias("depth"),
                         F.unhex(F.md5(F.col("k").cast("string"))).alias("digest"),
                         F.lit(T.NOTHING).alias("parent"), *[F.lit(0).cast("long").alias(c) for c in (
                             "words", "upto", "len")], "k")
    cells, bits = T.sketch(prefix.drop("k"))
    got = T.screened(prefix.drop("k"), cells, bits).groupBy("digest").agg(F.count("*").alias("n"), F.max("shared").alias(
        "shared")).collect()
    assert all(r.shared for r in got if r.n > 1)
    assert sum(r.shared for r in got if r.n == 1) <= 300


def test_a_hot_first_turn_and_a_hot_conversation(spark):
    hot = spark.range(600).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), F.when(
        F.col("id") % 2 == 0, "first").otherwise(F.col("id").cast("string")).alias("text"))
    long = spark.range(500).select(F.lit(1_000).alias("conv_id"), "id", F.lit("a"), F.col("id").cast("string"))
    rows = hot.union(long)
    want = brute_force([tuple(r) for r in rows.collect()], 20, 3)
    assert nodes(T.prefix_trie(rows, 20, 3, long_rows=50)) == want


def test_prefix_sums_of_parts_add_up():
    rows = [(1, k // 4, f"{k * 7919:032x}", k) for k in range(11)]
    whole = list(T.part_prefixes((1, 0, key, w) for _, _, key, w in rows))
    parts: dict = {}
    for r in T.part_prefixes(iter(rows)):
        parts.setdefault(r[1], []).append(r)
    packed = [{"part": p, "n": len(rs), "sum": rs[-1][3], "words": rs[-1][6], "first": [
        {"place": r[2], "sum": r[3], "upto": r[6]} for r in rs[:3]]} for p, rs in sorted(parts.items())]
    (conv, n, sums, heads, _, starts, offsets, words), = T.conversations_of_parts(iter([(1, packed)]), 3)
    assert (conv, n, sums, heads) == (1, 11, [r[3] for r in whole[:3]], [0, 1, 3])
    assert offsets[1:] == [whole[k - 1][3] for k in starts[1:]] and words[1:] == [6, 28]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert T.prefix_trie(df, 20, 3).collect() == []
    none = spark.createDataFrame([(None, 0, "u", "x", "", "", "", "")], SCHEMA)
    assert T.prefix_trie(none, 20, 3).collect() == []


def test_rows_of_tasks_pass_in_bounded_batches(spark):
    df = spark.range(2_000).select("id", F.lit("x" * 9_000).alias("t"))
    out = in_tasks(df, lambda rows: ((i, t[:3]) for i, t in rows), "id long, t string")
    assert out.agg(F.sum("id"), F.max("t")).first()[:] == (1_999_000, "xxx")
