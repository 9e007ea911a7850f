from __future__ import annotations

import math
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from ridelens.llm import sharding as S
from ridelens.llm.sharding import op6_shard_tree
from tests.llm.conftest import SF


def draw(i, path, w):
    h = 42 if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(path.encode(), h)
    return -math.log(((h >> 11) + 0.5) / (1 << 53)) / w


def descend(i, tree, path=""):
    name = min(tree, key=lambda n: draw(i, f"{path}/{n}", S.weight(tree[n]))) if len(tree) > 1 else next(iter(tree))
    kid = tree[name]
    return descend(i, kid, f"{path}/{name}") if isinstance(kid, dict) else name


def check(rows, texts):
    slots = {}
    for r in rows:
        assert r["shard"] == descend(r["doc_id"], S.EIGHT) and r["grown_shard"] == descend(r["doc_id"], S.NINE)
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
        slots.setdefault(r["shard"], []).append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_against_brute_force(spark, small, monkeypatch):
    check(op6_shard_tree(spark, SF).collect(), small)
    monkeypatch.setattr(S, "ROWS_PER_RANGE", 10)  # many ranges a shard
    got = op6_shard_tree(spark, SF).collect()
    check(got, small)
    assert sorted(map(tuple, got)) == sorted(map(tuple, op6_shard_tree(spark, SF).collect()))


def test_weights_and_movement(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    tree = {"a": {"k": {0: 1, 1: 3}}, "b": {"k": {2: 4}, "l": {3: 8}}}
    heavier = {"a": tree["a"], "b": {"k": {2: 8}, "l": {3: 8}}}
    got = S.shard_documents(docs, tree, heavier).select("shard", "grown_shard").collect()
    share = Counter(r["shard"] for r in got)
    assert all(abs(share[s] / 40_000 - w / 16) < 0.02 for s, w in ((0, 1), (1, 3), (2, 4), (3, 8)))
    moved = {(r["shard"], r["grown_shard"]) for r in got if r["shard"] != r["grown_shard"]}
    # only into the region that grew, and inside it only into the rack that grew
    assert {b for _, b in moved} <= {2, 3} and (2, 3) not in moved and not any(b in (0, 1) for _, b in moved)


def test_edges(edge_docs, edge_rows, no_docs):
    check(S.shard_documents(edge_docs, S.EIGHT, S.NINE).collect(), [(r[0], r[1]) for r in edge_rows])
    assert S.shard_documents(no_docs, S.EIGHT, S.NINE).count() == 0
