from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash

from ridelens.llm import simhash as H
from ridelens.llm.components import connected_components
from tests.llm.conftest import SF


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k:k + 3]), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute(pairs, bits=2):
    fps = [brute_fp(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    top = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            top[find(k)] = min(top.get(find(k), i), i)
    return Counter((i, format(f, "016x"), top.get(find(k))) for k, ((i, _), f) in enumerate(zip(pairs, fps, strict=True)))


def rows(df):
    return Counter((r["doc_id"], format(r["fp"] & (1 << 64) - 1, "016x"), r["component_id"]) for r in df.collect())


def test_against_brute_force(spark, small):
    assert rows(H.simhash_components(spark.read.parquet(f"{SF}/documents.parquet"))) == brute(small)


def test_edges(edge_docs, edge_rows, no_docs):
    assert rows(H.simhash_components(edge_docs)) == brute([(r[0], r[1]) for r in edge_rows])
    assert H.simhash_components(no_docs).count() == 0


def near_codes(seed, n=600):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (4, n)).astype(np.uint64))
    return np.unique(base[rng.integers(0, 12, n)] ^ flips[0] ^ flips[1] ^ flips[2] ^ flips[3])


def closure(codes, bits=2):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits
    label = np.arange(len(codes))
    while True:
        new = np.where(near, label[None, :], len(codes)).min(1)
        if (new == label).all():
            return label
        label = new


def test_gray_index_finds_all_links():
    for seed in range(5):
        codes = near_codes(seed)
        order, parent = H.gray_links(np.zeros(len(codes), np.int64), codes, 2)
        root = H._roots(parent, np.arange(len(parent)))
        assert (root == closure(codes[order])).all()


def test_split_nodes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(H, "SPLIT_ABOVE", 40)  # one node of many near fingerprints, split on every level
    codes = near_codes(9, 300)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    got = {r["fp"]: r["group_fp"] for r in H.simhash_groups(df).collect()}
    want = closure(codes)
    groups = {}
    for c, w in zip(codes.view(np.int64).tolist(), want.tolist(), strict=True):
        groups.setdefault(w, set()).add(c)
    mine = {}
    for c in codes.view(np.int64).tolist():
        mine.setdefault(got.get(c, ("alone", c)), set()).add(c)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_connected_components_of_a_path(spark):
    path = spark.range(200).selectExpr("xxhash64(id) AS a", "xxhash64(id + 1) AS b")
    got = connected_components(path)
    assert got.count() == 201 and got.select("component").distinct().count() == 1


def test_keep_one_of_each(edge_docs, edge_rows):
    kept = H.keep_one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    groups = {c for _, _, c in brute([(r[0], r[1]) for r in edge_rows])}
    # 21 stands for two documents of different groups
    assert sorted(ids) == sorted([*(g for g in groups if g is not None), 21])
