from __future__ import annotations

import os
import uuid
from collections import Counter

import numpy as np

from ridelens.llm import substring_dedup as S
from tests.llm.conftest import SF


def brute(pairs, window):
    """(n_words, n_removed, kept text) of every row, by comparing the windows themselves."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in pairs]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                s = tuple(w[k:k + window])
                first[s] = min(first.get(s, i), i)
    out = []
    for i, w in split:
        hit = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                hit[k:k + window] = [True] * window
        kept = [x for x, h in zip(w, hit, strict=True) if not h]
        out.append((i, len(w), sum(hit), b" ".join(kept).decode()))
    return Counter(out)


def rows(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(S.substring_dedup(docs)) == brute(small, 13)


def test_many_chunks_and_buckets(spark, small, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_WORDS", 3_000)
    monkeypatch.setattr(S, "BUCKET_WINDOWS", 4_000)
    monkeypatch.setattr(S, "GROUP_CHARS", 50_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    assert rows(S.substring_dedup(docs)) == brute(small, 13)


def test_edges(edge_docs, edge_rows, no_docs):
    got = S.substring_dedup(edge_docs)
    assert rows(got) == brute([(r[0], r[1]) for r in edge_rows], 13)
    assert S.substring_dedup(no_docs).count() == 0
    spans = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in got.where("doc_id IN (10, 11)").collect()}
    assert spans == {10: [], 11: [(1, 31)]}  # two repeats that touch are one interval


def test_rolling_hash_and_intervals():
    words = np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)
    base = S.BASES[0]
    direct = [sum(int(x) * pow(base, 12 - k, 1 << 64) for k, x in enumerate(words[i:i + 13])) % (1 << 64)
              for i in range(288)]
    assert S.Rolling(base, 13)(words).tolist() == direct
    hit = np.zeros(60, bool)
    hit[[0, 13, 40]] = True
    assert S.removal_intervals(hit, 13) == [(0, 26), (40, 53)]
    assert S.removal_intervals(np.zeros(5, bool), 13) == []


def test_homes_match_spark(spark):
    ids = [0, 1, -5, 2**62, -2**63]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr(
        "pmod(xxhash64(i), 97)").collect()]
    assert S.homes(np.array(ids, np.int64), 97).tolist() == want


def test_homes_are_bounded_for_null_and_repeated_ids(spark, monkeypatch, tmp_dir):
    monkeypatch.setattr(S, "GROUP_CHARS", 2_000)
    passage = " ".join(f"p{k}" for k in range(20))
    docs = [(1, f"first {passage}")]
    docs += [(None, f"null {k} {passage}") for k in range(150)]
    docs += [(7, f"seven {k} {passage} {k}") for k in range(150)]
    docs += [(9, f"nine {passage} tail")] * 150 + [(None, None)] * 150 + [(None, f"n {passage}")] * 30
    run = S.kept_rows

    def counted(window):
        def group(rows, repeats):
            open(f"{tmp_dir}/{len(rows)}-{uuid.uuid4().hex}", "w").close()
            return run(window)(rows, repeats)
        return group

    counted.__module__ = "__main__"
    monkeypatch.setattr(S, "kept_rows", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(S.substring_dedup(df)) == brute(docs, 13)
    sizes = [int(name.split("-")[0]) for name in os.listdir(tmp_dir)]
    assert max(sizes) <= 60, sorted(sizes)  # in all 631 rows of four keys, 303 different ones


def test_homes_of_id_and_text_match_spark(spark):
    pairs = [(i, k) for i in (0, 1, -1, 2**62, -(2**63), 2**63 - 1) for k in (0, 1, 2**31, 2**32 - 1)]
    df = spark.createDataFrame(pairs, "i long, k long").selectExpr("i", "k", "pmod(xxhash64(i, k), 97) AS h")
    got = df.collect()
    ids, keys = np.array([r["i"] for r in got], np.int64), np.array([r["k"] for r in got], np.uint32)
    assert S.homes(ids, 97, keys).tolist() == [r["h"] for r in got]


def test_copies_in_a_chunk_give_one_entry():
    import pandas as pd
    text = " ".join(f"w{k}" for k in range(40))
    pdf = pd.DataFrame({"id": ["4"] * 50 + ["5"], "text": [text] * 50 + ["x " + text]})
    out = pd.concat(S.window_entries(1, 13)(iter([pdf])))
    assert sorted(len(S._unpack(b)[3]) for b in out["blob"]) == [28, 29]
