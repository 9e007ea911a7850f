from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from ridelens.llm import mixing as M
from ridelens.llm.mixing import op5_mix_sources
from tests.llm.conftest import SF


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """By the words of the contract: share by weight, cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    out, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        w = sum(weight[s] for s in open_)
        out = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        over = [s for s in open_ if out[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return out
        capped |= set(over)


def check(rows, triples):
    sizes = defaultdict(int)
    for _, t, s in triples:
        sizes[s] += size(t)
    want = targets(sizes)
    assert Counter((r["doc_id"], r["size"], r["source"], r["source_size"]) for r in rows) == Counter(
        (i, size(t), s, sizes[s]) for i, t, s in triples)
    taken = defaultdict(int)
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    # rounding: half a word a source, cut from the last of the stream
    assert all(abs(taken[s] - want[s]) <= 1 + len(want) / 2 for s in want), (dict(taken), want)
    assert sum(taken.values()) <= sum(sizes.values())


def triples_of(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


def test_targets_and_queue(spark, monkeypatch):
    docs, triples = triples_of(spark)
    rows = M.mix_sources(docs).collect()
    check(rows, triples)
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 7)  # many ranges a source
    again = M.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))  # reruns and partitionings agree


def test_skewed_sources(spark):
    triples = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 11}") for i in range(400)]
    triples += [(1000, "one", "tiny"), (1001, None, "empty"), (1002, "x y", None)]
    df = spark.createDataFrame(triples, "doc_id long, text string, source string")
    check(M.mix_sources(df).collect(), triples)


@pytest.mark.parametrize("words", [(5, 10), (100, 200, 1000), (10,) * 6, (10, 20, 30), (4, 8, 0, 4)])
def test_sources_that_tie_at_the_level(spark, words):
    triples = [(10 * k, "w " * n, f"s{k}") for k, n in enumerate(words)]
    df = spark.createDataFrame(triples, "doc_id long, text string, source string")
    rows = M.mix_sources(df).collect()
    check(rows, triples)
    assert abs(sum(r["target"] for r in rows) - sum(words)) < 1e-6
    assert sum(words) - sum(r["taken"] for r in rows) <= len(words) / 2  # rounding only
    mixed = M.mix_documents(df).collect()
    assert sum(size(r["text"]) for r in mixed) == sum(r["taken"] for r in rows)


def test_edges(edge_docs, edge_rows, no_docs):
    check(M.mix_sources(edge_docs).collect(), [(r[0], r[1], r[3]) for r in edge_rows])
    assert M.mix_sources(no_docs).count() == 0 and M.mix_documents(no_docs).count() == 0


def test_stream_is_ordered_and_whole_documents_come_whole(spark):
    docs, _ = triples_of(spark)
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    taken, cut = Counter(), 0
    for r in mixed.collect():
        taken[r["doc_id"]] += size(r["text"])
        if r["text"] != text[r["doc_id"]]:
            cut += 1
            assert text[r["doc_id"]].split()[:size(r["text"])] == r["text"].split() and r["n_chars"] == len(r["text"])
    assert cut <= docs.select("source").distinct().count()
    want = {r["doc_id"]: r["taken"] for r in op5_mix_sources(spark, SF).collect() if r["taken"]}
    assert dict(taken) == want
