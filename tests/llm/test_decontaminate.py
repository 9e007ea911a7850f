from __future__ import annotations

import re
from collections import Counter

import pytest

from ridelens.llm import decontaminate as D
from tests.llm.conftest import SF

UP = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k:k + window]), set()).add(i)
    sizes = {len(s) for s in windows}
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    ids |= {str(x) for x in found if x is not None}
        out.append((i, len(w), len(hit), tuple(sorted(ids)), bool(hit)))
    return Counter(out)


def rows(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"])
                   for r in df.collect())


@pytest.mark.parametrize("bound", [D.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, small, monkeypatch, bound):
    monkeypatch.setattr(D, "BROADCAST_ROWS", bound)  # 0: the way beyond the broadcast
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert rows(D.decontaminate(docs, items)) == brute(small, [(r[0], r[1]) for r in items.collect()])


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "TWO words"), (3, None), (4, "..."),
         (5, "wörd ÀÉ 12"), (5, "same id"), (6, "one two three four five six seven eight nine ten"), (None, "no id at"),
         (10, "w5x5 w6x6"), (9, "a" * 100_000)]


def test_edges(spark, edge_docs, edge_rows, no_docs):
    items = spark.createDataFrame([i + ("x", "y") for i in ITEMS], "item_id long, text string, w string, pos string")
    pairs = [(r[0], r[1]) for r in edge_rows]
    assert rows(D.decontaminate(edge_docs, items)) == brute(pairs, ITEMS)
    assert D.decontaminate(no_docs, items).count() == 0
    assert rows(D.decontaminate(edge_docs, items.limit(0))) == brute(pairs, [])
    kept = D.drop_contaminated(edge_docs, items)
    want = Counter(i for i, *_, bad in brute(pairs, ITEMS).elements() if not bad)
    assert kept.columns == edge_docs.columns and Counter(r["doc_id"] for r in kept.collect()) == want


def test_lower_ascii(spark):
    texts = ["ÀÉ İ ΣΑΣ ABC é", "Plain ASCII", "naïve Straße", "Ω ǅ Ⅷ Ⓐ", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(D.lower_ascii(D.F.col("t"))).collect()
    assert [r[0] for r in got] == [t.translate(UP) for t in texts]


def test_beyond_the_bound_only_slices_are_shuffled(spark, edge_docs, monkeypatch):
    items = spark.createDataFrame([("a", "one two three four five six seven eight nine ten eleven twelve"),
                                   ("b", "two words"), ("c", "five six seven eight nine ten eleven twelve thirteen fourteen")],
                                  "item_id string, text string")
    want = sorted(map(str, D.decontaminate(edge_docs, items).collect()))
    for rows, size in ((0, 0), (4, 1 << 30)):  # nothing may be broadcast; only the rare words may
        monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(D, "BROADCAST_BYTES", size)
        assert sorted(map(str, D.decontaminate(edge_docs, items).collect())) == want
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    base = D.base_words(edge_docs)
    hits = D.find_hits(base, D.rarest_words(base, D.distinct_windows(items, 10)), 10)
    joins = [x for x in hits._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project [" in x]
    above = [x for x in joins if "around#" in x and "AS around" in x]
    assert above and not any(" w#" in x.split("AS around")[1] for x in above)  # what goes on from there has no array w
