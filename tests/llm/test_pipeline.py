from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline as P
from ridelens.llm.common import materialize
from ridelens.llm.toxicity import REJECT_FROM, fit_toxicity, with_severity
from tests.llm.conftest import SF
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_mixing import size, targets
from tests.llm.test_simhash import brute as groups
from tests.llm.test_token_files import brute as encoded


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        after[name] = docs.collect()
    first = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    severity = {r["doc_id"]: r["severity"] for r in with_severity(first, fit_toxicity(first, labels)).collect()}
    clean = {i for i, s in severity.items() if s < REJECT_FROM}
    assert {r["doc_id"] for r in after["toxicity"]} == clean
    pairs = [(r["doc_id"], r["text"]) for r in after["toxicity"]]
    heads = {i for i, _, c in groups(pairs) if i == c}
    assert sorted(r["doc_id"] for r in after["simhash_near_dedup"]) == sorted(heads)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    free = {i for i, *_, bad in leaks([(r["doc_id"], r["text"]) for r in after["simhash_near_dedup"]], items) if not bad}
    assert sorted(r["doc_id"] for r in after["benchmark_decontamination"]) == sorted(free)
    words, taken = Counter(), defaultdict(int)
    for r in after["benchmark_decontamination"]:
        words[r["source"]] += size(r["text"])
    for r in after["mixing"]:
        taken[r["source"]] += size(r["text"])
    want = targets(words)
    assert all(abs(taken[s] - want[s]) <= 1 + len(want) / 2 for s in want)
    assert max(Counter(r["doc_id"] for r in after["mixing"]).values()) <= 3
    out = P.STAGES[-1][1](spark, docs, SF)
    got = sorted((tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()),
                 key=lambda r: r[1])
    assert got == encoded([(r["doc_id"], r["text"]) for r in after["mixing"]])
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, out.collect()))


def test_edges(spark, edge_docs, no_docs, tmp_dir):
    spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(1, "seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(
        f"{tmp_dir}/benchmark.parquet")
    for docs in (edge_docs, no_docs):
        rows = docs.count()
        for name, stage in P.STAGES:
            docs = materialize(stage(spark, docs, tmp_dir), f"test-{name}")
            assert name == "token_files" or docs.columns == edge_docs.columns
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.isEmpty() == (rows == 0)


def test_only_the_last_input_is_left(spark, tmp_dir):
    import os

    from ridelens.llm.common import filesystem
    from ridelens.session import scratch_path

    folder = filesystem(scratch_path(spark, "x"))[1].removesuffix("/x")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    P.run(spark, SF).collect()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"pipeline-mixing", "token-files", "token-manifest"}
