"""The row-keeping stages pass every column on, whatever its name and type, with its values."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ridelens.llm.common import row_hash
from ridelens.llm.decontaminate import drop_contaminated
from ridelens.llm.mixing import mix_documents
from ridelens.llm.simhash import keep_one_of_each
from ridelens.llm.toxicity import drop_toxic


def as_rows(df, without=()):
    """Rows as JSON of their values in order, so that maps and nested values can be counted."""
    kept = [c for c in df.columns if c not in without]
    cols = [F.to_json(F.struct(F.col("`" + c.replace("`", "``") + "`").alias("v"))) for c in kept]
    return Counter(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture()
def stages(spark):
    labels = spark.createDataFrame([(1, 0), (5, 1), (8, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([("q1", "seven eight nine ten eleven twelve")], "item_id string, text string")
    return {
        "toxicity": lambda d: drop_toxic(d, labels),
        "near duplicates": keep_one_of_each,
        "contamination": lambda d: drop_contaminated(d, items),
    }


@pytest.mark.parametrize("name", ["toxicity", "near duplicates", "contamination"])
def test_rows_that_stay_are_unchanged(stages, clash_docs, name):
    out = stages[name](clash_docs)
    assert out.schema.simpleString() == clash_docs.schema.simpleString()
    before, after = as_rows(clash_docs), as_rows(out)
    assert after and not after - before


def test_the_same_rows_stay_without_the_extra_columns(stages, clash_docs, edge_docs):
    for stage in stages.values():
        kept = [c for c in edge_docs.columns]
        assert as_rows(stage(clash_docs).select(*kept)) == as_rows(stage(edge_docs))


def test_mixed_copies_keep_their_columns(clash_docs):
    out = mix_documents(clash_docs)
    assert out.schema.simpleString() == clash_docs.schema.simpleString()
    changed = ("text", "n_chars")
    assert not set(as_rows(out, changed)) - set(as_rows(clash_docs, changed))


def test_rows_that_differ_in_other_columns_only_are_mixed_each(spark):
    rows = [(1, "w " * 10, "s", f"row {k}") for k in range(6)] + [(2, "x " * 9, "t", "other")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    out = mix_documents(df)
    # source s may take 29 of its 60 words: three of its six rows, the last one cut
    taken = [(r["note"], len(r["text"].split())) for r in out.collect() if r["doc_id"] == 1]
    assert sorted(n for _, n in taken) == [9, 10, 10] and len({note for note, _ in taken}) == 3
    again = mix_documents(df.orderBy(F.rand(3)).repartition(5))
    assert as_rows(out) == as_rows(again)


def test_the_cut_is_the_same_in_reruns_with_repeated_ids(spark):
    # one id, equal sizes, different texts: a rerun must cut the same text
    rows = [(1, f"a{k} b{k} c{k} d{k} e{k} f{k} g{k}", "s") for k in range(40)] + [(None, f"n{k} m{k}", "t") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = as_rows(mix_documents(df))
    for seed in (1, 2):
        assert as_rows(mix_documents(df.orderBy(F.rand(seed)).repartition(3 + seed))) == want


def test_equal_maps_hash_alike(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert df.select(row_hash(df).alias("h")).distinct().count() == 1
