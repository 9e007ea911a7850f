from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

# name clashes with columns the operators make for themselves
EXTRA = "size long, words string, id string, hashes string, key string, range string, fp string, rank string, w string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, blanks, a very long text, ties, repeated rows, copies, ids that floats cannot hold."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "s1"), (2, None, "s1"), (3, "", None), (4, " \t\n ", "s2"),
        (5, "alpha beta gamma delta epsilon zeta", "s2"), (5, "alpha beta gamma delta epsilon zeta", "s2"),
        (6, "Word", "s3"), (7, "two words", "s3"), (8, long, "s1"), (9, long + " tail", "s2"),
        (10, f"start {passage} end", "s3"), (11, f"other {passage} {passage}", "s3"), (12, passage, None),
        (None, f"no id {passage}", "s1"), (None, "no id at all", None), (2**60 + 1, f"big {passage} id", "s1"),
        (2**60 + 3, "ÀÉ   Straße naïve \U0001F600 x\u0085y z \x1c a\x1db", "s2"), (-7, "negative id", "s2"),
        (20, "a" * 100_000, "s1"), (21, "same id", "s1"), (21, "same id, other text", "s1"),
    ]
    return [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]


@pytest.fixture()
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([r + (1, "x", "x", "x", "x", "x", "x", "x", "x") for r in edge_rows], SCHEMA)


# what the row-keeping stages name their own columns, a map, nested maps, dotted and odd names
CLASHES = {"row": "'r'", "order": "'o'", "no_id": "7", "id0": "8L", "text_key": "'t'", "row_key": "9L", "_key": "'k'",
           "_d": "1", "_k": "2", "_s": "3", "_copies": "4", "_severity": "0.5", "severity": "'sev'", "copy": "5", "n": "6",
           "rest": "'x'", "taken": "'y'", "words_": "'z'", "range_": "1", "salt": "2", "win": "3", "start": "4",
           "m": "map('b', 1, 'a', doc_id)", "deep": "named_struct('m', map('k', array(1, 2)))", "list": "array(map('p', 3))",
           "a.b": "concat('dot ', doc_id)", "we`ird name": "doc_id", "struct": "named_struct('row', 1, 'x.y', 'z')"}


@pytest.fixture()
def clash_docs(edge_docs):
    """``edge_docs`` with every such column; a value tells the row it belongs to where it can."""
    from pyspark.sql import functions as F

    return edge_docs.select("*", *[F.expr(v).alias(k) for k, v in CLASHES.items()])


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """documents of the smallest test table, as (doc_id, text) pairs."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r[0], r[1]) for r in rows)
