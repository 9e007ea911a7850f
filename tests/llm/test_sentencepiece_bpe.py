from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ridelens.llm import sentencepiece_bpe as S
from tests.llm.conftest import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TABLE, SURFACES, KINDS = S.read_model(PATH)
ENCODE, DECODE = S.Encoder(TABLE), S.Decoder(SURFACES, KINDS)
PIECES = [t for t in TABLE.text if t]


def ids(text: str) -> list[int]:
    return np.frombuffer(ENCODE(text), np.int32).tolist()


TRICKY = ["", " ", "  a", "a  ", "a▁b ▁▁c", "\n\n x\t\r\n", "\x00\x01", "İstanbul ß ſ é é", "\U0001F600‍\U0001F525 中文",
          "<s></s><unk><0x0A>", "12345 3.14", "x" * 3_000, "the" * 2_000, " " * 1_000 + "the", "aaaaaaaaab" * 50, "﻿ "]


@pytest.mark.parametrize("text", TRICKY)
def test_tricky_texts(text):
    want = LIBRARY.encode(text)
    assert ids(text) == want
    assert DECODE(np.array(want, np.int64)) == LIBRARY.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=60),
                 st.lists(st.sampled_from(PIECES), max_size=8).map("".join),
                 st.text(st.sampled_from(list("athein  ▁\n.,0é\U0001F600")), max_size=40)))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 265)), max_size=12))
def test_any_ids_decode(numbers):
    assert DECODE(np.array(numbers, np.int64)) == LIBRARY.decode(numbers)


def test_two_pieces_stay_apart_if_merging_says_so():
    rng = np.random.default_rng(1)
    for a, b in rng.integers(259, 32_000, (3_000, 2)).tolist() + [(259, 260), (260, 259), (259, 259)]:
        union = TABLE.merge(TABLE.text[a] + TABLE.text[b])[0]
        assert TABLE.apart(a, b) == (union == [TABLE.text[a], TABLE.text[b]])


def test_small_models_with_ties_and_dead_pieces():
    # equal scores, a piece that merging never makes, a character that only longer pieces have
    pieces = ["a", "b", "ab", "ba", "aba", "bab", "abab", "cb", "bcb", " ", " a", "aa", "aaa", "aaaa"]
    scores = [0, 0, -1, -1, -2, -2, -2, -4, -3, 0, -5, -6, -6, -6]
    table = S.MergeTable(pieces, [float(x) for x in scores], list(range(1_000, 1_256)))
    encoder = S.Encoder(table)
    rng = np.random.default_rng(2)
    for _ in range(3_000):
        text = "".join(rng.choice(list("aab bc?"), rng.integers(1, 12)))
        want = []
        for p in table.merge(" " + text)[0]:
            want += [table.number[p]] if p in table.score else encoder.ids_of_char(p)
        assert np.frombuffer(encoder(text), np.int32).tolist() == want, text


def test_memories_are_bounded(monkeypatch):
    monkeypatch.setattr(S, "CACHED_UNITS", 50)
    monkeypatch.setattr(S, "CACHED_PAIRS", 40)
    encoder = S.Encoder(TABLE)
    text = " ".join(f"word{i % 90} {'y' * (i % 70)}" for i in range(400))
    assert np.frombuffer(encoder(text), np.int32).tolist() == LIBRARY.encode(text)
    assert len(encoder.known) <= 50 and len(encoder.old) <= 50 and len(encoder.pairs) <= 40
    assert all(len(u) <= S.CACHED_CHARS for u in encoder.known)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(S, "PART_CHARS", 100)
    monkeypatch.setattr(S, "UNITS_AT_ONCE", 7)
    text = " ".join(f"some words {i}\n" for i in range(200))
    assert ids(text) == LIBRARY.encode(text)


def row(i, text):
    n = LIBRARY.encode(text or "")
    return (i, len(n), hashlib.sha256(",".join(map(str, n)).encode()).hexdigest(),
            hashlib.sha256(LIBRARY.decode(n).encode()).hexdigest())


def test_query_equals_the_library(spark, small):
    got = sorted(map(tuple, S.op12_sentencepiece(spark, SF).collect()))
    assert got == [row(i, t) for i, t in small]


def test_edges(spark, edge_docs, edge_rows, no_docs):
    both = S.decode_documents(S.encode_documents(edge_docs, PATH), PATH)
    got = [(r.doc_id, r.ids, r.decoded) for r in both.collect()]
    want = [(r[0], LIBRARY.encode(r[1] or "")) for r in edge_rows]
    assert sorted(got, key=str) == sorted([(i, n, LIBRARY.decode(n)) for i, n in want], key=str)
    assert S.decode_documents(S.encode_documents(no_docs, PATH), PATH).collect() == []


def test_null_ids_decode_to_the_empty_text(spark):
    df = spark.createDataFrame([(1, None), (None, [1, 2]), (3, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in S.decode_documents(df, PATH).collect()] == ["", "", ""]


def test_other_models_are_refused(tmp_dir):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    with open(f"{tmp_dir}/unigram.model", "wb") as f:
        f.write(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        S.read_model(f"{tmp_dir}/unigram.model")
