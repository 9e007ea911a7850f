from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridelens.llm import token_files as T
from tests.llm.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
JSON = open(PATH, encoding="utf-8").read()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 900), max_size=700))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64))
    ef = T.EliasFano.encode(values, int(values[-1]) if len(values) else 0)
    again = T.EliasFano(ef.n, ef.low_bits, ef.high_size, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes())
    assert again.all().tolist() == values.tolist()
    assert [again[i] for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2_000, 10_000))
    ef = T.EliasFano.encode(values, int(values[-1]))
    bits = 8 * (len(ef.low) + len(ef.high) + 4 * len(ef.samples)) / len(values)
    assert bits <= 2 + np.log2(values[-1] / len(values)) + 1


TRICKY = ["don't WE'LL o'clock '' 's's", "naïve Straße İstanbul ΣΑΣ ΌΣΟΣ", "a b c\u0085d\x1ce\x1d f", "",
          " \t\n", "<|endoftext|> x<|startoftext|>y", "word,word. word!? (x).) 12 3.4", "é ́x ｆｕｌｌ",
          "x" * 5_000, "\U0001F600‍\U0001F525 中文 日本語", "A.B,C;D:E!F?G", "ÀÉ. é, ÿ! ß? Ǆ ǅ"]


def test_encoder_equals_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    encode = T.PieceEncoder(JSON, np.dtype("<u2"))
    for texts in (TRICKY, TRICKY[::-1]):
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(r, "<u2").tolist() for r in encode(texts)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(text):
    if any("\ud800" <= c <= "\udfff" for c in text):
        return
    tokenizer = test_encoder_on_any_text.tokenizer
    raw = test_encoder_on_any_text.encode([text])[0]
    assert np.frombuffer(raw, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


test_encoder_on_any_text.tokenizer = Tokenizer.from_file(PATH)
test_encoder_on_any_text.encode = T.PieceEncoder(JSON, np.dtype("<u2"))


def test_tokenizers_that_keep_white_space_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    encode = T.PieceEncoder(open(path, encoding="utf-8").read(), np.dtype("<u4"))
    texts = [*TRICKY, "one two", "one  two", " led", "a\n\n b "]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(r, "<u4").tolist() for r in encode(texts)] == want
    assert not encode.drops_space and test_encoder_on_any_text.encode.drops_space


def brute(pairs):
    """(id, start, n_tokens, crc) in order, nulls first."""
    tokenizer, out, at = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def rows(df):
    df = df.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc"))
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("file_ids", [T.FILE_IDS, 5_000])
def test_files_round_trip(spark, small, tmp_dir, monkeypatch, file_ids):
    monkeypatch.setattr(T, "FILE_IDS", file_ids)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(6)
    manifest = T.write_token_files(docs, PATH, tmp_dir, 2).cache()
    assert rows(T.read_token_files(manifest)) == brute(small)
    # one document by random access
    first = manifest.orderBy("base").first()
    f = T.TokenFile(first["path"])
    tokenizer, (doc_id, text) = Tokenizer.from_file(PATH), small[1]
    assert f.doc_ids[1] == doc_id
    assert f.ids(*f.span(1)).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_edges(edge_docs, edge_rows, no_docs, tmp_dir):
    got = rows(T.read_token_files(T.write_token_files(edge_docs, PATH, tmp_dir, 2)))
    assert got == brute([(r[0], r[1]) for r in edge_rows])
    assert T.read_token_files(T.write_token_files(no_docs, PATH, tmp_dir, 2)).count() == 0
