"""Token-ID / binary output: concatenated id arrays with Elias-Fano encoded document boundaries.

Documents are range-partitioned and sorted by id; every task appends the ids of its documents to files of at most
``FILE_IDS`` ids, so a task's memory is bounded by one file's boundaries and a small batch of text. A manifest (one
row per file, in order) is written as a table; the prefix sum over it gives every file its place in the whole.

File format (all little-endian), in this order:

    ids         n_ids x uint16 (uint32 if the vocabulary needs it)
    ends        an Elias-Fano sequence: ids up to and with each document
    doc ids     an Elias-Fano sequence: the ids that are not null, less the smallest; null ids come first
    trailer     magic, id width, n_docs, n_ids, number of null ids, smallest id, (low_bits, number of high bits) of
                both sequences

    An Elias-Fano sequence is
    low bits    n x low_bits bits, packed
    high bits   upper part: value i sets bit (value_i >> low_bits) + i
    samples     uint32 position of every ``SAMPLE``-th set bit

Boundaries take about 2 + log2(n_ids / n_docs) bits a document and ids 2 + log2(id span / n_docs); no 64-bit table is
stored. ``select`` finds one value from the nearest sample.

Documents are sorted by id, rows of one id by text. An id that very many rows share (null is one) is spread over tasks by
the first ``TIE_CHARS`` characters of the text and a hash of all of it; in each task its rows are in the order of the text.

Encoding: a text is cut at ASCII white space, which the tokenizer drops and never joins tokens across, and each
distinct piece is encoded once by the tokenizers library and then taken from a bounded memory. The tests hold this
against encoding whole texts. A tokenizer that gives probe texts with white space other ids whole than in pieces gets whole
texts instead.

Defined results: a null or blank text is the end id alone; null doc ids come first and stay null; repeated rows are
all written; other columns are ignored; an empty table writes no file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import WORD, fresh_path, materialize, open_new, open_read, text_key

MAGIC = b"EFTOKEN2"
TRAILER = "<8sHQQQqHQHQ"
SAMPLE = 256
FILE_IDS = 8_000_000
FILE_DOCS = 500_000
BATCH_BYTES = 2_000_000
READ_IDS = 1_000_000
TIE_CHARS = 64
WORDS_AT_ONCE = 2_000  # the library's results take far more memory than the ids
CACHED_PIECES = 50_000  # per generation; of at most CACHED_CHARS characters
CACHED_CHARS = 64
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
WORD_AND_STOP = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)")


# ---- Elias-Fano -----------------------------------------------------------------------------------------------

class EliasFano:
    """A non-decreasing sequence below ``universe + 1`` in about 2 + log2(universe / n) bits an entry."""

    def __init__(self, n: int, low_bits: int, high_size: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.high_size = n, low_bits, high_size
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n, values = len(values), values.astype(np.uint64)
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = np.zeros((n, low_bits), np.uint8)
        for b in range(low_bits):
            bits[:, b] = values >> np.uint64(b) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = n + (universe >> low_bits) + 1
        high = np.zeros(size, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, size, np.packbits(bits.ravel(), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32).tobytes())

    @staticmethod
    def sizes(n: int, low_bits: int, high_size: int) -> tuple[int, int, int]:
        return (n * low_bits + 7) // 8, (high_size + 7) // 8, 4 * ((n + SAMPLE - 1) // SAMPLE)

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        z = a + self.low_bits
        raw = int.from_bytes(self.low[a // 8:(z + 7) // 8].tobytes(), "little")
        return raw >> a % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """Position of the i-th set bit of the upper part."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte:byte + 64], bitorder="little")[skip:])
            if left < len(ones):
                return byte * 8 + skip + int(ones[left])
            left, byte, skip = left - len(ones), byte + 64, 0

    def __getitem__(self, i: int) -> int:
        return (self.select(i) - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """The whole sequence, as uint64."""
        ones = np.flatnonzero(np.unpackbits(self.high, count=self.high_size, bitorder="little"))
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        for b in range(self.low_bits):
            out |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return out


# ---- files ----------------------------------------------------------------------------------------------------

class TokenFileWriter:
    def __init__(self, folder: str, dtype: np.dtype):
        self.out, self.uri = open_new(folder, "tokens", ".eft")
        self.dtype, self.n_ids, self.ends, self.ids = dtype, 0, [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.out.write(raw)
        self.n_ids += len(raw) // self.dtype.itemsize
        self.ends.append(self.n_ids)
        self.ids.append(doc_id)

    def close(self) -> tuple[str, int, int]:
        ids = [i for i in self.ids if i is not None]  # ascending, after those that are null
        first = ids[0] if ids else 0
        ends = EliasFano.encode(np.array(self.ends, np.int64), self.n_ids)
        ids = EliasFano.encode(np.array([i - first for i in ids], np.uint64), ids[-1] - first if ids else 0)
        for ef in (ends, ids):
            for part in (ef.low, ef.high, ef.samples):
                self.out.write(part.tobytes())
        self.out.write(struct.pack(TRAILER, MAGIC, self.dtype.itemsize, ends.n, self.n_ids, ends.n - ids.n, first,
                                   ends.low_bits, ends.high_size, ids.low_bits, ids.high_size))
        self.out.close()
        return self.uri, ends.n, self.n_ids


class DocIds:
    """The ids of a file's documents: nulls, then an Elias-Fano sequence above the smallest id."""

    def __init__(self, n_null: int, first: int, above: EliasFano):
        self.n_null, self.first, self.above = n_null, first, above

    def __getitem__(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.above[i - self.n_null]

    def all(self) -> list[int | None]:
        return [None] * self.n_null + [self.first + x for x in self.above.all().tolist()]


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        self.f = open_read(uri)
        size = self.f.size()
        tail = struct.calcsize(TRAILER)
        (magic, width, self.n, self.n_ids, n_null, first, *sizes) = struct.unpack(
            TRAILER, self._read(size - tail, tail))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.dtype = np.dtype(f"<u{width}")
        at, sequences = self.n_ids * width, []
        for n, low_bits, high in ((self.n, *sizes[:2]), (self.n - n_null, *sizes[2:])):
            parts = []
            for k in EliasFano.sizes(n, low_bits, high):
                parts.append(self._read(at, k))
                at += k
            sequences.append(EliasFano(n, low_bits, high, *parts))
        self.ends, self.doc_ids = sequences[0], DocIds(n_null, first, sequences[1])

    def _read(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        return self.f.read(size)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def ids(self, start: int, end: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self._read(start * w, (end - start) * w), self.dtype)


# ---- encoding -------------------------------------------------------------------------------------------------

PROBE = ["abc", "naïve", "ÀÉÎÕÜÿ", "ßø", "Quick", "tokenizers"]


SPACE_PROBE = ["two words", "two  words", " led", "trailed ", "\n", "a\nb", "a\r\n\r\nb", "\t a\tb", "a\x0b \x0cb",
               "don't  stop .", "1 2\n 3 , 4"]


def drops_white_space(tokenizer) -> bool:
    """Whether texts with ASCII white space have the ids of their pieces."""
    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    return all(ids(t) == [i for p in re.findall(WORD, t) for i in ids(p)] for t in SPACE_PROBE)


def plain_tokenizer(full, tokenizer_json: str):
    """The tokenizer for single lower-cased words of Latin letters, which need no normalising and no cutting.

    None if it would not give the same ids.
    """
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer_json)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "WhitespaceSplit"}, *(s for s in steps if s["type"] == "ByteLevel")]}}
    plain = Tokenizer.from_str(json.dumps(spec))
    same = all(plain.encode(w.lower(), add_special_tokens=False).ids == full.encode(w, add_special_tokens=False).ids
               for w in PROBE)
    return plain if same else None


def worker_encoder(tokenizer_json: str, dtype: np.dtype) -> PieceEncoder:
    """One encoder per Python worker: Spark reuses workers, so its tasks share the parsed vocabulary and memory."""
    store = sys.modules.setdefault("_ridelens_worker", types.ModuleType("_ridelens_worker")).__dict__
    key = f"{zlib.crc32(tokenizer_json.encode())}:{dtype.str}"
    if key not in store:
        store[key] = PieceEncoder(tokenizer_json, dtype)
    return store[key]


class PieceEncoder:
    """Ids of texts as bytes, through a bounded memory of encoded pieces.

    The memory has two generations: a full one becomes the old one, and pieces that are met again move on, so the
    common vocabulary stays.
    """

    def __init__(self, tokenizer_json: str, dtype: np.dtype):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.drops_space = drops_white_space(self.tokenizer)
        self.plain = plain_tokenizer(self.tokenizer, tokenizer_json)
        self.dtype, self.known, self.old = dtype, {}, {}
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, words: list[str], others: list[str]) -> None:
        """Put pieces into the memory. Each of ``words`` is one pre-token, with one word-end id."""
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at:at + WORDS_AT_ONCE]
            line = " ".join(some)
            line = (self.plain or self.tokenizer).encode_batch_fast([line.lower() if self.plain else line],
                                                                    add_special_tokens=False)[0]
            ids = np.array(line.ids, np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                w, raw = self.dtype.itemsize, ids.astype(self.dtype).tobytes()
                ends = (ends * w).tolist()
                self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
            else:  # a vocabulary without word ends: piece by piece
                others = others + some
        for at in range(0, len(others), WORDS_AT_ONCE):
            some = others[at:at + WORDS_AT_ONCE]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode the pieces that are not in the memory yet."""
        if len(self.known) > CACHED_PIECES:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        known[""] = b""
        words, others, parts = [], [], {}
        for p in pieces:
            if p in known:
                continue
            if p in old:
                known[p] = old[p]
            elif p.isalpha() and (p.isascii() or LETTERS.fullmatch(p)):
                words.append(p)
            elif m := WORD_AND_STOP.fullmatch(p):  # always two pre-tokens
                parts[p] = m.groups()
            else:
                others.append(p)
        more = {a for a, _ in parts.values()}.difference(known, words)
        stops = {b for _, b in parts.values()}.difference(known, others)
        self._encode([*words, *more], [*others, *stops])
        known.update((p, known[a] + known[b]) for p, (a, b) in parts.items())

    def __call__(self, texts) -> list[bytes]:
        """Per text of an Arrow array (or a list) its ids as bytes. Words are split and numbered by Arrow, so Python
        sees each distinct piece once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.drops_space:  # one text at a time: the library's results are large
            texts = texts if isinstance(texts, list) else map(pa.Scalar.as_py, texts)
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype).tobytes()
                    for t in texts]
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        numbered = split.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = numbered.indices.to_numpy()
        self._learn(pieces)
        raws, width = list(map(self.known.__getitem__, pieces)), self.dtype.itemsize
        for p in pieces:
            if len(p) > CACHED_CHARS:
                self.known.pop(p)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // width
        ids, starts = np.frombuffer(b"".join(raws), self.dtype), np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.append(0, np.cumsum(n))
        out = ids[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        first = split.offsets.to_numpy()
        cut = (ends[first - first[0]] * width).tolist()
        return [out[a:z] for a, z in zip(cut, cut[1:], strict=False)]


def _write(folder: str, tokenizer, end_id: int, dtype: np.dtype):
    """mapInArrow function: (id as text, text) -> manifest rows; texts stay in Arrow, in parts of BATCH_BYTES."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, done, out, encode = TaskContext.get().partitionId(), [], None, None
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            encode = encode or worker_encoder(tokenizer.value, dtype)
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                before = ends[at - 1] if at else 0
                z = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
                for i, raw in zip(ids.slice(at, z - at).to_pylist(), encode(texts.slice(at, z - at)), strict=True):
                    out = out or TokenFileWriter(folder, dtype)
                    out.add(None if i is None else int(i), raw + end)
                    if out.n_ids >= FILE_IDS or len(out.ends) >= FILE_DOCS:
                        done.append((part, len(done), *out.close()))
                        out = None
                at = z
        if out:
            done.append((part, len(done), *out.close()))
        columns = list(zip(*done, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["part", "seq", "path", "n_docs", "n_ids"])

    return run


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for uri, base in zip(pdf["path"], pdf["base"], strict=True):
            f = TokenFile(uri)
            ends = f.ends.all().astype(np.int64)
            starts = np.append(0, ends[:-1])
            doc_ids, at = f.doc_ids.all(), 0
            while at < f.n:
                z = max(at + 1, int(np.searchsorted(ends, starts[at] + READ_IDS)))
                raw = f.ids(int(starts[at]), int(ends[z - 1])).astype("<u4").tobytes()
                cut = 4 * (np.stack([starts[at:z], ends[at:z]]) - starts[at])
                yield pd.DataFrame({
                    "id": pd.array(doc_ids[at:z], "Int64"), "start": int(base) + starts[at:z],
                    "n_tokens": ends[at:z] - starts[at:z],
                    "ids": [raw[a:b] for a, b in zip(*cut.tolist(), strict=True)]})
                at = z


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Encode and write; returns the manifest (path, n_docs, n_ids, base: ids before the file), in doc id order."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB
    from tokenizers import Tokenizer

    size = Tokenizer.from_str(tokenizer.value).get_vocab_size()
    dtype = np.dtype("<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.substring(F.col(text_col).cast("string"), 1, TIE_CHARS).alias("head"),
                       text_key(F.col(text_col)), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), "head", "text_key", "row"]  # the row only parts equal rows
    ordered = base.repartitionByRange(*order).sortWithinPartitions(order[0], "text", "row")
    ordered = ordered.select(F.col("id").cast("string").alias("id"), "text")
    files = materialize(ordered.mapInArrow(_write(folder, tokenizer, end_id, dtype),
                                            "part int, seq int, path string, n_docs long, n_ids long"), "token-manifest")
    # one row per file: small, so one ordered window is fine
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("part", "seq", "path", "n_docs", "n_ids",
                        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start (ids before it), n_tokens, ids (little-endian uint32, binary)."""
    n = manifest.count()
    return manifest.select("path", "base").repartition(max(1, n), "path").mapInPandas(
        _read_back, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def token_output(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, public_tokenizers.path(tokenizer), folder, end_id)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    from ridelens.llm.common import documents

    return token_output(documents(spark, sf_dir))
