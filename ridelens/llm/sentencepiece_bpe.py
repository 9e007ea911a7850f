"""SentencePiece encoding and decoding for merge-type (BPE) models by a table of prefixes.

Method
------
A merge-type model starts from single characters and keeps merging the neighbours whose union has the best score, the
leftmost first among equals. Two facts make this a table look-up: a sequence of pieces is an encoding if and only if
each two neighbours in it are the encoding of their union (merges across a border depend on both sides of it alone), and
so every prefix of a text has exactly one last piece. The table stores that last piece per prefix:

1. An automaton over the vocabulary reports the pieces that end at each character, longest first.
2. A piece is the last one of the prefix if it is compatible with the last piece of the prefix before it. The test
   undoes the merges of both pieces from the last one on and asks, before each, whether a pair across the border would
   have been merged instead. It is remembered per pair. Pieces whose order of merges is not clear from their scores (ties)
   are tested by merging the two together.
3. The ids are read off backwards from the end of the table.

Time is linear in the text, whatever its words are, and nothing is ever merged in it.

The vocabulary also tells where texts can be cut: before a space that follows something else, and around characters
that occur in no longer piece. The units between are kept with their ids in a memory bounded by number and by length.
A model whose pieces go across such places is encoded without cutting.

The scores are read from the model file on the driver and the table is sent to the tasks (about 1 MB for 32,000 pieces). Texts are
never shuffled.

Defined results: a null or empty text has no ids and decodes to the empty text; a character outside of the vocabulary
becomes the ids of its UTF-8 bytes; U+2581 is a space, as in the library, and decodes to one; very long texts are
taken in parts; rows keep their number whatever repeats or is null; other columns are ignored; an empty table gives
an empty one. Decoding drops control ids and one leading space; bytes that are not UTF-8 become U+FFFD each. Models
with another normaliser than the identity, unused or user-defined pieces, or without byte pieces are refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import documents

SPACE = "▁"
# The kinds of pieces in a model file
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2

CACHED_UNITS = 250_000  # per generation; longer units than CACHED_CHARS are not kept
CACHED_CHARS = 48
CACHED_PAIRS = 1_000_000
UNITS_AT_ONCE = 200_000
PART_CHARS = 2_000_000


class MergeTable:
    """The pieces of a model, how each is made, and which two of them stay apart.

    A piece is known by its number: its id, or a number from the vocabulary's size on for a character that occurs in
    pieces without being one.
    """

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        """``pieces``: normal pieces by id with spaces for U+2581, "" for ids of another kind."""
        self.size, self.byte_ids = len(pieces), byte_ids
        self.number = {p: i for i, p in enumerate(pieces) if p}
        self.text = list(pieces)
        for c in sorted({c for p in pieces if len(p) > 1 for c in p}):
            if c not in self.number:
                self.number[c] = len(self.text)
                self.text.append(c)
        self.score = {p: scores[i] for p, i in self.number.items() if i < self.size}
        order = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        # single characters are there before any merge
        self.rank = [order[self.score[t]] if len(t) > 1 else -1 for t in self.text]
        self.parts, self.pair, self.unclear = [(-1, -1)] * len(self.text), {}, set()
        shared = set()
        ranks = [r for r in self.rank if r >= 0]
        if len(set(ranks)) < len(ranks):
            seen: set[int] = set()
            shared = {r for r in ranks if r in seen or seen.add(r)}
        self.whole = [bool(t) for t in self.text]  # pieces that merging can make
        for i in sorted((i for i, t in enumerate(self.text) if len(t) > 1), key=lambda i: len(self.text[i])):
            made, last = self.merge(self.text[i])
            self.whole[i] = len(made) == 1
            if self.whole[i]:
                a, b = (self.number[x] for x in last)
                self.parts[i] = a, b
                self.pair[a * len(self.text) + b] = i
                if (self.rank[i] in shared or self.rank[i] <= max(self.rank[a], self.rank[b])
                        or a in self.unclear or b in self.unclear):
                    self.unclear.add(i)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces that merging makes of a short ``text``, and the two that were merged last."""
        made, last = list(text), None
        while True:
            best = None
            for k in range(len(made) - 1):
                s = self.score.get(made[k] + made[k + 1])
                if s is not None and (best is None or s > best[0]):
                    best = s, k
            if best is None:
                return made, last
            k = best[1]
            last = made[k], made[k + 1]
            made[k:k + 2] = [made[k] + made[k + 1]]

    def apart(self, a: int, b: int) -> bool:
        """Whether piece ``b`` after piece ``a`` stays apart from it: the two are the encoding of their union."""
        if a in self.unclear or b in self.unclear:
            return self.merge(self.text[a] + self.text[b])[0] == [self.text[a], self.text[b]]
        rank, parts, pair, n = self.rank, self.parts, self.pair, len(self.text)
        bound = float("inf")  # of the merge that comes next
        while True:
            across = pair.get(a * n + b)
            if across is not None and rank[across] < bound:
                return False
            if rank[a] > rank[b]:
                bound = rank[a]
                a = parts[a][1]
            elif rank[b] >= 0:  # of equal merges the left one comes first, so a pair across comes before this one
                bound = rank[b] + 0.5
                b = parts[b][0]
            else:
                return True


class Encoder:
    """Ids of texts, in one task."""

    def __init__(self, table: MergeTable):
        import ahocorasick

        self.table, self.pairs = table, {}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(table.text):
            if table.whole[i]:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.length = [len(t) for t in table.text]
        self.cut = unit_pattern(table.text)
        self.known, self.old = Units(self), {}

    def ids_of_char(self, c: str) -> list[int]:
        return [self.table.byte_ids[x] for x in c.encode("utf-8")]

    def prefix_table(self, unit: str) -> array:
        """Per prefix the number of its last piece; -1 after a character that is in no piece."""
        last = array("i", [-1]) * (len(unit) + 1)
        length, pairs, n = self.length, self.pairs, len(self.length)
        for end, piece in self.automaton.iter(unit):
            if last[end + 1] >= 0:
                continue
            before = last[end + 1 - length[piece]]
            if before >= 0:
                key = before * n + piece
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= CACHED_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.table.apart(before, piece)
                if not fits:
                    continue
            last[end + 1] = piece
        return last

    def encode_unit(self, unit: str) -> list[int]:
        last, at, out = self.prefix_table(unit), len(unit), []
        while at:
            piece = last[at]
            if 0 <= piece < self.table.size:
                out.append(piece)
            else:
                out += self.ids_of_char(unit[at - 1])[::-1]
            at -= self.length[piece] if piece >= 0 else 1
        out.reverse()
        return out

    def __call__(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        if not text:
            return b""
        text = " " + text.replace(SPACE, " ")
        if len(text) <= PART_CHARS:
            return b"".join(map(self.known.__getitem__, self.cut.findall(text)))
        units, parts = (m.group() for m in self.cut.finditer(text)), []
        while some := list(islice(units, UNITS_AT_ONCE)):
            parts.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(parts)


class Units(dict):
    """Units with their ids as bytes. A full memory becomes the old one; units met again move on."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, unit: str) -> bytes:
        e = self.encoder
        raw = e.old.get(unit)
        if raw is None:
            raw = np.array(e.encode_unit(unit), np.int32).tobytes()
        if len(unit) <= CACHED_CHARS:
            if len(self) >= CACHED_UNITS:
                e.old = dict(self)
                self.clear()
            self[unit] = raw
        return raw


def unit_pattern(pieces: list[str]) -> re.Pattern:
    """What no piece of the vocabulary goes across: spaces with what follows, and characters that never join others."""
    if any(" " in p.lstrip(" ") for p in pieces):
        return re.compile(".+", re.DOTALL)
    joined = {c for p in pieces if len(p) > 1 for c in p}
    alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in joined)
    alone = alone.replace(re.escape(" "), "")
    return re.compile(f" +[^ {alone}]*|[{alone}]|[^ {alone}]+" if alone else " +[^ ]*|[^ ]+")


class Decoder:
    """Texts of ids, in one task."""

    def __init__(self, surfaces: list[bytes], kinds: list[int]):
        self.surfaces, self.kinds = surfaces, np.array(kinds)
        self.flat = np.frombuffer(b"".join(surfaces), np.uint8)
        self.sizes = np.array([len(s) for s in surfaces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray) -> str:
        ids = ids[self.kinds[ids] != CONTROL]
        if not len(ids):
            return ""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        raw = self.flat[np.repeat(self.starts[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()
        cut = int(self.kinds[ids[0]] == NORMAL and raw[:1] == b" ")
        try:
            return raw[cut:].decode("utf-8")
        except UnicodeDecodeError:
            return self._with_broken_bytes(ids)[cut:]

    def _with_broken_bytes(self, ids: np.ndarray) -> str:
        out, held = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.kinds[i] == BYTE:
                held += self.surfaces[i]
                continue
            while held:
                for n in range(1, 5):
                    try:
                        out.append(held[:n].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                held = held[n:]
            if i is not None:
                out.append(self.surfaces[i].decode("utf-8"))
        return "".join(out)


def read_model(path: str) -> tuple[MergeTable, list[bytes], list[int]]:
    """(merge table, surface per id, kind per id) of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds, norm = [p.type for p in model.pieces], model.normalizer_spec
    if model.trainer_spec.model_type != BPE or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or kinds.count(BYTE) != 256:
        raise ValueError(f"{path}: only merge-type models of normal and byte pieces are supported")
    if (norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
            or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix):
        raise ValueError(f"{path}: only the identity normaliser with a leading space is supported")
    byte_ids = [0] * 256
    surfaces = []
    for i, p in enumerate(model.pieces):
        if p.type == BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
            surfaces.append(bytes([int(p.piece[1:-1], 16)]))
        else:
            text = p.piece.replace(SPACE, " ") if p.type == NORMAL else ""
            surfaces.append((model.trainer_spec.unk_surface if p.type == UNKNOWN else text).encode())
    normal = [p.piece.replace(SPACE, " ") if p.type == NORMAL else "" for p in model.pieces]
    return MergeTable(normal, [p.score for p in model.pieces], byte_ids), surfaces, kinds


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array<int>) of every row of ``docs``; ``model`` is the path of a model file."""
    table = docs.sparkSession.sparkContext.broadcast(read_model(model)[0])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = None
        for batch in batches:
            encode = encode or Encoder(table.value)
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raws = [encode(t or "") for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(r) // 4 for r in raws]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded) of every row; ids outside of the vocabulary are an error."""
    _, surfaces, kinds = read_model(model)
    known = encoded.sparkSession.sparkContext.broadcast((surfaces, kinds))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decode = None
        for batch in batches:
            decode = decode or Decoder(*known.value)
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(1)
                flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.array([len(x) if x.is_valid else 0 for x in ids], np.int64)
                ends = np.cumsum(sizes).tolist()
                texts = [decode(flat[z - n:z]) for z, n in zip(ends, sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())],
                                                 names=["id", "ids", "decoded"])

    base = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnsRenamed(
        {"id": id_col, "ids": ids_col})


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode_documents(encode_documents(documents(spark, sf_dir), model), model)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
