"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Method
------
1. Each task walks its documents in chunks of about ``CHUNK_WORDS`` words. A word is hashed to 64 bits once;
   the Rabin-Karp hash of every window of ``window`` words then comes from a prefix sum (arithmetic modulo
   2**64 with an odd, hence invertible, base). A second hash with another base names the *bucket*.
2. Inside a chunk, windows of equal hash are combined before the shuffle: only those of the smallest document
   go on, the others are repeats already. A passage that a third of all documents share therefore sends one
   entry per chunk, not one per document.
3. The entries of a bucket (about ``BUCKET_WINDOWS`` of the corpus' windows) meet in one group; a window that
   starts in a document with a smaller id is a repeat there.
4. The repeats return to their documents, packed by groups of documents of about ``GROUP_CHARS`` characters
   (cogroup). A document's group comes from its id and text, of a null id from its text, and copies of a row are
   one row with a count there, so that neither makes a group grow; overlapping repeats merge into maximal removal intervals and the words outside them are kept.

Two windows are equal when both hashes agree: 64 bits and the bucket number, which is taken from the other
hash. The expected number of false matches is about 10**-13 per window of the corpus, at every corpus size,
because the number of buckets grows with it.

Defined results: a null text has no words; a null id compares with nothing, so such a document neither loses
words nor costs another one its words; rows that repeat an id do not remove words from each other, but each
loses what a smaller id has; an empty table gives an empty table; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so invertible modulo 2**64
CHUNK_WORDS = 1_000_000
BUCKET_WINDOWS = 2_500_000
GROUP_CHARS = 4_000_000
COPIES_AT_ONCE = 10_000
CACHED_WORDS, CACHED_BYTES = 300_000, 64
# The primes of XXH64
XXH64_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579,
                2870177450012600261)


class WordHashes(dict):
    """64-bit hashes of words, kept for the most recent vocabulary only."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 20)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Rabin-Karp hashes of all windows of a word-hash sequence, by prefix sums modulo 2**64."""

    def __init__(self, base: int, window: int):
        self.base, self.inverse, self.window = base, pow(base, -1, 1 << 64), window
        self.powers = self.inverses = np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        factors = np.full(n + 1, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if n < self.window:
            return np.zeros(0, np.uint64)
        if len(self.powers) < n:
            self.powers, self.inverses = (self._powers(b, n) for b in (self.base, self.inverse))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.inverses[:n], out=sums[1:])
        m = n - self.window + 1
        return (sums[self.window:] - sums[:m]) * self.powers[self.window - 1:self.window - 1 + m]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes split at 0x20 and 0x09-0x0D, exactly


def _pack(ids: np.ndarray, keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> bytes:
    head = np.array([len(ids)], np.uint32)
    return b"".join(x.tobytes() for x in (head, ids, keys, counts.astype(np.uint32), hashes))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    ids = np.frombuffer(blob, np.int64, n, 4)
    keys = np.frombuffer(blob, np.uint32, n, 4 + 8 * n)
    counts = np.frombuffer(blob, np.uint32, n, 4 + 12 * n)
    return ids, keys, counts, np.frombuffer(blob, np.uint64, -1, 4 + 16 * n)


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys starts."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def window_entries(buckets: int, window: int):
    """mapInPandas function: (id, text) -> (bucket, blob) entries; bucket -1 holds repeats found in a chunk."""

    def flush(docs: list, roll: list[Rolling]) -> Iterator[dict]:
        docs.sort(key=lambda d: (d[0], d[1]))
        # copies of one text under one id share their repeats
        docs = [d for k, d in enumerate(docs) if not k or d[:2] != docs[k - 1][:2]
                or not np.array_equal(d[2], docs[k - 1][2])]
        ids = np.array([d[0] for d in docs], np.int64)
        keys = np.array([d[1] for d in docs], np.uint32)
        sizes = np.array([len(d[2]) for d in docs], np.int64)
        flat = np.concatenate([d[2] for d in docs])
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        inside = doc[: len(flat) - window + 1] == doc[window - 1:]
        stored, other = (r(flat)[inside] for r in roll)
        doc = doc[: len(inside)][inside]
        order = np.argsort(stored, kind="stable")  # equal hashes: smallest id first
        starts = _runs(stored[order], other[order])
        first = np.repeat(ids[doc[order[starts]]], np.diff(np.append(starts, len(order))))
        late = np.zeros(len(order), bool)
        late[order] = ids[doc[order]] > first
        bucket = ((other >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        bucket[late] = -1
        order = np.argsort(bucket, kind="stable")  # within a bucket in document order
        starts = _runs(bucket[order])
        for a, b in zip(starts, np.append(starts, len(order))[1:], strict=True):
            own = order[a:b]
            at = _runs(doc[own])
            d = doc[own[at]]
            counts = np.diff(np.append(at, len(own)))
            yield {"bucket": int(bucket[own[0]]), "blob": _pack(ids[d], keys[d], counts, stored[own])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, roll, docs, held = WordHashes(), [Rolling(b, window) for b in BASES], [], 0
        for pdf in batches:
            for i, text in zip(pdf["id"].array, pdf["text"].array, strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                docs.append((int(i), zlib.crc32(text.encode("utf-8", "surrogatepass")), hashes.of(words)))
                held += len(words)
                if held >= CHUNK_WORDS:
                    yield pd.DataFrame(list(flush(docs, roll)), columns=["bucket", "blob"])
                    docs, held = [], 0
        if docs:
            yield pd.DataFrame(list(flush(docs, roll)), columns=["bucket", "blob"])

    return run


def homes(ids: np.ndarray, count: int, keys: np.ndarray | None = None) -> np.ndarray:
    """pmod(xxhash64(id), count) of 64-bit ids, or pmod(xxhash64(id, key), count), as Spark computes them."""
    h = _xxh64(ids, np.uint64(42))
    if keys is not None:
        h = _xxh64(keys.astype(np.int64), h)
    return h.view(np.int64) % count


def _xxh64(values: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of one long each."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in XXH64_PRIMES)

    def rotated(x: np.ndarray, k: int) -> np.ndarray:
        return x << np.uint64(k) | x >> np.uint64(64 - k)

    h = rotated(values.view(np.uint64) * p2, 31) * p1 ^ (seed + (p5 + np.uint64(8)))
    h = rotated(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _by_home(blobs: list[tuple[np.ndarray, ...]], hit: np.ndarray | None, count: int) -> pd.DataFrame:
    """(home, blob) rows: the entries marked by ``hit`` (all when None) for the groups their documents are in."""
    ids, keys, counts, hashes = (np.concatenate(x) for x in zip(*blobs, strict=True))
    run = np.repeat(np.arange(len(ids)), counts)
    if hit is not None:
        run, hashes = run[hit], hashes[hit]
    home = homes(ids, count, keys)
    order = np.argsort(home[run], kind="stable")
    run, hashes = run[order], hashes[order]
    starts, rows = _runs(home[run]), []
    for a, z in zip(starts, np.append(starts, len(run))[1:], strict=True):
        at = _runs(run[a:z])
        r = run[a:z][at]
        sizes = np.diff(np.append(at, z - a))
        rows.append((int(home[run[a]]), _pack(ids[r], keys[r], sizes, hashes[a:z])))
    return pd.DataFrame(rows, columns=["home", "blob"])


def bucket_repeats(pdf: pd.DataFrame, count: int) -> pd.DataFrame:
    """Of one bucket: the windows that a smaller document id also has."""
    blobs = [_unpack(b) for b in pdf["blob"]]
    doc = np.concatenate([np.repeat(b[0], b[2]) for b in blobs])
    hashes = np.concatenate([b[3] for b in blobs])
    order = np.argsort(hashes, kind="stable")
    starts = _runs(hashes[order])
    sorted_doc = doc[order]
    first = np.repeat(np.minimum.reduceat(sorted_doc, starts), np.diff(np.append(starts, len(order))))
    hit = np.zeros(len(order), bool)
    hit[order] = sorted_doc > first
    return _by_home(blobs, hit, count)


def removal_intervals(hit: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal word intervals [start, end) covered by the windows that start where ``hit`` is set."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.append(0, gap + 1)].tolist(), (at[np.append(gap, len(at) - 1)] + window).tolist(),
                    strict=True))


def kept_rows(window: int):
    """cogroup function: a group's documents (id, text, copies) and its repeats -> id, n_words, n_removed, removed,
    kept_text, copies."""

    def run(docs: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
        word_hashes, roll, found = WordHashes(), Rolling(BASES[0], window), defaultdict(list)
        for blob in repeats["blob"]:
            ids, keys, counts, hashes = _unpack(blob)
            parts = np.split(hashes, np.cumsum(counts)[:-1])
            for i, k, h in zip(ids.tolist(), keys.tolist(), parts, strict=True):
                found[i, k].append(h)
        out = []
        for i, text, copies in zip(docs["id"].array, docs["text"].array, docs["copies"].array, strict=True):
            raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            words, doc_id = raw.split(), None if i is None else int(i)
            n, spans = len(words), []
            if (hashes := found.get((doc_id, zlib.crc32(raw)))) and n >= window:
                hit = np.isin(roll(word_hashes.of(words)), np.concatenate(hashes))
                spans = removal_intervals(hit, window)
                ends = [0, *(x for s in spans for x in s), n]
                words = [w for a, b in zip(ends[::2], ends[1::2], strict=True) for w in words[a:b]]
            out.append((doc_id, n, n - len(words), [{"start": a, "end": b} for a, b in spans],
                        b" ".join(words).decode("utf-8", "surrogatepass"), copies))
        res = pd.DataFrame(out, columns=["id", "n_words", "n_removed", "removed", "kept_text", "copies"])
        return res.assign(id=pd.array([r[0] for r in out], "Int64"))

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per document: id, n_words, n_removed, removed (word intervals), kept_text (kept words, one space)."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets, groups = max(1, math.ceil(chars / 6 / BUCKET_WINDOWS)), max(1, math.ceil(chars / GROUP_CHARS))
    entries = base.where("id IS NOT NULL AND text IS NOT NULL").mapInPandas(
        window_entries(buckets, window), "bucket int, blob binary")
    # one shuffle for both kinds: a bucket is a group, repeats found inside a chunk pass through
    spread = entries.withColumn("part", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(
        -1 - F.pmod(F.crc32("blob"), F.lit(buckets)).cast("int")))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["part"].iloc[0] < 0:
            return _by_home([_unpack(b) for b in pdf["blob"]], None, groups)
        return bucket_repeats(pdf, groups)

    repeats = spread.select("part", "blob").groupBy("part").applyInPandas(group, "home int, blob binary")
    # ids go as text: pandas would turn a column of integers and nulls into floats
    # (null ids are skipped by the hash: their texts spread them)
    homed = base.select(F.col("id").cast("string").alias("id"), "text",
                        F.pmod(F.xxhash64("id", F.crc32("text")), F.lit(groups)).cast("int").alias("home"))
    # copies of a row are one row with a count; the shuffle by home serves this and the cogroup
    homed = homed.repartition("home").groupBy("home", "id", "text").agg(F.count("*").alias("copies"))
    kept = homed.groupBy("home").cogroup(repeats.groupBy("home")).applyInPandas(
        kept_rows(window), "id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, "
        "kept_text string, copies long")
    # each copy gets its row again, by two sequences of bounded size
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_AT_ONCE)))
    some = F.least(F.lit(COPIES_AT_ONCE).cast("long"), F.col("copies") - F.col("_part") * COPIES_AT_ONCE)
    kept = kept.select("*", parts.alias("_part")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), some)))
    return kept.select(F.col("id").alias(id_col), "n_words", "n_removed", "removed", "kept_text")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from ridelens.llm.common import documents

    out = substring_dedup(documents(spark, sf_dir), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), first AS (
  SELECT s, min(doc_id) AS m FROM win GROUP BY s
), cov AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM win JOIN first USING (s) WHERE win.doc_id > first.m
), word AS (
  SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
