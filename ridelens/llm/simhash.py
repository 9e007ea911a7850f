"""SimHash near-dedup over a Gray-order hierarchical index.

Method
------
* Fingerprint: bit k is set when more than half of the shingles' XXH64 hashes (seed 42) have it set. Shingles are
  slices of the normalised text, hashed and counted with numpy, whole texts.
* Index over the *distinct* fingerprints (copies are collapsed before, so a group of copies is one entry).
  The uppermost nodes of the hierarchy are masked bit patterns: of ``max_bits + 1`` bands of bits, two
  fingerprints at ``max_bits`` or fewer differing bits agree on at least one band. A node that holds more than
  ``SPLIT_ABOVE`` fingerprints is split by bands of its remaining bits, again without losing a pair; after four
  levels so few bits are left that no node can be larger. So a node fits one task at every corpus size.
* Within a node the fingerprints are sorted by Gray rank, so neighbours share most bits. Runs of ``FAN`` entries
  form an inner node that stores the bits on which all of them agree (a mask and a value); runs of inner nodes form
  the next level. Node pairs are walked from the top: differences in the shared bits are a lower bound for every
  pair below, so whole groups are pruned as soon as they exceed ``max_bits``.
* A task links what it finds by union-find and emits one edge per linked fingerprint, never all pairs.
  Connected components of these edges give the groups.

Defined results: a null or blank text has fingerprint zero and links like any other; of fewer words than a
shingle the whole sequence is the one shingle; a null id takes part, and a component's id is its smallest
non-null id (null if there is none); repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import ID, id_keys, materialize, own_row, row_hash, text_key, unpacked
from ridelens.llm.components import connected_components

BITS = 64
FAN = 8
SPLIT_ABOVE = 50_000
TASK_ROWS = 200_000
PAIRS_AT_ONCE = 40_000


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower: A-Z only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    line, xx = b" ".join(words), xxhash.xxh64_intdigest
    hashes = np.fromiter([xx(line[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({
                "id": pdf["id"], "text_key": pdf["text_key"],
                "fp": np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in pdf["text"].array],
                               np.int64)})

    return run


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 3) -> DataFrame:
    """(id, text_key, fp): a 64-bit fingerprint (signed) per row; text_key tells rows of equal id apart."""
    # ids go through as text: pandas would turn a column of integers and nulls into floats
    base = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("text_key"))
    fps = base.mapInPandas(_fingerprints(shingle), "id string, text_key long, fp long")
    return fps.withColumn("id", F.col("id").cast("long"))


# ---- the index ------------------------------------------------------------------------------------------------

def bands(free: int, parts: int) -> list[int]:
    """Split the set bits of ``free`` into ``parts`` masks of neighbouring bits."""
    bits = [i for i in range(BITS) if free >> i & 1]
    cut = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cut, cut[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masked_nodes(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(node, fp): each fingerprint below the uppermost nodes it belongs to; hot nodes are split by more bits."""
    masks = [0]
    level = distinct.select("fp", F.lit(0).alias("path"))
    done = None
    while True:
        nxt = [m | b for m in masks for b in bands(((1 << 64) - 1) & ~m, max_bits + 1)]
        arr = F.array(*[F.lit(_signed(m)) for m in nxt])
        kids = F.transform(F.sequence(F.lit(0), F.lit(max_bits)),
                           lambda k: (F.col("path") * (max_bits + 1) + k).cast("int"))
        level = level.select("fp", F.explode(kids).alias("path"))
        level = level.withColumn("node", F.xxhash64(F.lit(len(nxt)), "path", F.col("fp").bitwiseAND(
            F.element_at(arr, F.col("path") + 1))))
        masks = nxt
        free = BITS - min(int(m).bit_count() for m in masks)
        if 1 << free <= SPLIT_ABOVE:
            break
        hot = level.groupBy("node").count().where(F.col("count") > SPLIT_ABOVE).select("node")
        hot = materialize(hot, "simhash-hot")
        if hot.isEmpty():
            break
        level = materialize(level, "simhash-level")
        cool = level.join(hot, "node", "left_anti").select("node", "fp")
        done = cool if done is None else done.union(cool)
        level = level.join(hot, "node", "left_semi").select("fp", "path")
    last = level.select("node", "fp")
    return last if done is None else done.union(last)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence (prefix xor of its bits)."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            parent[x] = r
            return r
        r = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = _roots(parent, a), _roots(parent, b)
        apart = ra != rb
        a, b = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        np.minimum.at(parent, b, a)


def gray_links(node: np.ndarray, codes: np.ndarray, max_bits: int) -> np.ndarray:
    """Union-find parents over entries (sorted here by node and Gray rank): linked entries share a root.

    Returns (order, parent): parent is over positions of the sorted entries.
    """
    order = np.lexsort((gray_rank(codes), node))
    gid, fp = node[order], codes[order]
    parent = np.arange(len(fp))
    # levels[0] are the entries; above, runs of FAN with the AND and the OR of their members
    levels = [(fp, fp, None)]
    group, both, either = gid, fp, fp
    while True:
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(starts, len(group)))
        if (sizes == 1).all():
            break
        within = np.arange(len(group)) - np.repeat(starts, sizes)
        cut = np.flatnonzero(within % FAN == 0)
        both, either, group = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(either, cut), group[cut]
        levels.append((both, either, np.append(cut, len(within))))
    top = np.arange(len(group))
    if len(levels) == 1:
        return order, parent
    work = [(len(levels) - 1, top, top)]
    while work:
        at, x, y = work.pop()
        if len(x) > PAIRS_AT_ONCE:
            work.append((at, x[PAIRS_AT_ONCE:], y[PAIRS_AT_ONCE:]))
            x, y = x[:PAIRS_AT_ONCE], y[:PAIRS_AT_ONCE]
        edge = levels[at][2]
        nx, ny = edge[x + 1] - edge[x], edge[y + 1] - edge[y]
        many = nx * ny
        pair = np.repeat(np.arange(len(x)), many)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        a, b = edge[x][pair] + k // ny[pair], edge[y][pair] + k % ny[pair]
        both, either, _ = levels[at - 1]
        # bits on which all members of a node agree: AND equals OR
        shared = ~((both[a] ^ either[a]) | (both[b] ^ either[b]))
        near = np.bitwise_count((both[a] ^ both[b]) & shared) <= max_bits
        near &= (a < b) if at == 1 else (a <= b)
        a, b = a[near], b[near]
        if at == 1:
            _union(parent, a, b)
        elif len(a):
            work.append((at - 1, a, b))
    return order, parent


def _links(max_bits: int):
    """mapInPandas function over (node, fp) rows sorted by node: (a, b) edges, one per linked fingerprint."""

    def edges(node: np.ndarray, codes: np.ndarray) -> pd.DataFrame:
        many = np.flatnonzero(np.append(node[1:] == node[:-1], False) | np.append(False, node[1:] == node[:-1]))
        node, codes = node[many], codes[many]
        if not len(node):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        order, parent = gray_links(node, codes, max_bits)
        root = _roots(parent, np.arange(len(parent)))
        own = np.flatnonzero(root != np.arange(len(root)))
        fp = codes[order].view(np.int64)
        return pd.DataFrame({"a": fp[own], "b": fp[root[own]]}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, codes, held = [], [], 0
        for pdf in batches:
            nodes.append(pdf["node"].to_numpy(np.int64))
            codes.append(pdf["fp"].to_numpy(np.int64).view(np.uint64))
            held += len(pdf)
            if held >= TASK_ROWS:
                node, code = np.concatenate(nodes), np.concatenate(codes)
                whole = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
                if whole:
                    yield edges(node[:whole], code[:whole])
                nodes, codes, held = [node[whole:]], [code[whole:]], len(node) - whole
        if held:
            yield edges(np.concatenate(nodes), np.concatenate(codes))

    return run


def simhash_groups(fingerprints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, group_fp) of every fingerprint that links to another one (``fingerprints``: column fp)."""
    distinct = fingerprints.select("fp").distinct()
    nodes = masked_nodes(distinct, max_bits).repartition("node").sortWithinPartitions("node")
    found = nodes.mapInPandas(_links(max_bits), "a long, b long")
    # hashing a single long is one-to-one, so the hashes can stand for the fingerprints
    mixed = connected_components(found.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    return distinct.withColumn("node", F.xxhash64("fp")).join(mixed, "node").select(
        "fp", F.col("component").alias("group_fp"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 2) -> DataFrame:
    """Per row: id, text_key, fp, component_id (smallest id of the group), rep_key (text_key of that row)."""
    fps = materialize(simhash_fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    # a hot fingerprint or group is aggregated to one row per task before it is shuffled
    best = fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("best"))
    grouped = best.join(simhash_groups(fps, max_bits), "fp", "left").withColumn(
        "key", F.coalesce("group_fp", F.xxhash64("fp")))
    tops = grouped.groupBy("key").agg(F.min("best").alias("top"))
    by_fp = grouped.select("fp", "key").join(tops, "key").select(
        "fp", F.col("top.id").alias("component_id"), F.col("top.text_key").alias("rep_key"))
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), "text_key", "fp", "component_id", "rep_key")


def keep_one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one document of each group: the one with the smallest id; of rows that repeat
    both its id and its text, one by a hash of all columns. All columns are passed on as they are.

    Equal (id, text) rows are reduced to one before the shuffle, which is the only one that texts go through.
    """
    groups = simhash_components(docs, shingle=shingle, max_bits=max_bits)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key").eqNullSafe(
        F.col("rep_key")))).select(*id_keys(F.col("doc_id")), "text_key").distinct()
    rows = docs.select(*id_keys(F.col("doc_id")), text_key(F.col("text")), row_hash(docs).alias("order"), own_row(docs).alias("row"))
    keys = [*ID, "text_key"]
    return unpacked(rows.groupBy(*keys).agg(F.min_by("row", "order").alias("row")).join(kept, keys))


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from ridelens.llm.common import documents

    out = simhash_components(documents(spark, sf_dir), shingle=3, max_bits=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
