"""Sharding: a hierarchical weighted hash tree (region, rack, shard).

A document descends from the root; at each level every child draws ``-ln(u) / weight`` with u from a hash of the
document id and the child's path, and the smallest draw wins. A child wins in proportion to its weight, and its draw
does not depend on its siblings, so a changed weight moves documents only between the subtree it belongs to and its
siblings: inside an untouched subtree nothing moves. A shard that opens a region of its own therefore takes documents
only into itself (law ``key``: the id and the tree decide, nothing else).

Slots number a shard's documents without gaps in the order of a hash of id and text. They come from prefix sums over
(shard, hash range) counts, taken in blocks, so no shard is ever sorted as a whole in one task. An id that very many rows
share (null is one) is spread by its texts; very many equal rows are parted by a salt, as they are interchangeable.

Defined results: a null id draws by the paths alone (all null ids are in one shard); a null text has size 1 and the
CRC of no bytes; repeated rows get a slot each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import crowded, materialize, sums_before, top_bits

ROWS_PER_RANGE = 20_000
# Fixed topology of the query: region -> rack -> shard -> weight
EIGHT = {"r0": {"k0": {0: 1, 1: 1}, "k1": {2: 1, 3: 1}}, "r1": {"k0": {4: 1, 5: 1}, "k1": {6: 1, 7: 1}}}
NINE = EIGHT | {"r2": {"k0": {8: 1}}}


def weight(node) -> float:
    return sum(weight(x) for x in node.values()) if isinstance(node, dict) else node


def draw(key: Column, path: str, w: float) -> Column:
    """An exponential draw with rate ``w``, the same for a key and a path everywhere."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / float(w)


def descend(key: Column, tree: dict, path: str = "") -> Column:
    """The leaf (an int) that ``key`` comes to in ``tree``."""
    names = list(tree)
    if len(names) == 1:
        return _child(key, tree, names[0], path)
    draws = F.array(*[F.struct(draw(key, f"{path}/{n}", weight(tree[n])).alias("d"), F.lit(k).alias("k"))
                      for k, n in enumerate(names)])
    won = F.array_min(draws)["k"]
    out = None
    for k, n in enumerate(names):
        case = (won == k, _child(key, tree, n, path))
        out = F.when(*case) if out is None else out.when(*case)
    return out


def _child(key: Column, tree: dict, name, path: str) -> Column:
    kid = tree[name]
    return descend(key, kid, f"{path}/{name}") if isinstance(kid, dict) else F.lit(int(name))


def shard_documents(docs: DataFrame, tree: dict, grown: dict, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    key = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    # texts are read once; what follows is about 50 bytes a row
    placed = docs.select(key.alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text).alias("text_crc32"), F.xxhash64(key, text, F.lit("slot")).alias("h"),
                         F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    placed = materialize(placed.withColumn("shard", descend(F.col("id"), tree)).withColumn(
        "grown_shard", descend(F.col("id"), grown)), "shard-placed")
    bits = max(0, math.ceil(math.log2(max(1, placed.count() / ROWS_PER_RANGE))))
    equal = ["id", "size", "text_crc32", "h"]
    rows = top_bits(placed, crowded(placed, equal, ROWS_PER_RANGE, "shard-copies"), equal, "salt", "copy")
    rows = rows.withColumn("range", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy("shard", "range", "copy").agg(F.count("*").alias("n"))
    starts = sums_before(counts, ["shard"], ["range", "copy"], "n", block=F.shiftright("range", 12))
    own = Window.partitionBy("shard", "range", "copy").orderBy("h", *equal)
    return rows.join(starts.drop("n"), ["shard", "range", "copy"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.row_number().over(own) - 1 + F.col("first")).cast("long").alias("slot"), "grown_shard")


def op6_shard_tree(spark, sf_dir: str) -> DataFrame:
    from ridelens.llm.common import documents

    return shard_documents(documents(spark, sf_dir), EIGHT, NINE)
