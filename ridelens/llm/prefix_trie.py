"""Conversation prefix trie: nodes are the distinct sequences of first turns, found by count-min screening.

Method
------
1. Every turn becomes a 128-bit digest, every prefix of a conversation a polynomial of its turns' digests modulo
   2**127 - 1. Polynomials add up, so a very long conversation is cut into parts whose local sums are put together by a row
   per part. Texts are hashed where they are read and never shuffled.
2. A count-min sketch counts the prefixes: two rows of cells chosen by the prefix digest. Tasks count locally and send
   the cells they met, packed by bands of 65,536; bands are added up in streams and only a bit per cell remains: met
   more than once or not. The sketch takes at most ``MAX_CELLS`` bits a row, whatever the corpus.
3. A count-min estimate is never too low, so an estimate of one proves a singleton. Singletons are leaves' tails: their
   rows are made where the prefix is, without a shuffle (only the first row of a tail looks up its parent).
4. Prefixes that may be shared are grouped exactly by (depth, digest). Should the corpus outgrow the sketch, more
   prefixes take this way, with the same result.

Sums over subtrees need no walk of the tree. The smallest member of a node stands for it; a member stands for its nodes
from some depth r on. So a node's leaves are its members that stand for a childless node, its children the
members that stand for their next node, and the saved tokens of its subtree are the words of each member from the node's
depth up to r - 1. Hot prefixes are aggregated before the shuffle; joins on them rely on AQE's skew handling.

Two prefixes are equal when depth and digest are; with 10**12 prefixes the chance of any false match is below 10**-13.

Defined results: a null role or text is empty; null turns come first, rows of one turn stand in the order of the digest of
role and text, copies of a row are turns of their own; rows without conv_id are in no conversation; a conversation without
turns ends at the root; other columns are ignored; an empty table gives an empty one. The ids that end at a node are
hashed as one list: it is sorted by ranges in many tasks, and only its pieces (of 1 MB) pass one after the other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.arrow_rows import in_tasks
from ridelens.llm.common import WORD, materialize, table
from ridelens.llm.conversations import LONG_ROWS, row_key, with_parts

PRIME = (1 << 127) - 1
BASE = 0x5A827999_6ED9EBA1_8F1BBCDC_CA62C1D6  # below PRIME
WIDTH = 16
NOTHING = bytes(WIDTH)

SKETCH_ROWS = 2
BAND = 1 << 16
MAX_CELLS = 1 << 27  # a row: 16 MB of bits
CELLS_A_PREFIX = 8
COUNT_AT_ONCE = 2_000_000
LIST_BYTES = 1_000_000
EMPTY_SHA = hashlib.sha256().hexdigest()


def number(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def raw(value: int) -> bytes:
    return (value % PRIME).to_bytes(WIDTH, "big")


# ---- prefixes -------------------------------------------------------------------------------------------------

def part_prefixes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (conv, part, key, words) -> (conv, part, place, sum, sum before, words, words so far), local to the part."""
    for (conv, part), group in groupby(rows, itemgetter(0, 1)):
        total, upto, power, before = 0, 0, 1, NOTHING
        for place, (_, _, key, words) in enumerate(group, 1):
            power = power * BASE % PRIME
            total = (total + (int(key, 16) + 1) * power) % PRIME
            upto += words
            now = raw(total)
            yield conv, part, place, now, before, words, upto
            before = now


CONVERSATION = ("conv long, n long, sums array<binary>, heads array<long>, parts array<int>, starts array<long>, "
                "offsets array<binary>, word_offsets array<long>")


def conversations_of_parts(rows: Iterator[tuple], heads: int) -> Iterator[tuple]:
    """(conv, [part summaries]) -> CONVERSATION: prefix sums of its first ``heads`` turns, and what is before each
    part."""
    for conv, parts in rows:
        n = total = words = 0
        out = [[], [], [], [], [], []]
        for p in parts:
            shift = pow(BASE, n, PRIME)
            for head in p["first"]:
                if n + head["place"] <= heads:
                    out[0].append(raw(total + shift * number(head["sum"])))
                    out[1].append(words + head["upto"])
            for column, value in zip(out[2:], (p["part"], n, raw(total), words), strict=True):
                column.append(value)
            n, total, words = n + p["n"], (total + shift * number(p["sum"])) % PRIME, words + p["words"]
        yield conv, n, *out


PLACED = ("conv long, part int, shift long, skip long, len long, add binary, factor binary, word_shift long, "
          "depths array<long>, digests array<binary>, parents array<binary>, words array<long>, uptos array<long>")


def placed_parts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(CONVERSATION..., h, sums and words of the borrowed head) -> PLACED per part.

    The prefix that ends at a part's turn ``i`` has depth ``shift + i`` and digest ``add + factor * local sum``; turns up
    to ``skip`` are not used. The rows of the borrowed turns themselves come with the first part.
    """
    for conv, n, sums, heads, parts, starts, offsets, word_offsets, h, base_sums, base_words in rows:
        base_sums, base_words = base_sums or [], base_words or []
        b, own = len(base_sums), min(h, n)
        head_sum, head_words = (number(sums[own - 1]), heads[own - 1]) if own else (0, 0)
        base_sum, base_upto = (number(base_sums[-1]), base_words[-1]) if b else (0, 0)
        back = pow(BASE, b - own, PRIME)
        for k, (part, start, offset, words) in enumerate(zip(parts, starts, offsets, word_offsets, strict=True)):
            borrowed = [[], [], [], [], []]
            if not k:
                borrowed = [list(range(1, b + 1)), base_sums, [NOTHING, *base_sums][:b],
                            [x - y for x, y in zip(base_words, [0, *base_words], strict=False)], base_words]
            yield (conv, part, start + b - own, own - start, b + n - own,
                   raw(base_sum + back * (number(offset) - head_sum)), raw(back * pow(BASE, start, PRIME)),
                   words + base_upto - head_words, *borrowed)


PREFIX = "conv long, depth long, digest binary, parent binary, words long, upto long, len long"


def own_prefixes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, place, sum, sum before, words, upto, PLACED's numbers) -> PREFIX."""
    for conv, place, total, before, words, upto, shift, length, add, factor, word_shift in rows:
        a, f = number(add), number(factor)
        yield (conv, place + shift, raw(a + f * number(total)), raw(a + f * number(before)), words, upto + word_shift,
               length)


def prefixes(conversations: DataFrame, block: int | None, heads: int, long_rows: int) -> tuple[DataFrame, DataFrame]:
    """(PREFIX rows of all prefixes but the empty one, (conv, len) of all conversations).

    With ``block`` the first h turns of a conversation c are those of conversation c - c % block, where h = crc32(c) %
    (heads + 1).
    """
    conv, role, text = F.col("conv_id").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (
        "role", "text")]
    rows = conversations.select(
        conv.alias("conv"), F.col("turn").cast("long").alias("turn"), row_key(role, text).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).where("conv IS NOT NULL")
    rows = with_parts(rows, long_rows=long_rows)[0].withColumn("part", F.coalesce("part", F.lit(0)))
    turns = rows.repartition("conv", "part").sortWithinPartitions("conv", "part", "turn", "key")
    turns = materialize(in_tasks(
        turns.select("conv", "part", "key", "words"), part_prefixes,
        "conv long, part int, place long, sum binary, before binary, words long, upto long"), "trie-turns")
    first = F.sort_array(F.collect_list(F.when(F.col("place") <= heads, F.struct("place", "sum", "upto"))))
    parts = turns.groupBy("conv", "part").agg(
        F.max("place").alias("n"), F.max_by("sum", "place").alias("sum"), F.max("upto").alias("words"),
        first.alias("first"))
    whole = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "n", "sum", "words", "first"))).alias(
        "parts"))
    whole = materialize(in_tasks(whole, conversations_of_parts, CONVERSATION, heads), "trie-conversations")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (heads + 1) if block else F.lit(0)
    base = whole.select(F.col("conv").alias("base"), F.col("sums").alias("base_sums"), F.col("heads").alias(
        "base_words"))
    both = whole.withColumn("h", h.cast("int")).join(
        base, F.col("conv") - F.pmod("conv", F.lit(block or 1)) == F.col("base"), "left")
    both = both.select(*whole.columns, "h", *[F.slice(c, F.lit(1), F.col("h")).alias(c) for c in (
        "base_sums", "base_words")])
    placed = materialize(in_tasks(both, placed_parts, PLACED), "trie-placed")
    borrowed = placed.select("conv", "len", F.explode(F.arrays_zip("depths", "digests", "parents", "words", "uptos"))
                             .alias("x")).select("conv", F.col("x.depths").alias("depth"), F.col("x.digests").alias(
                                 "digest"), F.col("x.parents").alias("parent"), "x.words", F.col("x.uptos").alias(
                                 "upto"), "len")
    numbers = ["shift", "len", "add", "factor", "word_shift"]
    own = turns.join(placed.select(F.col("conv").alias("c"), F.col("part").alias("p"), "skip", *numbers),
                     (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p"))).where("place > skip")
    own = in_tasks(own.select("conv", "place", "sum", "before", "words", "upto", *numbers), own_prefixes, PREFIX)
    return (materialize(own.unionByName(borrowed), "trie-prefixes"),
            placed.select("conv", "len").distinct())


# ---- count-min screening --------------------------------------------------------------------------------------

def _cells(column, mask: int) -> list[np.ndarray]:
    """Per sketch row the cells of an Arrow column of digests."""
    words = np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, SKETCH_ROWS)
    return [(words[:, r] & np.uint64(mask)).astype(np.int64) for r in range(SKETCH_ROWS)]


def count_cells(prefix: DataFrame, cells: int) -> DataFrame:
    """(band, once, more): cells of a band (low 16 bits each) that a task met once, or more often."""
    mask = cells - 1

    def flush(held: list[np.ndarray]) -> Iterator:
        import pyarrow as pa

        met, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.flatnonzero(np.diff(met // BAND)) + 1
        for cell, count in zip(np.split(met, cuts), np.split(n, cuts), strict=True):
            low = (cell % BAND).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(cell[0]) // BAND], pa.int64()), pa.array([low[count == 1].tobytes()], pa.binary()),
                 pa.array([low[count > 1].tobytes()], pa.binary())], names=["band", "once", "more"])

    def run(batches: Iterator) -> Iterator:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held += [cell + r * cells for r, cell in enumerate(_cells(batch.column(0), mask))]
                size += batch.num_rows
            if size >= COUNT_AT_ONCE:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return prefix.select("digest").mapInArrow(run, "band long, once binary, more binary")


def add_bands(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (band, once, more) -> (band, a bit per cell: met more than once)."""
    for band, group in groupby(rows, itemgetter(0)):
        met, shared = np.zeros(BAND, bool), np.zeros(BAND, bool)
        for _, once, more in group:
            once = np.frombuffer(once, "<u2")
            shared[np.frombuffer(more, "<u2")] = True
            shared[once[met[once]]] = True
            met[once] = True
            met[np.frombuffer(more, "<u2")] = True
        yield band, np.packbits(shared).tobytes()


def sketch(prefix: DataFrame, max_cells: int = MAX_CELLS) -> tuple[int, bytes]:
    """(cells a row, a bit per cell of all rows): at most ``max_cells`` bits a row on the driver."""
    n = prefix.count()
    cells = min(max_cells, max(BAND, 1 << math.ceil(math.log2(max(1, n * CELLS_A_PREFIX)))))
    bands = count_cells(prefix, cells).repartition("band").sortWithinPartitions("band")
    bits = bytearray(SKETCH_ROWS * cells // 8)
    for band, part in in_tasks(bands, add_bands, "band long, bits binary").toLocalIterator():
        bits[band * BAND // 8:(band + 1) * BAND // 8] = part
    return cells, bytes(bits)


def screened(prefix: DataFrame, cells: int, bits: bytes) -> DataFrame:
    """Adds ``shared`` and ``parent_shared``: the estimate is above one. False proves a singleton."""
    known = prefix.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = np.frombuffer(known.value, np.uint8)

        def above_one(column) -> np.ndarray:
            out = np.ones(len(column), bool)
            for r, cell in enumerate(_cells(column, cells - 1)):
                at = cell + r * cells
                out &= (table[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            return out

        for batch in batches:
            k = {name: batch.schema.get_field_index(name) for name in ("digest", "parent")}
            flags = [pa.array(above_one(batch.column(k[c]))) for c in ("digest", "parent")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags],
                                             names=[*batch.schema.names, "shared", "parent_shared"])

    return prefix.mapInArrow(run, f"{PREFIX}, shared boolean, parent_shared boolean")


# ---- nodes ----------------------------------------------------------------------------------------------------

def id_lists(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (at, digest, conv) -> (digest, at, place, piece of the list of ids)."""
    for (at, digest), group in groupby(rows, itemgetter(0, 1)):
        held, size, place = [], 0, 0
        for _, _, conv in group:
            held.append(str(conv))
            size += len(held[-1]) + 1
            if size >= LIST_BYTES:
                yield digest, at, place, ",".join(held)
                held, size, place = [], 0, place + 1
        if held:
            yield digest, at, place, ",".join(held)


def list_digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (digest, at, place, piece) -> (digest, SHA-256 of the whole list)."""
    for digest, group in groupby(rows, itemgetter(0)):
        sha, some = hashlib.sha256(), False
        for *_, piece in group:
            sha.update((("," if some else "") + piece).encode())
            some = True
        yield digest, sha.hexdigest()


def sha_of_id(conv: Column) -> Column:
    return F.sha2(conv.cast("string").cast("binary"), 256)


def prefix_trie(conversations: DataFrame, block: int | None = None, heads: int = 3, long_rows: int = LONG_ROWS,
                max_cells: int = MAX_CELLS) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefix, every = prefixes(conversations, block, heads, long_rows)
    all_ = screened(prefix, *sketch(prefix, max_cells))
    maybe = materialize(all_.where("shared").drop("shared", "parent_shared"), "trie-candidates")
    groups = materialize(maybe.groupBy("depth", "digest").agg(F.min("conv").alias("rep"), F.max("len").alias("longest")),
                         "trie-groups")

    known = groups.select(F.col("depth").alias("d"), F.col("digest").alias("x"), "rep", "longest")
    met = maybe.join(known, (F.col("depth") == F.col("d")) & (F.col("digest") == F.col("x")))
    stands, ends = F.col("rep") == F.col("conv"), F.col("depth") == F.col("len")
    # a member stands for its nodes below those it doesn't; a tail beyond the candidates ends in a leaf of its own
    member = materialize(met.groupBy("conv").agg(
        (F.count_if(~stands) + 1).alias("r"), F.coalesce(F.max(F.when(~stands, F.col("upto"))), F.lit(0)).alias("told"),
        F.coalesce(F.max(F.when(ends, stands & (F.col("longest") == F.col("depth")))), F.lit(True)).alias("leaf")),
        "trie-members")
    rows = maybe.join(member.withColumnRenamed("conv", "c"), F.col("conv") == F.col("c"))
    before = F.col("upto") - F.col("words")
    nodes = materialize(rows.groupBy("depth", "digest").agg(
        F.min("conv").alias("conv_id"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"),
        F.count_if((F.col("len") > F.col("depth")) & (F.col("r") <= F.col("depth") + 1)).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("told") - before)).alias("saved_tokens"),
        F.count_if(ends).alias("n_ends"), F.min(F.when(ends, F.col("conv"))).alias("end")), "trie-nodes")

    root = every.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
                     F.count_if(F.col("len") > 0).alias("own")).first()
    told = member.agg(F.count("*").alias("n"), F.count_if(F.col("r") == 1).alias("top"), F.count_if("leaf").alias("leaf"),
                      F.coalesce(F.sum("told"), F.lit(0)).alias("told")).first()
    alone = root["own"] - told["n"]

    # ids that end at a node: a list if there are several
    several = nodes.where("n_ends > 1").select(F.col("depth").alias("d"), F.col("digest").alias("x"))
    lists = maybe.where(ends).join(several, (F.col("depth") == F.col("d")) & (F.col("digest") == F.col("x")), "left_semi")
    lists = lists.select("digest", "conv").union(every.where("len = 0").select(F.lit(NOTHING).alias("digest"), "conv"))
    lists = lists.repartitionByRange("digest", "conv").withColumn("at", F.spark_partition_id()).sortWithinPartitions(
        "at", "digest", "conv")
    pieces = materialize(in_tasks(lists.select("at", "digest", "conv"), id_lists,
                                  "digest binary, at int, place long, piece string"), "trie-lists")
    shas = in_tasks(pieces.repartition("digest").sortWithinPartitions("digest", "at", "place"), list_digests,
                    "of binary, sha string")

    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = nodes.join(shas, F.col("digest") == F.col("of"), "left").select(
        *columns, "parent", F.coalesce("sha", F.when(F.col("n_ends") == 1, sha_of_id(F.col("end"))), F.lit(
            EMPTY_SHA)).alias("ends_sha256"), F.lit(True).alias("look"))
    more = F.col("len") > F.col("depth")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = all_.where("NOT shared").select(
        F.col("conv").alias("conv_id"), "depth", one.alias("n_convs"), F.when(more, one).otherwise(none).alias(
            "n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), "parent",
        F.when(more, EMPTY_SHA).otherwise(sha_of_id(F.col("conv"))).alias("ends_sha256"),
        (F.col("parent_shared") & (F.col("depth") > 1)).alias("look"))
    up = groups.select((F.col("depth") + 1).alias("d"), F.col("digest").alias("x"), F.col("rep").alias("up"))
    found = shared.unionByName(tails.where("look"))
    found = found.join(up, (F.col("depth") == F.col("d")) & (F.col("parent") == F.col("x")), "left")
    # a parent that is not among the candidates is a singleton
    parent = F.when(F.col("depth") == 1, F.lit(root["conv_id"]).cast("long")).otherwise(F.coalesce("up", "conv_id"))
    found = found.unionByName(tails.where("NOT look").withColumn("up", F.lit(None).cast("long")),
                              allowMissingColumns=True)
    out = found.select("conv_id", "depth", parent.alias("parent_conv_id"), *columns[2:], "ends_sha256")
    values = {"conv_id": root["conv_id"], "depth": 0, "parent_conv_id": None, "n_convs": root["n_convs"],
              "n_children": alone + told["top"], "n_leaves": max(1, alone + told["leaf"]), "saved_tokens": told["told"]}
    # one row, if there is any conversation; its list of ids is that of the conversations without turns
    top = every.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(NOTHING).alias("nothing")).join(
        shas, F.col("nothing") == F.col("of"), "left").select(
        *[F.lit(v).cast("long").alias(c) for c, v in values.items()], F.coalesce("sha", F.lit(EMPTY_SHA)).alias(
            "ends_sha256"))
    return out.unionByName(top)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), block=20, heads=3)
