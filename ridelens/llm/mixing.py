"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Targets: a source's share of the budget is its weight's, at most ``max_repeats`` times its size; what a capped source
leaves is shared again by weight until none is above its cap (water-filling, solved in one pass over the sources).

Queue: the documents of a source are shuffled by a hash of their id and queued ``max_repeats`` times over. A copy's
virtual finish time is the source's words up to and with it, divided by the source's target: sources advance at rates
in proportion to their targets. The copies of all sources are range-sorted by finish time and the stream is cut at the
total budget; of each source, the copy in service at the cut counts with the words served by then.

No source is ever sorted or summed in one task: words before a document are the sum of the hash ranges before its own
(one row per source and range, summed in blocks) plus a running sum in its range; the position in the mixed stream comes
from ranges of virtual time in the same way. A range that one id crowds (null ids are one id) is parted by the texts'
hashes, and very many equal rows by a salt, which changes nothing as equal rows are interchangeable.

Defined results: a null or blank text has size 0, takes 0 and is not queued; a null source is a source of its own, last;
a null id is an id (all null ids hash alike, their texts' hashes break the tie); repeated rows are queued each; reruns agree;
other columns are ignored; an empty table gives an empty one. The source table (one row per source) is ordered in one
task; it is an aggregate, not rows of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import (
    ID,
    WORD,
    crowded,
    documents,
    id_keys,
    materialize,
    own_row,
    row_hash,
    sums_before,
    text_key,
    top_bits,
    unpacked,
)

ROWS_PER_RANGE = 2_000
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
COPIES_AT_ONCE = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, n) of each source in ``sizes`` (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1))
    per = per.withColumn("cap", F.col("source_size") * max_repeats)
    # sources reach their caps in the order of cap / weight; the level is set by the first that does not (of tied ones
    # the first in this order: what is left for a later one lacks caps that are not reached)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    left = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
    per = per.select("*", left.alias("left"), F.sum("w").over(rest).alias("w_left"),
                     F.row_number().over(order).alias("place"))
    open_ = F.col("cap") * F.col("w_left") >= F.col("left") * F.col("w")
    per = per.withColumn("level", F.min(F.when(open_, F.struct("place", "left", "w_left"))).over(Window.partitionBy()))
    share = F.col("level.left") * F.col("w") / F.col("level.w_left")
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"), "n")


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text_key, source, size, salt, ...) of every row, written; the salt only parts equal rows."""
    return materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")),
        F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"), *more), "mix-sizes")


RANGE = ["range", "sub", "copy"]


def queue_documents(sizes: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """Adds source_size, target and ``upto``: words of the source's shuffled queue up to and with the document.

    The queue is in the order of (range, sub, copy, h, doc_id, text_key, ...): ``range`` is of the id's hash h, ``sub`` of
    the text's hash in ranges that one id or a few crowd, ``copy`` of the salt among equal rows that are very many.
    """
    rows = sizes.count()
    bits = max(0, math.ceil(math.log2(max(1, rows / ROWS_PER_RANGE))))
    ties = [c for c in sizes.columns if c not in ("source", "salt", "size")]
    word = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))
    queue = sizes.withColumn("h", F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long"))  # 60 bits
    queue = queue.withColumn("range", F.shiftright("h", 60 - bits))
    queue = top_bits(queue, crowded(queue, ["source", "range"], ROWS_PER_RANGE, "mix-crowded"), ["source", "range"],
                     "text_key", "sub")
    equal = ["source", *ties]
    queue = top_bits(queue, crowded(sizes, equal, ROWS_PER_RANGE, "mix-copies"), equal, "salt", "copy")
    parts = queue.groupBy("source", *RANGE).agg(F.sum("size").alias("part"))
    starts = sums_before(parts, ["source"], RANGE, "part", block=F.shiftright("range", 12))
    starts = starts.select(*[F.col(c).alias(f"{c}_") for c in ("source", *RANGE)], "first")
    own = Window.partitionBy("source", *RANGE).orderBy("h", *ties, "size").rowsBetween(Window.unboundedPreceding, 0)
    run = queue.withColumn("own", F.sum("size").over(own))
    t = targets.select(F.col("source").alias("t"), "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("source_"))
    for c in RANGE:
        same = same & (F.col(c) == F.col(f"{c}_"))
    run = run.join(starts, same).join(t, F.col("source").eqNullSafe(F.col("t")))
    return run.select(*sizes.columns, "source_size", "target", (F.col("first") + F.col("own")).alias("upto"))


def mixed_stream(queue: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed stream: (row of ``queue``, pass, finish, words): copies by virtual finish time, cut at the budget.

    ``words`` is what the mix takes of the copy; it is less than the size only for the copies in service at the cut.
    """
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("pass")
    copies = queue.where("size > 0").select("*", passes)
    end = F.col("pass") * F.col("source_size") + F.col("upto")
    served = F.least(F.col("size"), F.round("target").cast("long") - (end - F.col("size")))
    copies = copies.withColumn("finish", end / F.col("target")).withColumn("words", served).where("words > 0")
    # range sort; the words before a range of virtual time are summed range by range
    budget = queue.agg(F.sum("size").alias("b"))
    sorted_ = copies.repartitionByRange(F.col("finish"), F.col("source"), F.col("upto")).sortWithinPartitions(
        "finish", "source", "upto", "pass")
    placed = materialize(sorted_.withColumn("at", F.spark_partition_id()), "mix-stream")
    parts = placed.groupBy("at").agg(F.sum("words").alias("part"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("at", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("at").orderBy("finish", "source", "upto", "pass").rowsBetween(
        Window.unboundedPreceding, -1)
    spot = placed.withColumn("own", F.coalesce(F.sum("words").over(own), F.lit(0))).join(starts, "at")
    spot = spot.withColumn("position", F.col("first") + F.col("own"))
    # targets add up to the budget but for the rounding of each, so at most a few words are cut here
    left = budget.scalar() - F.col("position")
    return spot.withColumn("words", F.least(F.col("words"), left)).where("words > 0").drop("at", "own", "first")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: ``docs`` (doc_id, text, source, n_chars, ...) with a row per copy taken.

    A copy that is cut has its first words only, joined by one space, and its own n_chars. Rows are told apart by all their columns;
    rows equal in all of them share their copies.
    """
    sizes = sized(docs, row_hash(docs).alias("row_key"))
    targets = materialize(source_targets(sizes, weights, max_repeats), "mix-targets")
    queue = materialize(queue_documents(sizes, targets), "mix-queue")
    keys = [*ID, "row_key"]
    copies = mixed_stream(queue, max_repeats).groupBy(*id_keys(F.col("doc_id")), "row_key", "words", "size").agg(
        F.count("*").alias("n"))
    # one text of equal rows; a text is shuffled once, as the join is on the same keys
    rows = docs.select(*id_keys(F.col("doc_id")), row_hash(docs).alias("row_key"), own_row(docs).alias("row"))
    rows = rows.groupBy(*keys).agg(F.first("row").alias("row")).join(materialize(copies, "mix-copies"), keys)
    at_once = F.lit(COPIES_AT_ONCE)
    rows = rows.withColumn("rest", F.explode(F.sequence(F.col("n"), F.lit(1).cast("long"), -at_once)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("rest", at_once))))
    text = F.col("row").getField("text")
    whole = F.col("words") == F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")),
                       " ")
    rows = rows.withColumn("taken", F.when(whole, text).otherwise(cut))
    out = {"text": F.col("taken")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(whole, F.col("row").getField("n_chars")).otherwise(
            F.length("taken").cast(docs.schema["n_chars"].dataType))
    return unpacked(rows, **out)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row of ``docs`` (doc_id, text, source)."""
    sizes = sized(docs)
    targets = materialize(source_targets(sizes, weights, max_repeats), "mix-targets")
    queue = materialize(queue_documents(sizes, targets), "mix-queue")
    keys = ["doc_id", "size", "source", "source_size", "target"]
    taken = mixed_stream(queue, max_repeats).groupBy(*keys, "upto").agg(F.sum("words").alias("taken"))
    rows = queue.select(*keys, "upto", F.lit(0).cast("long").alias("taken"))
    # a queued document is known by its source and place; rows of size 0 share a place, so they are kept apart
    whole = taken.select(*keys, "upto", "taken").union(rows.where("size > 0"))
    whole = whole.groupBy(*keys, "upto").agg(F.sum("taken").alias("taken"))
    return whole.drop("upto").union(rows.where("size = 0").drop("upto"))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source
), s1 AS (
  SELECT source, s, 3 * s AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s0
), s2 AS (
  SELECT *, CAST((SELECT sum(s) FROM s1) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest
  FROM s1
), level AS (
  SELECT rest, w_rest FROM s2 WHERE cap * w_rest >= rest * w ORDER BY cap / w, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, s, least(CAST(cap AS DOUBLE), level.rest * w / level.w_rest) AS target FROM s2, level
), q AS (
  SELECT doc_id, d.source, size, s, target,
    sum(size) OVER (PARTITION BY d.source
      ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':5'), 1, 15) AS BIGINT), doc_id, size
      ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(p * s + upto AS DOUBLE) / target AS finish,
    least(size, CAST(round(target) AS BIGINT) - (p * s + upto - size)) AS words
  FROM q, (SELECT unnest([0, 1, 2]) AS p) WHERE size > 0
), o AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY finish, source NULLS FIRST, upto, p
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM c WHERE words > 0
), k AS (
  SELECT doc_id, source, upto, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - place))) AS taken
  FROM o GROUP BY ALL
)
SELECT q.doc_id, q.size, q.s AS source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.source IS NOT DISTINCT FROM k.source
  AND q.upto = k.upto AND q.size > 0
"""
