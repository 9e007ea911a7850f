"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every benchmark item gives its windows of ``window`` consecutive words (a shorter item is one window). A window is
contained in a document only if all its words are, in order, so by the prefix-filter principle for containment 1 its
prefix is one token: the rarest. Words of the benchmark are counted over all documents, each window is indexed under
its rarest word, and documents meet windows only on those words. A meeting fixes where the window would start
(positional bound) and end (length bound); then its words are compared exactly with the document's at that place.

The windows of the benchmark are broadcast while their table stays under ``BROADCAST_ROWS`` rows and
``BROADCAST_BYTES`` bytes (both counted). Beyond that they are joined by shuffle: only words that are some window's
rarest go there, each with the at most ``2 * window - 1`` words around it, so the shuffle grows with the text and not
with the length of a document; a word that very many documents use is split by AQE. Items are joined to the hits by window, a
row per window and item. Documents are cut into words twice (count, match).

Defined results: null texts and texts without words have no words, no windows and are clean; repeated items count by
their ids (a null item id counts as no item but its windows still hit); repeated documents each get a row; a null
doc_id is an id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import ID, documents, id_keys, lower_ascii, materialize, own_row, table, text_key, unpacked

# What stands between words after lower-casing A-Z, and before
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64_000_000


def tokens(text: Column) -> Column:
    """The words, in order. (Splitting at a class of ASCII characters is several times faster than extracting runs
    of its complement; only the first and the last part can be empty.)"""
    parts = F.split(F.coalesce(lower_ascii(text), F.lit("")), BETWEEN)
    return F.array_remove(parts, "")


def n_tokens(text: Column) -> Column:
    """Number of words, without lower-casing them."""
    parts = F.split(F.coalesce(text, F.lit("")), BETWEEN_RAW)
    return (F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words): the windows of every item."""
    base = items.select(F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("w"))
    last = F.greatest(F.size("w") - window, F.lit(0))
    base = base.where(F.size("w") > 0).select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return base.select("item_id", F.slice("w", F.col("at") + 1, window).alias("words"))


def small_enough(df: DataFrame, size: Column) -> bool:
    """Whether ``df``, whose rows take about ``size`` bytes, may be broadcast."""
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size + 32), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def word_bytes(words: str) -> Column:
    return F.octet_length(F.array_join(words, " ")) + 16 * F.size(words)


def distinct_windows(items: DataFrame, window: int) -> DataFrame:
    """(win, words, item_id): a row per window and item; ``win`` names a window."""
    windows = item_windows(items, window).distinct()
    return materialize(windows.select(F.xxhash64("words").alias("win"), "words", "item_id"), "decon-windows")


def rarest_words(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(word, offset, words, win): the distinct windows under their word that is rarest in all documents."""
    spots = windows.select("win", "words").distinct().select("win", "words", F.posexplode("words").alias("offset", "word"))
    vocabulary = materialize(spots.select("word").distinct(), "decon-vocabulary")
    known = F.broadcast(vocabulary) if small_enough(vocabulary, F.octet_length("word")) else vocabulary
    counts = docs.select(F.explode("w").alias("word")).join(known, "word").groupBy("word").count()
    order = Window.partitionBy("win").orderBy(F.coalesce("count", F.lit(0)), "word", "offset")
    ranked = spots.join(counts, "word", "left").withColumn("rarity", F.row_number().over(order))
    # windows with a word that no document has cannot occur
    return materialize(ranked.where("rarity = 1 AND count > 0").select("word", "offset", "words", "win"), "decon-index")


def find_hits(docs: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, start, len, win): every occurrence of a window; ``docs``: doc_id, text_key, w."""
    start, size = F.col("pos") - F.col("offset"), F.size("words")
    out = ["doc_id", "text_key", start.alias("start"), size.alias("len"), "win"]
    words = docs.select("doc_id", "text_key", "w", F.posexplode("w").alias("pos", "word"))
    if small_enough(index, word_bytes("words")):
        met = words.join(F.broadcast(index), "word").where((start >= 0) & (start + size <= F.size("w")))
        return met.where(F.slice("w", start + 1, size) == F.col("words")).select(*out)
    rare = index.select("word").distinct()
    if small_enough(rare, F.octet_length("word")):
        words = words.join(F.broadcast(rare), "word", "left_semi")
    low = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    around = words.select("doc_id", "text_key", "pos", "word", low.alias("low"), F.size("w").alias("n"),
                          F.slice("w", low + 1, F.lit(2 * window - 1)).alias("around"))
    met = around.join(index, "word").where((start >= 0) & (start + size <= F.col("n")))
    return met.where(F.slice("around", start - F.col("low") + 1, size) == F.col("words")).select(*out)


def base_words(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")),
                       tokens(F.col("text").cast("string")).alias("w"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_words, n_hit, n_items, item_ids (sorted), contaminated."""
    base, windows = base_words(docs), distinct_windows(items, window)
    hits = materialize(find_hits(base, rarest_words(base, windows), window).distinct(), "decon-spots")
    key = [*id_keys(F.col("doc_id")), "text_key"]
    spans = hits.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"))
    # covered words: each span counts from where the spans before it end
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"))

    spans = spans.select(*ID, "text_key", F.aggregate("spans", zero, add)["n"].cast("long").alias("n_hit"))
    named = hits.select(*key, "win").distinct().join(windows.where("item_id IS NOT NULL").select("win", "item_id"), "win")
    named = named.groupBy(*ID, "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    found = materialize(spans.join(named, [*ID, "text_key"], "left"), "decon-hits")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *id_keys(F.col("doc_id")), text_key(F.col("text")),
                        n_tokens(F.col("text").cast("string")).alias("n_words"))
    out = every.join(found, [*ID, "text_key"], "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window of an item occurs, all columns unchanged."""
    base = base_words(docs)
    hits = find_hits(base, rarest_words(base, distinct_windows(items, window)), window)
    found = materialize(hits.select(*id_keys(F.col("doc_id")), "text_key").distinct(), "decon-found")
    rows = docs.select(*id_keys(F.col("doc_id")), text_key(F.col("text")), own_row(docs).alias("row"))
    return unpacked(rows.join(found, [*ID, "text_key"], "left_anti"))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM win
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
), hit AS (
  SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.s = win.s AND dw.k = win.k
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256,
  coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
