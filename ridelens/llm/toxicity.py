"""Toxicity: cumulative-link (proportional odds) ordinal regression over sparse text features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector is shared by all ordered thresholds. The output is the
expected severity, the sum over k >= 1 of P(grade >= k).

Features of a text: its lower-cased words and their beginnings of four and five letters, over whole texts, valued at
log(1 + occurrences per hundred words). Only features whose share among graded and clean documents differs clearly (a
z score over ``MIN_Z``, in at least ``MIN_DOCS`` documents) enter the model, at most ``max_features`` of them, so that
the thousands of other words of a long document add no noise. They are scaled by their z, so the penalty holds weakly
supported ones closer to zero.

Grades: a ``severity`` column of the labels (0 = clean) if there is one. Otherwise clean labels are grade 0 and toxic
ones 1 to 3, by the third in which their density of features that tell toxic from clean texts lies.

The model is fitted on at most ``max_labels`` labelled documents, chosen by a hash of the id (a documented bound);
feature statistics of that sample are counted in Spark and only the chosen features and the sample's sparse rows
(bounded by both parameters) come to the driver. Scoring covers every document and needs no shuffle.

Defined results: a null or blank text has no features and gets the severity of the bare thresholds; labels without
document, null labels and all but one of a document's repeated labels (the largest counts) are ignored; if the sample
lacks clean or toxic documents, nothing can be learnt and every severity is 0; repeated documents each get a row;
other columns pass through unchanged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import documents, materialize, own_row, table, unpacked

MAX_LABELS = 8_000
MAX_FEATURES = 20_000
MIN_DOCS, MIN_Z = 5, 4.0
REJECT_FROM = 0.5
WORDS = re.compile(r"[^\W\d_]+")
CACHED_WORDS, CACHED_CHARS = 100_000, 40
TEXTS_AT_ONCE = 500


def value_of(counts, n_words):
    """Feature value of a count in a text of ``n_words`` words (smoothed, so that short texts are not all density)."""
    return np.log1p(100.0 * counts / (n_words + 50.0))


def keys_of(word: str) -> list[str]:
    """The features a word counts for: itself and its beginnings."""
    return [word, *(f"{n}:{word[:n]}" for n in (4, 5) if len(word) > n)]


def _sample_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, grade, text in zip(pdf["id"], pdf["grade"], pdf["text"].array, strict=True):
            words = Counter(WORDS.findall(text.lower())) if isinstance(text, str) else Counter()
            counts: Counter = Counter()
            for w, n in words.items():
                for k in keys_of(w):
                    counts[k] += n
            rows.append((int(i), int(grade), sum(words.values()), list(counts), list(counts.values())))
        yield pd.DataFrame(rows, columns=["id", "grade", "n_words", "keys", "counts"])


@dataclass
class OrdinalModel:
    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray  # increasing; empty if there was nothing to learn

    def severity(self, score: Column) -> Column:
        """Expected severity of a document from its score w . x."""
        out = F.lit(0.0)
        for t in self.thresholds.tolist():
            out = out + 1.0 / (1.0 + F.exp(F.lit(t) - score))
        return F.round(out, 6)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
                        l2: float = 1e-5, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with an L2 penalty (Adam, full batch); returns (weights, increasing thresholds)."""
    n, k = len(grades), int(grades.max())
    shares = np.array([(grades <= j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    start = np.log(shares / (1 - shares))
    # thresholds: the first, then the logarithms of the gaps
    p = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1:])
        t = np.concatenate([[-np.inf], p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(rows, values * w[cols], n)
        hi, lo = _sigmoid(t[grades + 1] - score), _sigmoid(t[grades] - score)
        hi[grades == k], lo[grades == 0] = 1.0, 0.0
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob  # of the log-likelihood by the two thresholds
        g_score = (d_hi - d_lo) / n  # of the loss by the score
        g_t = np.zeros(k + 2)
        np.add.at(g_t, grades + 1, -d_hi / n)
        np.add.at(g_t, grades, d_lo / n)
        g_t = g_t[1:-1]
        tail = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, values * g_score[rows], n_features) + l2 * w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1:]))])
    return p[:n_features], t


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_features: int = MAX_FEATURES,
                 seed: int = 1) -> OrdinalModel:
    label = "severity" if "severity" in labels.columns else "toxic"
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("grade")).dropna()
    known = known.groupBy("id").agg(F.max("grade").alias("grade"))
    known = materialize(known.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_labels), "tox-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # at most max_labels ids: a bounded broadcast; of rows that repeat an id, the one with the smallest text hash
    sample = texts.join(F.broadcast(known), "id").groupBy("id", "grade").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("id", "text", "grade").mapInPandas(
        _sample_features, "id long, grade int, n_words long, keys array<string>, counts array<int>")
    sample = materialize(sample, "tox-sample")
    pos, n = sample.agg(F.count_if(F.col("grade") > 0), F.count("*")).first()
    neg = n - pos
    if not pos or not neg:
        return OrdinalModel([], np.zeros(0), np.zeros(0))
    stats = sample.select(F.explode("keys").alias("key"), (F.col("grade") > 0).cast("int").alias("t"))
    stats = stats.groupBy("key").agg(F.sum("t").alias("p"), F.count("*").alias("c"))
    share = F.col("c") / n
    z = (F.col("p") / pos - (F.col("c") - F.col("p")) / neg) / F.sqrt(
        F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / pos + 1 / neg))
    chosen = stats.where(F.col("c") >= MIN_DOCS).withColumn("z", z).where(F.abs("z") >= MIN_Z)
    chosen = chosen.orderBy(F.abs("z").desc(), "key").limit(max_features).select("key", "z").collect()
    place = {r["key"]: (k, r["z"]) for k, r in enumerate(chosen)}

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, g, words, keys, counts in pdf.itertuples(index=False):
                own = [(place[k][0], int(c)) for k, c in zip(keys, counts, strict=True) if k in place]
                rows.append((i, g, words, [k for k, _ in own], [c for _, c in own]))
            yield pd.DataFrame(rows, columns=["id", "grade", "n_words", "cols", "counts"])

    got = sample.mapInPandas(sparse, "id long, grade int, n_words long, cols array<int>, counts array<int>").collect()
    got.sort(key=lambda r: (r["id"], r["n_words"]))
    sizes = np.array([len(r["cols"]) for r in got])
    rows = np.repeat(np.arange(len(got)), sizes)
    cols = np.array([c for r in got for c in r["cols"]], np.int64)
    counts = np.array([c for r in got for c in r["counts"]], float)
    grades = np.array([r["grade"] for r in got])
    z = np.array([v[1] for v in place.values()])
    scale = np.abs(z) / np.abs(z).max(initial=1e-9)
    n_words = np.array([r["n_words"] for r in got], float)
    if label == "toxic":
        density = np.bincount(rows, counts * (z > 0)[cols] * scale[cols], len(got)) / (n_words + 50)
        edges = np.quantile(density[grades > 0], [1 / 3, 2 / 3])
        grades = np.where(grades > 0, 1 + np.searchsorted(edges, density, "right"), 0)
    values = value_of(counts, n_words[rows]) * scale[cols]
    weights, thresholds = fit_cumulative_link(rows, cols, values, grades, len(place))
    return OrdinalModel(list(place), weights * scale, thresholds)


def score_udf(model: OrdinalModel):
    """Arrow UDF text -> w . x; only ``TEXTS_AT_ONCE`` texts of a batch are Python objects at a time."""
    weight = dict(enumerate(model.weights.tolist()))
    place = {k: i for i, k in enumerate(model.features)}

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, tuple[int, ...]] = {}

        def one(text: str | None) -> float:
            counts: dict[int, int] = {}
            words = WORDS.findall(text.lower()) if text else []
            for w, n in Counter(words).items():
                at = memo.get(w)
                if at is None:
                    at = tuple(place[k] for k in keys_of(w) if k in place)
                    if len(w) <= CACHED_CHARS:
                        if len(memo) >= CACHED_WORDS:
                            memo.clear()
                        memo[w] = at
                for k in at:
                    counts[k] = counts.get(k, 0) + n
            return sum(weight[k] * math.log1p(100.0 * c / (len(words) + 50.0)) for k, c in sorted(counts.items()))

        for texts in batches:
            out: list[float] = []
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                out += map(one, texts.slice(at, TEXTS_AT_ONCE).to_pylist())
            yield pa.array(out, pa.float64())

    return score


def with_severity(docs: DataFrame, model: OrdinalModel, out: str = "severity", text: Column | None = None) -> DataFrame:
    """``docs`` with the expected severity of each row's text."""
    if not model.features:
        return docs.withColumn(out, F.lit(0.0))
    text = F.col("text") if text is None else text
    return docs.withColumn(out, model.severity(score_udf(model)(text.cast("string"))))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    out = with_severity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "severity", F.round("severity").cast("int").alias("grade"),
                      (F.col("severity") >= REJECT_FROM).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject_from: float = REJECT_FROM) -> DataFrame:
    """The documents whose expected severity is below ``reject_from``, all columns unchanged."""
    rows = docs.select(own_row(docs).alias("row"))
    scored = with_severity(rows, fit_toxicity(docs, labels), text=F.col("row").getField("text"))
    return unpacked(scored.where(F.col("severity") < reject_from).select("row"))
