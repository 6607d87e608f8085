"""Toxicity by non-negative positive-unlabelled learning (operator 4).

The classifier learns from confirmed toxic documents and from unlabelled ones.
With the class prior, the risk of the clean class is what the unlabelled
documents have beyond their toxic share; where that estimate falls below zero,
it is clamped and its gradient reversed, so the model doesn't overfit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.storage import stored

from .common import record_batch, table, text_chunks

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class PuOptions:
    """``positives``, ``unlabelled``: documents to learn from, at most.  ``features``: words and beginnings of words, at most.

    ``prior``: the share of toxic documents; None estimates it from both samples.
    A feature is used where confirmed documents have it ``enrichment`` times as
    often as unlabelled ones, with a likelihood ratio of ``evidence`` at least.
    """

    positives: int = 4000
    unlabelled: int = 8000
    features: int = 4096
    enrichment: float = 3.0
    evidence: float = 20.0
    rounds: int = 400
    rate: float = 0.05
    decay: float = 1e-3
    threshold: float = 0.7
    prior: float | None = None


def features_of(text: str) -> set[str]:
    """The distinct words of a text, in lower case, and the beginnings that two or three of them share (with as many marks)."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for n in PREFIXES:
        for start, times in Counter([w[:n] for w in words if len(w) > n]).items():
            found.add(start + "-")
            if times > 1:
                found.add(start + "--")
                if times > 2:
                    found.add(start + "---")
    return found


def nn_pu_fit(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, options: PuOptions) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over binary features, by Adam on the non-negative risk.

    ``rows`` has each document's features; ``positive`` is True for confirmed
    ones, False for unlabelled ones.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    features = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    w = np.zeros(n_features + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, options.rounds + 1):
        z = np.clip(w[-1] + np.bincount(at, w[features], len(rows)), -40, 40)
        up = 1 / (1 + np.exp(-z))  # slope of log(1 + e^z), the loss as clean
        clean_u = np.logaddexp(0, z[~positive]).mean() if n_u else 0.0
        clean_p = prior * np.logaddexp(0, z[positive]).mean()
        g_clean = np.where(positive, -prior / n_p, 1 / n_u) * up
        g_toxic = np.where(positive, prior / n_p, 0.0) * (up - 1)
        g = g_toxic + g_clean if clean_u >= clean_p else -g_clean
        grad = np.append(np.bincount(features, g[at], n_features), g.sum())
        grad[:-1] += options.decay * w[:-1] * prior
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - options.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def cut_of(z: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The cut that tells best: recall of the confirmed less the clean documents above it, as estimated from the unlabelled."""
    order = np.unique(z)
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
    recall = 1 - np.searchsorted(np.sort(z[positive]), cuts) / max(positive.sum(), 1)
    above = 1 - np.searchsorted(np.sort(z[~positive]), cuts) / max((~positive).sum(), 1)
    gain = recall - np.maximum(0, above - prior * recall) / (1 - prior)
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


#: Words whose beginnings with a weight a process remembers; beyond it the store starts anew.
REMEMBERED = 200_000


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.words = {f for f in self.weights if not f.endswith("-")}
        self.starts = {f.rstrip("-") for f in self.weights if f.endswith("-")}
        self.begins: dict[str, tuple[str, ...]] = {}

    def _begins(self, word: str) -> tuple[str, ...]:
        if len(self.begins) >= REMEMBERED:
            self.begins.clear()
        self.begins[word] = made = tuple(word[:n] for n in PREFIXES if len(word) > n and word[:n] in self.starts)
        return made

    def known(self, text: str) -> list[str]:
        """The features of :func:`features_of` that have a weight, in order; of the beginnings only these are counted."""
        words = set(_WORD.findall(text.lower()))
        begins, times = self.begins, Counter()
        for word in words:
            found = begins.get(word)
            if found is None:
                found = self._begins(word)
            if found:
                times.update(found)
        marked = (start + "-" * n for start, most in times.items() for n in range(1, min(most, 3) + 1))
        return sorted([*(words & self.words), *(f for f in marked if f in self.weights)])

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.array([self.bias + sum(map(self.weights.__getitem__, self.known(t))) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, toxic: DataFrame, unlabelled: DataFrame, options: PuOptions) -> ToxicityModel:
    """Learn from the documents of ``toxic(doc_id)`` and of ``unlabelled(doc_id)``.

    At most so many of either as the options say, drawn by a hash of the id; a
    document may be in both samples, as the unlabelled ones stand for all.
    No label of a clean document is used.  Without confirmed documents no text
    is called toxic.
    """
    by = F.xxhash64("doc_id"), F.col("doc_id")
    toxic = toxic.where("doc_id is not null").distinct().orderBy(*by).limit(options.positives).withColumn("positive", F.lit(1))
    other = unlabelled.where("doc_id is not null").distinct().orderBy(*by).limit(options.unlabelled).withColumn("positive", F.lit(0))
    drawn = toxic.union(other)
    schema = pa.schema([("doc_id", pa.int64()), ("positive", pa.int32()), ("features", pa.list_(pa.string()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            yield record_batch(schema, batch.column(0), batch.column(1), [sorted(features_of(t.decode())) for t in texts])

    # at most ``positives`` and ``unlabelled`` rows, so the ids are broadcast
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "positive", "text")
    sample = stored(texts.mapInArrow(extract, "doc_id long, positive int, features array<string>"), "pu-sample")
    n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if not n.get(1) or not n.get(0):
        return ToxicityModel({}, -8.0)
    p, u = (F.sum((F.col("positive") == flag).cast("long")) / n[flag] for flag in (1, 0))
    share = sample.select("positive", F.explode("features").alias("f")).groupBy("f").agg(p.alias("p"), u.alias("u"), F.sum("positive").alias("n_p"))
    share = stored(share, "pu-share")
    prior = options.prior or estimated_prior(share, n[1], n[0])
    gain = 2 * F.col("n_p") * F.log(F.col("p") / (F.col("u") + 0.5 / n[0]))
    share = share.where((F.col("n_p") >= 2) & (F.col("p") >= options.enrichment * F.col("u")) & (gain >= options.evidence))
    names = sorted(r["f"] for r in share.orderBy(F.desc(gain), "f").limit(options.features).collect())
    index = {f: i for i, f in enumerate(names)}
    got = sorted(_restricted(sample, index).collect(), key=lambda r: (r["doc_id"], r["positive"]))
    rows = [np.array([index[f] for f in r["features"]], np.int64) for r in got]
    positive = np.array([r["positive"] == 1 for r in got])
    weights, bias = nn_pu_fit(rows, positive, len(names), prior, options)
    z = bias + np.array([weights[r].sum() for r in rows])
    shift = cut_of(z, positive, prior) - float(np.log(options.threshold / (1 - options.threshold)))
    return ToxicityModel(dict(zip(names, weights.tolist())), bias - shift)


def estimated_prior(share: DataFrame, n_p: int, n_u: int) -> float:
    """The share of toxic documents among the unlabelled.

    A feature that the share p of the confirmed and u of the unlabelled have
    bounds it by u / p, as toxic documents alone account for prior * p of the
    unlabelled.  The least bound counts, each taken one standard error high, of
    features that a tenth of the confirmed have.
    """
    u = F.col("u") + F.sqrt((F.col("u") * (1 - F.col("u")) + 1 / n_u) / n_u)
    p = F.col("p") - F.sqrt(F.col("p") * (1 - F.col("p")) / n_p)
    least = share.where("p >= 0.1 and n_p >= 5").agg(F.min(u / p)).first()[0]
    return 0.1 if least is None else min(max(least, 0.01), 0.9)


def _restricted(sample: DataFrame, index: dict[str, int]) -> DataFrame:
    known = sample.sparkSession.sparkContext.broadcast(frozenset(index))
    schema = pa.schema([("doc_id", pa.int64()), ("positive", pa.int32()), ("features", pa.list_(pa.string()))])

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(schema, batch.column(0), batch.column(1), [[f for f in row if f in known.value] for row in batch.column(2).to_pylist()])

    return sample.mapInArrow(restrict, "doc_id long, positive int, features array<string>")


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row of ``docs``: 0 to 1, higher where toxicity is likelier; the whole text counts.

    Null and empty texts have no features and get the score of the bias; a null
    id stays null.  Of a text of any length only its different words are held.  Repeated
    rows are scored row by row; an empty table gives no rows; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            yield record_batch(schema, batch.column(0).cast(pa.int64()), shared.value.scores([t.decode() for t in texts]))

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(score, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learnt from what is not held out; nulls and odd rows as in :func:`toxicity_scores`."""
    options = PuOptions()
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    confirmed = labels.where(~held_out & (F.col("toxic") == 1)).select(F.col("doc_id").cast("long").alias("doc_id"))
    model = train(docs, confirmed, docs.where(~held_out).select(F.col("doc_id").cast("long").alias("doc_id")), options)
    scored = toxicity_scores(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= options.threshold).cast("int").alias("predicted"))
