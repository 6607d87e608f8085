"""Quality by attention-based multiple-instance learning (operator 1).

A document is a bag of passages.  Each passage is encoded; gated attention,
learnt from labels of whole documents alone, weighs the encodings, and the
weighted sum is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, table, text_chunks
from .spans import Spans, U, mix, repeated


@dataclass(frozen=True)
class MilOptions:
    """``sample``: labelled documents of each label to learn from, at most; all passages of each count.  ``threshold``: the score that decides best."""

    sample: int = 3000
    passage_words: int = 64
    hidden: int = 24
    gate: int = 12
    rounds: int = 60
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    threshold: float = 0.3


_KINDS = 14
_BAG = 24


def _kinds() -> np.ndarray:
    """The kind of each byte."""
    kind = np.full(256, 12)
    for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!", b"?", b"#*$%&", b"|<>", b"'\"()[]{}-", b" \t", b"\n\r")):
        kind[list(chars)] = i
    kind[128:] = 13
    return kind


_KIND = _kinds()
WIDTH = _KINDS + 9 + _BAG


def passage_features(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage of each text, and the text of each row; a text without words is one empty passage."""
    s = Spans.of(texts)
    n_passages = np.maximum(1, -(-s.n_words // words))
    first_passage = np.cumsum(n_passages) - n_passages
    first_word = np.cumsum(s.n_words) - s.n_words
    doc = np.repeat(np.arange(len(texts)), n_passages)
    out = np.zeros((len(doc), WIDTH), np.float32)
    if not len(s.start):
        return out, doc
    of = first_passage[s.doc] + (np.arange(len(s.doc)) - first_word[s.doc]) // words
    n = np.bincount(of, minlength=len(doc))
    some = np.maximum(n, 1)
    full = np.flatnonzero(n)
    begin = np.full(len(doc), 0)
    stop = np.full(len(doc), 0)
    starts = np.searchsorted(of, full)
    begin[full], stop[full] = s.start[starts], s.end[starts + n[full] - 1]
    kind = _KIND[s.buffer]
    size = np.maximum(stop - begin, 1)
    for k in range(_KINDS):
        sums = np.append(0, np.cumsum(kind == k))
        out[:, k] = (sums[stop] - sums[begin]) / size
    hashes = s.word_hashes()
    total = lambda v: np.bincount(of, v, len(doc))
    length = (s.end - s.start).astype(float)
    mean = total(length) / some
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (s.doc[1:] == s.doc[:-1]))
    salt = mix(np.arange(len(doc), dtype=np.uint64) + U(11))
    texts_salt = mix(np.arange(len(texts), dtype=np.uint64) + U(13))
    at, grams = s.windows(hashes, 4)
    again = np.zeros(len(hashes), bool)
    again[at[repeated(mix(grams ^ texts_salt[s.doc[at]]))[0]]] = True
    extra = [
        np.log1p(n), mean, np.sqrt(np.maximum(total(length**2) / some - mean**2, 0)), total(same) / some,
        total(repeated(mix(hashes ^ salt[of]))[1]) / some, total(again) / some, total(length == 1) / some,
        total((_KIND[s.buffer[s.end - 1]] > 2) & (_KIND[s.buffer[s.end - 1]] < 13)) / some, total(_KIND[s.buffer[s.start]] == 1) / some,
    ]
    out[:, _KINDS : _KINDS + 9] = np.stack(extra, 1)
    slot = (hashes >> U(40)) % U(_BAG)
    out[:, _KINDS + 9 :] = np.bincount(of * _BAG + slot.astype(np.int64), minlength=len(doc) * _BAG).reshape(-1, _BAG) / some[:, None]
    return out, doc


class MilModel:
    """Gated attention over encoded passages; numpy, with hand-written gradients."""

    def __init__(self, width: int, options: MilOptions, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h, g = options.hidden, options.gate
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"W": draw(width, h), "b": np.zeros(h), "V": draw(h, g), "U": draw(h, g), "w": draw(g, 1)[:, 0], "c": draw(h, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale, self.shift = np.zeros(width), np.ones(width), 0.0

    def _forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        return h, t, s, a, z, z @ p["c"] + p["d"][0]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        return self._forward(self.standard(x), bag, n)[-1] - self.shift

    def scores(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x, bag, n), -40, 40)))

    def _gradients(self, x: np.ndarray, bag: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, s, a, z, out = self._forward(x, bag, n)
        d_out = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y) * weight / n
        d_z = d_out[:, None] * p["c"]
        d_h = a[:, None] * d_z[bag]
        d_a = (d_z[bag] * h).sum(1)
        d_e = a * (d_a - np.bincount(bag, a * d_a, n)[bag])
        d_t, d_s = d_e[:, None] * p["w"] * s * (1 - t**2), d_e[:, None] * p["w"] * t * s * (1 - s)
        d_h += d_t @ p["V"].T + d_s @ p["U"].T
        d_x = d_h * (1 - h**2)
        return {"W": x.T @ d_x, "b": d_x.sum(0), "V": h.T @ d_t, "U": h.T @ d_s, "w": (t * s).T @ d_e, "c": z.T @ d_out, "d": np.array([d_out.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, options: MilOptions) -> MilModel:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        bags = [self.standard(b) for b in bags]
        rng = np.random.default_rng(6)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(options.rounds):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), options.batch):
                one = order[i : i + options.batch]
                bag = np.repeat(np.arange(len(one)), [len(bags[j]) for j in one])
                grads = self._gradients(np.concatenate([bags[j] for j in one]), bag, len(one), y[one], weight[one])
                step += 1
                for k, g in grads.items():
                    g = g + options.decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g**2
                    self.p[k] -= options.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The middle of the cuts with the best mean of both labels' shares of right answers."""
    order = np.sort(logit)
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
    up = np.searchsorted(np.sort(logit[y == 1]), cuts)
    down = np.searchsorted(np.sort(logit[y == 0]), cuts)
    right = (1 - up / max((y == 1).sum(), 1)) + down / max((y == 0).sum(), 1)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(cuts[best].mean())


def train(docs: DataFrame, labels: DataFrame, options: MilOptions) -> MilModel:
    """Learn from at most ``sample`` documents of each label, drawn by a hash of the id; a fifth of them sets the threshold.

    ``labels`` has ``doc_id`` and ``label`` (0 or 1).  Without both labels every
    score is that of the one label there is, or a half.
    """
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = None
    for label in (0, 1):
        one = labels.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.sample)
        drawn = one if drawn is None else drawn.union(one)
    schema = pa.schema([("label", pa.int32()), ("check", pa.int32()), ("x", pa.binary())])
    words = options.passage_words

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            x, doc = passage_features(texts, words)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield record_batch(schema, batch.column(0), batch.column(1), [x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])

    # at most twice ``sample`` rows, so the ids are broadcast
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    rows = texts.select(F.col("label").cast("int"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0).cast("int").alias("check"), "text")
    got = rows.mapInArrow(encode, "label int, check int, x binary").toArrow()
    y, check = got.column("label").to_numpy(), got.column("check").to_numpy() == 1
    model = MilModel(WIDTH, options)
    if len(set(y.tolist())) < 2:
        model.p["c"][:] = 0
        model.shift = -(8.0 if y.any() else -8.0) if len(y) else 0.0
        return model
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(np.float64) for x in got.column("x").to_pylist()]
    if len(set(y[check].tolist())) < 2 or len(set(y[~check].tolist())) < 2:
        check = np.zeros(len(y), bool)
    learn = np.flatnonzero(~check)
    order = np.array(sorted(learn.tolist(), key=lambda i: (len(bags[i]), bags[i].tobytes())))  # rows arrive in any order
    model.fit([bags[i] for i in order], y[order].astype(float), options)
    held = np.flatnonzero(check) if check.any() else learn
    bag = np.repeat(np.arange(len(held)), [len(bags[i]) for i in held])
    cut = best_cut(model.logits(np.concatenate([bags[i] for i in held]), bag, len(held)), y[held])
    model.shift = cut - float(np.log(options.threshold / (1 - options.threshold)))
    return model


def quality_scores(docs: DataFrame, model: MilModel, options: MilOptions, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row of ``docs``: 0 to 1, higher for label 1; the whole text counts.

    Null and empty texts are one empty passage and get that passage's score; a null
    id stays null.  Texts of any length are read in passages, with memory for one text
    and its passages.  Repeated rows are scored row by row; an empty table gives no rows;
    other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    words = options.passage_words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            x, doc = passage_features(texts, words)
            yield record_batch(schema, batch.column(0).cast(pa.int64()), shared.value.scores(x, doc, len(texts)))

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(score, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learnt from the labels that are not held out; nulls and odd rows as in :func:`quality_scores`."""
    options = MilOptions()
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs, labels.where(~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")), options)
    scored = quality_scores(docs, model, options)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= options.threshold).cast("int").alias("predicted"))
