"""Choosing captures: top-k with pins, diverse top-k, targets, and what changed."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.operators.ordering import AT, PART, Ordered
from framewise.storage import Scratch, write_table


@dataclass(frozen=True)
class Target:
    """How many captures to choose: a count, a percentage, all or none."""

    kind: str
    value: float = 0.0

    @classmethod
    def parse(cls, text: str) -> Target:
        word = text.strip().lower()
        if word in ("", "none", "skip", "0", "0%"):
            return cls("none")
        if word == "all":
            return cls("all")
        if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*%", word):
            share = float(m[1])
            if share > 100:
                raise ValueError(f"a percentage is at most 100: {text!r}")
            return cls("percent", share) if share else cls("none")
        if re.fullmatch(r"\d+", word):
            return cls("count", int(word)) if int(word) else cls("none")
        raise ValueError(f"not a count, a percentage, all or none: {text!r}")

    def of(self, base: int) -> tuple[int, bool]:
        """The number of ``base`` captures to take, and whether a count was cut down to it."""
        if self.kind == "none" or base == 0:
            return 0, False
        if self.kind == "all":
            return base, False
        if self.kind == "percent":
            return min(base, max(1, math.floor(base * self.value / 100 + 0.5))), False
        return min(base, int(self.value)), self.value > base


def percent_target(base: Column, percent: Column) -> Column:
    return F.when(base == 0, 0).otherwise(F.least(base, F.greatest(F.lit(1), F.floor(base * percent / 100 + 0.5)))).cast("long")


def pool_of(ranked: DataFrame, mode: str = "bursts", feedback: str = "feedback_decision") -> DataFrame:
    """Winners of bursts and captures to keep, or all captures (``photos``); never rejected ones."""
    if mode not in ("bursts", "photos"):
        raise ValueError(f"unknown mode {mode!r}")
    decision = F.coalesce(feedback, F.lit(""))
    there = F.lit(True) if mode == "photos" else F.col("burst_winner") | (decision == "keep")
    return ranked.where(there & (decision != "reject"))


def select_top(pool: DataFrame, count: int, pinned: Column | None = None) -> DataFrame:
    """The pinned captures and the best others, ``count`` or as many as are pinned; ``portfolio_selection_order`` is by score.

    One sort of ``pool``, which should have no more columns than are wanted.
    """
    pinned = F.lit(False) if pinned is None else F.coalesce(pinned, F.lit(False))
    ordered = Ordered(pool.withColumn("_pin", pinned.cast("int")), F.desc("composite_score"), "path_key", name="top", sums={"_pins": F.col("_pin")})
    left = max(0, count - (ordered.rows.agg(F.sum("_pin")).first()[0] or 0))
    placed = ordered.placed("_others").withColumn("_others", F.col("_others") - F.col("_pins"))
    chosen = placed.where((F.col("_pin") == 1) | (F.col("_others") <= left))
    order = F.col("_pins") + F.least("_others", F.lit(left))
    return chosen.withColumn("portfolio_selection_order", order).drop("_pin", "_pins", "_others", PART, AT)


#: Candidates that come to the driver at once in :func:`select_diverse`, and how many times as many candidates each further layer has.
BUFFER, GROWTH = 1024, 8


def _layers(rest: DataFrame, n: int, first: int) -> list[float]:
    """Falling qualities that cut candidates into layers, the first of about ``first`` rows, each next one ``GROWTH`` times as large; the last is below all."""
    shares, size = [], first
    while size < n:
        shares.append(1 - size / n)
        size *= GROWTH
    found = rest.approxQuantile("q", shares, 0.001) if shares else []
    return [*sorted(set(found), reverse=True), -math.inf]


def select_diverse(pool: DataFrame, count: int, diversity: float, pinned: Column | None = None, buffer: int = BUFFER, seen: dict[str, int] | None = None) -> DataFrame:
    """``path_key, pick``: captures in the order of maximal marginal relevance; pins come first, unordered among themselves.

    Each pick has the largest ``(1 - d) quality - d similarity``; the quality
    is scaled to 0..1, the similarity is the largest ``(cos + 1) / 2`` to a
    pick; ties go to the quality, then the path.  A capture without an embedding
    is at right angles to all, as are two embeddings of different lengths.

    Values only fall as picks are made.  So candidates lie in layers of falling
    quality, and a layer is read when what its best could still be worth is in
    reach of the best of the layers above; its similarity to all picks so far is
    made then.  Within the layers in reach the best ``buffer`` candidates of a pass are enough until the
    last of them could be beaten by one that did not come; each pass folds its picks
    into the stored similarity.  The driver holds ``buffer`` vectors at a time,
    whatever number is pinned or picked.  ``seen`` gets the number of candidates, and of rows
    that the passes have read.
    """
    if not 0 <= diversity <= 1:
        raise ValueError("diversity is from 0 to 1")
    spark, d, scratch = pool.sparkSession, float(diversity), Scratch()
    pin = F.lit(False) if pinned is None else F.coalesce(pinned, F.lit(False))
    low, high = pool.agg(F.min("composite_score"), F.max("composite_score")).first()
    span = 0.0 if low is None else high - low
    quality = (F.col("composite_score") - F.lit(low)) / F.lit(span) if span else F.lit(1.0)
    rows = pool.select("path_key", quality.alias("q"), F.col("embedding").cast("array<double>").alias("v"), pin.alias("pin"))
    candidates = rows.where("not pin").select("path_key", "q", "v")
    if d < 1 and count and d > 0:  # at every pick one of the first ``count`` by quality is still there
        cut = candidates.orderBy(F.desc("q")).limit(count).agg(F.min("q")).first()[0]
        candidates = candidates.where(F.col("q") >= (cut or 0.0) - d / (1 - d) - 1e-9)
    candidates = scratch.put(candidates, "candidates")
    n_candidates = candidates.count()
    schema = "path_key string, q double, v array<double>, near double"

    def matrices(vectors: list[list[float] | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length: positions and unit rows; a null vector is one of length 0."""
        sizes = np.array([0 if v is None else len(v) for v in vectors], int)
        out = []
        for width in np.unique(sizes):
            at = np.flatnonzero(sizes == width)
            m = np.array([vectors[i] or [] for i in at], float).reshape(len(at), width)
            out.append((at, m / np.where((size := np.linalg.norm(m, axis=1)) > 0, size, 1.0)[:, None]))
        return out

    def nearest(vectors: list[list[float] | None], picked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The largest similarity of each vector to those ``picked``."""
        out = np.full(len(vectors), 0.5)
        for at, m in matrices(vectors):
            same = next((p for _, p in picked if p.shape[1] == m.shape[1]), None)
            n_same = 0 if same is None else len(same)
            best = np.full(len(at), 0.5 if sum(len(p) for _, p in picked) > n_same else -np.inf)
            if n_same:
                best = np.maximum(best, ((m @ same.T + 1) / 2).max(1))
            out[at] = best
        return out

    def folded(rest: DataFrame, keys: list[str], vectors: list[list[float] | None]) -> DataFrame:
        """The candidates without ``keys``, with their largest similarity to these vectors too."""
        shared = spark.sparkContext.broadcast((set(keys), matrices(vectors)))

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            taken, picked = shared.value
            for batch in batches:
                batch = batch.filter(pa.array([p not in taken for p in batch.column(0).to_pylist()], pa.bool_()))
                if batch.num_rows:
                    near = nearest(batch.column(2).to_pylist(), picked)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.maximum(batch.column(3).to_numpy(), near))], names=batch.schema.names)

        return rest.mapInArrow(fold, schema)

    def kept(rest: DataFrame, name: str) -> DataFrame:
        out = scratch.put(rest, "next")
        if name in scratch.paths:
            scratch.drop(name)
        scratch.paths[name] = scratch.paths.pop("next")
        return out

    shape, done, n = "path_key string, pick long, v array<double>", [], 0

    def told(keys: list[str], vectors: list[list[float] | None]) -> None:
        nonlocal n
        done.append(write_table(spark.createDataFrame([(k, n + i, v) for i, (k, v) in enumerate(zip(keys, vectors), 1)], shape), "picks"))
        n += len(keys)

    if pinned is not None:
        pins = scratch.put(rows.where("pin").select("path_key", "v").orderBy("path_key"), "pins").orderBy("path_key").toLocalIterator()
        while block := list(islice(pins, buffer)):
            told([r["path_key"] for r in block], [r["v"] for r in block])
    read = 0
    edges = _layers(candidates, n_candidates, 4 * buffer)
    reach, edge = None, math.inf

    def layer_below() -> None:
        """Takes the next layer into reach, with its similarity to all picks so far."""
        nonlocal reach, edge, read
        upper, edge = edge, edges.pop(0)
        layer = candidates.where((F.col("q") < upper) & (F.col("q") >= edge) if upper < math.inf else F.col("q") >= edge)
        layer = layer.withColumn("near", F.lit(0.0))
        for path in done:
            block = spark.read.schema(shape).parquet(path).select("v").collect()  # ``buffer`` at most
            layer = kept(folded(layer, [], [r["v"] for r in block]), "layer")
        read += layer.count() * (1 + len(done))
        reach = layer if reach is None else kept(reach.union(layer), "reach")
        if "reach" not in scratch.paths and "layer" in scratch.paths:
            scratch.paths["reach"] = scratch.paths.pop("layer")

    objective = F.lit(1 - d) * F.col("q") - F.lit(d) * F.col("near")
    while n < count:
        if reach is None:
            layer_below()
        best = reach.withColumn("objective", objective).orderBy(F.desc("objective"), F.desc("q"), "path_key").limit(buffer).collect()
        below = ((1 - d) * edge, edge) if edges else (-np.inf, -np.inf)  # what the best of the layers below could be worth
        if edges and (not best or (best[0]["objective"], best[0]["q"]) <= below):
            layer_below()
            continue
        if not best:
            break
        keys, vectors = [r["path_key"] for r in best], [r["v"] for r in best]
        q, value = np.array([r["q"] for r in best]), np.array([r["objective"] for r in best])
        near = np.array([d * r["near"] for r in best])
        open_ = np.ones(len(best), bool)
        bound = max(below, (value[-1], q[-1]) if len(best) == buffer else (-np.inf, -np.inf))
        picks: list[int] = []
        units = matrices(vectors)
        row_of = {int(i): (at, m, k) for at, m in units for k, i in enumerate(at)}
        while n + len(picks) < count and open_.any():
            at = min(np.flatnonzero(open_), key=lambda i: (-value[i], -q[i], keys[i]))
            if picks and (value[at], q[at]) <= bound:
                break
            open_[at] = False
            picks.append(at)
            alike, m, k = row_of[int(at)]
            similar = np.full(len(best), 0.5)
            similar[alike] = (m @ m[k] + 1) / 2
            near = np.maximum(near, d * similar)
            value = (1 - d) * q - near
        told([keys[i] for i in picks], [vectors[i] for i in picks])
        if n < count:
            reach = kept(folded(reach, [keys[i] for i in picks], [vectors[i] for i in picks]), "reach")
            read += reach.count()
    if seen is not None:
        seen |= {"candidates": n_candidates, "read": read}
    if "candidates" in scratch.paths:
        scratch.drop(*[name for name in ("candidates", "layer", "reach", "pins") if name in scratch.paths])
    return (spark.read.schema(shape).parquet(*done) if done else spark.createDataFrame([], shape)).drop("v")


def selection_changes(before: DataFrame, after: DataFrame, limit: int = 20) -> DataFrame:
    """``change, path_key, composite_score, place``: who entered (worst first) and left (best first) a selection, ``limit`` of each."""
    entered = after.join(before.select("path_key"), "path_key", "left_anti").orderBy("composite_score", F.desc("path_key")).limit(limit)
    left = before.join(after.select("path_key"), "path_key", "left_anti").orderBy(F.desc("composite_score"), "path_key").limit(limit)
    out = None
    for name, df, key in (("entered", entered, F.col("composite_score")), ("left", left, -F.col("composite_score"))):
        one = df.select(F.lit(name).alias("change"), "path_key", "composite_score", key.alias("_key"))
        out = one if out is None else out.union(one)
    return out.drop("_key")


def cut_boundary(pool: DataFrame, count: int, limit: int = 25) -> DataFrame:
    """``side, path_key, composite_score, place`` and what else ``pool`` has: the lowest chosen and the highest not chosen captures, ``limit`` of each."""
    placed = Ordered(pool, F.desc("composite_score"), "path_key", name="cut").row_number("place")
    inside = placed.where((F.col("place") <= count) & (F.coalesce("feedback_decision", F.lit("")) != "keep")).orderBy(F.desc("place")).limit(limit)
    outside = placed.where(F.col("place") > count).orderBy("place").limit(limit)
    return inside.withColumn("side", F.lit("in")).union(outside.withColumn("side", F.lit("out")))


def review_groups(selected: DataFrame, ranked: DataFrame, limit: int = 100) -> DataFrame:
    """Whole bursts of the selection, in the order of its first member, while they fit ``limit`` frames; the first burst is cut if it alone is too large.

    ``selected`` has ``burst_id`` and ``place``; ``ranked`` the frames.  At most
    ``limit`` bursts can fit, so only so many are looked at.
    """
    first = selected.groupBy("burst_id").agg(F.min("place").alias("place"))
    few = first.orderBy("place", "burst_id").limit(max(1, limit))
    sized = few.join(ranked.groupBy("burst_id").agg(F.count("*").alias("size")), "burst_id")
    from pyspark.sql import Window

    order = Window.orderBy("place", "burst_id")  # of at most ``limit`` rows
    fits = sized.withColumn("upto", F.sum("size").over(order)).withColumn("group", F.row_number().over(order).cast("long"))
    fits = fits.where((F.col("upto") <= limit) | (F.col("group") == 1)).select("burst_id", "group")
    return ranked.join(F.broadcast(fits), "burst_id").where(F.col("burst_rank") <= limit)
