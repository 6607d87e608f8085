"""Hard negatives by exact search over one-dimensional distance keys (operator 11).

Integer vectors get one more component, so that all are equally long; then the
largest inner product is the smallest distance.  Every vector is stored under
the key (nearest pivot, distance to it), in that order.  The triangle inequality
bounds the products in an interval of keys from both sides, so a search takes
the intervals (annuli around the pivots) in the order of their bound, scans
more of them in each round, and ends when no interval left can hold
a row that belongs to the best.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from framewise.storage import Scratch

from .ann_ivfpq import k_means
from .common import record_batch, table


@dataclass(frozen=True)
class HardNegatives:
    """``positives`` of each anchor; for each, ``negatives`` with ``low`` to ``high`` per cent of its score.

    Components become floor(``scale`` * x).  Pivots (one for each ``pivot_rows`` rows, up to
    ``max_pivots``) and the ``annuli`` edges around each come from at most ``sample``
    vectors.  ``block_rows``: rows of an annulus that one step scans.  ``first_rows``: rows
    that a search takes in its first round; in each next one it takes ``growth`` times as many.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    sample: int = 20_000
    pivot_rows: int = 4096
    max_pivots: int = 1024
    annuli: int = 16
    block_rows: int = 8192
    first_rows: int = 4096
    growth: int = 8


#: No score is as large; sums of squares from here on do not take part, as a score might not be a long.
BEYOND = 1 << 62
#: Up to here sums of products are exact in double precision.
EXACT = 1 << 53
#: Searches whose products with a block are held at once.
AT_ONCE = 128

_ROW = pa.schema([("id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("v", pa.binary()), ("norm2", pa.int64())])


def integers(vectors: list[bytes], kind: np.dtype, dim: int, scale: int) -> np.ndarray:
    """Rows of whole numbers, as doubles."""
    return np.floor(scale * np.frombuffer(b"".join(vectors), kind).reshape(-1, dim).astype(np.float64))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers, exactly."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.sqrt((q * q).sum(1).max())) * float(np.sqrt((x * x).sum(1).max()))
    if most < EXACT / 2:  # no partial sum is larger than the product of the lengths
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def _valid(kind: np.dtype, scale: int):
    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten()
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            whole = ~flat.is_null().to_numpy(zero_copy_only=False) & np.isfinite(values)
            ends = np.cumsum(sizes)
            out = []
            with np.errstate(over="ignore"):
                large = np.floor(scale * values.astype(np.float64))
                squares = large * large
            for a, b, i, label in zip((ends - sizes).tolist(), ends.tolist(), ids.to_pylist(), labels.to_pylist()):
                if b > a and i is not None and label is not None and whole[a:b].all() and squares[a:b].sum() < BEYOND:
                    out.append((i, label, b - a, values[a:b].tobytes(), sum(int(x) * int(x) for x in large[a:b]) if squares[a:b].sum() > EXACT / 2 else int(squares[a:b].sum())))
            yield record_batch(_ROW, *(zip(*out) if out else ([] for _ in _ROW)))

    return valid


class Pivots:
    """Centres of the lengthened vectors, and the distances at which the annuli around each are cut."""

    def __init__(self, x: np.ndarray, norm2: np.ndarray, most: int, rows: int, o: HardNegatives) -> None:
        self.most = float(most)
        longer = self.lengthened(x, norm2)
        self.centres = k_means(longer, min(o.max_pivots, max(8, round(rows / o.pivot_rows))), 8, 1)
        pivot, distance = self.keys(longer)
        every = np.linspace(0, 1, o.annuli + 1)[1:-1]
        self.edges = np.stack([np.quantile(distance[pivot == p], every) if (pivot == p).any() else np.zeros(len(every)) for p in range(len(self.centres))])

    def lengthened(self, x: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.most - norm2))[:, None]], 1)

    def distances(self, longer: np.ndarray) -> np.ndarray:
        whole = (longer**2).sum(1)[:, None] + (self.centres**2).sum(1)[None]
        return np.sqrt(np.maximum(0.0, whole - 2 * longer @ self.centres.T))

    def keys(self, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distance = self.distances(longer)
        pivot = distance.argmin(1)
        return pivot, distance[np.arange(len(longer)), pivot]


@dataclass
class Annuli:
    """One entry for each annulus that has rows; as many at most as pivots times annuli.  Its blocks are ``first`` and the next ones."""

    pivots: Pivots
    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.blocks) - self.blocks

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the searches the least and the largest product that each annulus can hold, and how far rounding may be off."""
        whole = (q * q).sum(1)[:, None] + self.pivots.most
        to = self.pivots.distances(np.concatenate([q, np.zeros((len(q), 1))], 1))[:, self.pivot]
        least = np.maximum(0.0, np.maximum(to - self.far, self.near - to))
        return (whole - (to + self.far) ** 2) / 2, (whole - least**2) / 2, whole[:, 0] * 1e-6 + 0.25


def _asking(shared, kind: np.dtype, dim: int, o: HardNegatives, budget: int):
    """Which blocks each search scans next, the bound ``tau`` below which annuli are left for later, and ``more``, whether any can be of use."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli: Annuli = shared.value
        first, numbers = annuli.first, annuli.blocks
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
                low, high, slack = annuli.bounds(integers(column("v").to_pylist(), kind, dim, o.scale))
                blocks, taus = [], []
                slots = zip(*(column(c).to_pylist() for c in ("at_most", "at_least", "stop", "tau")))
                for i, (most, least, stop, tau) in enumerate(slots):
                    useful, must = np.zeros(len(first), bool), np.inf
                    for m, n, s in zip(most, least, stop):
                        if n <= m:
                            useful |= (high[i] >= s - slack[i]) & (low[i] <= m + slack[i])
                            must = min(must, m)
                    left = np.flatnonzero(useful & (high[i] < tau + slack[i]))
                    left = left[np.argsort(-high[i, left], kind="stable")]
                    before = np.cumsum(annuli.rows[left]) - annuli.rows[left]
                    n = int(((before < budget) | (high[i, left] >= must)).sum())
                    while 0 < n < len(left) and high[i, left[n]] > high[i, left[n - 1]] - 2 * slack[i]:  # the cut is where rounding does not matter
                        n += 1
                    taus.append(float((high[i, left[n - 1]] + high[i, left[n]]) / 2) if n < len(left) else -np.inf)
                    blocks.append(np.concatenate([np.arange(first[x], first[x] + numbers[x]) for x in left[:n]] or [np.zeros(0, np.int64)]).astype(np.int32))
                rest = [batch.column(j) for j, name in enumerate(batch.schema.names) if name != "tau"]
                names = [name for name in batch.schema.names if name != "tau"]
                offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(blocks)))
                yield pa.RecordBatch.from_arrays([*rest, pa.array(taus, pa.float64()), visits], names=[*names, "tau", "blocks"])

    return ask


def best_rows(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Search and position of the ``k`` largest products of each search, those beyond ``-BEYOND`` alone; of equal ones the first."""
    if score.shape[1] > k:
        limit = np.maximum(np.partition(score, score.shape[1] - k, axis=1)[:, -k], 1 - BEYOND)
    else:
        limit = np.full(len(score), 1 - BEYOND)
    of, at = np.nonzero(score >= limit[:, None])
    order = np.lexsort((at, -score[of, at], of))
    of, at = of[order], at[order]
    turn = np.arange(len(of)) - np.searchsorted(of, of, "left")
    return of[turn < k], at[turn < k]


def _scanning(kind: np.dtype, dim: int, o: HardNegatives, k: int, same: bool):
    """Rows come sorted by block: first those stored there, then the searches that scan it, however many.  Only one block is held."""
    schema = pa.schema([("query_id", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            block, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turns = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(block)]):
                if a == b:
                    continue
                if block[a] != now:
                    now, held, ready = block[a], [], None
                if side[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if ready is None:
                    rows = pa.Table.from_batches(held, batch.schema).sort_by("id").combine_chunks() if held else batch.slice(0, 0)
                    ready = rows.column("id").to_numpy(), np.array(rows.column("label").to_pylist(), object), integers(rows.column("v").to_pylist(), kind, dim, o.scale)
                    held = []
                for c in range(a, b, AT_ONCE):
                    yield from scanned(batch.slice(c, min(AT_ONCE, b - c)), *ready)

    def scanned(asked: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        of, label = asked.column(2).to_numpy(), np.array(asked.column(3).to_pylist(), object)
        q = integers(asked.column(4).to_pylist(), kind, dim, o.scale)
        most, least = (asked.column(i).to_pylist() for i in (5, 6))
        for one in dict.fromkeys(label):
            mine = np.flatnonzero(label == one)
            at = np.flatnonzero((labels == one) == same)
            score = products(q[mine], x[at])
            score[ids[at][None] == of[mine][:, None]] = -BEYOND
            for slot in range(max(len(most[i]) for i in mine)):
                has = np.array([len(most[i]) > slot for i in mine])
                top, bottom = (np.array([v[i][slot] if h else w for i, h in zip(mine, has)])[:, None] for v, w in ((most, -BEYOND), (least, BEYOND)))
                a, b = best_rows(np.where((score <= top) & (score >= bottom), score, -BEYOND), k)
                yield record_batch(schema, of[mine][a], np.full(len(a), slot, np.int32), ids[at][b], score[a, b])

    return scan


class Index:
    """The vectors in the order of their keys, and the annuli; ``rows`` has ``id, label, v, norm2`` of vectors of one length."""

    def __init__(self, rows: DataFrame, n: int, most: int, dim: int, kind: np.dtype, o: HardNegatives, scratch: Scratch) -> None:
        self.o, self.kind, self.dim, self.scratch = o, kind, dim, scratch
        spark = rows.sparkSession
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(o.sample).select("v", "norm2").toArrow()  # so many at most
        x = integers(drawn.column("v").to_pylist(), kind, dim, o.scale)
        shared = spark.sparkContext.broadcast(pivots := Pivots(x, drawn.column("norm2").to_numpy().astype(np.float64), most, n, o))
        schema = pa.schema([("pivot", pa.int32()), ("annulus", pa.int32()), ("distance", pa.float64()), ("id", pa.int64()), ("label", pa.string()), ("v", pa.binary())])

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = integers(batch.column(2).to_pylist(), kind, dim, o.scale)
                pivot, distance = shared.value.keys(shared.value.lengthened(x, batch.column(3).to_numpy().astype(np.float64)))
                annulus = (shared.value.edges[pivot] < distance[:, None]).sum(1)
                yield record_batch(schema, pivot.astype(np.int32), annulus.astype(np.int32), distance, *batch.columns[:3])

        stored = rows.select("id", "label", "v", "norm2").mapInArrow(keyed, "pivot int, annulus int, distance double, id long, label string, v binary")
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.rows = scratch.put(stored.repartitionByRange(parts, "pivot", "distance").sortWithinPartitions("pivot", "distance"), "index")
        found = self.rows.groupBy("pivot", "annulus").agg(F.min("distance"), F.max("distance"), F.count("*")).orderBy("pivot", "annulus").collect()  # one row for each annulus
        pivot, annulus, near, far, size = (np.array(c) for c in zip(*found))
        blocks = -(-size // o.block_rows)
        self.annuli = Annuli(pivots, pivot, near, far, size, blocks)
        self.shared = spark.sparkContext.broadcast(self.annuli)
        places = list(zip(pivot.tolist(), annulus.tolist(), self.annuli.first.tolist(), blocks.tolist()))
        self.places = spark.createDataFrame(places, "pivot int, annulus int, _first int, _blocks int")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """``query_id, slot, rank, id, score``: the ``k`` rows of largest product for each slot of each query, of its own label (``same``) or of others.

        ``queries`` has ``query_id, label, v`` and, for each slot, the products
        ``at_most`` and ``at_least``.  Rows of the query's own id are left out.
        """
        o, scratch = self.o, self.scratch
        place = self.rows.join(F.broadcast(self.places), ["pivot", "annulus"])
        place = place.select((F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_blocks"))).cast("int").alias("block"), F.lit(0).alias("side"), "id", "label", "v")
        none = F.lit(None).cast("array<long>")
        place = place.withColumns({"at_most": none, "at_least": none})
        state = queries.withColumns({"stop": F.col("at_least"), "tau": F.lit(float("inf"))})
        best, budget, turn, name = None, o.first_rows, 0, "same" if same else "other"
        parts = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        kinds = "query_id long, label string, v binary, at_most array<long>, at_least array<long>, stop array<long>, tau double, blocks array<int>"
        columns = ("query_id", "label", "v", "at_most", "at_least", "stop", "tau")
        order = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "id")
        while True:
            asking = state.select(*columns).mapInArrow(_asking(self.shared, self.kind, self.dim, o, budget), kinds)
            asked = scratch.put(asking.where(F.size("blocks") > 0), f"{name}_asked{turn}")
            if asked.isEmpty():
                scratch.drop(f"{name}_asked{turn}")
                break
            visits = asked.select(F.explode("blocks").alias("block"), F.lit(1).alias("side"), F.col("query_id").alias("id"), "label", "v", "at_most", F.col("stop").alias("at_least"))
            wanted = place.join(visits.select("block").distinct(), "block", "left_semi")
            both = wanted.union(visits).repartition(parts, "block").sortWithinPartitions("block", "side")
            found = both.mapInArrow(_scanning(self.kind, self.dim, o, k, same), "query_id long, slot int, id long, score long")
            found = found if best is None else best.union(found)
            found = found.repartition("query_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            best = scratch.put(found.select("query_id", "slot", "id", "score"), f"{name}_best{turn}")
            full = best.groupBy("query_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") == k)
            full = full.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "last"))).alias("_last"))  # an entry for each slot
            ends = F.transform("at_least", lambda x, i: F.coalesce(F.try_element_at("_last", i.cast("int")), x))
            state = asked.drop("blocks").join(full, "query_id", "left").withColumn("stop", ends)
            if turn:
                scratch.drop(f"{name}_asked{turn - 1}", f"{name}_best{turn - 1}")
            turn, budget = turn + 1, budget * o.growth
        if best is None:
            return queries.select("query_id", F.lit(0).alias("slot"), F.lit(1).alias("rank"), F.col("query_id").alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
        return best.withColumn("rank", F.row_number().over(order)).select("query_id", "slot", "rank", "id", "score")


def _share(score: str, percent: int, up: bool) -> Column:
    """``percent`` of a whole number, rounded down (or up), without a product that is too large."""
    rest = F.expr(f"pmod({score}, 100)")
    whole = F.expr(f"({score} - pmod({score}, 100)) div 100")
    return whole * percent + ((rest * percent + (99 if up else 0)) / 100).cast("long")


def hard_negatives(
    vectors: DataFrame, anchor: Column, options: HardNegatives | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows for which ``anchor`` holds.

    A score is the integer inner product with the anchor.  An anchor's positives
    are the first rows of its label, by score, then smaller id, without itself; the
    negatives of a positive are the first rows of other labels with
    ``low`` * positive_score <= 100 * score <= ``high`` * positive_score (none below a score of 0).
    Fewer are given where there are no more.  All are found: the search ends when the bounds prove it.

    Rows with a null id, label or vector, an empty vector or one with null or
    non-finite components take no part, nor those of another length than most or
    with a sum of squares of 2^62 or more, after scaling.  Of rows that repeat an id
    the one of the least label and vector counts.  Zero vectors take part.  An empty table gives no rows; other columns are not read.
    """
    o, scratch, spark = options or HardNegatives(), Scratch(), vectors.sparkSession
    wide = isinstance(vectors.schema[vector_col].dataType.elementType, DoubleType)
    kind = np.dtype("<f8" if wide else "<f4")
    given = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>" if wide else "array<float>").alias("v"), anchor.alias("anchor"))
    marks = given.where("anchor").select("id").distinct()
    valid = scratch.put(given.select("id", "label", "v").mapInArrow(_valid(kind, o.scale), "id long, label string, dim int, v binary, norm2 long"), "valid")
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    sizes = valid.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    dim = sizes[0]["dim"]
    rows = valid.where(F.col("dim") == dim).drop("dim")
    twice = scratch.put(rows.groupBy("id").count().where("count > 1").select("id"), "twice")
    if not twice.isEmpty():
        least = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v", "norm2")).alias("_r")).select("id", "_r.*")
        rows = rows.join(twice, "id", "left_anti").union(least.select(*rows.columns))
    n, most = rows.agg(F.count("*"), F.max("norm2")).first()
    index = Index(rows, n, most, dim, kind, o, scratch)
    anchors = index.rows.join(marks, "id", "left_semi").select(F.col("id").alias("query_id"), "label", "v")
    anchors = scratch.put(anchors, "anchors")
    scratch.drop("valid", "twice")
    every = anchors.withColumns({"at_most": F.array(F.lit(BEYOND).cast("long")), "at_least": F.array(F.lit(1 - BEYOND).cast("long"))})
    positives = scratch.put(index.search(every, o.positives, True), "positives")
    slots = positives.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", _share("score", o.high, False).alias("most"), _share("score", o.low, True).alias("least")))).alias("_all"))
    asked = anchors.join(slots, "query_id").select("query_id", "label", "v", F.col("_all.most").alias("at_most"), F.col("_all.least").alias("at_least"))
    found = index.search(asked, o.negatives, False)
    of = positives.select("query_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(of, ["query_id", "slot"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all rows of ``embeddings`` whose id is divisible by 50; every seventh label is moved on first.  Odd rows as in :func:`hard_negatives`."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 50 == 0)
