"""Nearest neighbours by inner product (operator 9).

An inverted file: coarse centroids, and product-quantised residuals below each.
Centroids and codebooks are fitted on a bounded sample; every vector is
indexed, with the length of what its code leaves out.  Of each query the k-th
best product with a bounded sample is a floor: no nearest vector lies below it.  A query
visits the cells whose centroid and farthest vector can reach the floor, leaves
out vectors whose asymmetric distance and code error cannot, and ranks all others by the
exact product of the original vectors in double precision.  A code error counts by the largest share
of it that products of the sample show; for vectors coded worse than any of the sample, in full.  A
query that finds fewer than it asked for is searched again in all cells, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from framewise.storage import Scratch

from .common import record_batch, table


@dataclass(frozen=True)
class IvfPq:
    """``sample``: vectors to fit on, at most.  ``cell_size``: rows for each cell, up to ``max_cells`` cells.

    ``short_list``: vectors of a query and block, the best by their codes, whose exact
    products raise the floor where more than these could reach it.  ``cell_rows``: rows of a cell in
    one block, which a task holds while queries stream past it.  ``query_rows``: queries
    that stream past one copy of a block; a further copy is made for so
    many more, so that no task is endless, and it is small beside the queries themselves.
    """

    sample: int = 20_000
    cell_size: int = 1024
    max_cells: int = 1024
    subspaces: int = 16
    short_list: int = 500
    cell_rows: int = 50_000
    query_rows: int = 1_000_000
    rounds: int = 10


#: Trial queries, and vectors beside the sample by which floors are set and codes judged.
TRIALS, REFERENCE = 256, 4096
#: Queries whose tables are read at once, and pairs whose products are taken at once.
AT_ONCE, PAIRS = 128, 1 << 16
#: Of the product of two lengths: more than sums of single precision are off.
ROUNDING = 1e-5


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids; empty ones are set on the points that lie farthest from theirs."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        distance = (centres**2).sum(1)[None] - 2 * x @ centres.T
        near = distance.argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if (empty := np.flatnonzero(n == 0)).size:
            far = np.argsort(-(distance[np.arange(len(x)), near] + (x**2).sum(1)), kind="stable")
            centres[empty] = x[far[: len(empty)]]
    return centres


class Model:
    """Cells, codebooks, and reference vectors ``held`` with their ids; ``rows`` is the size of the whole table, ``asked`` some of the queries."""

    def __init__(self, x: np.ndarray, held: np.ndarray, ids: np.ndarray, asked: np.ndarray, rows: int, options: IvfPq) -> None:
        x = x.astype(np.float64)
        n_cells = min(options.max_cells, max(16, round(rows / options.cell_size)))
        self.cells = k_means(x, n_cells, options.rounds, 1)
        rest = x - self.cells[self.cell_of(x)]
        self.cuts = np.linspace(0, x.shape[1], min(options.subspaces, x.shape[1]) + 1).astype(int)
        self.books = [k_means(rest[:, a:b], 256, options.rounds, 2) for a, b in zip(self.cuts, self.cuts[1:])]
        self.ids, first = np.unique(ids, return_index=True)
        self.reference = held[first].astype(np.float64)
        lost = self._lost(held.astype(np.float64))
        size = np.linalg.norm(lost, axis=1)
        q = asked.astype(np.float64)
        with np.errstate(all="ignore"):
            share = np.abs(q @ lost.T) / (np.linalg.norm(q, axis=1)[:, None] * size[None])
        self.worst, self.share = size.max(initial=0.0), min(1.0, np.nan_to_num(share, nan=0.0).max(initial=0.0))

    def _lost(self, x: np.ndarray) -> np.ndarray:
        cell = self.cell_of(x)
        return x - self.cells[cell] - self.decoded(self.codes(x, cell))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)

    def indexed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code, distance from the centroid, and by how much a product with a query of length 1 can exceed that of the code."""
        cell = self.cell_of(x)
        rest, codes = x - self.cells[cell], self.codes(x, cell)
        lost = np.linalg.norm(rest - self.decoded(codes), axis=1)
        return cell, codes, np.linalg.norm(rest, axis=1), np.where(lost <= self.worst, lost * self.share, lost)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return ((self.cells**2).sum(1)[None] - 2 * x @ self.cells.T).argmin(1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.cells[cell]
        near = [((b**2).sum(1)[None] - 2 * rest[:, i:j] @ b.T).argmin(1) for b, i, j in zip(self.books, self.cuts, self.cuts[1:])]
        return np.stack(near, 1).astype(np.uint8)

    def cut(self, q: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """For each query the ``k``-th best product with other reference vectors; no limit where there are fewer."""
        if len(self.ids) <= k:
            return np.full(len(q), -np.inf)
        score = np.where(self.ids[None] == ids[:, None], -np.inf, q @ self.reference.T)
        best = np.partition(score, len(self.ids) - k, axis=1)[:, len(self.ids) - k]
        return best - ROUNDING * np.linalg.norm(q, axis=1) * np.linalg.norm(self.reference, axis=1).max()

    def about(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """A row for each vector of the cell, a column for each query: the products by distance tables."""
        out = np.repeat((q @ self.cells[cell])[None].astype(np.float32), len(codes), 0)
        for k, (b, i, j) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            out += (b @ q[:, i:j].T).astype(np.float32)[codes[:, k]]  # the table of one subspace: a row for each code word
        return out


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the vectors that take part: not null or zero, all components finite."""
    chosen = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return chosen.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, options: IvfPq | None = None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row of ``queries`` in ``vectors``, without itself (all others, if fewer).

    Nearest is the largest inner product; ties go to the smaller vec_id.  Null
    and zero vectors, those with null or non-finite components, those of
    another length than most, and those without an id take no part on either
    side.  Rows that repeat a vec_id are one candidate, with its largest score; of
    queries that repeat an id the smallest vector counts.  An empty table gives
    no rows; other columns are not read.
    """
    options = options or IvfPq()
    spark, scratch = vectors.sparkSession, Scratch()
    wide = not all(isinstance(df.schema[c].dataType.elementType, FloatType) for df, c in ((vectors, vector_col), (queries, vector_col)))
    kind = np.dtype("<f8" if wide else "<f4")
    x, q = (valid_vectors(df, id_col, vector_col).withColumn("v", F.col("v").cast("array<double>" if wide else "array<float>")) for df in (vectors, queries))
    sizes = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    dim, rows = sizes[0]["d"], sizes[0]["count"]
    x, q = x.where(F.size("v") == dim), q.where(F.size("v") == dim)
    q = q.groupBy("vec_id").agg(F.min("v").alias("v"))
    some = x if rows <= options.sample + REFERENCE else x.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(math.ceil((1 << 30) * 1.2 * (options.sample + REFERENCE) / rows)))
    drawn = some.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(options.sample + REFERENCE).toArrow()
    trials = q.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).toArrow()
    flat = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    apart = drawn.num_rows >= options.sample + REFERENCE // 4  # vectors that nothing was fitted on, where the table has some to spare
    held = drawn.slice(options.sample if apart else 0, REFERENCE)
    model = Model(flat(drawn.slice(0, options.sample)), flat(held), held.column("vec_id").to_numpy(), flat(trials), rows, options)
    shared = spark.sparkContext.broadcast(model)  # at most max_cells + 256 + REFERENCE rows of dim
    n_cells = len(model.cells)

    coded_schema = pa.schema([("cell", pa.int32()), ("vec_id", pa.int64()), ("code", pa.binary()), ("far", pa.float64()), ("reach", pa.float64()), ("v", pa.binary())])

    def packed(m: np.ndarray) -> pa.Array:
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.shape[1] * m.itemsize), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(1).flatten().to_numpy().reshape(-1, dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch)
            cell, codes, far, reach = shared.value.indexed(m.astype(np.float64))
            yield record_batch(coded_schema, cell.astype(np.int32), batch.column(0), packed(codes), far, reach, packed(m.astype(kind)))

    coded = scratch.put(x.mapInArrow(index, "cell int, vec_id long, code binary, far double, reach double, v binary"), "index")
    per_cell, farthest = np.zeros(n_cells, np.int64), np.zeros(n_cells)
    for row in coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each cell
        per_cell[row["cell"]], farthest[row["cell"]] = row["n"], row["far"]
    blocks = np.maximum(1, -(-per_cell // options.cell_rows))
    probe_schema = pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("query_id", pa.int64()), ("cut", pa.float64()), ("v", pa.binary())])

    def probed(q: DataFrame, every: bool) -> DataFrame:
        """A row for each query and block of a cell that it visits; ``every``: all cells, without a cut."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for whole in batches:
                for a in range(0, whole.num_rows, 256):
                    batch = whole.slice(a, 256)
                    m = matrix(batch).astype(np.float64)
                    cut = np.full(len(m), -np.inf) if every else model.cut(m, batch.column(0).to_numpy(), k)
                    length = np.linalg.norm(m, axis=1)[:, None]
                    most = m @ model.cells.T + length * (farthest + ROUNDING * (np.linalg.norm(model.cells, axis=1) + farthest))
                    of, cell = np.nonzero(~(most < cut[:, None]) & (per_cell > 0))
                    times = blocks[cell]
                    at = np.repeat(of, times)
                    block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    take = pa.array(at)
                    yield record_batch(probe_schema, np.repeat(cell, times).astype(np.int32), block.astype(np.int32), batch.column(0).take(take), cut[at], packed(m.astype(kind)).take(take))

        return q.mapInArrow(probe, "cell int, block int, query_id long, cut double, v binary")

    near_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def values(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block: first its vectors, then the queries that visit it, however many."""
        now, held, ready = None, [], None
        for batch in batches:
            places = np.stack([batch.column(i).to_numpy() for i in range(4)])
            turns = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                if a == b:
                    continue
                *block, side = places[:, a].tolist()
                if block != now:
                    now, held, ready = block, [], None
                if side == 0:
                    held.append(batch.slice(a, b - a))
                elif ready or held:  # else none of the cell's rows lie in this block
                    if ready is None:
                        rows = pa.Table.from_batches(held).sort_by("id").combine_chunks()
                        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
                        ready, held = (rows.column("id").to_numpy(), values(rows.column("v")), codes, rows.column("reach").to_numpy()), []
                    for c in range(a, b, AT_ONCE):
                        yield from found_in(block[0], *ready, batch.slice(c, min(AT_ONCE, b - c)))

    def found_in(cell: int, ids: np.ndarray, m: np.ndarray, codes: np.ndarray, reach: np.ndarray, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of each query the best ``k`` of a block, if they reach its floor."""
        asking, cuts, qs = asked.column("id").to_numpy(), asked.column("cut").to_numpy().copy(), values(asked.column("v")).astype(np.float64)
        length = np.linalg.norm(qs, axis=1)
        about = np.ascontiguousarray(shared.value.about(qs, cell, codes).T)
        most = about + (length[:, None] * (reach + ROUNDING * np.linalg.norm(m.astype(np.float64), axis=1).max())[None])
        can = ~(most < cuts[:, None]) & (ids[None] != asking[:, None])

        def exact(i: np.ndarray, at: np.ndarray) -> np.ndarray:
            return (m[at].astype(np.float64) * qs[i]).sum(1)  # row by row, so that equal vectors have equal scores

        for i in np.flatnonzero(can.sum(1) > options.short_list):
            at = np.flatnonzero(can[i])
            at = at[np.argpartition(-about[i, at], options.short_list - 1)[: options.short_list]]
            score = exact(np.full(len(at), i), at)
            order = np.lexsort((ids[at], -score))
            best = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]  # each id once, by its best row
            if len(best) >= k:
                cuts[i] = max(cuts[i], score[best[k - 1]])
                can[i] &= ~(most[i] < cuts[i])
        upto = np.cumsum(can.sum(1))
        part = upto // PAIRS
        for p in np.unique(part):
            some = np.flatnonzero(part == p)
            of, at = np.nonzero(can[some])
            of = some[of]
            score = exact(of, at)
            good = np.flatnonzero(score >= cuts[of])
            of, score, found = of[good], score[good], ids[at[good]]
            order = np.lexsort((found, -score, of))
            of, score, found = of[order], score[order], found[order]
            once = np.lexsort((np.arange(len(of)), found, of))  # each id once, by its best row
            keep = np.ones(len(of), bool)
            keep[once[1:]] = (of[once][1:] != of[once][:-1]) | (found[once][1:] != found[once][:-1])
            of, score, found = of[keep], score[keep], found[keep]
            first = np.searchsorted(of, of)
            few = np.arange(len(of)) - first < k
            yield record_batch(near_schema, asking[of[few]], found[few], score[few])

    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(q: DataFrame, every: bool) -> DataFrame:
        parts = math.ceil(q.count() / options.query_rows) or 1
        number = F.array(*(F.lit(int(b)) for b in blocks))
        by, side = ("cell", "block", "part"), ("cell", "block", "part", "side", "id", "cut", "code", "reach", "v")
        placed = coded.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(number, F.col("cell") + 1)).cast("int"))
        placed = placed.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "side": F.lit(0), "id": F.col("vec_id"), "cut": F.lit(None).cast("double")})
        probes = probed(q, every).withColumns({"part": F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"), "side": F.lit(1), "id": F.col("query_id"), "code": F.lit(None).cast("binary"), "reach": F.lit(None).cast("double")})
        tasks = max(at_least, min(int(blocks.sum()) * parts // 4, 10_000))
        both = placed.select(*side).union(probes.select(*side)).repartition(tasks, *by).sortWithinPartitions(*by, "side")
        found = both.mapInArrow(search, "query_id long, vec_id long, score double")
        found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    q = scratch.put(q, "queries")
    found = scratch.put(searched(q, False), "found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    lacking = scratch.put(q.join(full, "vec_id", "left_anti"), "lacking")
    if not lacking.isEmpty():
        again = scratch.put(searched(lacking, True), "again")
        found = found.join(lacking.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(again)
    scratch.drop("index", "queries")
    return found


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th id among all ``embeddings``; nulls and odd rows as in :func:`nearest`."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
