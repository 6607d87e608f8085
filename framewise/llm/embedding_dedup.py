"""Near duplicates among embeddings of one label (operator 13).

Collision counting: vectors of length one are projected on many random lines.
On each line two vectors collide if one lies in the window around the other; a
pair that collides on enough lines is verified by its cosine.  The width of the
windows and the count come from the recall asked for.

The first lines are sorted into strips, as far as it takes to make cells of
bounded size; a vector visits the next strip too where its window reaches into
it, so every pair within the windows meets in just one cell.  Within a cell rows are
sorted by the next line, and the other lines are counted in numpy, a window at
a time.  A cell gives one row for each vector (its links, and one vector that
it is connected with), never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from framewise.storage import Scratch

from .common import record_batch, table
from .components import connected_components


@dataclass(frozen=True)
class Collisions:
    """``similarity``: least cosine of a link.  ``recall``: share of the pairs at just that cosine whose count is enough, over random lines.

    ``lines`` are counted, with windows of ``window`` standard deviations of
    such a pair's difference; up to ``levels`` more are cut into strips,
    with windows of ``wide`` ones.  A cell of more than ``cell_rows`` vectors is
    cut by the next line, and after the last into tiles of so many by so many.
    """

    similarity: float = 0.98
    recall: float = 0.9999
    lines: int = 24
    window: float = 3.0
    wide: float = 4.0
    levels: int = 8
    cell_rows: int = 4096
    seed: int = 13

    def __post_init__(self) -> None:
        if not (0 < self.similarity < 1 and 0 < self.recall < 1 and 0 < self.window <= self.wide and self.lines > 0 and 0 <= self.levels <= 30 and self.cell_rows > 0):
            raise ValueError(f"impossible options: {self}")

    @property
    def least_count(self) -> int:
        """The largest count that a pair at the least cosine reaches with the chance ``recall``."""
        p = math.erf(self.window / math.sqrt(2))
        reached, count = 0.0, self.lines + 1
        while reached < self.recall and count:
            count -= 1
            reached += math.comb(self.lines, count) * p**count * (1 - p) ** (self.lines - count)
        return count

    @property
    def widths(self) -> tuple[int, int]:
        """The two windows in steps of a projection; rounding takes one step at most."""
        return math.ceil(self.window * STEPS) + 1, math.ceil(self.wide * STEPS) + 1


#: Steps of a stored projection for the deviation of a pair at the least cosine, and the largest stored value.
STEPS, FAR = 64, 16_000
#: Rows whose windows are looked through together, and lines after which pairs that cannot reach the count are left.
AT_ONCE, FIRST_LINES = 256, 6
#: So near to the least cosine, a product made for many pairs at once is made again for the pair alone.
DOUBT = 1e-9


@lru_cache(maxsize=8)
def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, so that squares neither overflow nor vanish, and then to length one."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.sqrt((v * v).sum(1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with that row of ``y``, in double precision."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (x, y))
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _keyed(wide: bool):
    """Id, label and vector of each row to ``id, label, node, v``; node, which names label and vector, is null where the row takes no part."""
    kind = np.dtype("<f8" if wide else "<f4")
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("node", pa.binary()), ("v", pa.binary())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten()  # without the null ones
            whole = ~flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # -0.0 becomes 0.0
            whole &= np.isfinite(values)
            ends = np.cumsum(sizes)
            v, node = [], []
            for a, b, i, label in zip(ends - sizes, ends, ids.to_pylist(), labels.to_pylist()):
                valid = i is not None and label is not None and b > a and whole[a:b].all() and values[a:b].any()
                v.append(values[a:b].tobytes() if valid else None)
                node.append(hashlib.blake2b(v[-1] + label.encode(), digest_size=16, salt=len(v[-1]).to_bytes(16, "little")).digest() if valid else None)
            yield record_batch(schema, ids, labels, node, v)

    return keyed


def _projected(o: Collisions, wide: bool):
    """Adds the cell's first coordinate, the length of the vector, and its projections."""
    kind, n = np.dtype("<f8" if wide else "<f4"), o.levels + o.lines
    scale = STEPS / math.sqrt(2 - 2 * o.similarity)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(batch.schema.get_field_index("v")).to_pylist()
            dims = np.array([len(v) // kind.itemsize for v in vectors])
            out = np.empty((len(vectors), n), np.int16)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit_rows(np.frombuffer(b"".join(vectors[i] for i in at), kind).reshape(-1, dim).astype(np.float64))
                out[at] = np.clip(np.floor(x @ _directions(int(dim), n, o.seed) * scale), -FAR, FAR)
            lines = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), n).cast(pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims.astype(np.int32)), lines], names=[*batch.schema.names, "dim", "lines"])

    return project


def _joined_up(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of all rows after the pairs ``i, j`` are joined; ``parent`` has their roots before."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def linked_pairs(lines: np.ndarray, guest: np.ndarray, side: np.ndarray, v: np.ndarray, o: Collisions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows sorted by their first counted line, in parts: pairs of positions.

    ``guest`` has a bit for each line in whose strip the row is a guest; two
    guests of the same strip meet elsewhere.  ``side``: 0, or 1 and 2 in a tile of two
    groups of rows, of which only pairs between the two count.
    """
    window, _ = o.widths
    misses = o.lines - o.least_count
    counted = np.ascontiguousarray(lines[:, o.levels :].T)
    first, unit = counted[0], None
    for a in range(0, len(first), AT_ONCE):
        b = min(a + AT_ONCE, len(first))
        end = int(np.searchsorted(first, first[b - 1] + o.widths[1], "right"))  # rows after each in the order, within the wide window
        missed = np.zeros((b - a, end - a), np.uint8)
        for line in counted[:FIRST_LINES]:
            missed += np.abs(line[a:b, None] - line[None, a:end]) > window
        missed[np.arange(end - a)[None] <= np.arange(b - a)[:, None]] = 255  # each pair once
        x, y = np.nonzero(missed <= misses)
        n = missed[x, y]
        x, y = x + a, y + a
        fits = (guest[x] & guest[y] == 0) & ((side[x] == 0) | (side[x] != side[y]))
        x, y, n = x[fits], y[fits], n[fits]
        for line in counted[FIRST_LINES:]:
            n = n + (np.abs(line[x] - line[y]) > window)
            left = n <= misses
            if not left.all():
                x, y, n = x[left], y[left], n[left]
        if len(x) > 20_000:  # many: by one product of matrices, and the doubtful ones again
            unit = unit_rows(v) if unit is None else unit
            near = (unit[a:b] @ unit[a:end].T)[x - a, y - a] - o.similarity
            doubtful = np.flatnonzero(np.abs(near) <= DOUBT)
            near[doubtful] = cosines(v[x[doubtful]], v[y[doubtful]]) - o.similarity
            yes = near >= 0
        else:
            yes = cosines(v[x], v[y]) >= o.similarity
        if yes.any():
            yield x[yes], y[yes]


def _tile(o: Collisions, wide: bool):
    kind = np.dtype("<f8" if wide else "<f4")
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])

    def tile(rows: pa.Table) -> pa.Table:
        if rows.num_rows < 2:
            return schema.empty_table()
        lines = rows.column("lines").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        order = np.argsort(lines[:, o.levels], kind="stable")
        rows, lines = rows.take(pa.array(order)), lines[order]
        guest, chunk, n = (rows.column(c).to_numpy() for c in ("guest", "chunk", "n"))
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        side = np.where(chunk == low, 1, 2) if low != high else np.zeros(len(chunk), np.int64)
        v = np.frombuffer(b"".join(rows.column("v").to_pylist()), kind).reshape(rows.num_rows, -1).astype(np.float64)
        links, parent = np.zeros(len(n), np.int64), np.arange(len(n))
        for x, y in linked_pairs(lines, guest, side, v, o):
            np.add.at(links, x, n[y])
            np.add.at(links, y, n[x])
            parent = _joined_up(parent, x, y)
        has = pa.array(np.flatnonzero(links))
        nodes = rows.column("node")
        return pa.table([nodes.take(has), nodes.take(pa.array(parent)).take(has), pa.array(links).take(has)], schema=schema)

    return tile


def _cells(classes: DataFrame, o: Collisions, scratch: Scratch) -> DataFrame:
    """``classes`` with ``cell`` and ``guest``, a row for each cell that a class visits; only cells after the last level may be larger than ``cell_rows``."""
    by = ("label", "cell")
    strip = o.widths[1]
    rows = classes.withColumns({"cell": F.array("dim"), "guest": F.lit(0)}).drop("dim")
    done = None
    for level in range(o.levels):
        sizes = rows.groupBy(*by).agg(F.count("*").alias("_size"), F.bit_and("guest").alias("_all"))
        large = scratch.put(sizes.where(F.col("_size") > o.cell_rows).select(*by, (F.col("_all") == 0).alias("_cut")), f"large{level}")
        if large.isEmpty():
            break
        small = rows.join(large, list(by), "left_anti")
        at = F.element_at("lines", level + 1).cast("int")
        here = F.floor(at / F.lit(strip)).cast("int")
        visits = F.array(F.struct(here.alias("strip"), F.lit(0).alias("bit")), F.struct((here + 1).alias("strip"), F.lit(1 << level).alias("bit")))  # a strip is as wide as a window
        cut = rows.join(large.where("_cut"), list(by)).withColumn("_visit", F.explode(visits))
        cut = cut.withColumns({"cell": F.concat("cell", F.array("_visit.strip")), "guest": F.col("guest").bitwiseOR(F.col("_visit.bit"))}).drop("_visit", "_cut")
        done = small if done is None else done.union(small)
        rows = scratch.put(cut, f"cells{level}")
    return rows if done is None else done.union(rows)


def _tiled(cells: DataFrame, o: Collisions) -> DataFrame:
    """The rows with the tiles that they visit: chunks ``low`` and ``high`` of their cell; a cell that is not too large is one tile."""
    by = ["label", "cell"]
    large = cells.groupBy(*by).agg(F.count("*").alias("_size")).where(F.col("_size") > o.cell_rows).select(*by, F.ceil(F.col("_size") / o.cell_rows).cast("int").alias("_chunks"))
    joined = cells.join(large, by, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int")
    split = joined.withColumn("chunk", chunk).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return split.withColumns({"low": F.least("chunk", "_with"), "high": F.greatest("chunk", "_with")}).drop("_chunks", "_with")


def near_duplicates(
    vectors: DataFrame, options: Collisions | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: links are pairs of equal labels with a cosine of ``similarity`` or more.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    least vec_id that links reach, the row's own included, and ``kept`` says that it
    is the row's own.  Every link is verified in double precision; a pair is found
    with about the chance ``recall`` at least, copies always.  Rows with a null id, label or
    vector, an empty or zero vector or one with null or non-finite components link with nothing,
    and so do vectors of different lengths; such a row is kept, with its own
    id as component.  Rows that repeat an id are vectors of their own.  An empty
    table gives no rows; other columns are not read.  Equal vectors of a label are one
    class, compared once; a group of n different near vectors takes n * n / 2
    tests, in tiles.
    """
    o, scratch = options or Collisions(), Scratch()
    wide = isinstance(vectors.schema[vector_col].dataType.elementType, DoubleType)
    given = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>" if wide else "array<float>").alias("v"))
    keyed = given.mapInArrow(_keyed(wide), "id long, label string, node binary, v binary")
    rows = scratch.put(keyed, "keyed")
    classes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = scratch.put(classes.mapInArrow(_projected(o, wide), "node binary, id long, n long, label string, v binary, dim int, lines array<short>"), "classes")
    cells = _cells(classes.drop("id"), o, scratch)
    tiled = _tiled(cells, o).groupBy("label", "cell", "low", "high")
    met = scratch.put(tiled.applyInArrow(_tile(o, wide), "node binary, root binary, links long"), "met")
    components = connected_components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "components")
    ids = classes.select("node", "id", "n")
    found = ids.join(components, "node", "left").join(met.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    found = scratch.put(found.select("node", "id", "comp", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "found")
    least = found.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    linked = found.where("comp is not null").join(least, "comp").select("node", "n_links", F.col("least").alias("component_id"))
    told = linked.union(found.where("comp is null").select("node", "n_links", F.col("id").alias("component_id")))
    out = rows.where("node is not null").select("id", "node").join(told, "node").select("id", "n_links", "component_id")
    out = out.union(rows.where("node is null").select("id", F.lit(0).cast("long"), "id"))
    own: Column = F.col("id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", own.alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all rows of ``embeddings``; nulls and odd rows as in :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
