"""Best-fit packing of token sequences (operator 10).

Only the histogram of piece lengths decides which lengths share a sequence, so
it alone goes to the driver: one row for each length up to the capacity.  The
configuration linear program over it (a variable for each filling of a
sequence, a covering row for each length) is solved by multiplicative weights;
a knapsack dynamic program prices the fillings.  The solution is rounded down
and the program solved again for what is left, until best fit places the last
pieces.  Pieces then get their places by rank within their length, in Spark.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from framewise.storage import stored

from .common import record_batch, table, text_chunks

#: Steps of multiplicative weights in a round, and rounds; they bound the fillings that go to the executors.
STEPS, ROUNDS = 24, 8
#: How fast covered lengths lose weight, how far below the best a filling may be, and the share of a length that a step covers.
RATE, NEAR, SHARE = 1.0, 0.02, 0.5
#: Rows of one length that one task ranks, or the root of their number if that is more.
RANKED = 1_000

Filling = tuple[tuple[int, ...], int]  # lengths in a sequence, and how many sequences are filled so


class TokenIds:
    """Ids of whole texts, with a compiled encoder where ids order the merges (else :class:`~framewise.llm.bpe.ByteBpe`)."""

    _made: dict[str, TokenIds] = {}

    def __init__(self, path: str) -> None:
        import tiktoken

        self.plain = bpe.load(path)
        merged = sorted(self.plain.ranks, key=self.plain.ranks.__getitem__)
        ids = [self.plain.ids[m] for m in merged]
        self.fast = None
        if all(a < b for a, b in zip(ids, ids[1:])):
            self.fast = tiktoken.Encoding("packing", pat_str=bpe.PIECES, mergeable_ranks=self.plain.ids, special_tokens=self.plain.added)

    @classmethod
    def load(cls, path: str) -> TokenIds:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def of(self, text: str) -> np.ndarray:
        # the compiled encoder's pattern engine backtracks over long runs of white space or signs
        if self.fast is None or len(text) > 1 << 20:
            return np.frombuffer(self.plain.encode(text), "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, capacity: int, end_id: int, path: str) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32`` and the ``row``, to be written before it is used."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "row")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = TokenIds.load(path), TaskContext.get().partitionId() << 33
        for batch, texts in text_chunks(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                ids = np.append(tokens.of(text.decode()), end_id).astype("<u4")
                n = -(-len(ids) // capacity)
                stops = len(ids) - capacity * np.arange(n - 1, -1, -1)  # only the first is shorter
                start = 0
                for piece, stop in enumerate(stops.tolist()):
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), row))
                    start, row = stop, row + 1
            yield record_batch(schema, *zip(*rows))

    return docs.mapInArrow(cut, "doc_id long, piece long, start long, length long, ids_crc32 long, row long")


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The knapsack program for every room up to the capacity.

    ``values[l]`` is the value of length l, negative where there is none.
    Returns the best value in each room, the last length put in, and the room
    (itself or less) at which that happened.
    """
    best, last, at = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = best[:room][::-1] + values[1 : room + 1]
        i = int(gain.argmax())
        if gain[i] > best[room - 1]:
            best[room], last[room], at[room] = gain[i], i + 1, room
        else:
            best[room], at[room] = best[room - 1], at[room - 1]
    return best, last, at


def filling_of(room: int, last: np.ndarray, at: np.ndarray) -> list[int]:
    filling = []
    while at[room]:
        room = int(at[room])
        filling.append(int(last[room]))
        room -= filling[-1]
    return filling


def fractional(counts: np.ndarray, capacity: int) -> list[tuple[list[int], float]]:
    """A near-optimal point of the program by multiplicative weights, scaled to as many ids as there are.

    One pricing gives the best filling around each length; those within
    ``NEAR`` of the best of all are taken, as an approximate oracle may.
    """
    there = np.flatnonzero(counts)
    need = np.maximum(counts, 1).astype(float)
    length = np.arange(len(counts))
    weight = np.where(counts > 0, length / capacity, 0.0)
    found: dict[tuple[int, ...], float] = {}
    for _ in range(STEPS):
        # of fillings of equal weight, the fuller
        values = np.where(counts > 0, weight + 1e-6 * length / capacity, -1.0)
        best, last, at = price(values, capacity)
        around = values[there] + best[capacity - there]
        done = np.zeros(len(counts))
        for k in np.argsort(-around, kind="stable").tolist():
            if around[k] < (1 - NEAR) * best[capacity]:
                break
            one = int(there[k])
            if done[one] >= SHARE:
                continue
            filling = sorted([one, *filling_of(capacity - one, last, at)], reverse=True)
            used, a = np.unique(filling, return_counts=True)
            step = float(((SHARE - done[used]).clip(0) * need[used] / a).min())
            if step > 0:
                found[tuple(filling)] = found.get(tuple(filling), 0.0) + step
                done[used] += step * a / need[used]
        weight = weight * np.exp(-RATE * done)
        weight /= weight.max()
    ids = sum(sum(f) * x for f, x in found.items())
    scale = float((counts * length).sum()) / max(ids, 1.0)
    return [(list(f), x * scale) for f, x in found.items()]


def best_fit(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Longest first, each into the fullest sequence that has room.

    Sequences with the same filling are kept as one group, and so many pieces
    of a length as fit go into each at once; the work follows the number of
    lengths and groups, not of pieces.
    """
    rooms: list[int] = []  # sorted
    groups: dict[int, list[Filling]] = {}

    def put(room: int, filling: tuple[int, ...], times: int) -> None:
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((filling, times))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                put(capacity, (), -(-left // (capacity // length)))
                continue
            room = rooms[i]
            filling, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            fit = room // length
            whole = min(times, left // fit)
            if whole:
                put(room - fit * length, filling + (length,) * fit, whole)
            left -= whole * fit
            if whole < times:
                if left:
                    put(room - left * length, filling + (length,) * left, 1)
                if times - whole - (left > 0):
                    put(room, filling, times - whole - (left > 0))
                left = 0
    return [f for room in rooms for f in groups[room] if f[0]]


def plan(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Fillings that hold each length exactly as often as ``counts`` has it."""
    left = counts.astype(np.int64).copy()
    out: list[Filling] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    for _ in range(ROUNDS):
        if left.sum() <= 500:
            break
        before = left.sum()
        for filling, x in sorted(fractional(left, capacity), key=lambda f: (-sum(f[0]), -f[1])):
            a = np.bincount(filling, minlength=len(left))
            used = a > 0
            times = min(math.ceil(x), int((left[used] // a[used]).min()))
            if times:
                left -= times * a
                out.append((tuple(filling), times))
        if left.sum() > 0.9 * before:
            break
    return out + best_fit(left, capacity)


def _slots(fillings: list[Filling]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of slots."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for filling, times in fillings:
        offset = 0
        for length in filling:
            runs.setdefault(length, []).append((taken.get(length, 0), first, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        first += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in runs.items()}


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The place of each piece of each row of ``docs``.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    A null or empty text is the end id alone.  Rows that repeat an id are
    packed each; a null id stays null; an empty table packs nothing.  Other
    columns are not read.  Every row is packed whole: no cap, no sample.
    """
    path = path or bpe.default_path()
    spark = docs.sparkSession
    cut = stored(pieces(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), capacity, end_id, path), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    slots = spark.sparkContext.broadcast(_slots(plan(counts, capacity)))

    buckets = F.array(*(F.lit(max(1, math.ceil(c / max(RANKED, math.isqrt(c))))) for c in counts.tolist()))
    placed = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.element_at(buckets, F.col("length").cast("int") + 1)).cast("int"))
    sums = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1).join(sums, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).cast("long").alias("rank"))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length).tolist():
                at = np.flatnonzero(length == one)
                lows, firsts, offsets = table[one]
                k = np.searchsorted(lows, rank[at], "right") - 1
                sequence[at], offset[at] = firsts[k] + rank[at] - lows[k], offsets[k]
            yield record_batch(schema, *batch.columns[:5], sequence, offset)

    return ranked.mapInArrow(place, ", ".join(f"{f.name} long" for f in schema))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the pieces of all ``documents``; nulls and odd rows as in :func:`pack`."""
    return pack(table(spark, sf_dir, "documents"))
