"""Greedy grouping of captures into bursts.

A capture joins the burst of the capture before it, in the order of time,
sequence and path, if the camera is the same, both the gap and the time since
the burst began are within their limits, and the two look alike.  All but the
time since the beginning compares two neighbours, so the captures are sorted by
ranges and each task compares its own, in the pass in which they are written.
Behind its first break a range needs nothing from before.  For the captures up
to that break it tells, for every moment at which a burst may begin there, when
the last one before their end began and how many there are; from these tables
and the ends of the ranges follows, range by range, what each takes over.  So a
chain of any length is cut by all tasks at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from framewise.functions.vectors import sequence_number
from framewise.operators.ordering import AT, PART, Ordered
from framewise.storage import SHORT_ROWS, let_workers_import, stored


@dataclass(frozen=True)
class BurstRules:
    """Seconds between neighbours and within a burst, most differing hash bits, and least similarity (one of the two is enough)."""

    window: float = 2.0
    duration: float = 10.0
    hash_bits: int = 8
    similarity: float = 0.88

    def __post_init__(self) -> None:
        if self.window < 0 or self.duration < self.window or self.hash_bits < 0 or not 0 <= self.similarity <= 1:
            raise ValueError(f"impossible burst rules: {self}")

    def looser(self) -> BurstRules:
        return replace(self, window=self.window * 2, duration=self.duration * 2, hash_bits=min(64, self.hash_bits + 2), similarity=max(0.0, round(self.similarity - 0.04, 9)))

    def tighter(self) -> BurstRules:
        return replace(self, window=self.window / 2, duration=self.duration / 2, hash_bits=max(0, self.hash_bits - 2), similarity=min(1.0, round(self.similarity + 0.04, 9)))


def in_capture_order(df: DataFrame) -> tuple[DataFrame, list]:
    """The captures with what they are ordered by, and these keys: time, numbers of the sequence before texts, path.

    The keys are columns, as a sort makes an expression anew for each two rows that it compares.
    """
    text = F.coalesce("sequence_number", F.lit(""))
    rows = df.withColumn("_seq", sequence_number(text)).withColumn("_seq_text", F.when(F.col("_seq").isNull(), F.lower(text)))
    return rows, [F.col("ts_us"), F.col("_seq").asc_nulls_last(), F.col("_seq_text"), F.col("path_key")]


#: The time of a capture that has none; it is alone in its burst.
_NEVER = -(1 << 62)


def _hop(now: np.ndarray, n: np.ndarray, times: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """When the last burst began and how many there are, for each of the beginnings ``now``, after the captures of ``times``."""
    now, n, open_ = now.copy(), n.copy(), np.arange(len(now))
    while len(open_):
        at = np.searchsorted(times, now[open_] + limit, "right")
        open_, at = open_[at < len(times)], at[at < len(times)]
        now[open_], n[open_] = times[at], n[open_] + 1
    return now, n


class Lead:
    """The captures of a range up to its first break, as a function of when the burst before them began.

    It holds the moments within one burst's duration of the first capture, and the next one.
    """

    def __init__(self) -> None:
        self.entries, self.last, self.n = (np.zeros(0, np.int64) for _ in range(3))
        self.full = False

    def add(self, times: np.ndarray, limit: int) -> None:
        new = np.zeros(0, np.int64)
        if len(times) and not self.full:
            first = self.entries[0] if len(self.entries) else times[0]
            stop = int(np.searchsorted(times, first + limit, "right"))
            self.full = stop < len(times)
            new = np.setdiff1d(times[: stop + 1], self.entries)
        self.entries = np.concatenate([self.entries, new])
        self.last, self.n = _hop(np.concatenate([self.last, new]), np.concatenate([self.n, np.ones(len(new), np.int64)]), times, limit)

    def after(self, began: int, broken: bool, limit: int) -> tuple[int, int]:
        """When the last burst began at its end, and how many have begun, if one began at ``began`` before it; or, ``broken``, with its first capture."""
        at = 0 if broken else int(np.searchsorted(self.entries, began + limit, "right"))
        return (int(self.last[at]), int(self.n[at])) if at < len(self.entries) else (began, 0)


def _starts(times: np.ndarray, breaks: np.ndarray, began: int, limit: int) -> tuple[np.ndarray, int]:
    """Which captures begin a burst, and when the last one began; one began at ``began`` before them."""
    starts = breaks.astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(breaks), [len(times)]])
    edges = edges[np.append(edges[1:] > edges[:-1], True)]  # the first chain may have no row here
    first, behind = edges[:-1], edges[1:]
    begins = np.where(breaks[first], times[first], began)
    for chain in np.flatnonzero(times[behind - 1] > begins + limit).tolist():  # the others are one burst each
        at, b, now = int(first[chain]), int(behind[chain]), int(begins[chain])
        while (at := at + int(np.searchsorted(times[at:b], now + limit, "right"))) < b:
            now, starts[at] = int(times[at]), 1
        begins[chain] = now
    return starts, int(begins[-1]) if len(begins) else began


_LOOKS = ("ts_us", "camera_serial", "camera_model", "phash", "embedding")


def _coded(names: pa.DictionaryArray) -> tuple[np.ndarray, list[str]]:
    """A number for each row's name, -1 for the empty one, and the names."""
    words, codes = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)
    return (np.where(codes == words.index(""), -1, codes) if "" in words else codes), words


class _Looks:
    """What neighbours are compared by, of some captures in order."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        self.times = column("ts_us").fill_null(_NEVER).to_numpy(zero_copy_only=False)
        self.cameras = [_coded(column(c).fill_null("").dictionary_encode()) for c in ("camera_serial", "camera_model")]
        self.hashed = column("phash").is_valid().to_numpy(zero_copy_only=False)
        self.hash = column("phash").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        self.vectors = column("embedding")

    def end(self, i: int) -> tuple:
        return int(self.times[i]), [words[codes[i]] if codes[i] >= 0 else "" for codes, words in self.cameras], bool(self.hashed[i]), int(self.hash[i]), self.vectors[i].as_py()

    def breaks(self, rules: BurstRules) -> np.ndarray:
        """Whether each capture but the first can't be in the burst of the one before it."""
        serial, model = (codes for codes, _ in self.cameras)
        near = (self.times[:-1] != _NEVER) & (np.diff(self.times) <= round(rules.window * 1e6))
        decided = (serial[1:] >= 0) & (serial[:-1] >= 0)
        models = (model[1:] >= 0) & (model[:-1] >= 0)
        near &= np.where(decided, serial[1:] == serial[:-1], ~models | (model[1:] == model[:-1]))
        alike = near & self.hashed[1:] & self.hashed[:-1] & (np.bitwise_count(self.hash[1:] ^ self.hash[:-1]) <= rules.hash_bits)
        ask = np.flatnonzero(near & ~alike)  # the products are left to pairs that the cheap tests have not decided
        alike[ask[_products(self.vectors, ask) >= rules.similarity]] = True
        return ~alike


def _products(vectors: pa.Array, first: np.ndarray) -> np.ndarray:
    """Inner products of the vectors at ``first`` with the next ones; NaN where one is null, holds a null, or is of another length."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = np.full(len(first), np.nan)
    fits = (sizes[first] == sizes[first + 1]) & (sizes[first] >= 0)
    for size in np.unique(sizes[first[fits]]):
        at = np.flatnonzero(fits & (sizes[first] == size))
        one, other = (values[begin[first[at] + k][:, None] + np.arange(size)] for k in (0, 1))
        out[at] = (one * other).sum(1)
    return out


def _of(end: tuple, schema: pa.Schema) -> pa.RecordBatch:
    """One capture, from what :meth:`_Looks.end` has told of it."""
    time, (serial, model), hashed, hash_, vector = end
    fields = dict(zip(_LOOKS, (time, serial, model, np.uint64(hash_).view(np.int64).item() if hashed else None, vector)))
    return pa.RecordBatch.from_arrays([pa.array([fields[c]], schema.field(c).type) for c in _LOOKS], names=list(_LOOKS))


def _mark(rules: BurstRules, columns: list[str]):
    """The captures of a range with ``_n``, how many bursts have begun since its first break (null before it), and a last row with all that the next ranges need."""
    limit = round(rules.duration * 1e6)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, schema, part = None, None, None, 0
        lead, began, n = Lead(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            looks = batch.select(list(_LOOKS))
            whole = looks if before is None else pa.Table.from_batches([before, looks]).combine_chunks().to_batches()[0]
            seen = _Looks(whole)
            breaks = seen.breaks(rules)
            if before is None:
                first, part = seen.end(0), batch.column(schema.get_field_index(PART))[0].as_py()
                breaks = np.append(False, breaks)
            times = seen.times[-batch.num_rows :]
            cut = 0
            if began is None:
                cut = int(np.argmax(breaks)) if breaks.any() else len(breaks)
                lead.add(times[:cut], limit)
            numbers = np.zeros(len(times), np.int64)
            if cut < len(times):
                starts, began = _starts(times[cut:], breaks[cut:], 0 if began is None else began, limit)
                numbers[cut:] = n + np.cumsum(starts)
                n = int(numbers[-1])
            none = np.arange(len(times)) < cut
            yield pa.RecordBatch.from_arrays([*(batch.column(schema.get_field_index(c)) for c in (*columns, PART, AT, "_time")), pa.array(numbers, mask=none), pa.nulls(len(times), pa.binary())], names=[*columns, PART, AT, "_time", "_n", "_end"])
            before = looks.slice(batch.num_rows - 1)
        if schema is not None:
            end = pickle.dumps((first, _Looks(before).end(0), lead, began, n))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, schema.field(c).type) for c in columns), pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([end], pa.binary())], names=[*columns, PART, AT, "_time", "_n", "_end"])

    return mark


def _compose(rules: BurstRules, schema: pa.Schema):
    """What each range takes over: whether its first capture breaks with the last one before, when the burst began, how many bursts there are before it and before its first break."""
    limit = round(rules.duration * 1e6)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, began, n = None, 0, 0
        for batch in batches:
            out = []
            for part, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first, after, lead, own, more = pickle.loads(end)
                pair = [] if last is None else [pa.Table.from_batches([_of(last, schema), _of(first, schema)]).combine_chunks().to_batches()[0]]
                broken = not pair or bool(_Looks(pair[0]).breaks(rules)[0])
                now, starts = lead.after(began, broken, limit)
                out.append((part, broken, began, n, n + starts))
                began, n, last = (now if own is None else own), n + starts + more, after
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()))] if out else [pa.array([], t) for t in (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())], names=[PART, "_broken", "_began", "_before", "_behind"])

    return compose


def _cut_leads(limit: int):
    """``_id`` of the captures before the first break of a range, from what it takes over."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, began, n = None, 0, 0
        for batch in batches:
            parts, times, broken, taken, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4, 5))
            ids = np.zeros(len(parts), np.int64)
            edges = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(parts)) if len(parts) else []
            for a, b in zip(edges, edges[1:]):
                breaks = np.zeros(b - a, bool)
                if parts[a] != part:
                    part, began, n, breaks[0] = parts[a], int(taken[a]), int(count[a]), broken[a]
                starts, began = _starts(times[a:b], breaks, began, limit)
                ids[a:b] = n + np.cumsum(starts)
                n = int(ids[b - 1])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids)], names=[AT, "burst_id"])

    return cut


def group_bursts(captures: DataFrame, rules: BurstRules | None = None, without: tuple[str, ...] = (), vectors: DataFrame | None = None) -> DataFrame:
    """``captures`` with ``burst_id``, from 1 in capture order, but not its columns ``without``.

    Needs ``ts_us, sequence_number, path_key, camera_serial, camera_model,
    phash, embedding``.  A null hash or embedding is like no other; a capture
    without a time is a burst of its own.  One sort by ranges and one pass over the
    captures, which writes them; what ranges tell one another is one row for each.

    Where captures share embeddings, these may come as ``vectors`` (``vec_id, embedding``,
    one row each, few enough to be broadcast) and captures have a ``vec_id`` instead;
    then no embedding is shuffled or sorted.
    """
    rules, spark = rules or BurstRules(), captures.sparkSession
    let_workers_import(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in captures.columns if c not in without]
    rows, keys = in_capture_order(captures)
    ready = rows.withColumns({"ts_us": F.col("ts_us").cast("long"), "phash": F.col("phash").cast("long")})
    in_order = ready.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    in_order = in_order.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id(), "_time": F.coalesce("ts_us", F.lit(_NEVER))})
    if vectors is not None:
        in_order = in_order.join(F.broadcast(vectors.select("vec_id", "embedding")), "vec_id", "left")  # rows stay in order
    in_order = in_order.select(*dict.fromkeys((*columns, *_LOOKS, PART, AT, "_time")))
    kinds = StructType([*(in_order.schema[c] for c in (*columns, PART, AT, "_time")), StructField("_n", LongType()), StructField("_end", BinaryType())])
    kinds = StructType([StructField(f.name, f.dataType) for f in kinds])
    marked = stored(in_order.mapInArrow(_mark(rules, columns), kinds), "captures", SHORT_ROWS)
    looks = to_arrow_schema(in_order.select(*_LOOKS).schema)
    ends = marked.where("_end is not null").select(PART, "_end").repartition(1).sortWithinPartitions(PART)
    taken = stored(ends.mapInArrow(_compose(rules, looks), f"{PART} int, _broken boolean, _began long, _before long, _behind long"), "ranges")
    known = marked.where("_n is not null").join(F.broadcast(taken.select(PART, "_behind")), PART)
    known = known.withColumn("burst_id", F.col("_behind") + F.col("_n")).select(*columns, "burst_id")
    lead = marked.where("_n is null and _end is null")
    late = lead.select(PART, AT, "_time").join(F.broadcast(taken), PART).select(PART, AT, "_time", "_broken", "_began", "_before")
    late = late.repartition(n, PART).sortWithinPartitions(PART, AT).mapInArrow(_cut_leads(round(rules.duration * 1e6)), f"{AT} long, burst_id long")
    return known.union(lead.join(late, AT).select(*columns, "burst_id"))


def ungrouped(captures: DataFrame) -> DataFrame:
    """Each capture its own burst, numbered by time and path."""
    return Ordered(captures, "ts_us", "path_key", name="ungrouped").row_number("burst_id")


def burst_stats(grouped: DataFrame) -> DataFrame:
    """``burst_size`` and ``relative_focus_factor``, the focus as a share of the burst's best (1 where that is 0)."""
    burst = Window.partitionBy("burst_id")
    focus = F.when(F.isnan("focus_score") | F.col("focus_score").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), "focus_score"))
    best = F.max(focus).over(burst)
    return grouped.withColumns({"burst_size": F.count("*").over(burst), "relative_focus_factor": F.when(best > 0, focus / best).otherwise(F.lit(1.0))})
