"""How filters act on each other, in every order (operator 12).

A packed bitmap index: each task holds its rows as bitsets, one for each
filter, each label and the rows themselves, with the rows of a part in bytes of
their own.  AND-NOT with the filters of a subset and a count of the bits give
the rows of each part that these filters leave.  The counts of all tasks are
summed, and every figure of every order is a difference of two such counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.storage import Scratch

from .common import record_batch, table, text_chunks

#: The filters of :func:`text_failures`; filter number i is bit i of a row's mask.
FILTERS = "ABCDE"
#: Rows of one bitmap, and bytes of text whose words are held at once.
BLOCK_ROWS = 1 << 16
WORD_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS = bytes(range(65, 91))
_SIGNS = b"#$%&*|"


def word_counts(text: bytes, limit: int = WORD_BYTES) -> tuple[int, int]:
    """Words and different words.  Long texts are read in pieces that end at white space."""
    if len(text) <= limit:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        end = _SPACE.search(text, at + limit)
        words = text[at : end.start() if end else len(text)].split()
        n, at = n + len(words), end.end() if end else len(text)
        seen.update(words)
    return n, len(seen)


def _text_mask(text: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    n, distinct = word_counts(text)
    points = len(text.decode())
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text) - len(text.translate(None, _SIGNS))
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | (signs > 0) << 3


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])
    for part, texts in text_chunks(batches):
        masks = np.fromiter(map(_text_mask, texts), np.int32, len(texts))
        yield record_batch(schema, part.column(0), part.column(1), masks, [hashlib.blake2b(t, digest_size=16).digest() for t in texts])


def text_failures(docs: DataFrame, labels: DataFrame, scratch: Scratch, part: str = "source") -> DataFrame:
    """``part, mask, good, toxic`` of every row of ``docs``: the bits of the filters A to E it fails, and its labels.

    A: under 50 words.  B: 100 * different words < 65 * words.  C: 100 * letters
    A-Z > 5 * code points.  D: any of ``#$%&*|``.  E: the text of a row with a
    smaller doc_id.  A null text is empty, a null part an empty text.  Texts are
    told apart by 128 bits.  Rows without a doc_id never fail E, are nobody's
    first copy and have no label; rows that repeat a doc_id are not each
    other's copies.  A label counts if any row of ``labels`` of that doc_id has
    it.  Words are counted over whole texts, and of a text longer than a
    mebibyte only the different words are held at once.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), docs["text"].alias("text"))
    rows = scratch.put(rows.mapInArrow(_measure, "id long, part string, mask int, digest binary"), "measured")
    copies = rows.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("digest", "low")
    known = labels.groupBy(labels["doc_id"].cast("long").alias("id")).agg(F.max(labels["quality"] == 1).alias("good"), F.max(labels["toxic"] == 1).alias("toxic"))
    joined = rows.join(copies, "digest", "left").join(known, "id", "left")
    copied = F.when(F.col("id") > F.col("low"), 1 << FILTERS.index("E")).otherwise(0)
    no = F.lit(False)
    return joined.select("part", F.col("mask").bitwiseOR(copied).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


class Bitmaps:
    """Bitsets of a block of rows; ``parts`` are its different parts, each with bytes of its own."""

    def __init__(self, parts: np.ndarray, masks: np.ndarray, labels: list[np.ndarray], n_filters: int) -> None:
        self.parts, of, sizes = np.unique(parts, return_inverse=True, return_counts=True)
        n_bytes = (sizes + 7) // 8
        self.starts = np.cumsum(n_bytes) - n_bytes
        order = np.argsort(of, kind="stable")
        place = np.empty(len(of), np.int64)
        place[order] = np.arange(len(of)) + np.repeat(8 * self.starts - (np.cumsum(sizes) - sizes), sizes)
        self.length = 8 * int(n_bytes.sum())

        def packed(rows: np.ndarray) -> np.ndarray:
            bits = np.zeros(self.length, np.uint8)
            bits[place] = rows
            return np.packbits(bits)

        self.present = packed(np.ones(len(of), bool))
        self.fails = [packed(masks >> i & 1) for i in range(n_filters)]
        self.labels = [packed(x) for x in labels]

    def _count(self, bits: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.starts)

    def left(self) -> np.ndarray:
        """By subset of the filters, by part: the rows that no filter of the subset removes, then those of each label."""
        alive = [self.present]
        for subset in range(1, 1 << len(self.fails)):
            last = subset.bit_length() - 1
            alive.append(alive[subset ^ 1 << last] & ~self.fails[last])
        return np.array([[self._count(x), *(self._count(x & label) for label in self.labels)] for x in alive]).transpose(0, 2, 1)


def _indexed(n_filters: int, block_rows: int):
    schema = pa.schema([("part", pa.string()), ("subset", pa.int32()), ("kept", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(block: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(block)
            parts, masks, good, toxic = (whole.column(i).to_numpy() for i in range(4))
            bitmaps = Bitmaps(parts, masks, [good.astype(bool), toxic.astype(bool)], n_filters)
            left = bitmaps.left()
            subsets = np.repeat(np.arange(len(left), dtype=np.int32), len(bitmaps.parts))
            return record_batch(schema, pa.array(np.tile(bitmaps.parts, len(left)), pa.string()), subsets, *np.ascontiguousarray(left.reshape(-1, 3).T))

        block, n = [], 0
        for batch in batches:
            if block and n + batch.num_rows > block_rows:
                yield counted(block)
                block, n = [], 0
            if batch.num_rows:
                block, n = [*block, batch], n + batch.num_rows
        if block:
            yield counted(block)

    return index


def _reported(filters: str):
    """From the counts of all subsets of a part to its rows: one for each order and step."""
    orders = ["".join(p) for p in permutations(filters)]
    n = len(filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    letters = np.array([[bit[f] for f in order] for order in orders])
    after = np.bitwise_or.accumulate(letters, axis=1)
    before, letter, after = (after ^ letters).ravel(), letters.ravel(), after.ravel()
    every = (1 << n) - 1
    times = np.array([factorial(s.bit_count()) * factorial(max(0, n - 1 - s.bit_count())) for s in range(every + 1)])  # orders with just the filters s first, then a given one
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((x, pa.int64()) for x in names)])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, subsets, *counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                kept, good, toxic = (np.array(c)[np.argsort(subsets)] for c in counts)
                fails = kept[0] - kept[letter]
                removed = kept[before] - kept[after]
                shares = {b: sum(int(times[s]) * int(kept[s] - kept[s | b]) for s in range(every + 1) if not s & b) for b in bit.values()}
                yield record_batch(
                    schema, [part] * len(letter), np.repeat(orders, n), np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)), kept[after], removed, fails - removed,
                    kept[every ^ letter] - kept[every], good[before] - good[after], toxic[before] - toxic[after], [shares[b] for b in letter.tolist()],
                )

    return report, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'int' if f.type == pa.int32() else 'long'}" for f in schema)


def filter_audit(failures: DataFrame, filters: str = FILTERS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What each filter does at each step of every order, within each part.

    ``failures`` has ``part, mask, good, toxic``; bit i of the mask is set in
    rows that fail the filter ``filters[i]``, one letter each, up to eight.  Gives ``part,
    filter_order, step`` and counts of the part's rows: ``kept`` after the
    step, ``removed`` by it, ``redundant`` (they fail its filter, an earlier one has removed
    them), ``unique_fails`` (they fail its filter alone), ``good_lost`` and
    ``toxic_lost`` (removed here with that label), ``shapley`` (the filter's removed over
    all orders).  Nulls count as an empty part, no failure and no label; repeated rows
    count each; an empty table gives no rows.  A task holds the bitmaps of ``block_rows`` rows;
    it sends 32 rows (of five filters) for each part in it.
    """
    if not 1 <= len(filters) <= 8 or len(set(filters)) < len(filters):
        raise ValueError(f"one to eight different letters, not {filters!r}")
    no = F.lit(False)
    rows = failures.select(F.coalesce("part", F.lit("")).alias("part"), F.coalesce("mask", F.lit(0)).cast("int").alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    counts = ("kept", "good", "toxic")
    left = rows.mapInArrow(_indexed(len(filters), block_rows), "part string, subset int, kept long, good long, toxic long")
    summed = left.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in counts))
    columns = ("subset", *counts)
    wide = summed.groupBy("part").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_all"))  # 32 of five filters
    report, result = _reported(filters)
    return wide.select("part", *(F.col(f"_all.{c}").alias(c) for c in columns)).mapInArrow(report, result)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over whole ``documents``, for each source; nulls and odd rows as in :func:`text_failures`."""
    return filter_audit(text_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch()))


#: Row by row, without subsets: each document meets each step of each order.
SQL = r"""
WITH told AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low
    FROM documents
), masks AS (
    SELECT doc_id, part,
        CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN low < doc_id THEN 16 ELSE 0 END AS mask
    FROM told
), known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), groups AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask
), letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1 : step - 1]), 0)::BIGINT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
    SELECT part, filter_order, step, b,
        coalesce(sum(n) FILTER (WHERE mask & (before | b) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & b <> 0), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & b <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = b), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & b <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & b <> 0), 0) AS toxic_lost
    FROM groups, steps GROUP BY part, filter_order, step, b
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM counted
"""
