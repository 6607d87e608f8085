"""Exact Jaccard join of documents on word shingles (operator 8).

A size-aware heavy-light join.  A document's set is ordered by one global
order, common shingles last, and cut to the prefix in which two similar sets
must meet.  Light sets (at most ``boundary`` shingles) enumerate the two-element
subsets of their prefix; any two similar light sets have one in common.  Heavy
sets scan inverted lists of the single elements of their prefix, in which also
those light sets are entered that are large enough to be their partners.  The
boundary is where the estimated rows of both kinds are fewest.

Two sets that reach the similarity t share at least k elements of their first
``n - ceil(t n) + k``; the join uses k = 1 + n // ``SPARE`` for heavy sets, so a
few chance meetings make no candidate, and k = 2 for light ones.

Documents with the same set are one node.  Links are first sought between each
node and the most central node of its lists.  Then every pair that may be
similar and is not yet in one component is compared: pairs around one centre by
what they share beyond it, other pairs by their keys.  So the components are
exact, and a large group of copies is never expanded into its pairs.

The order of shingles rests on counts over all documents, however these are
dealt to files and tasks.  A set is told by a 64-bit hash; among n different
sets, two have the same with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framewise.storage import Scratch

from .common import fresh, record_batch, table, text_chunks
from .components import connected_components
from .spans import Spans, U, _rolling, mix

#: Shingles, and documents, of a block, within which keys are counted before they are shuffled.
BLOCK, BLOCK_ROWS = 1 << 19, 1 << 16
#: Shingles of so many sets are common; so many of them are told to all tasks at most, the most frequent.
COMMON, TOLD = 24, 1_000_000
#: Lower bits that are cut from a shingle's hash for the count, and entries that one task counts.
CUT, COUNTED = 24, 4_000_000
#: One element in so many is spared to demand a further common key.
SPARE = 20
#: Sets of more shingles are heavy in any case.
LIGHT = 40
#: Rows that a meeting of two sets under one key costs, by the pair and its comparison, where one entry costs one.
MEETING = 8
#: First tokens of a set by which a pair that has met before is told.
HEADS = 16
#: Outer shingles that become rows at once.
OUTER = 1 << 17
#: Keys that one task compares.
RANGE = 1_000_000
#: Bits, as a power of two, that mark the documents whose sets are built; a bound on what is broadcast.
MARKS = 27


@dataclass(frozen=True)
class Similarity:
    """Two sets link where ``100 * intersection >= percent * union``; shingles have ``words`` words."""

    percent: int = 75
    words: int = 5

    def least(self, n):
        """The least intersection of a set of ``n`` with any similar set."""
        return -(-self.percent * n // 100)

    def need(self, n: Column, m: Column) -> Column:
        """The least intersection of similar sets of ``n`` and ``m``."""
        return F.ceil(self.percent * (n + m) / (100 + self.percent))

    def links(self, both: int, n: int, m: int) -> bool:
        return 100 * both >= self.percent * (n + m - both)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    s = Spans.of(texts, lower=True)
    hashes = s.word_hashes()
    at, keys = s.windows(hashes, words)
    n_windows = np.bincount(s.doc[at], minlength=len(texts)) if len(at) else np.zeros(len(texts), np.int64)
    stops = np.cumsum(n_windows)
    sets = [np.unique(keys[a:b]) for a, b in zip((stops - n_windows).tolist(), stops.tolist())]
    few = np.flatnonzero((s.n_words > 0) & (s.n_words < words))
    if len(few):
        first = np.searchsorted(s.start, s.begin[few])
        whole = mix(_rolling(hashes, first, first + s.n_words[few], "word") ^ (s.n_words[few].astype(np.uint64) * U(0x9E3779B97F4A7C15)))
        for i, h in zip(few.tolist(), whole):
            sets[i] = np.array([h], np.uint64)
    return sets


def node_of(shingles: np.ndarray) -> int:
    """The 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Document ids and sets, in blocks of about ``BLOCK`` shingles, or of ``BLOCK_ROWS`` documents."""
    ids, sets, size = [], [], 0
    for batch, texts in text_chunks(batches):
        ids += batch.column(0).to_pylist()
        sets += (found := shingle_sets(texts, words))
        size += sum(map(len, found))
        if size >= BLOCK or len(ids) >= BLOCK_ROWS:
            yield ids, sets
            ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _surveyed(docs: DataFrame, rule: Similarity) -> DataFrame:
    """What each block has: its nodes with their documents (kind 0), and rows by elements and by subsets for each size of set (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("n", pa.int64()), ("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("elements", pa.int64()), ("subsets", pa.int64())])

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _blocks(batches, rule.words):
            names = [node_of(s) if len(s) else None for s in sets]
            single, holders = dict(zip(names, sets)), {}
            for i, name in zip(ids, names):
                holders.setdefault(name, []).append(i)
            yield pa.RecordBatch.from_pylist([{"kind": 0, "n": len(s), "node": name, "ids": holders[name]} for name, s in single.items()], schema=schema)
            single.pop(None, None)
            if not single:
                continue
            shingles, df = np.unique(np.concatenate(list(single.values())), return_counts=True)
            elements, subsets = np.zeros(LIGHT + 1, np.int64), np.zeros(LIGHT + 1, np.int64)
            small = [s for s in single.values() if 3 <= len(s) <= LIGHT]
            own = [(s[np.argsort(df[np.searchsorted(shingles, s)], kind="stable")], *_subset_keys(s, df[np.searchsorted(shingles, s)], rule)) for s in small]
            pairs, pair_df = np.unique(np.concatenate([k[1] for k in own]), return_counts=True) if own else (None, None)
            for s, keys in own:
                first = s[: len(s) - rule.least(len(s)) + 1]
                elements[len(s)] += len(first) + MEETING * int((df[np.searchsorted(shingles, first)] - 1).sum())
                subsets[len(s)] += len(keys) + MEETING * int((pair_df[np.searchsorted(pairs, keys)] - 1).sum())
            sizes = np.flatnonzero(subsets).tolist()
            yield pa.RecordBatch.from_pylist([{"kind": 1, "n": n, "elements": int(elements[n]), "subsets": int(subsets[n])} for n in sizes], schema=schema)

    return docs.mapInArrow(survey, "kind int, n long, node long, ids array<long>, elements long, subsets long")


def _upper(hashes: np.ndarray) -> bytes:
    """The upper five bytes of each hash."""
    return (hashes >> U(CUT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_upper(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def _common(docs: DataFrame, rule: Similarity, entries: int) -> DataFrame:
    """``token, total``: the upper bits of the shingles that ``COMMON`` sets or more have, of about ``entries`` shingles.

    Sets are counted once a block, and over all blocks: each sends its counts
    packed by range, so a shingle of every document takes one entry a block in
    the task that sums it.
    """
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries / COUNTED))
    packed = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _blocks(batches, rule.words):
            single = {node_of(s): s for s in sets if len(s)}
            if not single:
                continue
            shingles, df = np.unique(np.concatenate(list(single.values())), return_counts=True)
            part = ((shingles >> U(32)) * U(ranges) >> U(32)).astype(np.int64)  # in order
            edges = np.searchsorted(part, np.arange(ranges + 1)).tolist()
            keys, counts = _upper(shingles), df.clip(max=65535).astype("<u2").tobytes()
            rows = [(i, keys[5 * a : 5 * b], counts[2 * a : 2 * b]) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            for a in range(0, len(rows), 256):
                yield record_batch(packed, *zip(*rows[a : a + 256]))

    out = pa.schema([("token", pa.int64()), ("total", pa.int64())])

    def total(group: pa.Table) -> pa.Table:
        keys = _from_upper(b"".join(group.column("keys").to_pylist()))
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), "<u2")
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums = np.add.reduceat(counts, first)
        often = sums >= COMMON
        return pa.table([keys[first][often].astype(np.int64), sums[often]], schema=out)

    sent = docs.mapInArrow(split, "range int, keys binary, counts binary")
    return sent.repartition(ranges, "range").groupBy("range").applyInArrow(total, "token long, total long")


def boundary_of(costs: dict[int, tuple[int, int]], rule: Similarity) -> int:
    """The largest size of a light set: where the rows of subsets and elements together are fewest."""

    def rows(b: int) -> int:
        return sum(subset * (n <= b) + element * (n >= rule.least(b + 1)) for n, (element, subset) in costs.items())

    return min(range(2, LIGHT + 1), key=rows)


def _subset_keys(shingles: np.ndarray, count: np.ndarray, rule: Similarity) -> list[np.ndarray]:
    return _keys(shingles, count, len(shingles), rule)[:1]


def _keys(shingles: np.ndarray, count: np.ndarray, boundary: int, rule: Similarity) -> list[np.ndarray]:
    """Keys of a set: odd ones for subsets, even ones for elements.  ``count`` is above 0 for common shingles."""
    n = len(shingles)
    if n < 3 and rule.percent > 66:  # only an equal set is similar
        return []
    if count.any():
        shingles = shingles[np.lexsort((shingles, count))]
    p, out = n - rule.least(n), []
    if n <= boundary:
        first = np.sort(shingles[: p + 2])
        i, j = np.triu_indices(len(first), 1)
        out.append(mix(mix(first[i]) + first[j]) | U(1))
    if n >= rule.least(boundary + 1):
        out.append(mix(shingles[: p + 1 + n // SPARE] + U(1)) & ~U(1))
    return out


def _met(docs: DataFrame, rule: Similarity, boundary: int, common: DataFrame, ranges: int) -> DataFrame:
    """``key, node`` for keys that more than one node has; nodes that several blocks hold repeat.

    Each block sends each of its keys once, packed by range of keys; the other
    entries of a key that meets within the block go along without a comparison,
    to any task.  So a key that a third of all documents hold takes one entry a
    block in the task that compares it.
    """
    spark = docs.sparkSession
    told = common.toArrow()
    tokens = told.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    known = spark.sparkContext.broadcast((tokens[order], told.column("total").to_numpy()[order]))
    packed = pa.schema([("range", pa.int32()), ("compare", pa.bool_()), ("keys", pa.binary()), ("nodes", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, totals = known.value
        turn = TaskContext.get().partitionId()
        for _, sets in _blocks(batches, rule.words):
            single = {node_of(s): s for s in sets if len(s)}
            if not single:
                continue
            every = np.concatenate(list(single.values()))
            count = np.zeros(len(every), np.int64)
            if len(tokens):
                upper = every >> U(CUT)
                i = np.searchsorted(tokens, upper).clip(max=len(tokens) - 1)
                count = np.where(tokens[i] == upper, totals[i], 0)
            keys, names, at = [], [], 0
            for name, s in single.items():
                own = _keys(s, count[at : at + len(s)], boundary, rule)
                at += len(s)
                for k in own:
                    keys.append(k)
                    names.append(np.full(len(k), name, np.int64))
            if not keys:
                continue
            keys, names = np.concatenate(keys), np.concatenate(names)
            order = np.argsort(keys, kind="stable")
            keys, names = keys[order], names[order]
            again = np.append(False, keys[1:] == keys[:-1])
            meets = again | np.append(again[1:], False)
            part = ((keys >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
            rows = []
            first = ~again
            p, k, m = part[first], keys[first], names[first]
            cuts = np.flatnonzero(np.diff(p)) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(p)).tolist()):
                rows.append((int(p[a]), True, k[a:b].tobytes(), m[a:b].tobytes()))
            for a in range(0, int(meets.sum()), 1 << 16):
                turn += 1
                one = np.flatnonzero(meets)[a : a + (1 << 16)]
                rows.append((turn % ranges, False, keys[one].tobytes(), names[one].tobytes()))
            for a in range(0, len(rows), 256):
                yield record_batch(packed, *zip(*rows[a : a + 256]))

    out = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        found = []
        for same in (True, False):
            of = group.filter(pa.array(np.asarray(group.column("compare")) == same))
            if not of.num_rows:
                continue
            keys, names = (np.frombuffer(b"".join(of.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("nodes", np.int64)))
            if same:
                order = np.argsort(keys, kind="stable")
                keys, names = keys[order], names[order]
                again = np.append(False, keys[1:] == keys[:-1])
                meets = again | np.append(again[1:], False)
                keys, names = keys[meets], names[meets]
            found.append((keys.view(np.int64), names))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], schema=out)

    sent = docs.mapInArrow(send, "range int, compare boolean, keys binary, nodes binary")
    return sent.repartition(ranges, "range").groupBy("range").applyInArrow(compare, "key long, node long")


def _compared(pairs: DataFrame, sets: DataFrame, rule: Similarity, beyond: bool = False) -> DataFrame:
    """``a, b, n_both, n_a, n_b, linked`` for each of ``pairs(a, b)``.

    ``beyond``: also the shingles of a that b lacks, where they are not more
    than half of a (else null).
    """
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    names = ("a", "b", "n_both", "n_a", "n_b")
    schema = pa.schema([(c, pa.int64()) for c in names] + [("linked", pa.bool_()), ("beyond", pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                in_y = y[np.searchsorted(y, x).clip(max=len(y) - 1)] == x
                n = int(in_y.sum())
                rest = x[~in_y].tobytes() if beyond and 2 * n >= len(x) else None
                rows.append((a, b, n, len(x), len(y), rule.links(n, len(x), len(y)), rest))
            yield record_batch(schema, *(zip(*rows) if rows else [[]] * 7))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set")
    done = both.mapInArrow(compare, ", ".join(f"{c} long" for c in names) + ", linked boolean, beyond binary")
    return done.dropDuplicates(["a", "b"])  # a set may have been built twice


def _around_centres(compared: DataFrame, labels: DataFrame, rule: Similarity, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of one centre, in different components, that may still be similar; and the nodes that must be sought by their keys.

    One of the two, say x, is not similar to the centre.  What x and y share
    within the centre is at most what the lesser of them shares with it, so
    they must share the rest of the intersection they need outside of the
    centre.  Only those outer shingles are joined, and of them only the prefix,
    rarest first, that the need leaves.  A pair is without such a need where
    its sizes are so small beside the centre that what they share within it may
    do; nodes that have a size of such a partner among the centre's nodes, as
    short texts that a long one quotes, are told and meet by their own keys.
    """
    need = rule.need
    spokes = compared.where("beyond is not null").select(F.col("a").alias("node"), F.col("b").alias("centre"), F.col("n_both").alias("i"), F.col("n_a").alias("n"), "linked", "beyond")
    spokes = spokes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    groups = spokes.groupBy("centre").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("n_low"), F.max(F.when(~F.col("linked"), F.col("i"))).alias("i_high"), F.collect_set("n").alias("sizes")
    )
    groups = groups.where("low <> high and i_high is not null").select("centre", "n_low", "i_high", "sizes")
    n_least = F.greatest(F.col("n_low"), F.ceil(F.col("n") * rule.percent / 100))  # a partner has so many shingles at least
    members = spokes.join(groups, "centre").withColumn("least", need(F.col("n"), n_least) - F.least("i", "i_high"))
    fits = lambda m: (m * 100 >= F.col("n") * rule.percent) & (F.col("n") * 100 >= m * rule.percent) & (need(F.col("n"), m) <= F.least("i", "i_high"))
    members = scratch.put(members.select("centre", "node", "n", "i", "comp", "least", F.exists("sizes", fits).alias("small"), "beyond"), "members")

    names = ("centre", "node", "comp", "n", "i", "size", "keep", "token")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(pc.binary_length(whole.column(6)).to_numpy()) // (8 * OUTER)
            cuts = np.flatnonzero(np.diff(ends, prepend=-1, append=ends[-1:] + 1)) if len(ends) else []
            for a, b in zip(cuts, cuts[1:]):
                batch = whole.slice(a, b - a)
                sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(6)]
                sizes = np.array([len(x) for x in sets], np.int64)
                keep = sizes - np.maximum(batch.column(5).to_numpy(), 1) + 1
                repeat = lambda c: np.repeat(np.asarray(c), sizes)
                yield record_batch(schema, *(repeat(batch.column(k)) for k in range(5)), repeat(sizes), repeat(keep), np.concatenate(sets))

    tokens = members.select("centre", "node", "comp", "n", "i", "least", "beyond").mapInArrow(outer, ", ".join(f"{c} long" for c in names))
    tokens = scratch.put(tokens.where("keep > 0"), "outer")
    df = tokens.groupBy("centre", "token").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    single = tokens.join(df.where("df = 1"), ["centre", "token"], "left_semi").groupBy("node").agg(F.count("*").alias("first"))
    shared = tokens.join(df.where("df > 1"), ["centre", "token"]).join(single, "node", "left")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "token")) + F.coalesce("first", F.lit(0))  # within one set
    shared = shared.withColumn("rank", rank).where("rank <= keep and low <> high")
    # at the first token that two sets share, so many can follow that the pair's own need is met
    shared = shared.withColumn("after", F.col("size") - F.col("rank"))
    # a pair with a common token among the first ones before this has met there already
    shared = shared.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy("rank")))
    heads = F.collect_list(F.when(F.col("turn") <= HEADS, F.struct("turn", "token"))).over(Window.partitionBy("node"))
    shared = shared.withColumn("earlier", F.transform(F.filter(heads, lambda h: h["turn"] < F.col("turn")), lambda h: h["token"]))
    x, y = (shared.select("centre", "token", F.col("node").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("comp", "n", "i", "after", "earlier"))) for c in "ab")
    wanted = need(F.col("n_a"), F.col("n_b")) - F.least("i_a", "i_b")
    fits = (wanted > 0) & (F.col("n_a") * 100 >= F.col("n_b") * rule.percent) & (F.col("n_b") * 100 >= F.col("n_a") * rule.percent) & (F.least("after_a", "after_b") + 1 >= wanted) & ~F.arrays_overlap("earlier_a", "earlier_b")
    outside = x.join(y, ["centre", "token"]).where((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & fits).select("a", "b")

    around = scratch.put(outside.distinct(), "around")
    small = scratch.put(members.where("small").select("node", F.lit(True).alias("small")), "small")
    scratch.drop("members", "outer")
    return around, small


def similar_components(docs: DataFrame, rule: Similarity | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    component_id is the least doc_id that links reach.  Null, empty and blank
    texts have the empty set, link with nothing and are their own component;
    texts of fewer words than a shingle have their whole sequence as one.
    Repeated rows are equal sets, so they share a component; a null doc_id gets
    the component of its equals (null where it has none).  An empty table gives
    no rows; other columns are not read.  Texts are taken whole; no list, group
    or number of candidates is capped.
    """
    rows, of = _components(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), rule or Similarity())
    empty = rows.where("n = 0").select(F.explode("ids").alias("doc_id"), F.col("n").alias("n_shingles")).withColumn("component_id", F.col("doc_id"))
    # copies of one text come as one row a block
    full = rows.where("n > 0").join(of.select("node", "component_id"), "node").select(F.explode("ids").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return full.union(empty)


def _components(docs: DataFrame, rule: Similarity) -> tuple[DataFrame, DataFrame]:
    """Nodes of each block ``node, n, ids``, and all nodes ``node, doc_id`` (the least), ``comp, component_id``.

    Each table between the steps goes after its last reader.
    """
    spark, scratch = docs.sparkSession, Scratch()
    survey = scratch.put(_surveyed(docs, rule), "survey")
    rows = scratch.put(survey.where("kind = 0").select("node", "n", "ids"), "rows")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min(F.array_min("ids")).alias("doc_id"), F.first("n").alias("n"))
    shingles, entries = rows.agg(F.sum("n"), F.sum(F.col("n") * 3 / 10 + 3)).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((entries or 0) / RANGE))

    totals = scratch.put(_common(docs, rule, shingles or 0), "common")
    costs = {r["n"]: (r["e"], r["s"]) for r in survey.where("kind = 1").groupBy("n").agg(F.sum("elements").alias("e"), F.sum("subsets").alias("s")).collect()}
    boundary = boundary_of(costs, rule)
    scratch.drop("survey")
    by_log = {r["b"]: r["n"] for r in totals.groupBy(F.floor(F.log2("total")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    least = COMMON
    while sum(n for b, n in by_log.items() if 2 ** (b + 1) > least) > TOLD:  # a bound on what is broadcast; the order stays one order
        least *= 2

    # each node with the keys that it shares; a partner has three quarters of the size at least, and so demands so many
    met = _met(docs, rule, boundary, totals.where(F.col("total") >= least), ranges)
    demand = F.floor(F.ceil(F.col("n") * rule.percent / 100) / SPARE) + 1
    of_node = met.groupBy("node").agg(F.collect_set("key").alias("keys")).join(nodes, "node")  # of one set
    elements = F.size(F.filter("keys", lambda k: k % 2 == 0))
    able = of_node.where((elements < F.size("keys")) | (elements >= demand))
    able = scratch.put(able.select("node", "doc_id", "n", (F.size("keys") / F.col("n")).alias("share"), "keys"), "able")
    scratch.drop("common")

    # the centre of a list is the node most of whose keys are shared
    lists = able.select("node", "share", F.explode("keys").alias("key"))
    centres = lists.groupBy("key").agg(F.max(F.struct("share", "node")).alias("c"), F.count("*").alias("df")).where("df > 1").select("key", F.col("c.node").alias("centre"))
    spokes = lists.join(centres, "key").where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("shared"))
    best = scratch.put(spokes.groupBy("node").agg(F.max_by("centre", F.struct("shared", "centre")).alias("centre")), "best")
    sets = scratch.put(_sets(docs, able.select("node", "doc_id"), rule), "sets")
    compared = scratch.put(_compared(best.select(F.col("node").alias("a"), F.col("centre").alias("b")), sets, rule, beyond=True), "compared")
    scratch.drop("best")
    first = scratch.put(compared.where("linked").select("a", "b"), "first")
    labels = connected_components(first, scratch, "begun")

    # pairs that are not yet connected: around one centre, and others that share enough keys
    around, small = _around_centres(compared, labels, rule, scratch)
    of_centre = compared.where("beyond is not null").select(F.col("a").alias("node"), F.col("b").alias("centre"), F.col("n_both").alias("i"))
    marked = able.join(labels, "node", "left").join(of_centre, "node", "left").join(small, "node", "left")
    marked = marked.select("node", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("centre", "node").alias("centre"), F.coalesce("i", "n").alias("i"), F.when(F.col("small"), F.col("node")).otherwise(F.coalesce("centre", "node")).alias("group"), "keys")
    marked = scratch.put(marked, "marked")
    scratch.drop("able", "compared", "begun", "small")
    entered = marked.select("node", "n", "comp", "centre", "i", "group", F.explode("keys").alias("key"))
    by_comp = entered.groupBy("key", "comp").agg(F.min("group").alias("one"), F.max("group").alias("other"), F.count("*").alias("n"))
    open_keys = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), F.min("one").alias("one"), F.max("other").alias("other"), F.sum("n").alias("df"))
    open_keys = open_keys.where("comps > 1 and one <> other").select("key", "main", "df")
    rest = scratch.put(entered.join(open_keys, "key").withColumn("outer", F.col("comp") != F.col("main")).drop("main"), "open")
    scratch.drop("marked")

    # who shares so many of its keys with another shares one of its rarest, those beyond the demand
    elements = rest.where("key % 2 = 0")
    own = elements.groupBy("node").agg(F.collect_list("key").alias("keys"))  # of one set
    by_rarity = F.row_number().over(Window.partitionBy("node").orderBy("df", "key"))
    spare = F.count("*").over(Window.partitionBy("node")) - demand + 1
    rare = elements.withColumn("rank", by_rarity).withColumn("spare", spare).where("rank <= spare").drop("rank", "spare")
    # of two in different components, one at least is outside of the largest that its key meets
    sought = rare.union(rest.where("key % 2 <> 0").select(*rare.columns))
    a, b = (sought.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "comp", "centre", "i", "group", "outer"))) for s in "ab")
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * rule.percent) & (F.col("n_b") * 100 >= F.col("n_a") * rule.percent)
    new = (~F.col("outer_b") | (F.col("node_a") < F.col("node_b"))) & (F.col("comp_a") != F.col("comp_b"))
    apart = (F.col("centre_a") != F.col("centre_b")) | (rule.need(F.col("n_a"), F.col("n_b")) <= F.least("i_a", "i_b"))
    untested = (F.col("group_a") != F.col("group_b")) & (F.col("node_a") != F.col("centre_b")) & (F.col("node_b") != F.col("centre_a")) & apart
    met_again = a.where("outer_a").join(b, "key").where(new & untested & sizes).groupBy("node_a", "node_b").agg(
        F.count_if(F.col("key") % 2 != 0).alias("subsets"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")
    )
    a, b = (own.select(F.col("node").alias(f"node_{s}"), F.col("keys").alias(f"keys_{s}")) for s in "ab")
    shared = met_again.join(a, "node_a", "left").join(b, "node_b", "left").withColumn("elements", F.coalesce(F.size(F.array_intersect("keys_a", "keys_b")), F.lit(0)))
    # beyond their common keys, two sets share at most what one of them has after its prefix
    after = lambda n: F.greatest(F.ceil(n * rule.percent / 100) - 1 - F.floor(n / SPARE), F.lit(0))
    needed = rule.need(F.col("n_a"), F.col("n_b")) - F.greatest(after(F.col("n_a")), after(F.col("n_b")))
    enough = (F.col("subsets") > 0) | (F.col("elements") >= F.greatest(needed, 1 + F.floor(F.least("n_a", "n_b") / SPARE)))
    pairs = shared.where(enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).union(around).distinct()
    pairs = scratch.put(pairs, "pairs")
    scratch.drop("open", "around")
    second = scratch.put(_compared(pairs, sets, rule).where("linked").select("a", "b"), "second")
    scratch.drop("sets", "pairs")

    labels = connected_components(first.union(second), scratch)
    scratch.drop("first", "second")
    least_doc = labels.join(nodes, "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of = nodes.select("node", "doc_id").join(labels.join(least_doc, "comp"), "node", "left")
    return rows, of.select("node", "doc_id", F.coalesce("comp", "node").alias("comp"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _marks(node: np.ndarray, doc: np.ndarray, bits: int) -> np.ndarray:
    """A place among ``2**bits`` for each node and document."""
    return (mix(node.view(np.uint64) ^ mix(doc.view(np.uint64) + U(1))) >> U(64 - bits)).astype(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, rule: Similarity) -> DataFrame:
    """``node, shingles`` of the nodes of ``wanted(node, doc_id)``, and of few others; a node may come twice.

    The documents that have these sets are marked in a bitmap of bounded size,
    which is broadcast, so no text is shuffled.  Where the bitmap fills, more
    sets than wanted are built; none is missed.
    """
    spark = docs.sparkSession
    rows = wanted.count()
    bits = min(MARKS, max(16, (16 * rows).bit_length()))
    place = pa.schema([("place", pa.int64())])
    none = -(1 << 63)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(place, _marks(batch.column(0).to_numpy(), pc.fill_null(batch.column(1), none).to_numpy(), bits))

    places = wanted.select("node", "doc_id").mapInArrow(mark, "place long")
    pages = places.groupBy(F.shiftright("place", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bitmap")).toArrow()
    marked = np.zeros((max(1, (1 << bits) >> 15), 4096), np.uint8)
    for page, bitmap in zip(pages.column("page").to_pylist(), pages.column("bitmap").to_pylist()):
        marked[page] = np.frombuffer(bitmap, np.uint8)
    known = spark.sparkContext.broadcast(marked.ravel())
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            sets = shingle_sets(texts, rule.words)
            names = np.array([node_of(s) if len(s) else 0 for s in sets], np.int64)
            at = _marks(names, pc.fill_null(batch.column(0), none).to_numpy(), bits)
            hit = (known.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            found = {int(names[i]): sets[i].tobytes() for i in np.flatnonzero(hit) if len(sets[i])}
            yield record_batch(schema, list(found), list(found.values()))

    return docs.mapInArrow(build, "node long, shingles binary")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all ``documents``; nulls and odd rows as in :func:`similar_components`."""
    return similar_components(table(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame, rule: Similarity | None = None) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (of rows that repeat it, the least row with the least set; null ids last).

    Rows are told by doc_id and set, so rows that repeat an id with different
    texts stand for themselves.  Of rows without a set (null, empty or blank
    text) one for each doc_id stays, null being one doc_id.  An empty table
    stays empty; all columns stay.
    """
    rule = rule or Similarity()
    rows, of = _components(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), rule)
    first = of.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("one"))
    empty = rows.where("n = 0").select(F.explode("ids").alias("doc"), "node").distinct()
    kept = first.select(F.col("one.doc_id").alias("doc"), F.col("one.node").alias("node")).union(empty)

    names = docs.columns
    node, doc, *keys, row = (fresh(names, c) for c in ("_node", "_doc", "_n", "_no_n", "_d", "_no_d", "_row"))
    schema = StructType([*docs.schema.fields, StructField(node, LongType())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            nodes = [node_of(s) if len(s) else None for s in shingle_sets(texts, rule.words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*names, node])

    def by(n: str, d: str) -> list:  # nulls told by flags, so that the join and the choice below share one shuffle of the texts
        values = F.coalesce(n, F.lit(0)), F.col(n).isNull(), F.coalesce(d, F.lit(0)), F.col(d).isNull()
        return [v.alias(k) for k, v in zip(keys, values)]

    named = docs.mapInArrow(name, schema).withColumn(doc, F.col("doc_id").cast("long"))
    held = named.select(*names, *by(node, doc)).join(kept.select(*by("node", "doc")), keys)
    columns = [F.col(f"`{c}`") for c in names]
    ordered = [F.col("text"), *(F.col(f"`{c}`") for c, kind in docs.dtypes if c != "text" and "map<" not in kind and "variant" not in kind)]
    return held.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*ordered)).alias(row)).select(f"{row}.*")
