"""Dropping lines that many documents share (operator 7).

Normalised lines are exploded to hashes, the distinct documents of each hash
are counted, lines of hashes over the threshold are dropped everywhere but in
one document, and the other lines are put together again by position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.storage import stored

from .common import fresh, record_batch, table, text_chunks

#: One in so many entries, at least, has a line that is broadcast; so at most so many lines are.
HOT = 10_000
_INNER = bytes(range(0x80, 0xC0))  # bytes of a UTF-8 character after its first


@dataclass(frozen=True)
class LineRules:
    """Lines of at least ``min_chars`` code points found in at least ``min_docs`` documents go."""

    min_chars: int = 20
    min_docs: int = 3


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The hash of each line's normalised form; None for lines that are too short to count."""
    keys: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
        long = len(key) >= min_chars and len(key.translate(None, _INNER)) >= min_chars
        keys.append(xxhash.xxh3_128_digest(key) if long else None)
    return keys


def _exploded(docs: DataFrame, rules: LineRules) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            ids, found = batch.column(0).to_pylist(), []
            counts = []
            for text in texts:
                keys = dict.fromkeys(line_keys(text, rules.min_chars))  # once a document
                keys.pop(None, None)
                found += keys
                counts.append(len(keys))
            pair = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield record_batch(schema, pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), counts))), np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))

    return docs.mapInArrow(explode, "doc_id long, h1 long, h2 long")


def dropped_lines(docs: DataFrame, rules: LineRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the hashes of the lines that it loses, for documents that lose any.

    The exploded hashes are written once to the shared folder.  Distinct
    documents are counted in two steps, so a line that a third of all documents
    hold is summed in part before it is shuffled.  Lines with a larger share of
    all entries than one in ``HOT`` are at most ``HOT``, so these are broadcast
    to the entries; only the others are joined by a shuffle.
    """
    rules = rules or LineRules()
    lines = stored(_exploded(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), rules), "lines")
    shared = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    shared = stored(shared.where(F.col("n_docs") >= rules.min_docs).select("h1", "h2", "n", "keeper"), "shared")
    often = F.col("n") > lines.count() // HOT
    hot, other = shared.where(often).drop("n"), shared.where(~often).drop("n")
    held = lines.join(F.broadcast(hot), ["h1", "h2"]).union(lines.join(F.broadcast(hot.drop("keeper")), ["h1", "h2"], "left_anti").join(other, ["h1", "h2"]))
    lost = held.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def _reassembler(rules: LineRules, i_text: int, i_gone: int):
    def cut(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        for text, gone in zip(texts, batch.column(i_gone).to_pylist()):
            if not gone:
                yield text.count(b"\n") + 1, 0, text
                continue
            drop = {np.array([g["h1"], g["h2"]], "<i8").tobytes() for g in gone}
            lines = text.split(b"\n")
            kept = [line for line, key in zip(lines, line_keys(text, rules.min_chars)) if key not in drop]
            yield len(lines), len(lines) - len(kept), b"\n".join(kept)

    return cut


def line_dedup(docs: DataFrame, rules: LineRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``text`` without shared lines, ``n_lines`` before and ``n_dropped``.

    A null or empty text is one empty line and stays an (empty) text.  A
    document that loses every line keeps an empty text.  Rows that repeat a
    doc_id are the same document: they count once and lose the same lines.
    Rows with a null doc_id keep all lines and count as no document.  An empty
    table gives no rows; other columns are not read.
    """
    rules = rules or LineRules()
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    cut = _reassembler(rules, 1, 2)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            n, gone, kept = zip(*cut(batch, texts))
            yield record_batch(schema, batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), n, gone)

    return _with_lost(docs, dropped_lines(docs, rules), "doc_id", "gone").mapInArrow(assemble, "doc_id long, text string, n_lines long, n_dropped long")


def _with_lost(docs: DataFrame, gone: DataFrame, doc: str, lost: str) -> DataFrame:
    """``docs`` with the column ``lost``.  Rows without an id lose nothing and need no join, in which they would be one key."""
    gone = gone.select(F.col("doc_id").alias(doc), F.col("gone").alias(lost))
    known = docs.where(F.col(doc).isNotNull()).join(gone, doc, "left").select(*(F.col(f"`{c}`") for c in docs.columns), lost)
    return known.union(docs.where(F.col(doc).isNull()).withColumn(lost, F.lit(None).cast(gone.schema[lost].dataType)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and digests of what is kept of all ``documents``; nulls and odd rows as in :func:`line_dedup`."""
    docs = line_dedup(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def drop_shared_lines(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """``docs`` with shared lines taken out of ``text``, and ``n_chars`` to match; other columns stay.

    A null text stays null; else as :func:`line_dedup`, row by row.
    """
    rules = rules or LineRules()
    names = docs.columns
    doc, lost = fresh(names, "_doc"), fresh(names, "_gone")
    i_text, cut = names.index("text"), _reassembler(rules, names.index("text"), len(names) + 1)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            valid = batch.column(i_text).is_valid().to_pylist()
            kept = pa.array([x[2] if v else None for x, v in zip(cut(batch, texts), valid)], pa.binary()).cast(pa.string())
            columns = batch.columns[: len(names)]
            columns[i_text] = kept
            yield pa.RecordBatch.from_arrays(columns, names=names)

    told = docs.withColumn(doc, F.col("doc_id").cast("long"))
    out = _with_lost(told, dropped_lines(docs, rules), doc, lost).mapInArrow(assemble, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else out


SQL = r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    keyed AS (
      SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    shared AS (
      SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    judged AS (
      SELECT k.doc_id, k.i, k.line, (s.key IS NOT NULL AND k.doc_id <> s.keeper) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id"""
