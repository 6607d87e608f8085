"""Quality rules by repetition coverage (operator 3).

For several n-gram lengths, rolling hashes find the word windows that occur
twice or more within a text; the coverage of a length is the share of the
text's word characters that lie inside such windows.  The same is measured for
whole lines.  A text fails where a coverage exceeds the limit of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import record_batch, table, text_chunks
from .spans import Spans, mix, repeated

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_INNER = (np.arange(256) & 0xC0) == 0x80  # bytes of a UTF-8 character after its first


@dataclass(frozen=True)
class RepetitionRules:
    """``coverage``: the largest allowed percentage of word characters inside repeated n-grams, by n.

    ``line_coverage``: the same for repeated lines (every occurrence after the
    first counts).  ``symbol_percent``: the most symbols in a hundred words.
    """

    min_words: int = 10
    window: int = 5
    window_percent: int = 20
    coverage: dict[int, int] = field(default_factory=lambda: {3: 50, 5: 30, 8: 28, 13: 26})
    line_coverage: int = 30
    symbol_percent: int = 10


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long"


def _columns(rules: RepetitionRules) -> str:
    return COLUMNS + "".join(f", dup_chars_{n} long" for n in sorted(rules.coverage))


def measure(texts: list[bytes], rules: RepetitionRules) -> list[np.ndarray]:
    s = Spans.of(texts)
    inner = np.append(0, np.cumsum(_INNER[s.buffer], dtype=np.int64))
    chars = (s.end - s.start) - (inner[s.end] - inner[s.start])  # code points of each word
    total = lambda values: np.bincount(s.doc, values, len(texts)).astype(np.int64)
    word_chars, hashes = total(chars), s.word_hashes()
    salt = mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(77))

    def covered(n: int) -> np.ndarray:
        at, keys = s.windows(hashes, n)
        at = at[repeated(mix(keys ^ salt[s.doc[at]]))[0]]
        steps = np.bincount(at, minlength=len(hashes) + n + 1) - np.bincount(at + n, minlength=len(hashes) + n + 1)
        return np.cumsum(steps)[: len(hashes)] > 0

    repeat_words = total(covered(rules.window))
    start, end, doc = s.lines()
    first = np.searchsorted(s.start, start)
    words = np.searchsorted(s.start, end) - first
    full = words > 0
    keys = s.span_hashes(start[full], end[full]) if full.any() else np.zeros(0, np.uint64)
    later = repeated(mix(keys ^ salt[doc[full]]))[1]
    sums = np.append(0, np.cumsum(chars))
    dup = np.flatnonzero(full)[later]
    dup_lines = np.bincount(doc[dup], minlength=len(texts))
    dup_line_chars = np.bincount(doc[dup], sums[first[dup] + words[dup]] - sums[first[dup]], len(texts)).astype(np.int64)
    dup_chars = {n: total(chars * covered(n)) for n in sorted(rules.coverage)}
    symbols = s.count(_SYMBOL[s.buffer])
    base = (s.n_words < rules.min_words) | (100 * repeat_words > rules.window_percent * s.n_words)
    bad = (100 * dup_line_chars > rules.line_coverage * word_chars) | (100 * symbols > rules.symbol_percent * s.n_words)
    for n, limit in rules.coverage.items():
        bad |= 100 * dup_chars[n] > limit * word_chars
    return [s.n_words, word_chars, symbols, dup_lines, repeat_words, base, ~(base | bad), dup_line_chars, *dup_chars.values()]


def repetition_quality(docs: DataFrame, rules: RepetitionRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures and the verdict for each row of ``docs``.

    Null and empty texts have no words, so they fail the least number of words.
    Repeated rows and ids are judged row by row; a null id stays null; other
    columns are not read.  Texts are read whole, in slices of about a megabyte
    of many texts, so a task's memory follows its longest text only.  An empty
    table gives no rows.
    """
    rules = rules or RepetitionRules()
    names = _columns(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "boolean": pa.bool_()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in names.split(", ")])
        for batch, texts in text_chunks(batches):
            yield record_batch(schema, batch.column(0).cast(pa.int64()), *measure(texts, rules))

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(judge, names)


def op3_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of all ``documents`` under the standard rules; nulls and odd rows as in :func:`repetition_quality`."""
    return repetition_quality(table(spark, sf_dir, "documents"))


def keep_quality(docs: DataFrame, rules: RepetitionRules | None = None) -> DataFrame:
    """``docs`` without the rows that the rules reject; columns and row content stay as they are.

    Null and empty texts have no words and go.  Rows that repeat stay or go
    together, null ids count like others, and an empty table stays empty.
    """
    rules = rules or RepetitionRules()
    kept = len(_columns(rules).split(", ")[: 8]) - 1

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            yield batch.filter(pa.array(measure(texts, rules)[kept - 1]))

    return docs.mapInArrow(only, docs.schema)


def _sql(rules: RepetitionRules) -> str:
    def cover(n: int, what: str) -> str:
        return f"""
      cover_{n} AS (
        SELECT doc_id, sum({what}) AS v FROM (
          SELECT w.doc_id, w.chars, max(d.hit) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit
          FROM words w LEFT JOIN (
            SELECT doc_id, i, CASE WHEN count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS hit FROM (
              SELECT doc_id, unnest(generate_series(1, len(ws) - {n - 1})) AS i, array_to_string(ws[i:i + {n - 1}], ' ') AS gram
              FROM split WHERE len(ws) >= {n})) d ON w.doc_id = d.doc_id AND w.i = d.i)
        WHERE hit = 1 GROUP BY doc_id)"""

    bad = " OR ".join(
        [f"100 * dup_chars_{n} > {limit} * word_chars" for n, limit in sorted(rules.coverage.items())]
        + [f"100 * dup_line_chars > {rules.line_coverage} * word_chars", f"100 * n_symbols > {rules.symbol_percent} * n_words"]
    )
    return f"""
    WITH split AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
      words AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, length(unnest(ws)) AS chars FROM split),
      lines AS (
        SELECT doc_id, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n, sum(CASE WHEN k > 1 THEN chars ELSE 0 END) AS chars FROM (
          SELECT doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM split)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) GROUP BY doc_id),
      repeats AS (SELECT * FROM (WITH {cover(rules.window, "1").replace(f"cover_{rules.window}", "c")} SELECT * FROM c)),
      {", ".join(cover(n, "chars") for n in sorted(rules.coverage))},
      found AS (
        SELECT s.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
          length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
          coalesce(r.v, 0)::BIGINT AS n_repeat_words, coalesce(l.chars, 0)::BIGINT AS dup_line_chars,
          {", ".join(f"coalesce(c{n}.v, 0)::BIGINT AS dup_chars_{n}" for n in sorted(rules.coverage))}
        FROM split s LEFT JOIN lines l ON s.doc_id = l.doc_id LEFT JOIN repeats r ON s.doc_id = r.doc_id
          {" ".join(f"LEFT JOIN cover_{n} c{n} ON s.doc_id = c{n}.doc_id" for n in sorted(rules.coverage))})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.window_percent} * n_words) AS base_failed,
      NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.window_percent} * n_words OR {bad}) AS kept,
      dup_line_chars, {", ".join(f"dup_chars_{n}" for n in sorted(rules.coverage))}
    FROM found"""


SQL = _sql(RepetitionRules())
