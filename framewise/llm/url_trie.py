"""URL filters over a broadcast trie (operator 2).

The trie holds host labels from the last to the first, and below each host the
path segments of its rules.  The longest rule that fits a URL decides; of rules
of the same length block does, then the one with the longer host.

A list too long to broadcast is joined instead, node by node of the same trie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, table

#: So many rules are broadcast at most; a longer list is joined.
MAX_RULES = 200_000
_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class UrlRule:
    """``host`` fits itself and its subdomains; ``path`` is a prefix of the path, ``/`` included."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


class _Node:
    __slots__ = ("labels", "segments", "tails", "sizes")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}  # next host label to the left
        self.segments: dict[str, _Node] = {}  # next whole path segment
        self.tails: dict[str, UrlRule] = {}  # how the next segment must begin
        self.sizes: list[int] = []  # lengths of the tails


def _weight(rule: UrlRule) -> tuple[int, bool, int]:
    return len(rule.text), rule.verdict == "block", len(rule.host)


class UrlTrie:
    def __init__(self, rules: Iterable[UrlRule]) -> None:
        self.root, self.any_path = _Node(), "\0"
        for rule in rules:
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {rule.verdict!r}")
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node.labels.setdefault(label, _Node())
            if rule.path and rule.path[0] != "/":
                raise ValueError(f"a path begins with /: {rule.path!r}")
            *whole, tail = rule.path.split("/")[1:] or [self.any_path]
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            if tail not in node.tails or _weight(rule) > _weight(node.tails[tail]):
                node.tails[tail] = rule
            if tail != self.any_path and len(tail) not in node.sizes:
                node.sizes.append(len(tail))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Text and verdict of the longest rule that fits."""
        best = None
        node = self.root
        segments = path.split("/")[1:]
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            below, found = node, [node.tails.get(self.any_path)]
            for segment in segments:
                found += [below.tails.get(segment[:n]) for n in below.sizes if n <= len(segment)]
                below = below.segments.get(segment)
                if below is None:
                    break
            for hit in found:
                if hit and (best is None or _weight(hit) > _weight(best)):
                    best = hit
        return (best.text, best.verdict) if best else None


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def url_verdicts(
    pages: DataFrame, rules: Iterable[UrlRule] | DataFrame = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most: int = MAX_RULES
) -> DataFrame:
    """Host, path, deciding rule and verdict for each row of ``pages``.

    ``rules`` may be a table ``verdict, host, path``; a null field of it is an
    empty text, so a rule without a path fits all paths, one without a host fits
    hosts that end with a dot, and one without a verdict is an error.  A null or malformed URL
    has an empty host and path, no rule, and the ``default`` verdict, as has a
    URL that no rule fits.  Repeated rows are judged row by row; an empty table
    gives no rows; other columns are not read.  Up to ``most`` rules are
    broadcast, and the work is one pass without a shuffle; more are joined to
    the distinct URLs.
    """
    spark = pages.sparkSession
    chosen = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if len(rules) > most:
            rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    elif rules.count() <= most:
        rules = [UrlRule(*(x or "" for x in r)) for r in rules.select("verdict", "host", "path").collect()]
    if isinstance(rules, DataFrame):
        return _joined(chosen, rules, default)
    trie = spark.sparkContext.broadcast(UrlTrie(rules))
    schema = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict"))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hits = [match(*p) if p[0] else None for p in parts]
            yield record_batch(
                schema, batch.column(0).cast(pa.int64()), [p[0] for p in parts], [p[1] for p in parts],
                [h[0] if h else None for h in hits], [h[1] if h else default for h in hits],
            )

    return chosen.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _joined(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by joins.

    A URL visits the nodes of its host's suffixes and its path's whole
    segments; a node tells the lengths of its tails, and each length names one
    rule at most.  So both joins find one row for a key at most, whatever
    number of rules or URLs a host has.
    """
    fields = F.coalesce("verdict", F.lit("")).alias("verdict"), F.coalesce("host", F.lit("")).alias("as_given"), F.coalesce("path", F.lit("")).alias("path")
    given = rules.select(*fields)
    bad = ~F.col("verdict").isin("allow", "block") | ((F.col("path") != "") & ~F.col("path").startswith("/"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a rule: "), F.concat_ws(" ", "verdict", "as_given", "path"))).cast("string")).otherwise(F.col("verdict"))
    text = F.concat("as_given", "path")
    rule = F.struct(F.length(text).alias("length"), (checked == "block").alias("block"), F.length("as_given").alias("host"), text.alias("rule"), checked.alias("verdict"))
    single = given.groupBy(_lower(F.col("as_given")).alias("at"), F.col("path").alias("prefix")).agg(F.max(rule).alias("hit"))
    nodes = single.groupBy("at", F.regexp_extract("prefix", "^.*/", 0).alias("base")).agg(F.collect_set(F.length("prefix")).alias("sizes"))

    after = F.when(F.instr("url", "://") > 0, F.regexp_extract(F.expr("substring(url, instr(url, '://') + 3)"), "^[^?#]*", 0)).otherwise("")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(after, F.lit("")).alias("rest"))
    parts = parts.select("page_id", _lower(F.regexp_extract("rest", "^[^/]*", 0)).alias("host"), F.regexp_extract("rest", "(?s)/.*", 0).alias("path"))
    urls = parts.where("host <> ''").select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    folders = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.when(i == 1, "").otherwise(F.concat(F.array_join(F.slice(segments, 1, i - 1), "/"), F.lit("/"))))
    visited = urls.select("host", "path", F.explode(suffixes).alias("at"), folders.alias("folders")).select("host", "path", "at", F.explode("folders").alias("base"))
    tails = visited.join(nodes, ["at", "base"]).select("host", "path", "at", F.explode("sizes").alias("size")).where(F.col("size") <= F.length("path"))
    hits = tails.withColumn("prefix", F.col("path").substr(F.lit(1), F.col("size"))).join(single, ["at", "prefix"])
    best = hits.groupBy("host", "path").agg(F.max("hit").alias("hit"))
    nowhere = parts.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    out = parts.where("host <> ''").join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")).union(nowhere)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` under the four rules; nulls and odd rows as in :func:`url_verdicts`."""
    return url_verdicts(table(spark, sf_dir, "pages"))


SQL = r"""
    WITH cut AS (
      SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*', 0) ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        CASE WHEN position('/' IN rest) > 0 THEN substr(rest, position('/' IN rest)) ELSE '' END AS path FROM cut),
    ruled AS (
      SELECT page_id, host, path, CASE
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
