"""An evaluation run that reuses what earlier runs have kept: modes, refreshed and new rows, changed files, failures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.operators.cache import known
from framewise.sinks.journal import observed
from framewise.storage import Scratch, write_table

MODES = ("use", "refresh", "none")
FINGERPRINT = ("size_bytes", "modified_ns")
FAILURE = "file_path string, stage string, error_type string, message string"


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown cache mode {mode!r}; choose from {', '.join(MODES)}")


def with_tags(pending: DataFrame, tags: DataFrame, *columns: str) -> DataFrame:
    """``pending`` with the tags read in bulk: of each of ``columns`` the value of ``tags(file_path, ...)``, else, where that is null or empty, the file's own."""
    bulk = tags.select("file_path", *(F.col(c).alias(f"_bulk_{c}") for c in columns))
    filled = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c))
    joined = pending.join(bulk, "file_path", "left")
    return joined.withColumns({c: F.coalesce(filled(f"_bulk_{c}"), F.col(c)) for c in columns}).drop(*(f"_bulk_{c}" for c in columns))


def failure(stage: str, kind: Column | str, message: Column | str) -> Column:
    """``stage, error_type, message`` of one failed file."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(stage).alias("stage"), text(kind).alias("error_type"), text(message).alias("message"))


def told_failure(error: Column, stage: str) -> Column:
    """The failure of an error written ``Type: message``; null without one."""
    parts = F.split(error, ": ", 2)
    return F.when(error.isNotNull(), failure(stage, parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))))


def changed_failure(evaluated: DataFrame, now: DataFrame) -> DataFrame:
    """``evaluated`` with ``_changed``: a failure where the file no longer has the size and time it was evaluated with, else null.

    ``now`` has ``file_path, size_bytes, modified_ns`` of a second scan; a file that it lacks has changed.
    """
    again = now.select("file_path", F.lit(True).alias("_there"), *(F.col(c).alias(f"_now_{c}") for c in FINGERPRINT))
    same = F.col("_there").isNotNull()
    for c in FINGERPRINT:
        same = same & F.col(c).eqNullSafe(F.col(f"_now_{c}"))
    lost = F.when(~same, failure("checkpoint", "RuntimeError", "File changed while it was being evaluated"))
    return evaluated.join(again, "file_path", "left").withColumn("_changed", lost).drop("_there", *(f"_now_{c}" for c in FINGERPRINT))


@dataclass(frozen=True)
class Run:
    """What a run made of its candidates, read from one stored table.

    ``records`` of every candidate that has any, with ``cache_hit``; ``fresh``,
    those evaluated now, and ``refreshed``, those with new preset scores;
    ``kept``, the fresh ones that later runs may use (none in mode ``none``);
    ``failures``; and ``counts`` of each kind, taken while the table was written.
    """

    records: DataFrame
    fresh: DataFrame
    refreshed: DataFrame
    kept: DataFrame
    failures: DataFrame
    counts: dict[str, int]


def run(
    candidates: DataFrame, base: DataFrame, presets: DataFrame, signature: str, preset: str, evaluate: Callable[[DataFrame], DataFrame], refresh: Callable[[DataFrame], DataFrame],
    rescan: DataFrame, needs_pixels: bool = False, mode: str = "use",
) -> Run:
    """Hits as they were kept, preset scores made anew from kept rows, and the rest evaluated.

    ``candidates`` has ``file_path, relative_path, size_bytes, modified_ns``.
    ``base`` has the kept measures, ``presets`` the kept preset scores, which
    go by ``relative_path, pipeline_signature`` (and ``preset``).  ``evaluate``
    takes the misses and gives them back with all measures and ``error``;
    ``refresh`` takes rows of ``base`` and adds the preset's scores.  A file that
    ``rescan`` finds changed has no record.
    """
    check_mode(mode)
    return finish(known(candidates, base, presets, signature, preset, needs_pixels), evaluate, refresh, rescan, mode)


def finish(known: DataFrame, evaluate: Callable[[DataFrame], DataFrame], refresh: Callable[[DataFrame], DataFrame], rescan: DataFrame, mode: str = "use") -> Run:
    """The run of candidates of which :func:`framewise.operators.cache.known` tells the route and what is kept.

    In the modes ``refresh`` and ``none`` nothing that is kept is used.  The
    ways are written once and the outcome of every candidate
    once, so each model sees a file once however much of the result is read.
    """
    scratch = Scratch()
    if mode != "use":
        known = known.withColumn("route", F.lit("miss"))
    known = scratch.put(known, "known")
    given = [c for c in known.columns if c not in ("_kept", "_scores", "route")]
    kept, scores = ([f"{s}.{f.name}" for f in known.schema[s].dataType if f.name != "_there"] for s in ("_kept", "_scores"))
    none = F.lit(None).cast("struct<stage: string, error_type: string, message: string>")
    hits = known.where("route = 'hit'").select(*given, *kept, *scores).withColumns({"_kind": F.lit("hit"), "_failure": none})
    renewed = refresh(known.where("route = 'preset'").select(*given, *kept)).withColumns({"_kind": F.lit("refreshed"), "_failure": none})
    made = changed_failure(evaluate(known.where("route = 'miss'").select(*given)), rescan)
    made = made.withColumns({"_kind": F.lit("evaluated"), "_failure": F.coalesce(told_failure(F.col("error"), "evaluation"), F.col("_changed"))}).drop("error", "_changed")
    every = hits.unionByName(renewed, allowMissingColumns=True).unionByName(made, allowMissingColumns=True)
    every = every.withColumn("cache_hit", F.col("_kind") != "evaluated")
    whole = F.col("_failure").isNull()
    kinds = {"cached": F.col("cache_hit"), "refreshed": F.col("_kind") == "refreshed", "evaluated": (F.col("_kind") == "evaluated") & whole, "failed": ~whole}
    paths: list[str] = []
    counts = observed(every, lambda df: paths.append(write_table(df, "outcome")), discovered=F.count("*"), **{name: F.count_if(yes) for name, yes in kinds.items()})
    told = every.sparkSession.read.schema(every.schema).parquet(*paths)
    scratch.drop("known")
    records = told.where(whole).drop("_kind", "_failure")
    fresh = records.where("not cache_hit")
    failures = told.where(~whole).select("file_path", "_failure.*")
    return Run(records, fresh, told.where("_kind = 'refreshed'").drop("_kind", "_failure"), fresh if mode != "none" else fresh.where("false"), failures, counts)


def some(records: DataFrame) -> DataFrame:
    """``records``; an error where there are none, as a run of failures alone is no success."""
    if records.isEmpty():
        raise RuntimeError("No images were successfully processed")
    return records


def phase_counts(run: Run) -> DataFrame:
    """One row: ``discovered, cached, refreshed, evaluated, failed``, as counted while the outcome was written."""
    names = ("discovered", "cached", "refreshed", "evaluated", "failed")
    return run.records.sparkSession.createDataFrame([tuple(run.counts[n] for n in names)], ", ".join(f"{n} long" for n in names))
