"""Evaluations kept from earlier runs: an append-only log, its latest view, routing and migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.files import strip_preset
from framewise.functions.vectors import subject_integrity, subject_probability

BASE_KEY = ("relative_path", "pipeline_signature")
PRESET_KEY = (*BASE_KEY, "preset")


def latest(log: DataFrame, key: tuple[str, ...] = BASE_KEY, order: str = "written_at") -> DataFrame:
    """The last row of each key, of rows written at once always the same one; a map-side aggregate, so that a key written often is one row before the shuffle."""
    tie = F.xxhash64(*(c for c, kind in log.dtypes if "map<" not in kind))
    return log.groupBy(*key).agg(F.max_by(F.struct(*(c for c in log.columns if c not in key)), F.struct(order, tie)).alias("_row")).select(*key, "_row.*")


def append(rows: DataFrame, path: str) -> None:
    """One commit of a batch; readers see all of it or none."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def append_both(base: DataFrame, presets: DataFrame, base_path: str, preset_path: str) -> None:
    """Preset rows first: what looks up a file begins with its base row, so a write that fails between the two leaves nothing half there."""
    append(presets, preset_path)
    append(base, base_path)


def way_of(base: Column, scores: Column, needs_pixels: bool) -> Column:
    """``hit``, ``preset`` or ``miss``, from whether a row has its measures and its preset's scores."""
    return F.when(~base, "miss").when(scores, "hit").otherwise("miss" if needs_pixels else "preset")


def known(candidates: DataFrame, base: DataFrame, presets: DataFrame, signature: str, preset: str, needs_pixels: bool = False) -> DataFrame:
    """``candidates(relative_path, size_bytes, modified_ns, ...)`` with ``route`` and what is kept of them: ``_kept``, measures, and ``_scores``, of the preset.

    ``hit``: both are there.  ``preset``: the measures are, the preset's scores
    are not (``miss`` instead where a preset needs pixels).  ``miss``: no
    measures, or those of another file or signature.
    """
    stamp = ["relative_path", "size_bytes", "modified_ns"]
    kept = F.struct(F.lit(True).alias("_there"), *(c for c in base.columns if c not in (*stamp, "pipeline_signature")))
    scores = F.struct(F.lit(True).alias("_there"), *(c for c in presets.columns if c not in PRESET_KEY))
    b = base.where(F.col("pipeline_signature") == signature).select(*stamp, kept.alias("_kept"))
    p = presets.where((F.col("pipeline_signature") == signature) & (F.col("preset") == preset)).select("relative_path", scores.alias("_scores"))
    joined = candidates.join(b, stamp, "left").join(p, "relative_path", "left")
    return joined.withColumn("route", way_of(F.col("_kept").isNotNull(), F.col("_scores").isNotNull(), needs_pixels))


def route(candidates: DataFrame, base: DataFrame, presets: DataFrame, signature: str, preset: str, needs_pixels: bool = False) -> DataFrame:
    """``candidates`` with the ``route`` of :func:`known`."""
    narrow = base.select("relative_path", "size_bytes", "modified_ns", "pipeline_signature"), presets.select(*PRESET_KEY)
    return known(candidates, *narrow, signature, preset, needs_pixels).drop("_kept", "_scores")


def migrate(legacy: DataFrame, order: str = "row_id", root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Base and preset rows of a log whose signature held the preset; the last copy counts.

    With ``root``, rows go by an absolute ``file_path`` so far: they get the
    ``relative_path`` below the root, and those of other places are left out.
    """
    if root is not None:
        top = root.rstrip("/") + "/"
        legacy = legacy.where(F.col("file_path").startswith(top)).withColumn("relative_path", F.substring("file_path", len(top) + 1, 1_000_000)).drop("file_path")
    plain, preset = strip_preset(F.col("pipeline_signature"))
    split = legacy.withColumn("preset", preset).withColumn("pipeline_signature", plain)
    base = latest(split.drop("preset", "subject_integrity"), BASE_KEY, order)
    return base, latest(split.where("preset <> ''").select(*PRESET_KEY, "subject_integrity", order), PRESET_KEY, order)


def refresh_preset(rows: DataFrame, prompts: DataFrame, preset: str) -> DataFrame:
    """``subject_integrity`` of stored embeddings under a preset: 1 without prompts; ``prompts(preset, positive, negative)`` has a row each."""
    one = prompts.where(F.col("preset") == preset).select("positive", "negative").limit(1)
    scored = rows.join(F.broadcast(one), how="left")  # one row or none
    value = subject_integrity(subject_probability(F.col("embedding"), F.col("positive"), F.col("negative")))
    return scored.withColumn("subject_integrity", F.coalesce(value, F.lit(1.0))).drop("positive", "negative")
