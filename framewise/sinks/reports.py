"""Reports, templates, failure logs and the review page."""

from __future__ import annotations

import html
import json
import os
import tempfile
import uuid
from importlib import resources
from itertools import groupby
from string import Template
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.files import csv_safe
from framewise.functions.scoring import MULTIPLIERS
from framewise.storage import hadoop, take_name, write_text

# Fixed values.
REPORT_COLUMNS = (
    "global_quality_rank", "selection_rank", "burst_rank", "file_name", "file_path", "timestamp", "timestamp_utc", "timestamp_source", "timezone_source",
    "camera_model", "camera_serial", "sequence_number", "autofocus_info", "burst_id", "burst_size", "burst_winner", "focus_score", "focus_percentile",
    "absolute_focus_factor", "relative_focus_factor", "musiq_score", "aesthetic_score", "subject_integrity", "face_count", "eye_count", "eye_factor",
    "eye_warning", "blown_pct", "crushed_pct", "exposure_penalty", *MULTIPLIERS, "composite_score", "score_reason", "feedback_decision",
    "portfolio_selected", "cache_hit",
)
FAILURE_COLUMNS = ("file_path", "stage", "error_type", "message")


def report_rows(evaluated: DataFrame, columns: tuple[str, ...] = REPORT_COLUMNS) -> DataFrame:
    """The fixed columns, empty where a stage has not run, texts safe for spreadsheets."""
    kinds = dict(evaluated.dtypes)
    safe = lambda c: csv_safe(F.col(c)) if kinds[c] == "string" else F.col(c)
    return evaluated.select(*(safe(c).alias(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in columns))


def iso_text(micros: Column) -> Column:
    """Micros since 1970 as a time of UTC, whatever the session's zone."""
    day, second = 86_400_000_000, 1_000_000
    rest = F.pmod(micros, F.lit(day))
    whole = lambda n: F.floor(rest / n)
    clock = F.format_string("%02d:%02d:%02d.%06d", whole(3600 * second), whole(60 * second) % 60, whole(second) % 60, rest % second)
    return F.concat(F.date_from_unix_date(((micros - rest) / day).cast("int")).cast("string"), F.lit("T"), clock)


def iso_times(rows: DataFrame) -> DataFrame:
    """``timestamp`` with its own offset and ``timestamp_utc``, from ``ts_us`` and ``tz_offset_minutes``."""
    m = F.coalesce("tz_offset_minutes", F.lit(0)).cast("long")
    zone = F.concat(F.when(m < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(m) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(m) % 60).cast("string"), 2, "0"))
    return rows.withColumns({"timestamp": F.concat(iso_text(F.col("ts_us") + m * F.lit(60_000_000)), zone), "timestamp_utc": F.concat(iso_text(F.col("ts_us")), F.lit("+00:00"))})


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """A CSV folder, sorted over all its files.

    It is written aside; when it is whole, an earlier one makes way and the
    new one takes the name.  Whatever fails leaves the earlier one, under its
    name or, where even that fails, beside it with the ending ``old``.
    """
    aside, old = (f"{path.rstrip('/')}.{uuid.uuid4().hex}.{word}" for word in ("part", "old"))
    files, new = hadoop(rows.sparkSession, aside)
    try:
        (rows.orderBy(*order) if order else rows).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(aside)
        take_name(files, new, hadoop(rows.sparkSession, path)[1], hadoop(rows.sparkSession, old)[1])
    finally:
        files.delete(new, True)


def feedback_template(ranked: DataFrame) -> DataFrame:
    """Rows for people to fill in; what is selected starts as kept."""
    decision = F.when(F.coalesce("portfolio_selected", F.lit(False)), "keep").otherwise("")
    return ranked.select("file_path", decision.alias("decision"), "selection_rank", "global_quality_rank", "composite_score")


def failures(rows: DataFrame, stage: str) -> DataFrame:
    """The dead letters of a step whose rows have ``error``, written ``Type: message``."""
    parts = F.split("error", ": ", 2)
    one = rows.where("error is not null").select("file_path", F.lit(stage).alias("stage"), parts[0].alias("error_type"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("message"))
    return report_rows(one, FAILURE_COLUMNS)


def stage_costs(events: DataFrame) -> DataFrame:
    return events.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"))


def write_json(rows: DataFrame, path: str) -> None:
    """The one row of a report, as a file of sorted keys that appears whole."""
    one = rows.limit(2).toPandas()
    if len(one) != 1:
        raise ValueError("a JSON report has one row")
    text = json.dumps(json.loads(one.to_json(orient="records"))[0], indent=2, sort_keys=True)
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False) as f:
        f.write(text)
    os.replace(f.name, path)


def review_page(groups: DataFrame, limit: int = 100, title: str = "Review") -> str:
    """An HTML page of at most ``limit`` frames, on which a person decides frame by frame and saves the decisions as a CSV for :func:`framewise.sources.reports.read_feedback`.

    ``groups`` has ``group, burst_rank, burst_id, file_path, composite_score,
    score_reason``, and may have ``aesthetic_score``, ``musiq_score``,
    ``selection_rank``, ``burst_winner`` (else the first of a burst won),
    ``portfolio_selected`` and ``thumbnail``, the picture to show.  A burst of
    several frames is a section of its own, so that its winner can be turned down for
    another; frames that stand alone follow each other in one.  All texts are escaped.  The
    browser keeps decisions by ``title``, so each run should have its own.
    """
    rows = [r.asDict() for r in groups.orderBy("group", "burst_rank", "file_path").limit(limit).collect()]
    sections: list[str] = []
    n_bursts = 0
    for alone, same in groupby([list(g) for _, g in groupby(rows, key=lambda r: r["group"])], key=lambda g: len(g) == 1):
        if alone:
            sections.append(_section("", [_card(r, False) for g in same for r in g]))
            continue
        for frames in same:
            n_bursts += 1
            head = f"<h2>Burst {_escaped(frames[0]['burst_id'])}, {len(frames)} frames</h2>"
            sections.append(_section(head, [_card(r, True) for r in frames]))
    chosen = sum(bool(r.get("portfolio_selected")) for r in rows)
    told = f"{len(rows)} photos, {n_bursts} bursts, {chosen} exported."
    parts = {"title": _escaped(title), "told": _escaped(told), "sections": "".join(sections), "name": json.dumps(title).replace("<", "\\u003c")}
    return Template(resources.files("framewise.sinks").joinpath("review.html").read_text()).substitute(parts)


def write_review(groups: DataFrame, path: str, limit: int = 100, title: str | None = None) -> None:
    """The page as a file that appears whole; its folder's name is the title where none is given."""
    page = review_page(groups, limit, title or os.path.basename(os.path.dirname(path.rstrip("/"))) or "Review")
    write_text(groups.sparkSession, path, page)


def _escaped(value: object) -> str:
    return "" if value is None else html.escape(str(value), quote=True)


def _section(head: str, cards: list[str]) -> str:
    return f'<section class="{"burst" if head else "alone"}">{head}<div>{"".join(cards)}</div></section>'


def _card(r: dict[str, object], burst: bool) -> str:
    """One frame: its picture, what it is in its burst and in the selection, scores and reason."""
    path, rank = str(r["file_path"]), r.get("selection_rank")
    won = r.get("burst_winner")
    won = r["burst_rank"] == 1 if won is None else bool(won)
    marks = []
    if burst:
        marks.append("<mark>Pick</mark>" if won else "<mark class=lost>Lost</mark>")
    if rank is not None and (won or not burst):
        marks.append(f"#{_escaped(rank)}")
    elif not burst and not won:
        marks.append("Feedback keep")
    if r.get("portfolio_selected"):
        marks.append("<mark>Exported</mark>")
    scores = [f"{name} {r[c]:.{digits}f}" for name, c, digits in (("Score", "composite_score", 2), ("Aesthetic", "aesthetic_score", 2), ("MUSIQ", "musiq_score", 1)) if r.get(c) is not None]
    if burst:
        scores.append(f"Burst rank {_escaped(r['burst_rank'])}")
    picture = quote(str(r["thumbnail"] if r.get("thumbnail") else path), safe="/:")
    name = _escaped(os.path.basename(path))
    return (
        f'<figure data-path="{_escaped(path)}" data-burst="{_escaped(r["burst_id"])}"><img src="{_escaped(picture)}" loading="lazy" alt="{name}">'
        f'<figcaption><strong>{" ".join([*marks, name])}</strong><span>{" · ".join(scores)}</span><em>{_escaped(r["score_reason"])}</em></figcaption></figure>'
    )
