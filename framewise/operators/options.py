"""What a run is asked for, checked as a whole before any work begins."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from framewise.functions.scoring import PROFILES
from framewise.operators.bursts import BurstRules
from framewise.operators.incremental import check_mode
from framewise.operators.replan import Settings
from framewise.storage import hadoop


@dataclass(frozen=True)
class RunOptions:
    """``source`` and ``output`` are folders, ``files`` names files that a run reads (decisions, weights) by what they are for."""

    source: str
    output: str
    settings: Settings = field(default_factory=lambda: Settings(PROFILES["balanced"]))
    rules: BurstRules = field(default_factory=BurstRules)
    cache: str = "use"
    batch: int = 8
    review: int = 100
    files: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_mode(self.cache)
        if self.batch < 1:
            raise ValueError(f"a batch has one picture at least, not {self.batch}")
        if self.review < 0:
            raise ValueError(f"a page has no {self.review} frames")

    def check(self, spark: SparkSession) -> RunOptions:
        """These options; a ValueError that lists all that is wrong with the folders and files they name."""
        source, output = whole(spark, self.source), whole(spark, self.output)
        wrong = []
        if not is_kind(spark, self.source, "isDirectory"):
            wrong.append(f"no folder {self.source}")
        if f"{source}/".startswith(f"{output}/"):
            wrong.append(f"the output {self.output} is the source or above it")
        wrong += [f"no file {path} for {what}" for what, path in self.files.items() if not is_kind(spark, path, "isFile")]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


def is_kind(spark: SparkSession, path: str, kind: str) -> bool:
    files, target = hadoop(spark, path)
    return bool(files.exists(target) and getattr(files.getFileStatus(target), kind)())


def whole(spark: SparkSession, path: str) -> str:
    """The full name of a path with its scheme, without ``.`` and ``..``; links are followed on the local disk."""
    files, target = hadoop(spark, path)
    name = files.makeQualified(target).toUri()
    scheme, place = name.getScheme(), os.path.normpath(name.getPath())
    if scheme == "file":
        place = os.path.realpath(place)
    return f"{scheme}://{name.getAuthority() or ''}{place}".rstrip("/")
