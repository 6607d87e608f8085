"""Kept evaluations in versions: base and preset rows change together, and a lookup leaves most of them where they lie.

A batch is written aside, both tables of it; then one small file, made by an
atomic create, lists the files of the next version.  Readers see whole versions
only, whatever is lost between the two writes.  From time to time all
batches are settled: the last row of each key, in buckets of its path, so that a
lookup moves its candidates to the buckets and not the buckets to them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators import incremental
from framewise.operators.cache import BASE_KEY, PRESET_KEY, latest, way_of
from framewise.storage import hadoop, make_folder, read_text, write_text

TABLES = {"base": BASE_KEY, "presets": PRESET_KEY}
ORDER = "_order"


@dataclass(frozen=True)
class Version:
    """``settled`` and each of ``batches`` are folders with one table of either kind; later batches supersede earlier ones."""

    number: int = 0
    settled: str | None = None
    buckets: int = 0
    batches: list[str] = field(default_factory=list)


class EvaluationStore:
    """The store in ``folder``, for rows of the two schemas (texts, as for ``createDataFrame``).

    ``base_schema`` has ``relative_path, pipeline_signature``, the file's ``size_bytes`` and
    ``modified_ns`` and all measures; ``preset_schema`` has these two keys, ``preset`` and
    its scores.  ``buckets``: of a settled table.  After ``settle_after``
    batches a commit settles, so a lookup reads a bounded number of them.
    Several writers may commit; each batch becomes a version of its own.
    """

    def __init__(self, spark: SparkSession, folder: str, base_schema: str, preset_schema: str, buckets: int = 64, settle_after: int = 16) -> None:
        self.spark, self.folder, self.buckets, self.settle_after = spark, folder.rstrip("/"), buckets, settle_after
        self.schemas = {"base": base_schema, "presets": preset_schema}
        try:
            make_folder(spark, f"{self.folder}/versions")
        except FileExistsError:
            pass

    def _numbers(self) -> list[int]:
        files, here = hadoop(self.spark, f"{self.folder}/versions")
        names = (s.getPath().getName() for s in files.listStatus(here))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """The last version, or that of a number."""
        numbers = self._numbers() if number is None else [number]
        return Version(**json.loads(read_text(self.spark, f"{self.folder}/versions/{numbers[-1]:010d}.json"))) if numbers else Version()

    def _advance(self, change: Callable[[Version], Version]) -> Version:
        """Makes the next version; where another writer has just made it, the change is made to that one."""
        while True:
            now = self.version()
            new = replace(change(now), number=now.number + 1)
            try:
                write_text(self.spark, f"{self.folder}/versions/{new.number:010d}.json", json.dumps(asdict(new)), over=False)
                return new
            except FileExistsError:
                continue

    def commit(self, base: DataFrame, presets: DataFrame) -> Version:
        """Keeps a batch of rows of both tables, all or nothing."""
        batch = f"{self.folder}/data/{uuid.uuid4().hex}"
        for kind, rows in (("base", base), ("presets", presets)):
            self._typed(kind, rows).write.parquet(f"{batch}/{kind}")
        made = self._advance(lambda now: replace(now, batches=[*now.batches, batch]))
        return self.settle() if len(made.batches) >= self.settle_after else made

    def settle(self) -> Version:
        """Writes the last row of each key in buckets.  Batches that come meanwhile stay batches."""
        now, to = self.version(), f"{self.folder}/data/{uuid.uuid4().hex}"
        for kind in TABLES:
            rows = self.rows(kind, now).repartition(self.buckets, "relative_path")
            rows.write.format("parquet").bucketBy(self.buckets, "relative_path").option("path", f"{to}/{kind}").saveAsTable(self._name(to, kind))
        return self._advance(lambda late: replace(late, settled=to, buckets=self.buckets, batches=[b for b in late.batches if b not in now.batches]))

    def forget(self, keep: int = 1) -> None:
        """Deletes all versions but the last ``keep``, and what only these have listed; nobody may still read them or be committing."""
        numbers = self._numbers()
        kept = [self.version(n) for n in numbers[-keep:]]
        listed = {p for v in kept for p in (v.settled, *v.batches) if p}
        for n in numbers[:-keep]:
            files, path = hadoop(self.spark, f"{self.folder}/versions/{n:010d}.json")
            files.delete(path, False)
        files, data = hadoop(self.spark, f"{self.folder}/data")
        names = {p.rsplit("/", 1)[1] for p in listed}
        for s in files.listStatus(data) if files.exists(data) else ():
            if s.getPath().getName() not in names:
                files.delete(s.getPath(), True)

    def _typed(self, kind: str, rows: DataFrame) -> DataFrame:
        schema = self.spark.createDataFrame([], self.schemas[kind]).schema
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))

    @staticmethod
    def _name(folder: str, kind: str) -> str:
        return f"framewise_{kind}_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"

    def _settled(self, kind: str, version: Version) -> DataFrame | None:
        """The bucketed table, which this session may not know yet."""
        if version.settled is None:
            return None
        name = self._name(version.settled, kind)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self.schemas[kind]}) USING parquet CLUSTERED BY (relative_path) INTO {version.buckets} BUCKETS LOCATION '{version.settled}/{kind}'")
        return self.spark.table(name)

    def _recent(self, kind: str, version: Version) -> DataFrame:
        """The last row of each key that the batches hold."""
        rows = self.spark.createDataFrame([], self.schemas[kind]).withColumn(ORDER, F.lit(0))
        schema = rows.drop(ORDER).schema
        for i, batch in enumerate(version.batches):
            rows = rows.union(self.spark.read.schema(schema).parquet(f"{batch}/{kind}").withColumn(ORDER, F.lit(i)))
        return latest(rows, TABLES[kind], ORDER).drop(ORDER).select(*schema.names)

    def rows(self, kind: str, version: Version | None = None) -> DataFrame:
        """The last row of each key of the table ``base`` or ``presets``."""
        version = version or self.version()
        recent, settled = self._recent(kind, version), self._settled(kind, version)
        if settled is None:
            return recent
        both = settled.withColumn(ORDER, F.lit(0)).union(recent.withColumn(ORDER, F.lit(1)))
        return latest(both, TABLES[kind], ORDER).drop(ORDER).select(*recent.columns)

    def known(self, candidates: DataFrame, signature: str, preset: str, needs_pixels: bool = False) -> DataFrame:
        """As :func:`framewise.operators.cache.known`, without moving the settled rows: a path is in one bucket of either table."""
        version, out = self.version(), candidates
        for kind, where in (("base", F.col("pipeline_signature") == signature), ("presets", (F.col("pipeline_signature") == signature) & (F.col("preset") == preset))):
            found = []
            for part, rows in (("settled", self._settled(kind, version)), ("recent", self._recent(kind, version) if version.batches else None)):
                if rows is not None:
                    row = F.struct(*(c for c in rows.columns if c not in ("relative_path", "pipeline_signature", "preset")))
                    out = out.join(rows.where(where).select("relative_path", row.alias(f"_{kind}_{part}")), "relative_path", "left")
                    found.insert(0, F.col(f"_{kind}_{part}"))
            drop = [f"_{kind}_{part}" for part in ("settled", "recent")]
            empty = self.spark.createDataFrame([], self.schemas[kind]).schema
            none = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in empty if f.name not in ("relative_path", "pipeline_signature", "preset")))
            out = out.withColumn("_kept" if kind == "base" else "_scores", F.coalesce(*found) if found else F.when(F.lit(False), none)).drop(*drop)
        same = (F.col("_kept.size_bytes") == F.col("size_bytes")) & (F.col("_kept.modified_ns") == F.col("modified_ns"))
        out = out.withColumn("_kept", F.when(same, F.col("_kept").dropFields("size_bytes", "modified_ns")))
        return out.withColumn("route", way_of(F.col("_kept").isNotNull(), F.col("_scores").isNotNull(), needs_pixels))

    def evaluate(
        self, candidates: DataFrame, signature: str, preset: str, evaluate: Callable[[DataFrame], DataFrame], refresh: Callable[[DataFrame], DataFrame], rescan: DataFrame,
        batch: Column | None = None, batches: int = 1, needs_pixels: bool = False, mode: str = "use",
    ) -> list[incremental.Run]:
        """Runs (:func:`framewise.operators.incremental.finish`) of ``batches`` parts of the candidates, each kept before the next begins.

        ``batch`` numbers the part of a candidate from 0; without it a hash of the path does.  A run
        that was interrupted is begun again with the same call: what is kept is a hit then,
        and only the rest is evaluated.  In mode ``none`` nothing is kept.
        """
        incremental.check_mode(mode)
        part = F.pmod(F.xxhash64("relative_path"), F.lit(batches)) if batch is None else batch
        runs = []
        for i in range(batches):
            known = self.known(candidates.where(part == i), signature, preset, needs_pixels)
            run = incremental.finish(known, evaluate, refresh, rescan, mode)
            runs.append(run)
            if mode != "none":
                marks = {"pipeline_signature": F.lit(signature), "preset": F.lit(preset)}
                new = run.kept.withColumns(marks)
                scored = [c for c in self.spark.createDataFrame([], self.schemas["presets"]).columns]
                self.commit(new, new.select(*scored).union(run.refreshed.withColumns(marks).select(*scored)))
        return runs
