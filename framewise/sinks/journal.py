"""What a run did, as a table: a row for each step, with its seconds and the rows that passed.

Rows are counted by an ``Observation`` on the write that makes a step's result,
so counting takes no job of its own.  ``run.json`` in the run's folder is one rendering of
the table, with the options, models and software of the run.
"""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from framewise.sinks.reports import FAILURE_COLUMNS, report_rows
from framewise.storage import make_folder, write_text

STEPS = "step string, began timestamp, seconds double, outcome string, counts map<string, long>"


@dataclass
class Step:
    step: str
    began: datetime
    seconds: float = 0.0
    outcome: str = "open"
    counts: dict[str, int] = field(default_factory=dict)


class Journal:
    """The steps of one run; the driver holds a few hundred bytes for each.

    ``folder`` must be new, in any store that Spark writes to.  ``options`` is what the run was
    asked for, ``models`` maps the name of each model to its version or digest.
    """

    def __init__(self, spark: SparkSession, folder: str, options: dict[str, Any] | None = None, models: dict[str, str] | None = None) -> None:
        make_folder(spark, folder)
        self.spark, self.folder = spark, folder.rstrip("/")
        self.options, self.models = dict(options or {}), dict(models or {})
        self.done: list[Step] = []
        self.files: dict[str, str] = {}
        self._told()

    @contextmanager
    def step(self, name: str) -> Iterator[Step]:
        """Times what is done inside; an error is the step's outcome and goes on."""
        one, began = Step(name, datetime.now(UTC)), time.perf_counter()
        self.done.append(one)
        self._told()
        try:
            yield one
            one.outcome = "done"
        except BaseException as error:
            one.outcome = f"{type(error).__name__}: {error}".splitlines()[0][:300]
            raise
        finally:
            one.seconds = round(time.perf_counter() - began, 6)
            self._told()

    def write(self, step: Step, rows: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict[str, int]:
        """Has ``rows`` written by ``write``, in one job, and gives the aggregates ``counts`` of the rows that passed."""
        made = observed(rows, write, **counts)
        for name, n in made.items():
            step.counts[name] = step.counts.get(name, 0) + n
        self._told()
        return made

    def output(self, name: str, path: str) -> None:
        self.files[name] = path
        self._told()

    def table(self) -> DataFrame:
        """``step, began, seconds, outcome, counts``, in the order of their beginnings."""
        return self.spark.createDataFrame([tuple(asdict(s).values()) for s in self.done], STEPS)

    def costs(self) -> DataFrame:
        """``step, seconds, rows`` and ``rows_a_second`` of steps by name, where ``rows`` is the largest count."""
        most = F.array_max(F.map_values("counts"))
        return self.table().groupBy("step").agg(F.sum("seconds").alias("seconds"), F.coalesce(F.sum(most), F.lit(0)).alias("rows")).withColumn("rows_a_second", F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds")))

    def rendered(self) -> dict[str, Any]:
        software = {"python": platform.python_version(), "spark": self.spark.version, "platform": platform.platform(), "master": self.spark.sparkContext.master}
        steps = [asdict(s) | {"began": s.began.isoformat()} for s in self.done]
        return {"options": self.options, "models": self.models, "software": software, "steps": steps, "files": self.files}

    def _told(self) -> None:
        write_text(self.spark, f"{self.folder}/run.json", json.dumps(self.rendered(), indent=1, default=str) + "\n")

    def failures(self, rows: DataFrame) -> None:
        """Adds the failures of a step to ``failures`` in the folder, one commit a step; without any, the header is there all the same."""
        report_rows(rows, FAILURE_COLUMNS).write.mode("append").option("header", True).csv(f"{self.folder}/failures")


def observed(rows: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict[str, int]:
    """The aggregates ``counts`` of ``rows``, taken while ``write`` writes them."""
    watch = Observation()
    write(rows.observe(watch, *(c.alias(name) for name, c in counts.items())))
    return {name: watch.get[name] or 0 for name in counts}
