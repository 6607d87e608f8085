"""CSV files that people hand in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.files import casefold
from framewise.operators.feedback import decisions
from framewise.operators.ordering import Ordered


#: As spreadsheets and browsers write them: a quote within quotes is doubled.
CSV = {"header": True, "escape": '"'}


def read_feedback(spark: SparkSession, path: str, root: str, multiline: bool = False) -> DataFrame:
    """``file_path, decision`` of a CSV with at least these columns; the last row of a path counts.

    ``path`` may be a folder; its files count in the order of their names.  Rows
    are numbered by one sort of the file, so that an error tells the row as a
    spreadsheet shows it: the header is row 1, and lines without any value are none.  A file is
    cut at line ends and read by many tasks, unless ``multiline`` says that quoted
    values may hold some.
    """
    rows = spark.read.options(**CSV, multiLine=multiline).csv(path)
    if "file_path" not in rows.columns:
        raise ValueError("a feedback file has a column file_path")
    decision = F.col("decision") if "decision" in rows.columns else F.lit("")
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    numbered = Ordered(rows.select("file_path", decision.alias("decision"), *place), "_file", "_block", "_id", name="feedback").row_number("row_id")
    first = numbered.groupBy("_file").agg(F.min("row_id").alias("_first"))
    told = F.concat((F.col("row_id") - F.col("_first") + 2).cast("string"), F.lit(" of "), F.col("_file"))
    return decisions(numbered.join(first, "_file").select("row_id", told.alias("row_text"), "file_path", "decision"), root)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """A report's paths, scores and ranks, with their types; an error for a report without rows."""
    rows = spark.read.options(**CSV).csv(path)
    if not rows.columns or rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows.select("file_path", casefold("file_path").alias("path_key"), F.col("composite_score").cast("double"), F.col("global_quality_rank").cast("long"))
