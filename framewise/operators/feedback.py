"""Decisions of people, and how well ranks agree with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.files import casefold, resolved
from framewise.operators.ordering import Ordered

DECISIONS = ("keep", "reject")


def decisions(rows: DataFrame, root: str | None = None, fold: bool = False) -> DataFrame:
    """``file_path, decision`` from ``rows(row_id, file_path, decision)``: the last decision of a path counts, blank ones don't.

    Another decision, or one without a path, is an error that names the row: by
    its ``row_text`` where ``rows`` has that, else by ``row_id``.  With ``root``, paths are normal
    ones below it or absolute, so that two spellings of a path are one.
    """
    word = F.regexp_replace(F.coalesce("decision", F.lit("")), r"(?U)^\s+|\s+$", "")
    word = casefold(word) if fold else F.lower(word)
    row = F.col("row_text" if "row_text" in rows.columns else "row_id").cast("string")
    told = lambda what: F.raise_error(F.concat(F.lit(f"{what} in row "), F.col("row_text"))).cast("string")
    path = F.col("file_path") if root is None else resolved(F.col("file_path"), root)
    known = rows.select("row_id", row.alias("row_text"), path.alias("file_path"), word.alias("word")).where("word <> ''")
    checked = known.withColumns({"word": F.when(F.col("word").isin(*DECISIONS), F.col("word")).otherwise(told("invalid decision")), "file_path": F.coalesce("file_path", told("no path"))})
    return checked.groupBy("file_path").agg(F.max_by("word", "row_id").alias("decision"))


def overlay(captures: DataFrame, feedback: DataFrame) -> DataFrame:
    """``captures`` with ``feedback_decision``, empty where there is none."""
    marks = feedback.select("file_path", F.col("decision").alias("feedback_decision"))
    return captures.join(marks, "file_path", "left").withColumn("feedback_decision", F.coalesce("feedback_decision", F.lit("")))


def agreement(ranked: DataFrame) -> DataFrame:
    """One row of measures over captures with ``composite_score, path_key, global_quality_rank, feedback_decision``.

    Pairs of a kept and a rejected capture are never joined: in the order of
    scores, each kept one counts the rejected ones strictly below by a running
    sum over distinct scores.
    """
    keep, reject = (F.col("feedback_decision") == d for d in DECISIONS)
    n = lambda c: F.count_if(c)
    n_keep = ranked.agg(n(keep).alias("k")).first()["k"]
    by_score = ranked.where(keep | reject).groupBy("composite_score").agg(n(keep).alias("n_keep"), n(reject).alias("n_reject"))
    below = Ordered(by_score, "composite_score", name="agreement").running_sum(F.col("n_reject"), "upto")
    correct = below.agg(F.coalesce(F.sum(F.col("n_keep") * (F.col("upto") - F.col("n_reject"))), F.lit(0)).alias("correct"))
    top = ranked.where((F.col("global_quality_rank") <= n_keep) & keep).agg(F.count("*").alias("in_top"))
    sums = ranked.agg(
        F.count("*").alias("total_images"), n(keep | reject).alias("labeled_images"), n(keep).alias("keeps"), n(reject).alias("rejects"),
        F.avg(F.when(keep, F.col("global_quality_rank"))).alias("mean_keep_global_rank"), F.avg(F.when(reject, F.col("global_quality_rank"))).alias("mean_reject_global_rank"),
    )
    one = sums.crossJoin(correct).crossJoin(top)  # of one row each
    share = lambda a, b: F.when(b > 0, a / b)
    return one.select(
        "total_images", "labeled_images", "keeps", "rejects", share(F.col("in_top"), F.col("keeps")).alias("precision_at_keep_count"),
        share(F.col("correct"), F.col("keeps") * F.col("rejects")).alias("pairwise_accuracy"), "mean_keep_global_rank", "mean_reject_global_rank",
    )


def common_root(paths: DataFrame, path: str = "file_path", by: tuple[str, ...] = ()) -> DataFrame:
    """The deepest directory above all paths, or those of each group: what the least and the greatest list of directories share."""
    parts = F.split(F.regexp_replace(path, "/[^/]*$", ""), "/")
    ends = paths.groupBy(*by).agg(F.min(parts).alias("a"), F.max(parts).alias("b"))
    same: Column = F.transform(F.arrays_zip("a", "b"), lambda x: x["a"] == x["b"])
    n = F.coalesce(F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False)).cast("int")), 0), F.lit(0))
    length = F.when(n == 0, F.size("a")).otherwise(n - 1)
    return ends.select(*by, F.array_join(F.slice("a", F.lit(1), length.cast("int")), "/").alias("root"))
