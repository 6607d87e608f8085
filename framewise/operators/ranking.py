"""Percentiles, composite scores and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.scoring import Profile, absolute_focus, composite, multipliers, positive
from framewise.operators.bursts import BurstRules, burst_stats, group_bursts, ungrouped
from framewise.operators.ordering import AT, PART, Ordered, value_ranks
from framewise.storage import SHORT_ROWS


def with_percentile(captures: DataFrame, ranks: DataFrame) -> DataFrame:
    """``focus_percentile`` by mid-rank (equal values share the mean of their ranks), from the :func:`value_ranks` of the focus."""
    middle = (F.col("below") + F.lit(1) + F.col("upto")) / F.lit(2.0) / F.col("total")
    joined = captures.withColumn("_focus", positive(F.col("focus_score"))).join(ranks.withColumnRenamed("value", "_focus"), "_focus")
    return joined.withColumn("focus_percentile", middle).drop("_focus", "below", "upto", "total")


def focus_percentile(captures: DataFrame, p: Profile) -> DataFrame:
    """``focus_percentile`` and ``absolute_focus_factor``."""
    joined = with_percentile(captures, value_ranks(captures, positive(F.col("focus_score")))[0])
    return joined.withColumn("absolute_focus_factor", absolute_focus(F.col("focus_percentile"), p))


def scored(
    captures: DataFrame, p: Profile, rules: BurstRules | None = None, grouped: bool = True, numbered: bool = True, without: tuple[str, ...] = (), vectors: DataFrame | None = None
) -> DataFrame:
    """Bursts, multipliers and ``composite_score`` of each capture; its embedding is of no more use then and does not travel further, nor do columns ``without``.

    Captures that are not grouped are bursts of one; without ``numbered`` they get no ``burst_id``, which takes a sort.
    ``vectors`` are as in :func:`group_bursts`.
    """
    placed, without = focus_percentile(captures, p), ("embedding", "vec_id", *without)
    if grouped:
        groups = burst_stats(group_bursts(placed, rules, without, vectors))
    else:
        groups = ungrouped(placed.drop("embedding", "vec_id")) if numbered else placed.drop(*without)
        groups = groups.withColumns({"burst_size": F.lit(1).cast("long"), "relative_focus_factor": F.lit(1.0)})
    return groups.withColumns(multipliers(p)).withColumn("composite_score", composite(p))


def burst_ranks(scores: DataFrame) -> DataFrame:
    """``burst_rank`` and ``burst_winner``; ties go to the lesser path."""
    order = Window.partitionBy("burst_id").orderBy(F.desc("composite_score"), "path_key")
    return scores.withColumn("burst_rank", F.row_number().over(order).cast("long")).withColumn("burst_winner", F.col("burst_rank") == 1)


def global_rank(scores: DataFrame, name: str = "global_quality_rank") -> DataFrame:
    return Ordered(scores, F.desc("composite_score"), "path_key", name=name).row_number(name)


def evaluated(captures: DataFrame, p: Profile, rules: BurstRules | None = None, grouped: bool = True, without: tuple[str, ...] = (), vectors: DataFrame | None = None) -> DataFrame:
    """All ranks of all captures; ``selection_rank`` is among the winners of bursts, null for the others.

    Both ranks are sums along one order.
    """
    scores = burst_ranks(scored(captures, p, rules, grouped, without=without, vectors=vectors))
    ordered = Ordered(scores, F.desc("composite_score"), "path_key", name="evaluated", sums={"selection_rank": F.col("burst_winner").cast("int")}, more=SHORT_ROWS)
    ranked = ordered.placed("global_quality_rank")
    return ranked.withColumn("selection_rank", F.when(F.col("burst_winner"), F.col("selection_rank"))).drop(PART, AT)
