"""Why a capture stands where it does, in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.files import one_digit
from framewise.functions.scoring import positive, power
from framewise.operators.ordering import value_ranks
from framewise.storage import LONG_EXPRESSIONS, SHORT_ROWS, stored

# Fixed values.
PENALTY_LIMIT, STANDING_LIMIT = 0.95, 25
MEASURES = (("aesthetic", "aesthetic_score"), ("sharpness", "focus_score"), ("technical quality", "musiq_score"))
FACTORS = ("aesthetic", "sharpness", "technical quality", "exposure", "eye check", "subject check")


def whole(x: Column) -> Column:
    """A whole number as text, halves to even."""
    return F.rint(x).cast("long").cast("string")


def ordinal(n: Column) -> Column:
    last = F.when((n % 100).between(10, 20), F.lit("th")).otherwise(F.element_at(F.array(*map(F.lit, ("th", "st", "nd", "rd", "th", "th", "th", "th", "th", "th"))), (n % 10 + 1).cast("int")))
    return F.concat(n.cast("string"), last)


def loss(multiplier: Column) -> Column:
    return F.concat(F.lit("(-"), whole(F.lit(100.0) * (F.lit(1.0) - multiplier)), F.lit("%)"))


def amount(high: Column, low: Column) -> Column:
    percent = F.lit(100.0) * (F.lit(1.0) - low / high)
    return F.when(low <= 0, F.lit("100%")).when(percent >= 99.5, F.lit("more than 99%")).when(percent >= 1, F.concat(whole(percent), F.lit("%"))).otherwise(F.lit("less than 1%"))


def factors(aesthetic_weight: float) -> list[Column]:
    return [
        power(positive(F.col("aesthetic_score")), float(aesthetic_weight)), F.col("absolute_focus_multiplier") * F.col("relative_focus_multiplier"),
        F.col("musiq_multiplier"), F.col("exposure_multiplier"), F.col("eye_multiplier"), F.col("subject_multiplier"),
    ]


def main_factor(ratios: list[Column]) -> Column:
    """The first factor with the largest ratio, where that is above 1; else null."""
    best = F.greatest(*ratios)
    named = None
    for ratio, name in zip(ratios, FACTORS):
        named = F.when(ratio == best, F.lit(name)) if named is None else named.when(ratio == best, F.lit(name))
    return F.when(best > 1, named)


def with_burst_clause(ranked: DataFrame, aesthetic_weight: float) -> DataFrame:
    """``ranked`` with ``_clause``, the place of each capture within its burst; winners are set against the second, others against the first.

    Of a burst only its first two are looked up, so no row is sorted for it.
    """
    burst, won = Window.partitionBy("burst_id"), F.col("burst_rank") == 1
    at = lambda rank: F.first(F.when(F.col("burst_rank") == rank, F.col("_me")), ignorenulls=True).over(burst)
    values = [f"f{i}" for i in range(len(FACTORS))]
    out = ranked.withColumn("_me", F.struct("file_name", "composite_score", *(v.alias(k) for k, v in zip(values, factors(aesthetic_weight)))))
    out = out.withColumns({"_first": at(1), "_second": at(2)}).withColumn("_other", F.when(won, F.col("_second")).otherwise(F.col("_first")))
    better = lambda field: F.when(won, F.col("_me")[field]).otherwise(F.col("_other")[field])
    worse = lambda field: F.when(won, F.col("_other")[field]).otherwise(F.col("_me")[field])
    out = out.withColumns({
        "_high": better("composite_score"), "_low": worse("composite_score"),
        **{f"_ratio_{k}": F.when(worse(k) > 0, better(k) / worse(k)).when(better(k) > 0, F.lit(float("inf"))).otherwise(F.lit(1.0)) for k in values},
    })
    out = out.withColumns({
        "_amount": amount(F.col("_high"), F.col("_low")), "_why": F.coalesce(F.concat(F.lit(", mainly on "), main_factor([F.col(f"_ratio_{k}") for k in values])), F.lit("")), "_name": F.col("_other.file_name"),
        "_place": F.concat(F.when(won, F.lit("best")).otherwise(ordinal(F.col("burst_rank"))), F.lit(" of "), F.col("burst_size").cast("string"), F.lit(" in burst; ")),
    })
    tied = F.concat(F.lit("ties "), F.col("_name"), F.when(won, F.lit(" on score and wins on path order")).otherwise(F.lit(" on score and loses on path order")))
    lower = F.when(won, F.concat(F.lit("next best "), F.col("_name"), F.lit(" scored "), F.col("_amount"), F.lit(" lower"), F.col("_why"))).otherwise(
        F.concat(F.lit("scored "), F.col("_amount"), F.lit(" lower than "), F.col("_name"), F.col("_why"))
    )
    clause = F.when(F.col("burst_size") == 1, F.lit("single shot")).otherwise(F.concat(F.col("_place"), F.when(F.col("_low") >= F.col("_high"), tied).otherwise(lower)))
    return out.withColumn("_clause", clause).drop("_me", "_first", "_second", "_other", "_high", "_low", "_amount", "_why", "_name", "_place", *(f"_ratio_{k}" for k in values))


def standings(ranked: DataFrame) -> DataFrame:
    """``top_percent, top_label, bottom_percent, bottom_label`` of each capture among all.

    A null or NaN measure counts as 0, as it does in the score.  One join on
    each measure's distinct values; a value that many captures share is one row
    on the small side.  ``ranked`` is read for the counts and for the rows, so
    it should be a written table.
    """
    value = lambda field: F.when(F.col(field).isNull() | F.isnan(field), F.lit(0.0)).otherwise(F.col(field).cast("double")) + F.lit(0.0)
    ranks = value_ranks(ranked, *(value(field) for _, field in MEASURES))
    out, n = ranked, range(len(MEASURES))
    for i, (_, field) in enumerate(MEASURES):
        key = f"_v{i}"
        of = ranks[i].select(
            F.col("value").alias(key), F.ceil(F.lit(100) * (F.col("total") - F.col("below")) / F.col("total")).alias(f"_top{i}"), F.ceil(F.lit(100) * F.col("upto") / F.col("total")).alias(f"_bottom{i}")
        )
        out = out.withColumn(key, value(field)).join(of, key).drop(key)

    def first_at(side: str) -> Column:
        """The number of the first measure that has the least percent of a side."""
        return F.coalesce(*(F.when(F.col(f"_{side}{i}") == F.col(f"{side}_percent"), F.lit(i)) for i in n))

    label = lambda at: F.element_at(F.array(*(F.lit(label) for label, _ in MEASURES)), at + 1)
    out = out.withColumn("top_percent", F.least(*(f"_top{i}" for i in n))).withColumn("_best", first_at("top"))
    named = F.when(F.col("top_percent") <= STANDING_LIMIT, F.col("_best")).otherwise(F.lit(-1))  # not named a second time
    out = out.withColumns({f"_bottom{i}": F.when(named != i, F.col(f"_bottom{i}")) for i in n})
    out = out.withColumn("bottom_percent", F.least(*(f"_bottom{i}" for i in n)))
    out = out.withColumns({"top_label": label(F.col("_best")), "bottom_label": label(first_at("bottom"))})
    return out.drop("_best", *(f"_{k}{i}" for k in ("top", "bottom") for i in n))


def penalty_clauses() -> list[Column]:
    warning = F.coalesce("eye_warning", F.lit(""))
    warning = F.concat(F.lower(F.substring(warning, 1, 1)), F.substring(warning, 2, 1_000_000))
    clipped = F.concat(F.lit("clipping "), loss(F.col("exposure_multiplier")), F.lit(": "), one_digit(F.col("blown_pct")), F.lit("% highlights blown, "), one_digit(F.col("crushed_pct")), F.lit("% shadows crushed"))
    return [
        F.when(F.col("exposure_multiplier") <= PENALTY_LIMIT, clipped),
        F.when(F.col("eye_multiplier") <= PENALTY_LIMIT, F.concat(F.when(warning != "", warning).otherwise(F.lit("eye check")), F.lit(" "), loss(F.col("eye_multiplier")))).when(warning != "", warning),
        F.when(F.col("subject_multiplier") <= PENALTY_LIMIT, F.concat(F.lit("weak subject check "), loss(F.col("subject_multiplier")))),
    ]


def score_reasons(ranked: DataFrame, aesthetic_weight: float = 1.0, grouped: bool = True) -> DataFrame:
    """``ranked``, without the embedding, with ``score_reason``.

    All that needs no standing is told in the pass that writes ``ranked``.
    """
    ranked = ranked.drop("embedding")
    told = with_burst_clause(ranked, aesthetic_weight) if grouped else ranked
    out = standings(stored(told.withColumn("_penalties", F.concat_ws("; ", *penalty_clauses())), "ranked", LONG_EXPRESSIONS | SHORT_ROWS))
    clauses = [F.col("_clause")] if grouped else []
    for side in ("top", "bottom"):
        of = F.concat(F.col(f"{side}_label"), F.lit(f" in {side} "), F.col(f"{side}_percent").cast("string"), F.lit("% of all photos"))
        clauses.append(F.when(F.col(f"{side}_percent") <= STANDING_LIMIT, of))
    text = F.concat_ws("; ", *clauses, F.when(F.col("_penalties") != "", F.col("_penalties")))
    return out.withColumn("score_reason", F.when(text == "", F.lit("no standout strength or penalty")).otherwise(text)).drop("_clause", "_penalties", "top_percent", "top_label", "bottom_percent", "bottom_label")
