"""A session of changes to a selection, in which a change makes anew only what hangs on it.

Each stage is a stored table; it names the stages and the settings it is made from.
A changed weight leaves the bursts as they are, a changed target leaves the
scores.  Tables of the last settings stay, so that a change taken back costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.scoring import SLIDERS, Profile, absolute_focus, composite, multipliers, positive, profile
from framewise.operators.bursts import BurstRules, burst_stats, group_bursts
from framewise.operators.ordering import AT, PART, Ordered, value_ranks
from framewise.operators.ranking import burst_ranks, with_percentile
from framewise.operators.selection import Target, pool_of, select_diverse, select_top, selection_changes
from framewise.storage import SHORT_ROWS, drop_tables, tables, write_table

LEVELS: dict[str, Callable[[BurstRules], BurstRules]] = {"tighter": BurstRules.tighter, "normal": lambda rules: rules, "looser": BurstRules.looser}
MODES = ("bursts", "photos")
#: What captures are put into bursts by, and what their scores are made of.
_LOOKS = ("ts_us", "sequence_number", "camera_serial", "camera_model", "phash")
_MEASURES = ("file_path", "feedback_decision", "focus_score", "aesthetic_score", "musiq_score", "exposure_penalty", "eye_factor", "subject_integrity")
#: Settings whose tables of a stage stay at once.
KEPT = 3


@dataclass(frozen=True)
class Settings:
    """``target``: a text as :class:`Target` takes it."""

    profile: Profile
    level: str = "normal"
    mode: str = "bursts"
    target: str = "none"
    diversity: float = 0.0

    def __post_init__(self) -> None:
        one_of("mode", self.mode, MODES)
        one_of("bursts", self.level, LEVELS)
        Target.parse(self.target)
        if not 0 <= self.diversity <= 1:
            raise ValueError(f"diversity is from 0 to 1, not {self.diversity}")


def one_of(name: str, value: str, choices: Iterable[str]) -> str:
    if value not in choices:
        raise ValueError(f"{name} is one of {', '.join(choices)}, not {value!r}")
    return value


def number(name: str, text: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise ValueError(f"{name} takes a number, not {text!r}") from None


#: What a command of two words sets.
_SET: dict[str, Callable[[Settings, str], Settings]] = {
    "mode": lambda s, v: replace(s, mode=v),
    "bursts": lambda s, v: replace(s, level=v),
    "start": lambda s, v: replace(s, profile=profile(v)),
    "diversity": lambda s, v: replace(s, diversity=number("diversity", v)),
    "target": lambda s, v: replace(s, target=v),
}
#: Commands that ask and set nothing; an empty line accepts the selection.
_ASK = {"": "export", "help": "help", "?": "help", "settings": "settings", "show": "show"}


def command(line: str, settings: Settings) -> tuple[str, Settings]:
    """What a line asks for, ``set`` where it changes something, and the settings after it.

    A line is one of the words above, ``mode``, ``bursts``, ``start``,
    ``diversity``, ``target`` or the name of a weight with one value, or a target alone.
    """
    words = line.casefold().split()
    if (head := words[0] if words else "") in _ASK:
        return _ASK[head], settings
    slider = head.replace("-", "_")
    if head not in _SET and slider not in SLIDERS:
        return "set", replace(settings, target=" ".join(words))
    if len(words) != 2:
        raise ValueError(f"{head} takes one value")
    if head in _SET:
        return "set", _SET[head](settings, words[1])
    return "set", replace(settings, profile=settings.profile.with_weights(**{slider: number(head, words[1])}))


@dataclass(frozen=True)
class Stage:
    """A stored table: ``make`` gets the settings and the tables of ``after``; it hangs on no other settings than ``on`` and theirs.

    What ``make`` gives is not written again where its rows are in a table that it wrote itself (``written``).
    """

    after: tuple[str, ...]
    on: tuple[str, ...]
    make: Callable[..., DataFrame]
    written: bool = False


class Session:
    """Selections of ``captures`` under changing settings; ``captures`` may have a ``feedback_decision``.

    With ``vectors``, as in :func:`group_bursts`, captures have a ``vec_id`` instead of an ``embedding``.
    ``built`` lists the stages in the order in which they were made.
    """

    def __init__(self, captures: DataFrame, settings: Settings, rules: BurstRules | None = None, vectors: DataFrame | None = None) -> None:
        self.settings, self.rules, self.vectors, self.built = settings, rules or BurstRules(), vectors, []
        if "feedback_decision" not in captures.columns:
            captures = captures.withColumn("feedback_decision", F.lit(""))
        self.captures = captures
        self._tables: dict[str, dict[tuple, tuple[tuple[str, ...], DataFrame]]] = {}
        self.stages = {
            "measures": Stage((), (), self._measures),
            "vectors": Stage((), (), self._vectors),
            "bursts": Stage(("measures",), ("level",), self._bursts),
            "scores": Stage(("bursts",), ("profile",), self._scores, written=True),
            "sizes": Stage(("scores",), (), lambda s, scores: scores.agg(F.count("*").alias("photos"), F.count_if("burst_winner").alias("bursts"))),
            "cut": Stage(("scores",), ("mode", "target", "diversity"), self._cut),
        }

    def _key(self, name: str, settings: Settings) -> tuple:
        stage = self.stages[name]
        return tuple(getattr(settings, f) for f in stage.on), *(self._key(a, settings) for a in stage.after)

    def table(self, name: str, settings: Settings | None = None) -> DataFrame:
        """The stored table of a stage, made where its settings have not been seen of late."""
        settings = settings or self.settings
        kept, key = self._tables.setdefault(name, {}), self._key(name, settings)
        if key not in kept:
            after = [self.table(a, settings) for a in self.stages[name].after]
            before = set(tables())
            made = self.stages[name].make(settings, *after)
            if self.stages[name].written:
                kept[key] = tuple(t for t in tables() if t not in before), made
            else:
                path = write_table(made, name)
                kept[key] = (path,), made.sparkSession.read.schema(made.schema).parquet(path)
            self.built.append(name)
            while len(kept) > KEPT:
                drop_tables(*kept.pop(next(iter(kept)))[0])
        else:
            kept[key] = kept.pop(key)  # the last used are kept
        return kept[key][1]

    def _measures(self, settings: Settings) -> DataFrame:
        """A row for each value of the focus, with its place among all."""
        return value_ranks(self.captures, positive(F.col("focus_score")))[0]

    def _vectors(self, settings: Settings) -> DataFrame:
        captures = self.captures if self.vectors is None else self.captures.join(F.broadcast(self.vectors), "vec_id", "left")
        return captures.select("path_key", "embedding")

    def _bursts(self, settings: Settings, measures: DataFrame) -> DataFrame:
        """All that scores are made of, so that they need no join of captures."""
        looks = (*_LOOKS, "embedding" if self.vectors is None else "vec_id")
        captures = self.captures.withColumn("feedback_decision", F.coalesce("feedback_decision", F.lit(""))).select("path_key", *looks, *_MEASURES)
        grouped = group_bursts(with_percentile(captures, measures), LEVELS[settings.level](self.rules), looks, self.vectors)
        return burst_stats(grouped).select("path_key", "burst_id", "burst_size", "relative_focus_factor", "focus_percentile", *(c for c in _MEASURES if c != "focus_score"))

    def _scores(self, settings: Settings, bursts: DataFrame) -> DataFrame:
        p = settings.profile
        told = bursts.withColumn("absolute_focus_factor", absolute_focus(F.col("focus_percentile"), p)).withColumns(multipliers(p)).withColumn("composite_score", composite(p))
        narrow = burst_ranks(told.select("path_key", "file_path", "composite_score", "burst_id", "burst_size", "feedback_decision"))
        free = ~F.col("feedback_decision").isin("keep", "reject")
        sums = {"selection_rank": F.col("burst_winner"), "_photos": free, "_bursts": free & F.col("burst_winner")}
        ordered = Ordered(narrow, F.desc("composite_score"), "path_key", name="scores", sums={k: v.cast("int") for k, v in sums.items()}, more=SHORT_ROWS)
        return ordered.placed("global_quality_rank").withColumn("selection_rank", F.when(F.col("burst_winner"), F.col("selection_rank"))).drop(PART, AT)

    def requested(self, settings: Settings | None = None) -> tuple[int, bool]:
        """How many captures the target asks for, of all photos or of the bursts' winners, and whether there are fewer than it says."""
        settings = settings or self.settings
        sizes = self.table("sizes", settings).first()
        return Target.parse(settings.target).of(sizes[settings.mode])

    def _cut(self, settings: Settings, scores: DataFrame) -> DataFrame:
        count, _ = self.requested(settings)
        pool, keep = pool_of(scores, settings.mode), F.col("feedback_decision") == "keep"
        pool, free = pool.drop("_photos", "_bursts"), pool.where(keep | (F.col(f"_{settings.mode}") <= count))
        if settings.diversity == 0:  # no other capture can be chosen, and few are left to sort
            return select_top(free.drop("_photos", "_bursts"), count, keep)
        picks = select_diverse(pool.join(self.table("vectors"), "path_key"), count, settings.diversity, keep)
        return pool.join(picks.withColumnRenamed("pick", "portfolio_selection_order"), "path_key")

    def selection(self) -> DataFrame:
        """The chosen captures of the present settings, with ``portfolio_selection_order``."""
        return self.table("cut")

    def summary(self) -> DataFrame:
        """One row of the present selection: ``photos`` and ``base`` to choose from, ``requested``, ``capped`` where there are fewer than the target says, ``selected``, ``keeps`` that people pinned, ``lowest_score`` of those chosen by score (null without any), and ``notes``."""
        count, capped = self.requested()
        sizes = self.table("sizes").select(F.col("photos").alias("photos"), F.col(self.settings.mode).alias("base"))
        keep = F.col("feedback_decision") == "keep"
        sums = self.selection().agg(F.count("*").alias("selected"), F.count_if(keep).alias("keeps"), F.min(F.when(~keep, F.col("composite_score"))).alias("lowest_score"))
        one = sizes.crossJoin(sums).withColumns({"requested": F.lit(count).cast("long"), "capped": F.lit(capped)})  # of one row each
        notes = F.array_compact(F.array(
            F.when(F.col("capped"), F.concat(F.lit("the target is more than there are: "), F.col("base"))),
            F.when(F.col("keeps") > F.col("requested"), F.concat(F.col("keeps"), F.lit(" pinned, more than the target; all are chosen"))),
            F.when(F.col("selected") < F.col("requested"), F.concat(F.col("selected"), F.lit(" are left after rejections"))),
        ))
        return one.select("photos", "base", "requested", "capped", "selected", "keeps", "lowest_score", notes.alias("notes"))

    def change(self, line: str) -> tuple[str, DataFrame | None]:
        """Does what a line says; after a change, who entered and left the selection.  A line that is none raises ValueError and changes nothing."""
        asked, settings = command(line, self.settings)
        if asked != "set":
            return asked, None
        before = self.selection()
        after = self.table("cut", settings)
        self.settings = settings
        return asked, selection_changes(before, after)

    def close(self) -> None:
        """Drops all stored tables."""
        drop_tables(*(path for kept in self._tables.values() for paths, _ in kept.values() for path in paths))
        self._tables.clear()
