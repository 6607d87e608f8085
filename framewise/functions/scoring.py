"""Scores of a capture as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    name: str
    aesthetic_weight: float = 1.0
    absolute_focus_floor: float = 0.5
    absolute_focus_weight: float = 1.0
    relative_focus_exponent: float = 1.5
    musiq_weight: float = 1.0
    exposure_weight: float = 1.0
    eye_weight: float = 0.0
    subject_weight: float = 0.0

    def with_weights(self, **sliders: float) -> Profile:
        """The profile with the weights of named sliders, each from 0 to 3."""
        for slider, value in sliders.items():
            if slider not in SLIDERS:
                raise ValueError(f"unknown weight {slider!r}; choose from {', '.join(SLIDERS)}")
            if not 0 <= value <= 3:
                raise ValueError(f"{slider} must be from 0 to 3, not {value}")
        return replace(self, **{SLIDERS[s]: float(v) for s, v in sliders.items()})


# Fixed values.
PROFILES = {
    "balanced": Profile("balanced", absolute_focus_weight=0.5),
    "wildlife": Profile("wildlife", 1.0, 0.55, 0.8, 1.8, 1.0, 0.8, 0.0, 0.2),
    "portrait": Profile("portrait", 1.0, 0.6, 0.7, 1.6, 1.0, 0.8, 0.35, 0.15),
    "landscape": Profile("landscape", 1.0, 0.45, 1.2, 1.2, 1.1, 1.2, 0.0, 0.15),
}
SLIDERS = {
    "appeal": "aesthetic_weight", "sharpness": "absolute_focus_weight", "burst_sharpness": "relative_focus_exponent",
    "quality": "musiq_weight", "exposure": "exposure_weight", "eyes": "eye_weight", "subject": "subject_weight",
}
assert set(SLIDERS.values()) < {f.name for f in fields(Profile)}

#: Multiplier columns, in the order in which the composite takes them.
MULTIPLIERS = ("absolute_focus_multiplier", "relative_focus_multiplier", "musiq_multiplier", "exposure_multiplier", "eye_multiplier", "subject_multiplier")


def profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; choose from {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def clamp(x: Column) -> Column:
    """Between 0 and 1; NaN and null are 0."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def positive(x: Column) -> Column:
    """At least 0; NaN and null are 0."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), x))


def absolute_focus(percentile: Column, p: Profile) -> Column:
    return F.lit(p.absolute_focus_floor) + F.lit(1.0 - p.absolute_focus_floor) * percentile


def power(x: Column, weight: float) -> Column:
    """``x``, which is not null or below 0, to a weight, by the C library's ``pow``.

    Spark's own is off by a last bit for one value in ten, by which captures of
    nearly equal scores change places.
    """
    if weight in (0.0, 1.0):
        return x if weight else F.lit(1.0)

    def powers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = batch.dictionary_encode()  # few are different
            yield pa.array([v**weight for v in values.dictionary.to_pylist()], pa.float64()).take(values.indices)

    return F.arrow_udf(powers, "double")(x)


def multipliers(p: Profile) -> dict[str, Column]:
    """The six multipliers from ``absolute_focus_factor``, ``relative_focus_factor``, ``musiq_score``, ``exposure_penalty``, ``eye_factor`` and ``subject_integrity``."""
    terms = (
        (F.col("absolute_focus_factor"), p.absolute_focus_weight), (F.col("relative_focus_factor"), p.relative_focus_exponent), (F.col("musiq_score") / F.lit(100.0), p.musiq_weight),
        (F.col("exposure_penalty"), p.exposure_weight), (F.col("eye_factor"), p.eye_weight), (F.col("subject_integrity"), p.subject_weight),
    )
    return {name: power(clamp(x), float(weight)) for name, (x, weight) in zip(MULTIPLIERS, terms)}


def composite(p: Profile) -> Column:
    """The weighted aesthetic score times the multiplier columns."""
    out = power(positive(F.col("aesthetic_score")), float(p.aesthetic_weight))
    for name in MULTIPLIERS:
        out = out * F.col(name)
    return out


def exposure_penalty(blown: Column, crushed: Column) -> Column:
    """From the shares of blown and crushed pixels."""
    over = lambda x, allowed: F.greatest(F.lit(0.0), x - F.lit(allowed))
    return F.greatest(F.lit(0.4), F.lit(1.0) - F.lit(5.0) * over(blown, 0.02)) * F.greatest(F.lit(0.6), F.lit(1.0) - F.lit(2.0) * over(crushed, 0.05))


def eye_rule(faces: Column, eyes: Column) -> tuple[Column, Column]:
    """Factor and warning from the numbers of faces and eyes."""
    factor = F.when((faces > 0) & (eyes == 0), F.lit(0.7)).otherwise(F.lit(1.0))
    warning = F.when(faces == 0, F.lit("No face detected")).when(eyes == 0, F.lit("Possible closed/obscured eyes")).otherwise(F.lit(""))
    return factor, warning


def rating(rank: Column, total: Column) -> Column:
    """Five stars for the first tenth, four up to two fifths, else three."""
    share = (rank - F.lit(1)) / total
    return F.when(share < F.lit(0.1), 5).when(share < F.lit(0.4), 4).otherwise(3).cast("int")
