"""Capture time and camera from metadata tags, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"^\s*(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:?\d{2})?\s*$"
EMBEDDED, ASSUMED = "embedded_offset", "system_local_assumption"


@dataclass(frozen=True)
class CaptureTime:
    """``column`` is a struct of ``micros`` since 1970 (null where the text is no time), minutes of the offset, and where the offset is from."""

    column: Column

    @property
    def micros(self) -> Column:
        return self.column["micros"]

    @property
    def offset_minutes(self) -> Column:
        return self.column["offset_minutes"]

    @property
    def zone_source(self) -> Column:
        return self.column["zone_source"]


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, where ``value`` is evaluated once however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def capture_time(text: Column, subsecond: Column | None = None, offset: Column | None = None, zone: str = "UTC") -> CaptureTime:
    """A time like ``2024:01:31 12:00:00.25+05:30``.

    Digits after the sixth are cut.  The text's own offset comes before
    ``offset``; without either, the time is local to ``zone``.  An impossible
    date, time or offset gives null.  The text is matched once.
    """
    parts = F.split(F.when(text.rlike(_DATE), F.regexp_replace(text, _DATE, "$1-$2-$3 $4:$5:$6|$7|$8")), r"\|")  # second, fraction, offset
    extra = F.regexp_replace(subsecond, r"\D", "") if subsecond is not None else F.lit("")
    other = F.trim(offset) if offset is not None else F.lit("")
    given = F.struct(parts.alias("parts"), extra.alias("extra"), other.alias("other"))

    def with_offset(x: Column) -> Column:
        own = F.coalesce(F.nullif(x["parts"][2], F.lit("")), x["other"], F.lit(""))
        wall = F.unix_micros(F.try_to_timestamp(F.concat(x["parts"][0], F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX")))  # as if of UTC, whatever the session's zone
        micros = F.rpad(F.substring(F.coalesce(F.nullif(x["parts"][1], F.lit("")), x["extra"], F.lit("")), 1, 6), 6, "0").cast("long")
        return _bound(F.struct(own.alias("own"), wall.alias("wall"), micros.alias("micros")), found)

    def found(x: Column) -> Column:
        number = F.regexp_replace(F.when(x["own"].rlike(r"^[+-]\d{2}:?\d{2}$"), x["own"]), ":", "").try_cast("int")  # hours and minutes as hhmm
        minutes = F.when(x["own"] == "Z", 0).otherwise((number / 100).cast("int") * 60 + number % 100)
        return _bound(F.struct(x["own"].alias("own"), x["wall"].alias("wall"), x["micros"].alias("micros"), F.when(F.abs(minutes) < 1440, minutes).alias("minutes")), last)

    def last(x: Column) -> Column:
        local = x["wall"] if zone == "UTC" else F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(x["wall"]), zone))
        start = F.when(x["own"] == "", local).otherwise(x["wall"] - x["minutes"].cast("long") * 60_000_000)
        return F.struct((start + x["micros"]).alias("micros"), x["minutes"].alias("offset_minutes"), F.when(x["own"] == "", F.lit(ASSUMED)).otherwise(F.lit(EMBEDDED)).alias("zone_source"))

    return CaptureTime(_bound(given, with_offset))


def wall_micros(time: Column) -> Column:
    """Micros since 1970 of a time without a zone, as if of UTC, whatever the session's zone."""
    seconds = (F.unix_date(time.cast("date")).cast("long") * 24 + F.hour(time)) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("second"), time) * 1_000_000).cast("long")


def first_time(candidates: list[tuple[str, CaptureTime]], fallback_micros: Column) -> Column:
    """``struct(micros, source, zone_source)`` of the first candidate that is a time, else of the file's own."""

    def of(source: str) -> Callable[[Column], Column]:
        return lambda t: F.struct(t["micros"].alias("micros"), F.lit(source).alias("source"), t["zone_source"].alias("zone_source"))

    found = [_bound(c.column, of(source)) for source, c in candidates]
    fallback = F.struct(fallback_micros.alias("micros"), F.lit("filesystem_mtime").alias("source"), F.lit(ASSUMED).alias("zone_source"))
    return F.coalesce(F.get(F.filter(F.array(*found), lambda t: t["micros"].isNotNull()), F.lit(0)), fallback)


def first_tag(tags: Column, *names: str) -> Column:
    """The first of the tags that is not empty; else an empty text."""
    return F.coalesce(*(F.nullif(F.try_element_at(tags, F.lit(n)), F.lit("")) for n in names), F.lit(""))


def camera_columns(tags: Column) -> dict[str, Column]:
    return {
        "camera_model": first_tag(tags, "Model", "CameraModelName"), "camera_serial": first_tag(tags, "SerialNumber", "InternalSerialNumber"),
        "sequence_number": first_tag(tags, "SequenceNumber", "ImageNumber"), "autofocus_info": first_tag(tags, "AFPointsUsed", "AFPoint"),
    }
