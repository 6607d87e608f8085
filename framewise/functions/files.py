"""Names, extensions and keys of files as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
RAW_EXTENSIONS = ("3fr", "arw", "cr2", "cr3", "dng", "erf", "iiq", "kdc", "mos", "mrw", "nef", "orf", "pef", "raf", "rw2", "sr2", "srw", "x3f")
STANDARD_EXTENSIONS = ("bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp")
SIDECAR_EXTENSIONS = ("cos", "dop", "on1", "pp3", "xmp")
SYSTEM_DIRECTORIES = (".fseventsd", ".spotlight-v100", ".temporaryitems", ".trash", ".trashes", "$recycle.bin", "@eadir", "lost+found", "system volume information")
GENERATED_DIRECTORY = r"(?i)^(picks|run)_\d{8}_\d{6}(_\d{6})?$"
IMAGE_EXTENSIONS = RAW_EXTENSIONS + STANDARD_EXTENSIONS


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Python's case folding, for keys by which files are one family or one destination; Spark has lower() only."""
    return text.map(lambda t: None if t is None else t.casefold())


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(name: Column) -> Column:
    """In lower case, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def logical_stem(name: Column) -> Column:
    """The stem of an asset's family: a sidecar of ``a.arw`` may be ``a.xmp`` or ``a.arw.xmp``."""
    outer = stem(name)
    double = extension(name).isin(*SIDECAR_EXTENSIONS) & extension(outer).isin(*IMAGE_EXTENSIONS)
    return casefold(F.when(double, stem(outer)).otherwise(outer))


def is_pruned_directory(part: Column) -> Column:
    return F.lower(part).isin(*SYSTEM_DIRECTORIES) | part.rlike(GENERATED_DIRECTORY)


def is_source_image(path: Column) -> Column:
    """A supported image outside of generated and system directories, and no resource fork."""
    directories = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return extension(file_name(path)).isin(*IMAGE_EXTENSIONS) & ~file_name(path).startswith("._") & ~F.exists(directories, is_pruned_directory)


def relative_key(path: Column, root: str) -> Column:
    """The path below ``root``; an error for a path outside of it."""
    top = root.rstrip("/") + "/"
    outside = F.raise_error(F.concat(path, F.lit(f" is outside of {root}"))).cast("string")
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1_000_000)).otherwise(outside)


def normal_path(path: Column) -> Column:
    """A path without empty parts, ``.`` and ``..``, which take the part before them; what a scheme says stays, links are not followed."""
    scheme = F.regexp_extract(path, r"^(?:[A-Za-z][A-Za-z0-9+.-]+:(?://[^/]*)?)?(?=/)", 0)

    def step(out: Column, part: Column) -> Column:
        above = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(part.isin("", "."), out).when(part == "..", above).otherwise(F.concat(out, F.array(part)))

    parts = F.aggregate(F.split(F.substring(path, F.length(scheme) + 1, F.length(path)), "/"), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"/\.{0,2}(/|$)"), F.concat(scheme, F.lit("/"), F.array_join(parts, "/"))).otherwise(path)


def resolved(path: Column, root: str) -> Column:
    """The normal form of a path, which is below ``root`` unless it is absolute or has a scheme."""
    absolute = path.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]+:/)")
    return normal_path(F.when(absolute, path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)))


def signature(parts: Iterable[tuple[str, str]]) -> str:
    return ";".join(f"{k}={v}" for k, v in parts)


def strip_preset(text: Column) -> tuple[Column, Column]:
    """The signature without its preset, and the preset (empty without one)."""
    parts = F.split(text, ";")
    presets = F.filter(parts, lambda p: p.startswith("preset="))
    return F.array_join(F.filter(parts, lambda p: ~p.startswith("preset=")), ";"), F.coalesce(F.substring(F.try_element_at(presets, F.lit(1)), 8, 1_000_000), F.lit(""))


def byte_text(count: Column) -> Column:
    """A size as ``512 B``, ``1.5 KiB``, ``3.0 MiB`` or ``2.0 GiB``."""
    value, out = count.cast("double"), None
    for i, unit in enumerate(("B", "KiB", "MiB", "GiB")):
        text = F.concat(F.rint(value).cast("long").cast("string") if i == 0 else one_digit(value / 1024.0**i), F.lit(f" {unit}"))
        last = unit == "GiB"
        out = F.when(value < 1024.0 ** (i + 1), text) if out is None else out.otherwise(text) if last else out.when(value < 1024.0 ** (i + 1), text)
    return out


def duration_text(seconds: Column) -> Column:
    """``1h 5m``, ``5m 3s`` or ``3s``; parts of a second round, halves to even."""
    n = F.greatest(F.lit(0), F.rint(seconds).cast("long"))
    h, m, s = (x.cast("string") for x in (F.floor(n / 3600), F.floor(n / 60) % 60, n % 60))
    return F.when(n >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(n >= 60, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def one_digit(x: Column) -> Column:
    """A number of at least 0 with one digit after the point, rounded as its exact binary value demands, halves to even.

    With t tenths below it, 20 x less the odd number 2 t + 1 tells on which
    side of the middle x lies; near the middle that difference is exact.
    """
    tenths = F.floor(x * 10)
    odd = (2 * tenths + 1).cast("double")
    side = (16 * x - odd) + 4 * x
    made = tenths + F.when(side > 0, 1).when(side < 0, 0).otherwise(tenths % 2)
    return F.concat(F.floor(made / 10).cast("string"), F.lit("."), (made % 10).cast("string"))


def csv_safe(text: Column) -> Column:
    """A text that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def thumbnail_key(relative: Column, size_bytes: Column, modified_ns: Column, dimension: int = 2048) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", relative, size_bytes, modified_ns, F.lit(dimension)).cast("binary"), 256), 1, 32)
