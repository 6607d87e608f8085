"""Measures of pixels, and providers of model scores."""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewise.functions.resample import fitted, resized
from framewise.sources.tags import file_tags
from framewise.storage import let_workers_import


def tile_bounds(length: int, sections: int) -> np.ndarray:
    """Edges of nearly equal tiles; the first ones are longer by one where it does not divide."""
    return np.append(0, np.cumsum([length // sections + (i < length % sections) for i in range(sections)]))


def tile_edges(length: str, sections: int) -> Column:
    """The same as an array column, from a column of lengths."""
    n = F.col(length)
    base, rest = F.floor(n / sections), n % sections
    return F.transform(F.sequence(F.lit(0), F.lit(sections)), lambda i: (i * base + F.least(i, rest)).cast("long"))


def gray(bgr: np.ndarray) -> np.ndarray:
    """Rounded luminance of blue, green, red."""
    return np.rint(bgr[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299]))


def laplacian(image: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours less four times the pixel; the border mirrors without repeating its edge."""
    p = np.pad(image.astype(np.float64), 1, mode="reflect") if min(image.shape) > 1 else np.pad(image.astype(np.float64), 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image


def focus_score(bgr: np.ndarray, grid: int = 16, share: float = 0.03) -> float:
    """The mean variance of the sharpest tiles; of the whole image where tiles would be under eight pixels."""
    edges = laplacian(gray(bgr))
    height, width = edges.shape
    if min(height, width) // grid < 8:
        return float(edges.var())
    rows, columns = tile_bounds(height, grid)[:-1], tile_bounds(width, grid)[:-1]
    tile = lambda x: np.add.reduceat(np.add.reduceat(x, rows, 0), columns, 1)
    n = tile(np.ones_like(edges))
    variance = np.maximum(tile(edges**2) / n - (tile(edges) / n) ** 2, 0).ravel()
    return float(np.sort(variance)[::-1][: max(1, round(len(variance) * share))].mean())


def clipping(bgr: np.ndarray) -> tuple[float, float]:
    """Shares of pixels with any channel blown, and with all crushed."""
    pixels = bgr[..., None] if bgr.ndim == 2 else bgr
    return float((pixels >= 254).any(2).mean()), float((pixels <= 1).all(2).mean())


def draft_box(width: Column, height: Column, longest: int) -> Column:
    """``struct(width, height)`` of the box in which a decoder may draft a picture whose longest side becomes ``longest``."""
    part = lambda x, y: F.greatest(F.lit(1), F.rint(F.lit(float(longest)) * x / y).cast("int"))
    box = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    whole = F.lit(longest)
    return F.when((width <= 0) | (height <= 0), box(whole, whole)).when(width >= height, box(whole, part(height, width))).otherwise(box(part(width, height), whole))


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """The picture upright, by the eight values of the orientation tag; others leave it."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


def perceptual_hashes(gray32: np.ndarray) -> list[int]:
    """64 bits for each of a stack of gray pictures of 32 by 32: which of the lowest cosine terms are above their median, the first bit highest."""
    terms = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(32) + 1) / 64)
    low = (terms @ gray32.astype(np.float64) @ terms.T).reshape(len(gray32), 64)
    bits = low > np.median(low, axis=1, keepdims=True)
    return [int.from_bytes(row.tobytes(), "big") for row in np.packbits(bits, axis=1)]


def perceptual_hash(gray32: np.ndarray) -> int:
    return perceptual_hashes(gray32[None])[0]


def picture(data: bytes, height: int, width: int, channels: int, orientation: int = 1, longest: int | None = None) -> np.ndarray:
    """Blue, green, red of one row of Spark's image source, upright, its longest side ``longest`` at most."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    pixels = np.repeat(pixels, 3, 2) if channels == 1 else pixels[..., :3]
    return oriented(pixels if longest is None else fitted(pixels, longest), orientation)


MEASURES = "height int, width int, focus_score double, blown double, crushed double, phash long, error string"


def _turned(origin: str) -> int:
    """The orientation that the head of a local file tells; 1 where it tells none."""
    path = unquote(urlparse(origin).path)
    try:
        with open(path, "rb", buffering=4096) as file:
            value = file_tags(file, file.seek(0, 2)).get("Orientation", "1")
    except (OSError, ValueError, struct.error):
        return 1
    return int(value) if value in ("2", "3", "4", "5", "6", "7", "8") else 1


def measure_images(images: DataFrame, longest: int | None = 1024, upright: bool = False) -> DataFrame:
    """``origin``, the size that a picture is measured in, ``focus_score, blown, crushed, phash`` and ``error`` of Spark's image source.

    ``images`` has the struct ``image`` and may have ``orientation`` (1 to 8;
    null is 1), by which a picture is turned upright; with ``upright`` the file's
    head tells it.  A larger picture is brought down to ``longest`` first.  A
    broken image has an error and no measures, the others go on; repeated rows
    are measured each; an empty table gives no rows.  A task works on one picture at a time; how many
    wait for it, ``spark.sql.execution.arrow.maxBytesPerBatch`` says.
    """
    let_workers_import(images.sparkSession)
    own = "orientation" in images.columns
    turn = F.coalesce("orientation", F.lit(1)).cast("int") if own else F.lit(1)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, small = [], []
            for r in batch.itertuples():
                try:
                    if r.height < 1 or r.width < 1:
                        raise ValueError("no picture")
                    turned = _turned(r.origin) if upright and not own else r.orientation
                    pixels = picture(r.data, r.height, r.width, r.nChannels, turned, longest)
                    small.append(resized(gray(pixels).astype(np.uint8), 32, 32))
                    rows.append([r.origin, *pixels.shape[:2], focus_score(pixels), *clipping(pixels), len(small) - 1, None])
                except Exception as error:  # noqa: BLE001 - of any decoder; it is reported in the row
                    rows.append([r.origin, *[None] * 6, f"{type(error).__name__}: {error}"])
            hashes = [h - (h >> 63 << 64) for h in perceptual_hashes(np.array(small))] if small else []
            for row in rows:
                row[6] = None if row[6] is None else hashes[row[6]]
            yield pd.DataFrame(rows, columns=["origin", "height", "width", "focus_score", "blown", "crushed", "phash", "error"], dtype=object)

    return images.select("image.*", turn.alias("orientation")).mapInPandas(measure, f"origin string, {MEASURES}")


def scan_pictures(files: DataFrame, root: str, longest: int | None = 1024) -> DataFrame:
    """``files(file_path, ...)``, which lie below ``root``, with the measures of their pictures, upright and no larger than ``longest``.

    Spark's image source decodes what the virtual machine can (JPEG, PNG, BMP,
    GIF).  A file that is broken, missing or of another format has an ``error``.
    Pixels go from the source to the measures of the same task; only measures are joined.
    """
    found = files.sparkSession.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)
    measured = measure_images(found, longest, upright=True)
    path = F.url_decode(F.regexp_replace(F.regexp_replace("origin", r"^[a-z]+:(//)?", ""), r"\+", "%2B"))
    joined = files.join(measured.withColumn("file_path", path).drop("origin").withColumn("_there", F.lit(True)), "file_path", "left")
    return joined.withColumn("error", F.when(F.col("_there").isNull(), "ValueError: not decoded here").otherwise(F.col("error"))).drop("_there")


class FeatureProvider(Protocol):
    """A model: what it adds, and how to score one batch.  It is loaded once in each task."""

    schema: StructType

    def load(self) -> None: ...

    def score(self, batch: pd.DataFrame) -> pd.DataFrame: ...


#: Weight files whose digest this Python process has found right.
_CHECKED: set[tuple[str, str]] = set()


def digest_of(path: str) -> str:
    """SHA-256 of a file, a mebibyte at a time."""
    made = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            made.update(block)
    return made.hexdigest()


def check_weights(weights: dict[str, str], where: Callable[[str], str]) -> None:
    """An error that names the first file whose SHA-256 is not the one given; ``where`` tells a file's place.  A process reads each once."""
    for name, wanted in sorted(weights.items()):
        if (name, wanted) not in _CHECKED:
            if (found := digest_of(where(name))) != wanted.lower():
                raise ValueError(f"the weights {name} have the digest {found}, not {wanted}")
            _CHECKED.add((name, wanted))


def in_halves(score: Callable[[pd.DataFrame], pd.DataFrame], batch: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """``score`` of a batch, with ``error``; a batch that fails (too large for the memory, or with a row that can't be scored) is halved, down to the rows that fail alone.

    One bad row of n costs about 2 log2(n) calls more, not n.
    """
    try:
        made = score(batch)[names].reset_index(drop=True)
        if len(made) != len(batch):
            raise ValueError(f"{len(made)} results for {len(batch)} rows")
        return made.assign(error=None)
    except Exception as error:  # noqa: BLE001 - of any model; it is reported in the row
        if len(batch) < 2:
            return pd.DataFrame([{**dict.fromkeys(names), "error": f"{type(error).__name__}: {error}"}] * len(batch), columns=[*names, "error"])
    middle = len(batch) // 2
    return pd.concat([in_halves(score, batch.iloc[:middle], names), in_halves(score, batch.iloc[middle:], names)], ignore_index=True)


def with_features(rows: DataFrame, provider: FeatureProvider, weights: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with the provider's columns and ``error``; a batch that fails is halved until the rows that fail are found.

    ``weights`` maps the paths of weight files to their SHA-256.  The driver sends the files to
    all executors, and every Python process checks them before it loads the
    provider (which finds them by ``SparkFiles.get(name)``); a changed byte
    fails the task with the file's name.
    """
    let_workers_import(rows.sparkSession)
    names = [f.name for f in provider.schema]
    schema = StructType([*rows.schema.fields, *provider.schema.fields]).add("error", "string")
    for path in weights or {}:
        rows.sparkSession.sparkContext.addFile(path)
    digests = {os.path.basename(path): digest for path, digest in (weights or {}).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        check_weights(digests, SparkFiles.get)
        provider.load()
        for batch in batches:
            made = in_halves(provider.score, batch, names)
            yield pd.concat([batch.reset_index(drop=True), made], axis=1)

    return rows.mapInPandas(run, schema)
