"""Small copies of pictures in a folder that all tasks share, each made once, by a key of the file's content."""

from __future__ import annotations

import hashlib
import os
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.resample import fitted
from framewise.operators.features import _turned, oriented
from framewise.operators.ordering import Ordered
from framewise.sources.files import scan
from framewise.storage import let_workers_import


def key_of(relative: str, size_bytes: int, modified_ns: int, dimension: int) -> str:
    """As :func:`framewise.functions.files.thumbnail_key`, of one file."""
    return hashlib.sha256(f"{relative}|{size_bytes}|{modified_ns}|{dimension}".encode()).hexdigest()[:32]


def png(pixels: np.ndarray) -> bytes:
    """A PNG of blue, green, red."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((len(pixels), 1), np.uint8), np.ascontiguousarray(pixels[..., ::-1]).reshape(len(pixels), -1)], 1)
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def place(folder: str, key: str) -> str:
    return f"{folder.rstrip('/')}/{key[:2]}/{key}.png"


def get_or_make(folder: str, key: str, make: Callable[[], bytes]) -> tuple[str, bool]:
    """The path of a thumbnail, and whether it was made just now.

    It appears whole: it is written aside and linked into its place, which one of
    several tasks at once can do; the others take that one.  One that is there
    already counts as used now.
    """
    path = place(folder, key)
    if os.path.exists(path):
        try:
            os.utime(path)
            return path, False
        except FileNotFoundError:  # pruned just now
            pass
    os.makedirs(os.path.dirname(path), exist_ok=True)
    aside = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.part"
    try:
        with open(aside, "wb") as file:
            file.write(make())
        os.link(aside, path)
        return path, True
    except FileExistsError:
        return path, False
    finally:
        if os.path.exists(aside):
            os.unlink(aside)


def make_thumbnails(images: DataFrame, root: str, folder: str, dimension: int = 2048) -> DataFrame:
    """``origin, key, thumbnail, made, error`` of Spark's image source over local files below ``root``.

    Upright, the longest side ``dimension`` at most.  A broken picture or a file
    that is gone has an error; rows that repeat share one thumbnail.
    """
    let_workers_import(images.sparkSession)
    top = root.rstrip("/") + "/"

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    path = unquote(urlparse(r.origin).path)
                    stat = os.stat(path)
                    key = key_of(path.removeprefix(top), stat.st_size, stat.st_mtime_ns, dimension)
                    if r.height < 1 or r.width < 1:
                        raise ValueError("no picture")

                    def pixels(r=r) -> bytes:
                        whole = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                        whole = np.repeat(whole, 3, 2) if r.nChannels == 1 else whole[..., :3]
                        return png(oriented(fitted(whole, dimension), _turned(r.origin)))

                    out.append((r.origin, key, *get_or_make(folder, key, pixels), None))
                except Exception as error:  # noqa: BLE001 - of any decoder; it is reported in the row
                    out.append((r.origin, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["origin", "key", "thumbnail", "made", "error"], dtype=object)

    return images.select("image.*").mapInPandas(make, "origin string, key string, thumbnail string, made boolean, error string")


def prune(spark: SparkSession, folder: str, keep: int, age: float = 3600.0) -> int:
    """Deletes all but the ``keep`` thumbnails used last; gives the number deleted.

    Their ranks come from one sort by ranges; tasks delete.  One that has been used
    since it was ranked stays, and so do files being written, up to ``age`` seconds.
    """
    let_workers_import(spark)
    found = scan(spark, folder).where("error is null")
    ranked = Ordered(found.where("file_path like '%.png'"), F.desc("modified_ns"), "file_path", name="thumbnails").row_number("k")
    old = found.where(F.col("file_path").endswith(".part") & (F.col("modified_ns") < F.lit(int((time.time() - age) * 1e9))))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for path, modified in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if os.stat(path).st_mtime_ns == modified:
                        os.unlink(path)
                        n += path.endswith(".png")
                except FileNotFoundError:  # another task's
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    gone = ranked.where(F.col("k") > keep).select("file_path", "modified_ns").union(old.select("file_path", "modified_ns"))
    return gone.mapInArrow(drop, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
