"""Tags from the heads of picture files: JPEG, PNG and TIFF (which most raw formats are).

A task opens a file, walks its directories and reads the values asked for, a
few kilobytes, wherever in the file they lie; pixels are never read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.metadata import CaptureTime, capture_time, first_time
from framewise.storage import let_workers_import

# Numbers and names of tags.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0132: "ModifyDate",
    0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized",
    0x9211: "ImageNumber", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized", 0xA431: "SerialNumber", 0xC62F: "InternalSerialNumber",
}
EXIF_DIRECTORY = 0x8769
#: Bytes of one value of each type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WHOLE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
#: Longer values and longer directories are no camera's.
MOST_BYTES, MOST_ENTRIES = 4096, 4096


class _Part:
    """A stretch of a file, from ``start``, that is read by offsets; reading beyond its end is an error."""

    def __init__(self, file: BinaryIO, start: int, length: int) -> None:
        self.file, self.start, self.length = file, start, length

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.length:
            raise ValueError(f"bytes {at} to {at + n} lie beyond the {self.length} there are")
        self.file.seek(self.start + at)
        got = self.file.read(n)
        if len(got) < n:
            raise ValueError("the file is cut short")
        return got


def _value(part: _Part, order: str, kind: int, count: int, raw: bytes) -> str | None:
    """An entry's value as a text; null for kinds that are not told."""
    size = SIZES.get(kind, 0) * count
    if not size or size > MOST_BYTES:
        return None
    data = raw[:size] if size <= 4 else part.read(struct.unpack(order + "I", raw)[0], size)
    if kind == 2:
        return data.split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in WHOLE:
        return " ".join(map(str, struct.unpack(f"{order}{count}{WHOLE[kind]}", data)))
    return None


def directory_tags(part: _Part) -> dict[str, str]:
    """The tags of the first directory and of the one for exposures; a directory that points back to one already read is an error."""
    head = part.read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("no byte order")
    out: dict[str, str] = {}
    todo, seen = [struct.unpack(order + "I", head[4:])[0]], set()
    while todo:
        at = todo.pop(0)
        if at in seen:
            raise ValueError("directories form a ring")
        seen.add(at)
        n = struct.unpack(order + "H", part.read(at, 2))[0]
        if n > MOST_ENTRIES:
            raise ValueError(f"a directory of {n} entries")
        entries = part.read(at + 2, 12 * n)
        for i in range(0, 12 * n, 12):
            tag, kind, count = struct.unpack(order + "HHI", entries[i : i + 8])
            raw = entries[i + 8 : i + 12]
            if tag == EXIF_DIRECTORY:
                todo.append(struct.unpack(order + "I", raw)[0])
            elif tag in TAGS and (text := _value(part, order, kind, count, raw)):
                out.setdefault(TAGS[tag], text)
    return out


def jpeg_tags(whole: _Part) -> dict[str, str]:
    """Tags of the segment that has them, and the size from the frame's header."""
    out: dict[str, str] = {}
    at = 2
    while at + 4 <= whole.length:
        mark, code = whole.read(at, 2)
        if mark != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        if code == 0xFF:  # fill
            at += 1
            continue
        if code in (0xD9, 0xDA):  # the end, or pixels from here on
            break
        if code == 0x01 or 0xD0 <= code <= 0xD7:
            at += 2
            continue
        length = struct.unpack(">H", whole.read(at + 2, 2))[0]
        if length < 2:
            raise ValueError(f"a segment of {length} bytes")
        if code == 0xE1 and length >= 8 and whole.read(at + 4, 6) == b"Exif\0\0":
            out |= {k: v for k, v in directory_tags(_Part(whole.file, whole.start + at + 10, length - 8)).items() if k not in out}
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", whole.read(at + 5, 4))
            out |= {"ImageWidth": str(width), "ImageHeight": str(height)}
        at += 2 + length
    return out


def png_tags(whole: _Part) -> dict[str, str]:
    out: dict[str, str] = {}
    at = 8
    while at + 8 <= whole.length:
        length, kind = struct.unpack(">I4s", whole.read(at, 8))
        if kind == b"IHDR":
            width, height = struct.unpack(">II", whole.read(at + 8, 8))
            out |= {"ImageWidth": str(width), "ImageHeight": str(height)}
        elif kind == b"eXIf":
            out |= {k: v for k, v in directory_tags(_Part(whole.file, whole.start + at + 8, min(length, whole.length - at - 8))).items() if k not in out}
        elif kind == b"IEND":
            break
        at += 12 + length
    return out


def file_tags(file: BinaryIO, size: int) -> dict[str, str]:
    """The tags of one open file; ValueError where it is of no such format or broken."""
    whole = _Part(file, 0, size)
    head = whole.read(0, min(12, size))
    if head[:2] == b"\xff\xd8":
        return jpeg_tags(whole)
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return png_tags(whole)
    if head[:2] in (b"II", b"MM"):
        return directory_tags(whole)
    raise ValueError("neither JPEG nor PNG nor TIFF")


def read_tags(files: DataFrame) -> DataFrame:
    """``file_path, tags, error`` of each row of ``files(file_path, size_bytes, ...)``: a map of texts, or what is wrong with the file, as ``Type: message``.

    A null path, a missing or unreadable file and a broken one are rows with an
    error and no tags; rows that repeat are read each; an empty table gives no
    rows.  At most a few kilobytes of a file are held.
    """
    schema = pa.schema([("file_path", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags: list[dict[str, str] | None] = []
            errors: list[str | None] = []
            for path in batch.column(0).to_pylist():
                try:
                    with open(path, "rb", buffering=4096) as file:
                        tags.append(file_tags(file, file.seek(0, 2)))
                    errors.append(None)
                except (OSError, ValueError, TypeError, struct.error) as error:
                    tags.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t if t is None else list(t.items()) for t in tags], schema.field(1).type), pa.array(errors, pa.string())], schema=schema)

    let_workers_import(files.sparkSession)
    return files.select("file_path").mapInArrow(read, "file_path string, tags map<string, string>, error string")


def tag_time(tags: Column, modified_us: Column, zone: str = "UTC") -> Column:
    """``struct(micros, source, zone_source)`` of the first of the three times in ``tags`` that is one, else the file's own."""
    t = lambda name: F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit(""))
    times: list[tuple[str, CaptureTime]] = [
        (name, capture_time(t(name), t(fraction), t(offset), zone))
        for name, fraction, offset in (
            ("DateTimeOriginal", "SubSecTimeOriginal", "OffsetTimeOriginal"), ("CreateDate", "SubSecTimeDigitized", "OffsetTimeDigitized"), ("ModifyDate", "SubSecTime", "OffsetTime"),
        )
    ]
    return first_time(times, modified_us)


def orientation(tags: Column) -> Column:
    """1 to 8; 1 where the tag is missing or none of these."""
    value = F.try_element_at(tags, F.lit("Orientation")).try_cast("int")
    return F.when(value.between(1, 8), value).otherwise(1)


def tag_table(files: DataFrame, preference: str = "auto", external: DataFrame | None = None) -> DataFrame:
    """``file_path, tags, error`` from where ``preference`` says.

    ``external``: from that table alone, an error where there is none.
    ``embedded``: from the files' heads.  ``auto``: from the table where it has
    the file, else from its head.
    """
    if preference not in ("auto", "external", "embedded"):
        raise ValueError(f"unknown preference {preference!r}; choose auto, external or embedded")
    if preference == "external" and external is None:
        raise ValueError("tags of an outside program were asked for, and there is no table of them")
    if preference == "embedded" or external is None:
        return read_tags(files)
    told = files.select("file_path").join(external.select("file_path", "tags"), "file_path")
    told = told.withColumn("error", F.lit(None).cast("string"))
    if preference == "external":
        return told
    return told.union(read_tags(files.join(external.select("file_path"), "file_path", "left_anti")))
