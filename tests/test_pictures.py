"""Tags from file heads, smaller pictures, measures, hashes and model batches, on files made here."""

from __future__ import annotations

import hashlib
import io
import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewise.functions import metadata, resample
from framewise.operators import features
from framewise.sources import tags as source
from framewise.sources.files import scan


def tiff(order, entries, exif=(), link=None, start=8):
    """A TIFF head with a directory of (tag, kind, count, value bytes) and one for exposures."""
    n = len(entries) + bool(exif)
    after = start + 2 + 12 * n + 4
    data, body = b"", b""

    def packed(entries, data):
        out = b""
        for tag, kind, count, value in entries:
            if len(value) <= 4:
                out += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
            else:
                out += struct.pack(order + "HHII", tag, kind, count, after + len(data))
                data += value
        return out, data

    body, data = packed(entries, data)
    if exif:
        inner, data = packed(exif, data)
        at = after + len(data) if link is None else link
        data += struct.pack(order + "H", len(exif)) + inner + b"\0\0\0\0"
        body += struct.pack(order + "HHII", source.EXIF_DIRECTORY, 4, 1, at)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start)
    return head.ljust(start, b"\0") + struct.pack(order + "H", n) + body + b"\0\0\0\0" + data


def text(tag, value):
    data = value.encode() + b"\0"
    return tag, 2, len(data), data


def jpeg(exif, width=30, height=20):
    segment = b"" if exif is None else b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif
    return b"\xff\xd8\xff\xe0\x00\x04ab" + segment + b"\xff\xff\xc0\x00\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x00\x11\x00" + b"\xff\xda" + b"pixels"


def png(pixels, exif=None):
    """A PNG of red, green, blue."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    extra = b"" if exif is None else chunk(b"eXIf", exif)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def head(order="<", turned=6):
    h = order + "H"
    return tiff(order, [text(0x0110, "Model X"), (0x0112, 3, 1, struct.pack(h, turned)), text(0x0132, "2020:01:01 00:00:00")],
                [text(0x9003, "2024:01:31 12:00:00"), text(0x9291, "25"), text(0x9011, "+05:30"), text(0xA431, "SN 7"), (0x9211, 4, 1, struct.pack(order + "I", 77)), (0x829A, 5, 1, b"\0" * 8)])


WANT = {"Model": "Model X", "Orientation": "6", "ModifyDate": "2020:01:01 00:00:00", "DateTimeOriginal": "2024:01:31 12:00:00", "SubSecTimeOriginal": "25", "OffsetTimeOriginal": "+05:30", "SerialNumber": "SN 7", "ImageNumber": "77"}


def read(data):
    return source.file_tags(io.BytesIO(data), len(data))


@pytest.mark.parametrize("order", ["<", ">"])
def test_tags_of_each_format(order):
    made = head(order)
    assert read(made) == WANT
    assert read(jpeg(made)) == WANT | {"ImageWidth": "30", "ImageHeight": "20"}
    assert read(png(np.zeros((4, 5, 3), np.uint8), made)) == WANT | {"ImageWidth": "5", "ImageHeight": "4"}
    assert read(jpeg(None)) == {"ImageWidth": "30", "ImageHeight": "20"}


def test_broken_files_are_errors():
    made = head()
    for data in (b"", b"\xff", b"not a picture", b"II*\0", made[:40], made[:-60], tiff("<", [], [text(0x9003, "x" * 9)], link=8), tiff("<", [], [text(0x9003, "x" * 9)], link=1 << 31), jpeg(made[:30]), b"\xff\xd8\xff\xe1\x00\x01", b"\xff\xd8abcd",
                 b"II*\0\x08\0\0\0\xff\xff" + b"\0" * 100):
        with pytest.raises((ValueError, struct.error)):
            read(data)
    rng = np.random.default_rng(0)
    for _ in range(3000):  # any bytes at all: tags or one of these errors, and an end
        data = bytearray(jpeg(head()))
        for at in rng.integers(0, len(data), 4):
            data[at] = rng.integers(0, 256)
        try:
            read(bytes(data[: rng.integers(1, len(data) + 1)]))
        except (ValueError, struct.error):
            pass


def test_tags_to_times_and_cameras(spark, tmp_path):
    files = {"a.jpg": jpeg(head()), "b.dng": head(">"), "c.jpg": b"nothing", "d.jpg": jpeg(None)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = scan(spark, str(tmp_path)).union(spark.createDataFrame([(f"{tmp_path}/gone.jpg", 1, 1, None), (None, None, None, None)], "file_path string, size_bytes long, modified_ns long, error string"))
    found = source.read_tags(rows)
    camera = metadata.camera_columns(F.col("tags"))
    got = {r[0] and r[0].rsplit("/", 1)[1]: r[1:] for r in found.select("file_path", "error", source.orientation(F.col("tags")), camera["camera_model"], camera["camera_serial"], camera["sequence_number"], source.tag_time(F.col("tags"), F.lit(5))).collect()}
    at = 1706702400_250000 - 19_800_000_000
    assert got["a.jpg"] == (None, 6, "Model X", "SN 7", "77", (at, "DateTimeOriginal", "embedded_offset")) == got["b.dng"]
    assert got["d.jpg"] == (None, 1, "", "", "", (5, "filesystem_mtime", "system_local_assumption"))
    assert got["c.jpg"][0].startswith("ValueError: neither") and got["gone.jpg"][0].startswith("FileNotFoundError") and got[None][0].startswith("TypeError")
    outside = spark.createDataFrame([(f"{tmp_path}/a.jpg", {"Model": "Other"})], "file_path string, tags map<string, string>")
    model = lambda df: {r[0].rsplit("/", 1)[1]: r[1] for r in df.select("file_path", F.col("tags")["Model"]).collect()}
    images = rows.where("file_path like '%.jpg' and file_path not like '%gone%'")
    assert model(source.tag_table(images, "auto", outside)) == {"a.jpg": "Other", "c.jpg": None, "d.jpg": None}
    assert model(source.tag_table(images, "external", outside)) == {"a.jpg": "Other"} and model(source.tag_table(images, "embedded", outside))["a.jpg"] == "Model X"
    for bad in (("external", None), ("some", outside)):
        with pytest.raises(ValueError):
            source.tag_table(images, *bad)
    assert source.read_tags(rows.limit(0)).count() == 0


def plain_resized(pixels, height, width):
    """Number by number, both axes at once."""
    def weights(length, to, i):
        scale = max(length / to, 1.0)
        middle = (i + 0.5) * length / to
        w = []
        for k in range(length):
            x = (k + 0.5 - middle) / scale
            sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
            w.append(sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0)
        return [v / sum(w) for v in w]

    out = np.zeros((height, width, *pixels.shape[2:]))
    for i in range(height):
        for j in range(width):
            wy, wx = weights(pixels.shape[0], height, i), weights(pixels.shape[1], width, j)
            out[i, j] = sum(a * b * pixels[y, x].astype(float) for y, a in enumerate(wy) if a for x, b in enumerate(wx) if b)
    return np.clip(out, 0, 255)


@pytest.mark.parametrize("shape", [(40, 31, 3), (17, 50, 3), (33, 33, 3), (9, 9)])
@pytest.mark.parametrize("to", [(11, 8), (5, 13), (32, 32)])
def test_smaller_pictures_equal_a_plain_double_loop(shape, to):
    pixels = np.random.default_rng(sum(shape)).integers(0, 256, shape, dtype=np.uint8)
    got = resample.resized(pixels, *to)
    assert np.abs(got - plain_resized(pixels, *to)).max() <= 0.51 and got.dtype == np.uint8


def test_the_longest_side_fits():
    pixels = np.zeros((300, 200, 3), np.uint8)
    assert resample.fitted(pixels, 100).shape == (100, 67, 3) and resample.fitted(pixels.swapaxes(0, 1), 100).shape == (67, 100, 3) and resample.fitted(pixels, 300) is pixels
    assert resample.fitted(np.zeros((1000, 1, 3), np.uint8), 10).shape == (10, 1, 3)
    assert (resample.fitted(np.full((500, 300, 3), 77, np.uint8), 64) == 77).all()


def test_scan_of_pictures(spark, tmp_path):
    rng = np.random.default_rng(1)
    whole = np.kron(rng.integers(0, 256, (12, 9, 3)), np.ones((16, 16, 1))).astype(np.uint8)  # red, green, blue
    (tmp_path / "x y").mkdir()
    for turned in range(1, 9):
        (tmp_path / f"x y/{turned}+%20.png").write_bytes(png(whole, head(turned=turned)))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (tmp_path / "raw.dng").write_bytes(head())
    rows = scan(spark, str(tmp_path)).drop("error")
    got = {r["file_path"].rsplit("/", 1)[1]: r for r in features.scan_pictures(rows, str(tmp_path), 48).collect()}
    assert len(got) == 10 and got["bad.png"]["error"] and got["raw.dng"]["error"] and got["bad.png"]["phash"] is None
    for turned in range(1, 9):
        pixels = features.oriented(resample.fitted(whole[..., ::-1], 48), turned)
        r = got[f"{turned}+%20.png"]
        assert r["error"] is None and (r["height"], r["width"]) == pixels.shape[:2] == ((48, 36) if turned < 5 else (36, 48))
        assert r["focus_score"] == pytest.approx(features.focus_score(pixels)) and (r["blown"], r["crushed"]) == pytest.approx(features.clipping(pixels))
        small = np.rint(plain_resized(features.gray(pixels), 32, 32))
        low = [[sum(small[y, x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
        bits = "".join(str(int(t > np.median(low))) for line in low for t in line)
        assert (r["phash"] ^ (int(bits, 2) - (1 << 64 if bits[0] == "1" else 0))).bit_count() <= 2  # a term may lie on the median
    assert len({r["phash"] for r in got.values() if r["phash"] is not None}) > 1


class Model:
    schema = StructType().add("score", "double")

    def __init__(self, bad=(), most=10**9, calls=None):
        self.bad, self.most, self.calls = set(bad), most, calls

    def load(self):
        pass

    def score(self, batch):
        if self.calls is not None:
            self.calls.add(1)
        if len(batch) > self.most:
            raise MemoryError("too large")
        if self.bad & set(batch["id"]):
            raise ValueError("bad row")
        return pd.DataFrame({"score": batch["id"] * 0.5})


def test_a_bad_row_costs_few_calls(spark):
    calls = spark.sparkContext.accumulator(0)
    rows = spark.range(1024).coalesce(1)
    got = features.with_features(rows, Model({700}, calls=calls)).collect()
    assert [r["id"] for r in got] == list(range(1024)) and {r["id"]: r["error"] for r in got if r["error"]} == {700: "ValueError: bad row"}
    assert all(r["score"] == r["id"] * 0.5 for r in got if r["id"] != 700) and calls.value <= 2 * 10 + 1
    small = spark.sparkContext.accumulator(0)
    got = features.with_features(rows, Model(most=100, calls=small)).collect()
    assert all(r["error"] is None for r in got) and small.value == 31  # 16 batches of 64, and 15 that were too large
    assert features.with_features(rows.limit(0), Model()).count() == 0


def test_weights_are_checked_before_they_are_loaded(spark, tmp_path):
    path = tmp_path / f"model-{tmp_path.name}.bin"
    path.write_bytes(b"weights" * 300_000)
    right = hashlib.sha256(path.read_bytes()).hexdigest()
    assert features.with_features(spark.range(4), Model(), {str(path): right}).count() == 4
    other = tmp_path / f"other-{tmp_path.name}.bin"
    other.write_bytes(b"weights" * 300_000 + b"x")
    with pytest.raises(Exception, match=other.name):
        features.with_features(spark.range(4), Model(), {str(other): right}).collect()
    features.check_weights({path.name: right}, lambda name: str(path))
