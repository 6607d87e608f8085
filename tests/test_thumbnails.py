"""Thumbnails made by several tasks at once, and pruning."""

from __future__ import annotations

import os
import threading

import numpy as np
from pyspark.sql import functions as F

from framewise.functions.files import thumbnail_key
from framewise.functions.resample import fitted
from framewise.sinks import thumbnails

from .test_pictures import head, png


def test_tasks_at_once_make_one_file(tmp_path):
    made, both = [], threading.Barrier(8)

    def make():
        both.wait()
        return b"picture"

    tasks = [threading.Thread(target=lambda: made.append(thumbnails.get_or_make(str(tmp_path), "ab12", make))) for _ in range(8)]
    for t in tasks:
        t.start()
    for t in tasks:
        t.join()
    assert sum(new for _, new in made) == 1 and len({p for p, _ in made}) == 1
    assert os.listdir(tmp_path / "ab") == ["ab12.png"] and (tmp_path / "ab/ab12.png").read_bytes() == b"picture"
    assert thumbnails.get_or_make(str(tmp_path), "ab12", None)[1] is False

    def broken():
        raise ValueError

    try:
        thumbnails.get_or_make(str(tmp_path), "cd", broken)
    except ValueError:
        pass
    assert os.listdir(tmp_path / "cd") == []


def test_thumbnails_of_a_folder_and_pruning(spark, tmp_path):
    whole = np.random.default_rng(3).integers(0, 256, (40, 30, 3), dtype=np.uint8)
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / f"in/{i}.png").write_bytes(png(whole + np.uint8(i), head(turned=6 if i == 1 else 1)))
    (tmp_path / "in/bad.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    source = spark.read.format("image").option("dropInvalid", False)
    images, store = source.load(str(tmp_path / "in")), str(tmp_path / "store")
    first = {r["origin"].rsplit("/", 1)[1]: r for r in thumbnails.make_thumbnails(images.union(images), str(tmp_path / "in"), store, 20).where("made or error is not null").collect()}
    assert len(first) == 7 and first["bad.png"]["error"] and first["bad.png"]["key"] is None
    assert thumbnails.make_thumbnails(images, str(tmp_path / "in"), store, 20).where("made").count() == 0
    stat = os.stat(tmp_path / "in/0.png")
    key = spark.range(1).select(thumbnail_key(F.lit("0.png"), F.lit(stat.st_size), F.lit(stat.st_mtime_ns), 20)).first()[0]
    assert first["0.png"]["key"] == key and first["0.png"]["thumbnail"] == thumbnails.place(store, key)
    seen = {r["image"]["origin"].rsplit("/", 1)[1]: r["image"] for r in source.option("recursiveFileLookup", True).load(store).collect()}
    small = seen[f"{key}.png"]
    assert np.array_equal(np.frombuffer(small["data"], np.uint8).reshape(20, 15, 3), fitted(whole[..., ::-1], 20))
    turned = seen[f"{first['1.png']['key']}.png"]
    assert (turned["height"], turned["width"]) == (15, 20)
    for i in range(6):
        os.utime(first[f"{i}.png"]["thumbnail"], (1000 + i, 1000 + i))
    os.makedirs(tmp_path / "store/zz")
    for name, at in (("old", 5), ("new", None)):
        path = tmp_path / f"store/zz/.{name}.part"
        path.write_bytes(b"x")
        if at:
            os.utime(path, (at, at))
    assert thumbnails.prune(spark, store, 2) == 4
    left = sorted(f for _, _, files in os.walk(store) for f in files)
    assert left == sorted([".new.part", os.path.basename(first["4.png"]["thumbnail"]), os.path.basename(first["5.png"]["thumbnail"])])
    assert thumbnails.prune(spark, store, 2) == 0
