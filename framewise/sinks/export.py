"""Copies of chosen files and star ratings, from tasks."""

from __future__ import annotations

import os
import shutil
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_RDF, _XMP, _META = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://ns.adobe.com/xap/1.0/", "adobe:ns:meta/"


def copy_plan(plan: DataFrame, target: str) -> int:
    """Copies every ``source`` to its ``destination`` below ``target``, a folder that all executors share.

    Files gather in a hidden folder beside it, which takes the name when all
    are there; an existing target is left alone, and after a failure nothing
    is.  Sources are regular files, and the disk must have room for all.  A
    task that runs again writes its files again.
    """
    target = target.rstrip("/")
    if os.path.lexists(target):
        raise FileExistsError(target)
    if not plan.where("destination like '/%' or concat('/', destination, '/') like '%/../%'").isEmpty():
        raise ValueError("a destination must stay below the target")
    if not plan.groupBy("destination_key").count().where("count > 1").isEmpty():
        raise ValueError("two sources share a destination")
    over, name = os.path.split(os.path.abspath(target))
    needed, free = required_bytes(plan), shutil.disk_usage(over).free
    if needed > free:
        raise OSError(f"the export needs {needed} bytes, and {free} are free")
    staging = f"{over}/.{name}.{uuid.uuid4().hex}.part"
    os.makedirs(staging)

    def copy(rows: Iterator[Row]) -> None:
        for r in rows:
            if os.path.islink(r["source"]) or not os.path.isfile(r["source"]):
                raise ValueError(f"not a regular file: {r['source']}")
            path = os.path.join(staging, r["destination"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            shutil.copy2(r["source"], path)

    try:
        plan.foreachPartition(copy)
        if os.path.lexists(target):
            raise FileExistsError(target)
        os.rename(staging, target)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return plan.count()


def required_bytes(plan: DataFrame) -> int:
    """What the sources take on disk now, as their tasks see them."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([os.path.getsize(p) if os.path.isfile(p) else 0 for p in batch.column(0).to_pylist()], pa.int64())})

    return plan.select("source").mapInArrow(measure, "n long").agg({"n": "sum"}).first()[0] or 0


def link_or_copy(pairs: DataFrame) -> None:
    """Puts each ``source`` at its ``destination`` by a hard link, or a copy where there can be none; an earlier file is replaced."""

    def put(rows: Iterator[Row]) -> None:
        for r in rows:
            os.makedirs(os.path.dirname(r["destination"]), exist_ok=True)
            part = f"{r['destination']}.{uuid.uuid4().hex}"
            try:
                os.link(r["source"], part)
            except OSError:
                shutil.copy2(r["source"], part)
            os.replace(part, r["destination"])

    pairs.foreachPartition(put)


def preview(chosen: DataFrame, folder: str) -> DataFrame:
    """``source, destination`` of numbered pictures in a folder, from ``chosen(source, place)``: ``0001_name.jpg`` and so on."""
    name = F.element_at(F.split("source", "/"), -1)
    return chosen.select("source", F.concat(F.lit(folder.rstrip("/") + "/"), F.lpad(F.col("place").cast("string"), 4, "0"), F.lit("_"), name).alias("destination"))


def rated_xmp(text: str | None, stars: int, label: str = "Green") -> str:
    """An XMP document with one rating and label, in the block that has a rating already, else in the first; other content stays."""
    for prefix, uri in (("rdf", _RDF), ("xmp", _XMP), ("x", _META)):
        ET.register_namespace(prefix, uri)
    root = ET.fromstring(text) if text else ET.Element(f"{{{_META}}}xmpmeta")
    rdf = root if root.tag == f"{{{_RDF}}}RDF" else root.find(f"{{{_RDF}}}RDF")
    if rdf is None:
        rdf = ET.SubElement(root, f"{{{_RDF}}}RDF")
    blocks = rdf.findall(f"{{{_RDF}}}Description") or [ET.SubElement(rdf, f"{{{_RDF}}}Description", {f"{{{_RDF}}}about": ""})]
    rating = f"{{{_XMP}}}Rating"
    one = next((b for b in blocks if b.get(rating) is not None), None)
    if one is None:
        one = next((b for b in blocks if b.find(rating) is not None), blocks[0])
    for block in blocks:
        for name in ("Rating", "Label"):
            tag = f"{{{_XMP}}}{name}"
            block.attrib.pop(tag, None)
            for child in block.findall(tag):
                block.remove(child)
    one.set(rating, str(stars))
    one.set(f"{{{_XMP}}}Label", label)
    return ET.tostring(root, encoding="unicode")


def write_ratings(rated: DataFrame) -> None:
    """Writes ``rating`` to each ``sidecar`` path, which is made where it is missing."""

    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            old = None
            if os.path.exists(r["sidecar"]):
                with open(r["sidecar"], encoding="utf-8") as f:
                    old = f.read()
            part = f"{r['sidecar']}.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as f:
                f.write(rated_xmp(old, r["rating"]))
            os.replace(part, r["sidecar"])

    rated.foreachPartition(write)
