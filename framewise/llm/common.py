"""Small helpers shared by the operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass works on; bounds the memory of a task.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it (else give it with ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def text_chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``limit`` bytes of text (one row at least), and their texts.

    Null is empty.  Bytes that are not UTF-8 become U+FFFD, in every operator.
    Only the texts of one slice are Python objects at a time.
    """
    for batch in batches:
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        sums = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        try:
            column.validate(full=True)
            valid = True
        except pa.ArrowInvalid:
            valid = False
        start = 0
        while start < len(column):
            before = int(sums[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(sums, before + limit, "right")))
            part = batch.slice(start, stop - start)
            texts = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
            yield part, texts if valid else [t.decode("utf-8", "replace").encode() for t in texts]
            start = stop


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def fresh(names: list[str], name: str) -> str:
    """``name``, lengthened until no column has it in any case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name
