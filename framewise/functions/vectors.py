"""Distances and model heads over vectors and hashes, without a UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; null where a side is null."""
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_to_hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hex_to_hash(text: Column) -> Column:
    """The signed 64-bit value."""
    return F.conv(text, 16, -10).cast("long")


def subject_probability(embedding: Column, positive: Column, negative: Column, scale: float = 10.0) -> Column:
    """The first share of a softmax over two scaled similarities."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-scale) * (dot(embedding, positive) - dot(embedding, negative))))


def subject_integrity(probability: Column) -> Column:
    return F.lit(0.5) + F.lit(0.5) * probability


def affine(embedding: Column, weights: Sequence[float], bias: float) -> Column:
    """A linear head; a chain of linear layers folds into one (:func:`folded`)."""
    return dot(embedding, F.array(*(F.lit(float(w)) for w in weights))) + F.lit(float(bias))


def folded(layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]]) -> tuple[list[float], float]:
    """Weights and bias of one linear map equal to ``layers`` of (matrix, bias) in turn, the last with one output."""
    import numpy as np

    w, b = None, None
    for matrix, bias in layers:
        m, c = np.asarray(matrix, float), np.asarray(bias, float)
        w, b = (m, c) if w is None else (m @ w, m @ b + c)
    return w[0].tolist(), float(b[0])


_INTEGER = r"^\s*[+-]?\d+\s*$"


def sequence_number(text: Column) -> Column:
    """The number of a sequence text; null where it is none.  Numbers come before texts."""
    return F.when(text.rlike(_INTEGER), text.try_cast("long"))


def same_camera(serial: Column, model: Column, other_serial: Column, other_model: Column) -> Column:
    """Serials decide where both are known, else models unless one is unknown."""
    known = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.when(known(serial) & known(other_serial), serial == other_serial).when(known(model) & known(other_model), model == other_model).otherwise(F.lit(True))


def of_length(vector: Column, length: int) -> Column:
    """The vector; an error where it was cut or is of another model."""
    bad = F.raise_error(F.concat(F.lit(f"an embedding has {length} numbers, not "), F.size(vector).cast("string")))
    return F.when(vector.isNull() | (F.size(vector) == length), vector).otherwise(bad.cast("array<double>"))
