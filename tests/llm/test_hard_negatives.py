"""Hard negatives against a plain loop over all rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import hard_negatives
from framewise.llm.hard_negatives import HardNegatives
from framewise.llm.queries import QUERIES

from ..conftest import DATA

ROW = "vec_id long, embedding array<double>, label int, slot string, id string, v string, rank string, block string"


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, label, "x", "x", "x", "x", "x") for i, v, label in rows], ROW.replace("double", kind))


def brute(rows, anchor, positives=5, negatives=3, scale=256, low=50, high=95):
    """Rows of the result; of rows that repeat an id the least label (as text) and vector."""
    fine = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(scale * c) for c in v]
            if sum(c * c for c in x) < 1 << 62:
                key = (str(label), np.array(v).tobytes())
                if i not in fine or key < fine[i][0]:
                    fine[i] = key, x, label
    dims = Counter(len(x) for _, x, _ in fine.values())
    dim = min(dims, key=lambda d: (-dims[d], d), default=0)
    fine = {i: (x, label) for i, (_, x, label) in fine.items() if len(x) == dim}
    out = set()
    for a in fine:
        if anchor(a):
            score = {i: sum(p * q for p, q in zip(fine[a][0], x)) for i, (x, _) in fine.items() if i != a}
            order = sorted(score, key=lambda i: (-score[i], i))
            for p in [i for i in order if fine[i][1] == fine[a][1]][:positives]:
                found = [i for i in order if fine[i][1] != fine[a][1] and low * score[p] <= 100 * score[i] <= high * score[p]][:negatives]
                out |= {(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(found, 1)}
    return out


def drawn(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, labels)) if rng.random() < 0.7 else 0
        v = centres[label] * 0.3 + rng.standard_normal(dim) * rng.choice([0.2, 0.02, 0.6])
        rows.append((i, np.round(v, rng.choice([1, 3])).tolist(), label))
    copies = [(1000 + i, rows[7][1], int(rng.integers(0, labels))) for i in range(n // 3)]
    return rows + copies


OPTIONS = [HardNegatives(), HardNegatives(first_rows=8, growth=2, block_rows=16, pivot_rows=20, annuli=4), HardNegatives(first_rows=1, growth=4, block_rows=7, pivot_rows=1000, annuli=3, sample=30, positives=9, negatives=1, low=0, high=100)]


@pytest.mark.parametrize("o", OPTIONS)
def test_equals_plain_loop(spark, o):
    rows = drawn(240, 6, 1)
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, o).collect()
    want = brute(rows, lambda i: i % 10 == 0, o.positives, o.negatives, o.scale, o.low, o.high)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_query_equals_plain_loop(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    got = QUERIES["op11_hard_negatives"](spark, f"{DATA}/sf0.001").collect()
    want = brute(rows, lambda i: i % 50 == 0)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.5, 0.5], 2), (3, [0.8, 0.1], None), (4, None, 1), (5, [nan, 1.0], 2), (6, [-inf, 1.0], 2), (7, [None, 1.0], 2), (8, [], 2), (9, [0.7, 0.1, 0.0], 2),
        (10, [0.0, 0.0], 1), (11, [0.9, 0.1], 2), (11, [0.9, 0.1], 2), (12, [0.7, 0.2], 3), (12, [0.6, 0.2], 2), (None, [0.8, 0.2], 2), (20, [-1.0, -0.5], 2), (30, [1e300, 0.0], 2), (31, [1e7, 1.0], 2), (32, [2e6, 0.3], 1),
        (33, [4e6, 0.1], 3), (40, [1.0, 0.5], 4), (-50, [0.7, 0.3], 2),
    ]
    df = frame(spark, rows)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(got) == len(want) and {tuple(r) for r in got} == want and want
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0
    assert hard_negatives.hard_negatives(df.where("label = 4"), F.lit(True)).count() == 0


def test_float_vectors_and_large_numbers(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(5) * 10.0 ** rng.integers(-2, 5)).astype(np.float32).astype(float).tolist(), i % 3) for i in range(90)]
    got = hard_negatives.hard_negatives(frame(spark, rows, "float"), F.col("vec_id") < 15, HardNegatives(block_rows=10, first_rows=10, pivot_rows=10)).collect()
    want = brute(rows, lambda i: i < 15)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for size in (1 << 8, 1 << 29):
        q, x = (rng.integers(-size, size, (4, 3)).astype(float) for _ in range(2))
        assert hard_negatives.products(q, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in q]


def test_bounds_hold(spark):
    """Bounds of an annulus enclose the products of all its rows."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.standard_normal((500, 8)))
    norm2 = (x * x).sum(1)
    pivots = hard_negatives.Pivots(x, norm2, int(norm2.max()), 500, HardNegatives(pivot_rows=50, annuli=5))
    pivot, distance = pivots.keys(pivots.lengthened(x, norm2))
    annulus = (pivots.edges[pivot] < distance[:, None]).sum(1)
    keys = sorted(set(zip(pivot.tolist(), annulus.tolist())))
    inside = [(pivot == p) & (annulus == a) for p, a in keys]
    one = np.ones(len(keys), int)
    annuli = hard_negatives.Annuli(pivots, np.array([p for p, _ in keys]), np.array([distance[i].min() for i in inside]), np.array([distance[i].max() for i in inside]), one, one)
    low, high, slack = annuli.bounds(x[:50])
    for k, rows in enumerate(inside):
        score = x[:50] @ x[rows].T
        assert (score.max(1) <= high[:, k] + slack).all() and (score.min(1) >= low[:, k] - slack).all()
