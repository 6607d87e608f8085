"""Near duplicates of embeddings against all pairs."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from framewise.llm import embedding_dedup
from framewise.llm.embedding_dedup import Collisions, near_duplicates

ROW = "vec_id long, embedding array<double>, label int, node string, n string, cell string, id string"


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, label, "x", "x", "x", "x") for i, v, label in rows], ROW.replace("double", kind))


def groups(n=600, seed=0, dim=16, labels=3):
    """Copies, near copies of a few centres (some just at the limit), and vectors of their own; one label has a third and more."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, labels)) if rng.random() < 0.6 else 0
        draw = rng.random()
        v = centres[rng.integers(0, 6)] * rng.choice([1.0, 3.0]) if draw < 0.6 else rng.standard_normal(dim)
        if draw > 0.15:
            v = v + rng.standard_normal(dim) * np.linalg.norm(v) / math.sqrt(dim) * rng.choice([0.05, 0.1, 0.14, 0.18])
        rows.append((i, v.tolist(), label))
    return rows


def brute(rows, similarity=0.98):
    """Counters of ``vec_id, n_links, component_id, kept``."""
    fine = [i for i, (_, v, label) in enumerate(rows) if rows[i][0] is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for a, i in enumerate(fine):
        for j in fine[a + 1 :]:
            x, y = rows[i][1], rows[j][1]
            if rows[i][2] == rows[j][2] and len(x) == len(y) and embedding_dedup.cosines(np.array([x]), np.array([y]))[0] >= similarity:
                near[i].add(j)
                near[j].add(i)
    out = Counter()
    for i, (own, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in near[k] if j not in seen and not seen.add(j)]
        comp = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out[own, len(near[i]), comp, own == comp] += 1
    return out


@pytest.mark.parametrize("options", [Collisions(), Collisions(cell_rows=40, levels=3), Collisions(cell_rows=30, levels=0), Collisions(cell_rows=25, levels=8, recall=0.999999)])
def test_equals_all_pairs(spark, options):
    rows = groups()
    assert Counter(map(tuple, near_duplicates(frame(spark, rows), options).collect())) == brute(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [], 1),
        (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, -0.0, 0.0], 1), (12, [5.0], 1), (13, [1e-3], 1), (14, [-1.0], 1), (None, [1.0, 0.0], 1), (None, None, None), (1, [2.0, 0.0], 1),
        (15, [1e300, 1e300], 1), (16, [1e-300, 1e-300], 1), (17, [1.0, 0.0], 2), (18, [1.0, 0.1], 2), (18, [0.1, 1.0], 2),
    ]
    assert Counter(map(tuple, near_duplicates(frame(spark, rows)).collect())) == brute(rows)
    assert near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_many_copies_and_many_near_ones(spark):
    """One vector makes up a third of all rows, near ones another third; every link is counted."""
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(8)
    rows = [(i, centre.tolist(), 0) for i in range(300)] + [(300 + i, (centre + rng.standard_normal(8) * 0.01).tolist(), 0) for i in range(300)]
    rows += [(600 + i, rng.standard_normal(8).tolist(), 0) for i in range(300)]
    got = Counter(map(tuple, near_duplicates(frame(spark, rows), Collisions(cell_rows=64, levels=2)).collect()))
    assert got == brute(rows)
    assert sum(n for (_, links, comp, _), n in got.items() if comp == 0 and links >= 599) == 600


def test_count_comes_from_recall():
    counts = [Collisions(recall=r).least_count for r in (0.5, 0.99, 0.9999, 1 - 1e-9)]
    assert counts == sorted(counts, reverse=True) and counts[0] == 24 and counts[2] == 22
    rng = np.random.default_rng(4)
    o = Collisions()
    dim, n = 64, 4000
    x = embedding_dedup.unit_rows(rng.standard_normal((n, dim)))
    side = rng.standard_normal((n, dim))
    side = embedding_dedup.unit_rows(side - (side * x).sum(1)[:, None] * x)
    y = o.similarity * x + math.sqrt(1 - o.similarity**2) * side  # just at the limit
    lines = [np.floor(z @ embedding_dedup._directions(dim, o.levels + o.lines, o.seed) * embedding_dedup.STEPS / math.sqrt(2 - 2 * o.similarity)) for z in (x, y)]
    hits = (np.abs(lines[0] - lines[1])[:, o.levels :] <= o.widths[0]).sum(1)
    assert (hits >= o.least_count).mean() >= 0.999


def test_float_vectors(spark):
    rows = groups(200, seed=9)
    exact = [(i, np.array(v, np.float32).astype(float).tolist(), label) for i, v, label in rows]
    assert Counter(map(tuple, near_duplicates(frame(spark, exact, "float")).collect())) == brute(exact)


def test_impossible_options():
    for bad in ({"similarity": 1.0}, {"recall": 0.0}, {"window": 5.0}, {"lines": 0}, {"cell_rows": 0}):
        with pytest.raises(ValueError):
            Collisions(**bad)
