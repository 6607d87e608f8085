"""The filter audit against plain loops over rows and orders."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import filter_audit
from framewise.storage import Scratch

DOC = "doc_id long, text string, source string, mask string, part string, digest string, id string"
LABEL = "doc_id long, quality int, toxic int, part string"


def plain_mask(rows, i):
    doc, text, _ = rows[i]
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]
    fails.append(doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows))
    return fails


def plain_audit(rows, labels):
    fails = [plain_mask(rows, i) for i in range(len(rows))]
    parts = {s or "" for _, _, s in rows}
    out = {}
    for part in parts:
        here = [i for i in range(len(rows)) if (rows[i][2] or "") == part]
        shapley, steps = Counter(), {}
        for order in permutations(range(5)):
            alive = set(here)
            for step, f in enumerate(order, 1):
                gone = {i for i in alive if fails[i][f]}
                redundant = sum(fails[i][f] and i not in alive for i in here)
                alive -= gone
                shapley[f] += len(gone)
                has = lambda k: sum(any(lab[k] == 1 for lab in labels if lab[0] is not None and lab[0] == rows[i][0]) for i in gone)  # noqa: E731, B023
                steps["".join("ABCDE"[x] for x in order), step, f] = (len(alive), len(gone), redundant, sum(sum(fails[i]) == 1 and fails[i][f] for i in here), has(1), has(2))
        out |= {(part, order, step): (*v, shapley[f]) for (order, step, f), v in steps.items()}
    return out


def odd_rows():
    rng = random.Random(3)
    many = " ".join(f"w{k}" for k in range(60))
    texts = [None, "", " \n", "a b", "A B C # d", many, many + " $", "same word " * 40, many.upper(), "É ß \U0001f600 x " * 30, "long word " * 150_000 + "#"]
    rows = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(60)]
    return rows + [(None, many, "s"), (None, None, None), (7, many, "t"), (7, many, "t"), (-1, "a b", "u")]


def test_equals_plain_loops_on_odd_rows(spark):
    rows = odd_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (7, None, None), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOC)
    failures = filter_audit.text_failures(docs, spark.createDataFrame([(*r, "x") for r in labels], LABEL), Scratch())
    got = filter_audit.filter_audit(failures.repartition(3)).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * 4


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)
    assert filter_audit.filter_audit(filter_audit.text_failures(docs, labels, Scratch())).count() == 0


def test_any_filters_and_null_flags(spark):
    rows = [("p", 1, True, None), ("p", 3, True, True), (None, None, None, None), ("p", 2, False, True)]
    df = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.filter_audit(df, "XY").collect()}
    assert got["p", "XY", 1] == (1, 2, 0, 1, 2, 1, 3) and got["p", "XY", 2] == (0, 1, 1, 1, 0, 1, 3)
    assert got["", "YX", 2] == (1, 0, 0, 0, 0, 0, 0)
    for bad in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            filter_audit.filter_audit(df, bad)


def test_words_of_long_texts_are_counted_in_pieces():
    rng = random.Random(5)
    text = "".join(rng.choice([" ", "\n", "\t ", "x", "yy", "é", "\x0b"]) for _ in range(3000)).encode()
    for limit in (1, 2, 7, 100, 10_000):
        assert filter_audit.word_counts(text, limit) == (len(text.split()), len(set(text.split())))


def test_bitmaps_of_many_parts():
    rng = np.random.default_rng(1)
    parts, masks, good = np.array([f"p{k}" for k in rng.integers(0, 300, 2000)]), rng.integers(0, 8, 2000), rng.random(2000) < 0.5
    bitmaps = filter_audit.Bitmaps(parts, masks, [good], 3)
    left = bitmaps.left()
    for subset in range(8):
        for j, part in enumerate(bitmaps.parts):
            alive = (parts == part) & (masks & subset == 0)
            assert tuple(left[subset, j]) == (alive.sum(), (alive & good).sum())


def test_blocks_of_a_task_add_up(spark):
    df = spark.range(500).select(F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("part"), (F.col("id") % 32).cast("int").alias("mask"), (F.col("id") % 2 == 0).alias("good"), (F.col("id") % 5 == 0).alias("toxic"))
    whole = sorted(filter_audit.filter_audit(df.coalesce(1)).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert sorted(filter_audit.filter_audit(df.repartition(5), block_rows=25).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
