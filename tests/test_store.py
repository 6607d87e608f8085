"""Versions of kept evaluations: crashes, lookups, settling."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from framewise.operators import store as module
from framewise.operators.cache import latest
from framewise.operators.store import EvaluationStore

BASE = "relative_path string, pipeline_signature string, size_bytes long, modified_ns long, focus_score double"
PRESETS = "relative_path string, pipeline_signature string, preset string, subject_integrity double"


def open_store(spark, path, **options):
    return EvaluationStore(spark, str(path), BASE, PRESETS, buckets=4, **options)


def rows(spark, *ids, score=1.0, signature="s"):
    base = spark.createDataFrame([(f"p{i}", signature, i, 2 * i, score) for i in ids], BASE)
    return base, base.select("relative_path", "pipeline_signature", F.lit("p").alias("preset"), F.lit(score).alias("subject_integrity"))


def files(spark, n):
    id_ = F.col("id")
    return spark.range(n).select(id_, F.concat(F.lit("/r/p"), id_.cast("string")).alias("file_path"), F.concat(F.lit("p"), id_.cast("string")).alias("relative_path"), id_.alias("size_bytes"), (2 * id_).alias("modified_ns"))


def seen(store, kind="base"):
    return sorted((r["relative_path"], r["pipeline_signature"], r[-1]) for r in store.rows(kind).collect())


def test_nothing_is_half_seen_after_a_crash(spark, tmp_path, monkeypatch):
    store = open_store(spark, tmp_path / "s")
    assert seen(store) == [] and store.version().number == 0
    store.commit(*rows(spark, 1, 2))
    before = seen(store), seen(store, "presets")
    base, presets = rows(spark, 2, 3, score=9.0)
    with pytest.raises(Exception, match="lost"):  # between the two tables
        store.commit(base, presets.withColumn("subject_integrity", F.raise_error(F.lit("lost")).cast("double")))
    assert (seen(store), seen(store, "presets")) == before

    def lost(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:  # between the tables and the version
        m.setattr(module, "write_text", lost)
        with pytest.raises(OSError):
            store.commit(base, presets)
    assert (seen(store), seen(store, "presets")) == before and store.version().number == 1
    store.commit(base, presets)
    assert seen(open_store(spark, tmp_path / "s")) == [("p1", "s", 1.0), ("p2", "s", 9.0), ("p3", "s", 9.0)] and len(seen(store, "presets")) == 3
    store.forget()
    assert len(list((tmp_path / "s/data").iterdir())) == 2 and len(seen(store)) == 3


def test_two_writers_lose_no_batch(spark, tmp_path, monkeypatch):
    one, other = open_store(spark, tmp_path / "s"), open_store(spark, tmp_path / "s")
    write, first = module.write_text, []

    def late(*args, **kwargs):
        if not first:
            first.append(1)
            other.commit(*rows(spark, 2))
        write(*args, **kwargs)

    monkeypatch.setattr(module, "write_text", late)
    made = one.commit(*rows(spark, 1))
    assert made.number == 2 and [r[0] for r in seen(one)] == ["p1", "p2"]
    first.clear()
    one.settle()  # a batch that comes while it is settled stays
    assert [r[0] for r in seen(one)] == ["p1", "p2"] and len(one.version().batches) == 1


def test_a_second_run_evaluates_only_the_rest(spark, tmp_path, monkeypatch):
    store, photos = open_store(spark, tmp_path / "s"), files(spark, 40)
    calls = spark.sparkContext.accumulator(0)

    def model(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch.assign(focus_score=batch["id"] * 1.5, subject_integrity=0.5, error=[None if i % 10 else "ValueError: dark" for i in batch["id"]])

    def evaluate(df):
        return df.mapInPandas(model, "id long, file_path string, relative_path string, size_bytes long, modified_ns long, focus_score double, subject_integrity double, error string")

    commit, done = store.commit, []

    def interrupted(*args):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(1)
        return commit(*args)

    monkeypatch.setattr(store, "commit", interrupted)
    with pytest.raises(KeyboardInterrupt):
        store.evaluate(photos, "s", "p", evaluate, lambda r: r, photos, F.col("id") % 4, 4)
    assert calls.value == 30 and len(seen(store)) == 18  # the third part was evaluated but not kept
    monkeypatch.setattr(store, "commit", commit)
    runs = store.evaluate(photos, "s", "p", evaluate, lambda r: r, photos, F.col("id") % 4, 4)
    assert calls.value == 30 + 2 + 20 and sum(r.records.count() for r in runs) == 36 and len(seen(store)) == 36  # what failed is tried again
    assert [r.counts["cached"] for r in runs] == [8, 10, 0, 0]
    again = store.evaluate(photos, "s", "q", evaluate, lambda r: r.withColumn("subject_integrity", F.lit(0.9)), photos, batches=3)
    assert sum(r.counts["refreshed"] for r in again) == 36 and calls.value == 52 + 4 and len(seen(store, "presets")) == 72
    store.evaluate(photos, "t", "p", evaluate, lambda r: r, photos, mode="none")
    assert len(seen(store)) == 36
    with pytest.raises(ValueError, match="cache mode"):
        store.evaluate(photos, "s", "p", evaluate, lambda r: r, photos, mode="some")


def test_a_lookup_does_not_move_the_settled_rows(spark, tmp_path):
    store = open_store(spark, tmp_path / "s")
    store.commit(*rows(spark, *range(200)))
    store.commit(*rows(spark, *range(100), score=2.0))
    store.commit(*rows(spark, *range(50), score=4.0, signature="t"))
    store.settle()
    store.commit(*rows(spark, 7, score=3.0))
    with_threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = open_store(spark, tmp_path / "s").known(files(spark, 210), "s", "p")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: (r["route"], r["_kept"] and r["_kept"]["focus_score"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_threshold)
    assert got == {i: ("hit", 3.0 if i == 7 else 2.0 if i < 100 else 1.0) if i < 200 else ("miss", None) for i in range(210)}
    lines = plan.splitlines()
    depth = lambda line: re.search(r"[A-Za-z]", line).start()
    scans = [i for i, line in enumerate(lines) if "FileScan parquet spark_catalog.default.framewise_" in line]
    assert len(scans) == 2 and "Bucketed: true" in plan
    for at in scans:  # up from the scan: the join comes before any exchange
        level = depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) < level:
                level = depth(line)
                assert "Exchange" not in line
                if "SortMergeJoin" in line:
                    break
        else:
            raise AssertionError("no join")


def test_settling_keeps_the_latest(spark, tmp_path):
    store = open_store(spark, tmp_path / "s", settle_after=3)
    log = None
    for i in range(7):
        base, presets = rows(spark, *range(i, 12, 1 + i % 3), score=float(i))
        log = base.withColumn("written_at", F.lit(i)) if log is None else log.union(base.withColumn("written_at", F.lit(i)))
        store.commit(base, presets)
        want = sorted((r["relative_path"], r["pipeline_signature"], r["focus_score"]) for r in latest(log).collect())
        assert seen(store) == want and len(store.version().batches) < 3
    assert store.version(1).batches and store.version().settled
    assert sorted(r[0] for r in store.rows("base", store.version(1)).collect()) == sorted(f"p{i}" for i in range(12))
