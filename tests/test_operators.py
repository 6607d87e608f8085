"""Small cases with known answers."""

from __future__ import annotations

import json
import os
import re
import types

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewise import storage
from framewise.functions import files as ff
from framewise.functions import metadata, vectors
from framewise.functions.scoring import MULTIPLIERS, PROFILES, power
from framewise.operators import bursts, cache, explain, families, features, feedback, incremental, ranking, selection
from framewise.operators.bursts import BurstRules, group_bursts
from framewise.operators.ordering import Ordered, value_ranks
from framewise.sinks import export, reports
from framewise.sinks.export import copy_plan, rated_xmp
from framewise.sinks.reports import review_page, write_csv
from framewise.sinks.journal import Journal, observed
from framewise.sources import files as fs
from framewise.sources.reports import read_evaluation

SCHEMA = "file_path string, path_key string, file_name string, ts_us long, sequence_number string, camera_serial string, camera_model string, phash long, embedding array<float>, focus_score double, musiq_score double, aesthetic_score double, exposure_penalty double, eye_factor double, eye_warning string, subject_integrity double, blown_pct double, crushed_pct double"


def captures(spark, rows):
    """Each row: name, seconds, and changes of the defaults."""
    made = []
    for name, seconds, changes in rows:
        r = {
            "file_path": name, "path_key": name.lower(), "file_name": name, "ts_us": round(seconds * 1e6), "sequence_number": "", "camera_serial": "camera-a", "camera_model": "", "phash": 0,
            "embedding": [1.0, 0.0], "focus_score": 10.0, "musiq_score": 80.0, "aesthetic_score": 7.0, "exposure_penalty": 1.0, "eye_factor": 1.0, "eye_warning": "", "subject_integrity": 1.0,
            "blown_pct": 0.0, "crushed_pct": 0.0,
        }
        made.append(tuple((r | changes).values()))
    return spark.createDataFrame(made, SCHEMA)


def ids(df):
    return [r[0] for r in df.orderBy("ts_us", "path_key").select("burst_id").collect()]


@pytest.mark.parametrize(("rows", "want"), [
    ([("b.jpg", 0, {}), ("a.jpg", 0, {})], [1, 1]),
    ([("a", 0, {}), ("b", 3, {})], [1, 2]),
    ([(f"{i}", 2 * i, {}) for i in range(7)], [1, 1, 1, 1, 1, 1, 2]),
    ([("a", 0, {}), ("b", 0, {"camera_serial": "camera-b"})], [1, 2]),
    ([("a", 0, {}), ("b", 0.1, {"camera_serial": "camera-b"}), ("c", 0.2, {})], [1, 2, 3]),
    ([("a", 0, {}), ("b", 1, {"phash": 511})], [1, 1]),
    ([("a", 0, {}), ("b", 1, {"phash": 511, "embedding": [0.0, 1.0]})], [1, 2]),
    ([("a", 0, {"phash": None}), ("b", 1, {"embedding": None})], [1, 2]),
    ([], []),
])
def test_bursts(spark, rows, want):
    assert ids(group_bursts(captures(spark, rows))) == want


def test_bursts_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{i:04d}", float(t), {"camera_serial": f"c{rng.integers(2)}" if i % 9 == 0 else "c0", "phash": int(rng.integers(8))}) for i, t in enumerate(np.cumsum(rng.exponential(1.2, 400)))]
    got = ids(group_bursts(captures(spark, rows), BurstRules()))
    want, began, n = [], 0, 0
    for i, (_, t, c) in enumerate(rows):
        t = round(t * 1e6)
        before = rows[i - 1] if i else None
        if not before or c["camera_serial"] != before[2]["camera_serial"] or t - round(before[1] * 1e6) > 2_000_000 or t - began > 10_000_000:
            n, began = n + 1, t
        want.append(n)
    assert got == want


@pytest.mark.parametrize("kind", ["even", "uneven", "copies", "breaks", "short"])
def test_long_chains_match_a_plain_loop(spark, kind):
    """A time-lapse is one chain; its ranges are cut apart from one another."""
    rng = np.random.default_rng(len(kind))
    n = 7 if kind == "short" else 700
    gaps = {"even": np.full(n, 1.7), "uneven": rng.exponential(0.9, n).clip(0, 1.9), "copies": rng.choice([0.0, 0.0, 1.5], n), "breaks": rng.choice([0.5, 1.5, 2.5], n, p=[0.6, 0.395, 0.005]), "short": np.full(n, 1.9)}[kind]
    times = [round(float(t), 3) for t in np.cumsum(gaps)]
    df = captures(spark, [(f"{i:05d}", t, {}) for i, t in enumerate(times)])
    want, began, k = [], 0, 0
    for i, t in enumerate(round(x * 1e6) for x in times):
        if not i or t - round(times[i - 1] * 1e6) > 2_000_000 or t - began > 10_000_000:
            k, began = k + 1, t
        want.append(k)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for ranges in ("1", "3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            assert ids(group_bursts(df)) == want, ranges
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rules_scale_and_are_checked():
    assert BurstRules().looser() == BurstRules(4, 20, 10, 0.84)
    assert BurstRules().tighter() == BurstRules(1, 5, 6, 0.92)
    with pytest.raises(ValueError):
        BurstRules(window=3, duration=2)


def test_mid_rank(spark):
    for scores, want in (([10.0], [1.0]), ([10.0, 10.0], [0.75, 0.75])):
        rows = captures(spark, [(str(i), i, {"focus_score": s}) for i, s in enumerate(scores)])
        assert [r[0] for r in ranking.focus_percentile(rows, PROFILES["balanced"]).select("focus_percentile").collect()] == want


def reasons(spark, rows):
    ranked = ranking.burst_ranks(ranking.scored(captures(spark, rows), PROFILES["balanced"]))
    return {r["file_name"]: r["score_reason"] for r in explain.score_reasons(ranked).collect()}


def test_powers_equal_the_c_library(spark):
    """Bit by bit, as SQL has them; a last bit decides between captures of nearly equal scores."""
    x = np.random.default_rng(4).random(3000).tolist() + [0.0, 1.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for weight in (0.0, 0.15, 0.5, 0.7, 1.0, 1.5, 2.0):
        assert {r["x"]: r["y"] for r in df.select("x", power(F.col("x"), weight).alias("y")).collect()} == {v: v**weight for v in x}


def test_reasons(spark):
    made = reasons(spark, [(f"{i}.jpg", i, {"focus_score": float(f)}) for i, f in enumerate((100, 80, 20))])
    assert made["0.jpg"].startswith("best of 3 in burst; next best 1.jpg scored 35% lower, mainly on sharpness")
    assert made["2.jpg"].startswith("3rd of 3 in burst; scored 93% lower than 0.jpg, mainly on sharpness")
    made = reasons(spark, [(f"{i}.jpg", i, {"focus_score": 50.0}) for i in range(2)])
    assert "ties 1.jpg on score and wins on path order" in made["0.jpg"] and "loses on path order" in made["1.jpg"]
    made = reasons(spark, [(f"{i}.jpg", 60 * i, {"aesthetic_score": 4.0 + i}) for i in range(4)])
    assert "aesthetic in top 25% of all photos" in made["3.jpg"] and "aesthetic in bottom 25%" in made["0.jpg"] and made["1.jpg"] == "single shot"
    made = reasons(spark, [("a", 0, {"exposure_penalty": 0.8, "blown_pct": 6.0})])
    assert "clipping (-20%): 6.0% highlights blown, 0.0% shadows crushed" in made["a"]


def test_reasons_look_up_the_first_two_without_a_sort(spark):
    rows = spark.createDataFrame([("a.jpg", "a.jpg", 7.0, 1, 2)], "file_name string, path_key string, aesthetic_score double, burst_id long, burst_size long")
    rows = rows.withColumns({"composite_score": F.col("aesthetic_score"), **{m: F.lit(1.0) for m in MULTIPLIERS}})
    plan = explain.with_burst_clause(ranking.burst_ranks(rows), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert [line.split("Sort ")[1].count(",") for line in plan.splitlines() if "+- Sort [" in line] == [4]  # by burst, score and path


def test_standings_need_no_lambda(spark):
    plan = explain.standings(captures(spark, [("a.jpg", 0, {})]))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # Spark compiles no step that has one


def test_captures_may_name_shared_vectors(spark, monkeypatch):
    looks = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: None}
    rows = [(f"{i}.jpg", i // 3, {"phash": None, "sequence_number": ("x", "7", "10")[i % 3], "embedding": looks.get(i % 5)}) for i in range(40)]
    plain = captures(spark, rows)
    named = plain.withColumn("vec_id", F.regexp_extract("path_key", r"\d+", 0).cast("int") % 5).drop("embedding")
    shared, plans = spark.createDataFrame(list(looks.items()), "vec_id int, embedding array<float>"), []
    monkeypatch.setattr(bursts, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or storage.stored(df, name))
    want = [r[:] for r in group_bursts(plain).orderBy("path_key").select("path_key", "burst_id").collect()]
    got = group_bursts(named, without=("vec_id", "phash"), vectors=shared)
    assert [r[:] for r in got.orderBy("path_key").select("path_key", "burst_id").collect()] == want and len({b for _, b in want}) > 10
    assert not {"vec_id", "phash", "embedding"} & set(got.columns)
    sorts = [line for plan in plans for line in plan.splitlines() if "Sort [ts_us" in line]
    assert len(sorts) == 2 and not any("RLIKE" in line for line in sorts)


def test_ordinals(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 11, 12, 13, 21, 22, 102, 111)], "n long")
    assert [r[0] for r in rows.select(explain.ordinal(F.col("n"))).collect()] == "1st 2nd 3rd 4th 11th 12th 13th 21st 22nd 102nd 111th".split()


def pool(spark, rows):
    return spark.createDataFrame(rows, "path_key string, composite_score double, embedding array<double>, feedback_decision string")


def slow_mmr(rows, k, d, pins):
    q = [s for _, s, _ in rows]
    span = max(q) - min(q)
    q = [(x - min(q)) / span if span else 1.0 for x in q]
    unit = [np.array(v) / np.linalg.norm(v) for _, _, v in rows]
    picks = sorted(pins, key=lambda i: rows[i][0])
    while len(picks) < min(len(rows), max(k, len(pins))):
        near = lambda i: max(((unit[i] @ unit[j] + 1) / 2 for j in picks), default=0.0)  # noqa: E731, B023
        picks.append(min((i for i in range(len(rows)) if i not in picks), key=lambda i: (-((1 - d) * q[i] - d * near(i)), -q[i], rows[i][0])))
    return [rows[i][0] for i in picks]


@pytest.mark.parametrize("d", [0.1, 0.5, 0.8])
@pytest.mark.parametrize("pins", [(), (3, 7)])
def test_diverse_selection_matches_a_plain_loop(spark, d, pins):
    rng = np.random.default_rng(int(d * 10))
    rows = [(f"p{i:02d}", float(rng.integers(1, 9)), rng.normal(size=6).tolist()) for i in range(24)]
    df = pool(spark, [(*r, "keep" if i in pins else "") for i, r in enumerate(rows)])
    pinned = F.col("feedback_decision") == "keep" if pins else None
    got = selection.select_diverse(df, 7, d, pinned, buffer=4).orderBy("pick").collect()
    assert [r["path_key"] for r in got] == slow_mmr(rows, 7, d, pins)


@pytest.mark.parametrize("d", [0.0, 0.2, 0.6, 1.0])
def test_layers_out_of_reach_are_not_read(spark, d):
    """Picks equal the plain loop's, from embeddings of two lengths and none, while poor candidates are left alone where the diversity allows it."""
    rng = np.random.default_rng(7)
    n = 400
    rows = [(f"p{i:03d}", float(rng.exponential(2.0)), (rng.normal(size=6) + (2 if i % 3 else 0)).tolist()) for i in range(n)]
    seen = {}
    got = selection.select_diverse(pool(spark, [(*r, "") for r in rows]), 12, d, buffer=5, seen=seen).orderBy("pick").collect()
    assert [r["path_key"] for r in got] == slow_mmr(rows, 12, d, ())
    assert seen["candidates"] <= n and (d > 0.2 or seen["read"] < 3 * n)
    odd = [("a", 3.0, [1.0, 0.0], ""), ("b", 2.9, [1.0, 0.0, 0.0], ""), ("c", 2.8, None, ""), ("d", 2.7, [1.0, 0.0], ""), ("e", 0.0, [0.0, 0.0], "")]
    assert selection.select_diverse(pool(spark, odd), 5, d, buffer=2).count() == 5


def test_top_with_pins_and_rejects(spark):
    df = pool(spark, [(n, float(s), [1.0], m) for n, s, m in (("a", 10, ""), ("b", 9, ""), ("c", 8, ""), ("d", 7, "reject"), ("e", 6, "keep"))]).withColumn("burst_winner", F.lit(True))
    chosen = selection.select_top(selection.pool_of(df), 3, F.col("feedback_decision") == "keep")
    assert [r["path_key"] for r in chosen.orderBy("portfolio_selection_order").collect()] == ["a", "b", "e"]


def test_targets():
    T = selection.Target.parse
    assert all(T(x).kind == "none" for x in ("", "none", "SKIP", "0", "0%")) and T(" 12 ").value == 12 and T("2.50 %").value == 2.5
    assert [T(t).of(n)[0] for t, n in (("10%", 1840), ("50%", 3), ("33%", 3), ("1%", 10), ("10%", 0))] == [184, 2, 1, 1, 0]
    assert T("920").of(612) == (612, True)
    for bad in ("five", "1.5", "-3", "101%", "-1%", "nan%", "inf%", "x%", "%"):
        with pytest.raises(ValueError):
            T(bad)


def test_feedback_rules(spark):
    rows = spark.createDataFrame([(1, "a", " Keep"), (2, "b", "reject"), (3, "a", "REJECT"), (4, "b", " ")], "row_id long, file_path string, decision string")
    assert {tuple(r) for r in feedback.decisions(rows, "/r").collect()} == {("/r/a", "reject"), ("/r/b", "reject")}
    with pytest.raises(Exception, match="invalid decision"):
        feedback.decisions(rows.withColumn("decision", F.lit("maybe"))).collect()


def test_agreement(spark):
    rows = spark.createDataFrame([("a", 3.0, 1, "keep"), ("b", 2.0, 2, ""), ("c", 1.0, 3, "reject")], "path_key string, composite_score double, global_quality_rank long, feedback_decision string")
    assert tuple(feedback.agreement(rows).first()) == (3, 2, 1, 1, 1.0, 1.0, 1.0, 3.0)
    assert feedback.agreement(rows.where("path_key = 'b'")).first()["pairwise_accuracy"] is None


def test_times(spark):
    t = lambda text, sub, off: spark.createDataFrame([(text, sub, off)], "t string, s string, o string").select(metadata.capture_time(F.col("t"), F.col("s"), F.col("o")).micros.alias("m"), metadata.capture_time(F.col("t"), F.col("s"), F.col("o")).zone_source.alias("z")).first()
    day = 1788912000_000000
    at = day + (12 * 3600 + 34 * 60 + 56) * 1_000_000
    assert tuple(t("2026:09:09 12:34:56", "1234", "-04:00")) == (at + 4 * 3_600_000_000 + 123400, "embedded_offset")
    assert tuple(t("2026:09:09 12:34:56.9876543+0530", None, None)) == (at - 19_800_000_000 + 987654, "embedded_offset")
    assert tuple(t("2026:09:09 12:34:56", None, None)) == (at, "system_local_assumption")
    assert t("2026:13:09 12:34:56", None, None)["m"] is None and t("nothing", None, None)["m"] is None


def test_scan(spark, tmp_path):
    for p in ("session/B.JPG", "session/a.arw", "picks_20260909_120000/old.jpg", ".Trash/x.jpg", "session/._a.arw", "session/notes.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    (tmp_path / "session/link.jpg").symlink_to(tmp_path / "session/B.JPG")
    found = fs.images(fs.scan(spark, str(tmp_path)))
    assert [r["name"] for r in found.orderBy("path_key").collect()] == ["a.arw", "B.JPG"]


def test_families(spark, tmp_path):
    files = spark.createDataFrame([("/s", n, 1) for n in ("IMG_0001.ARW", "IMG_0001.JPG", "IMG_0001.ARW.xmp", "IMG_0002.xmp", "shot.v2.xmp", "shot.ARW")], "parent string, name string, size_bytes long")
    plan = families.export_plan(files.where("name = 'IMG_0001.ARW'"), files)
    assert sorted(r["destination"] for r in plan.collect()) == ["s/IMG_0001.ARW", "s/IMG_0001.ARW.xmp", "s/IMG_0001.JPG"]
    both = spark.createDataFrame([("/a/IMG.JPG", "a/IMG.JPG", "a/img.jpg"), ("/a/img.jpg", "a/img.jpg", "a/img.jpg")], "source string, destination string, destination_key string")
    assert families.collisions(both).count() == 1
    with pytest.raises(Exception, match="two sources"):
        families.checked_plan(both).collect()
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jpg").write_bytes(b"1")
    one = spark.createDataFrame([(str(tmp_path / "a/x.jpg"), "a/x.jpg", "a/x.jpg")], both.schema)
    assert copy_plan(one, str(tmp_path / "out")) == 1 and (tmp_path / "out/a/x.jpg").read_bytes() == b"1"
    with pytest.raises(FileExistsError):
        copy_plan(one, str(tmp_path / "out"))


def test_xmp_has_one_rating():
    once = rated_xmp(None, 3)
    assert rated_xmp(once, 5).count("Rating") == 1 and 'Rating="5"' in rated_xmp(once, 5)


def test_pixels(spark):
    red = np.full((20, 20, 3), (50, 100, 255), np.uint8)
    assert features.clipping(red) == (1.0, 0.0) and features.clipping(np.zeros((4, 4, 3), np.uint8)) == (0.0, 1.0)
    noise = np.random.default_rng(1).integers(0, 256, (301, 277, 3), dtype=np.uint8)
    edges = features.laplacian(features.gray(noise))
    tiles = [t.var() for band in np.array_split(edges, 16) for t in np.array_split(band, 16, 1)]
    assert features.focus_score(noise) == pytest.approx(np.mean(sorted(tiles)[-8:]))


def test_order_over_ranges_equals_a_plain_sort(spark):
    rows = spark.range(500).select((F.xxhash64("id") % 50).alias("k"), "id")
    ordered = Ordered(rows, "k", "id")
    got = ordered.row_number("n").orderBy("n").collect()
    want = sorted((r["k"], r["id"]) for r in rows.collect())
    assert [(r["k"], r["id"]) for r in got] == want and [r["n"] for r in got] == list(range(1, 501))
    before = {r["id"]: r["p"] for r in ordered.lag({"p": "id"}).collect()}
    assert before == {b[1]: (want[i - 1][1] if i else None) for i, b in enumerate(want)}
    assert value_ranks(rows.limit(0), F.col("k"))[0].count() == 0


def test_sums_of_placed_rows_move_no_row(spark):
    rows = spark.range(300).select(((F.col("id") * 37) % 300).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 5 - 2).alias("v"))
    placed = Ordered(rows, "k", sums={"upto": F.col("v")}).placed("n")
    upto = 0
    for i, r in enumerate(placed.orderBy("k").collect(), 1):
        upto += r["v"] or 0
        assert (r["n"], r["upto"]) == (i, upto)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_part") == 1  # of the counts of ranges alone
    assert not Ordered(rows.limit(0), "k", sums={"upto": F.col("v")}).placed("n").count()


def test_diverse_picks_without_embeddings_and_many_pins(spark):
    rows = [("a", 3.0, [1.0, 0.0], True), ("b", 2.9, None, True), ("c", 2.8, [1.0, 0.1], True), ("d", 2.7, None, False), ("e", 2.6, [0.0, 1.0], False), ("f", 2.5, [1.0, 0.0], False)]
    df = spark.createDataFrame(rows, "path_key string, composite_score double, embedding array<double>, pin boolean")
    got = [r["path_key"] for r in selection.select_diverse(df, 5, 0.9, F.col("pin"), buffer=2).orderBy("pick").collect()]
    assert sorted(got[:3]) == ["a", "b", "c"] and got[3:] == ["d", "e"]
    assert selection.select_diverse(df.drop("embedding").withColumn("embedding", F.lit(None).cast("array<double>")), 2, 0.5).count() == 2
    assert selection.select_diverse(df.limit(0), 3, 0.5).count() == 0


def test_kept_rows(spark, tmp_path):
    v = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert v.select(vectors.of_length(F.col("v"), 2)).count() == 2
    with pytest.raises(Exception, match="3 numbers, not 2"):
        v.select(vectors.of_length(F.col("v"), 3)).collect()
    twice = spark.createDataFrame([("a", "s", 1.0, 5), ("a", "s", 2.0, 5), ("a", "s", 9.0, 4)], "relative_path string, pipeline_signature string, x double, written_at long")
    assert len({cache.latest(twice.orderBy(F.rand(i)).repartition(3)).first()["x"] for i in range(3)}) == 1
    base = twice.drop("written_at")
    cache.append_both(base.limit(1), base.limit(1), f"{tmp_path}/base", f"{tmp_path}/preset")
    bad = base.withColumn("x", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        cache.append_both(base, bad, f"{tmp_path}/base", f"{tmp_path}/preset")
    assert spark.read.parquet(f"{tmp_path}/base").count() == 1
    base.limit(0).write.option("header", True).csv(f"{tmp_path}/empty")
    with pytest.raises(ValueError, match="no rows"):
        read_evaluation(spark, f"{tmp_path}/empty")


def test_one_digit_rounds_as_python_does(spark):
    values = [i / 20 for i in range(0, 200)] + [0.35, 2.45, 1.15, 0.25, 99.95, 0.05, 0.04999999999999999, 12.349999999999998, 7.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", ff.one_digit(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{r['x']:.1f}" for r in got]


def test_standings_keep_rows_without_a_measure(spark):
    rows = captures(spark, [("a", 0, {"focus_score": None}), ("b", 60, {"musiq_score": float("nan")}), ("c", 120, {"aesthetic_score": None}), ("d", 180, {})])
    assert explain.standings(rows).count() == 4
    scored = explain.score_reasons(ranking.burst_ranks(ranking.scored(rows, PROFILES["balanced"])))
    assert scored.where("score_reason is not null").count() == 4


def test_pictures():
    p = np.arange(6).reshape(2, 3)
    turned = {1: p, 2: p[:, ::-1], 3: p[::-1, ::-1], 4: p[::-1], 5: p.T, 6: np.rot90(p, -1), 7: p[::-1, ::-1].T, 8: np.rot90(p)}
    for o, want in turned.items():
        assert np.array_equal(features.oriented(p, o), want), o
    picture = np.random.default_rng(2).integers(0, 256, (32, 32)).astype(float)
    term = lambda u, v: sum(picture[i, j] * np.cos(np.pi * u * (2 * i + 1) / 64) * np.cos(np.pi * v * (2 * j + 1) / 64) for i in range(32) for j in range(32))
    low = np.array([[term(u, v) for v in range(8)] for u in range(8)])
    assert f"{features.perceptual_hash(picture):064b}" == "".join(str(int(x > np.median(low))) for x in low.ravel())


def test_csv_and_log(spark, tmp_path):
    rows = spark.createDataFrame([("b", "=1"), ("a", "x")], "k string, v string")
    path = str(tmp_path / "out")
    write_csv(rows, path, "k")
    write_csv(rows.where("k = 'a'"), path, "k")
    assert spark.read.option("header", True).csv(path).count() == 1 and os.listdir(tmp_path) == ["out"]
    bad = rows.select("k", F.when(F.col("k") == "a", F.raise_error(F.lit("no"))).otherwise("y").alias("v"))
    with pytest.raises(Exception, match="no"):
        write_csv(bad, path)
    assert spark.read.option("header", True).csv(path).count() == 1 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(RuntimeError):
        incremental.some(rows.limit(0))


class Files:
    """A file system of names, of which some renames fail."""

    def __init__(self, names, bad=()):
        self.names, self.bad = set(names), bad

    def exists(self, name):
        return name in self.names

    def rename(self, a, b):
        if (a, b) in self.bad:
            raise OSError("away")
        if a not in self.names or b in self.names:
            return False
        self.names = self.names - {a} | {b}
        return True

    def delete(self, name, deep):
        self.names -= {name}


def test_a_report_that_cannot_take_its_name_leaves_the_earlier_one():
    files = Files({"new", "here"})
    storage.take_name(files, "new", "here", "before")
    assert files.names == {"here"}
    files = Files({"new", "here"}, bad={("new", "here")})
    with pytest.raises(OSError):
        storage.take_name(files, "new", "here", "before")
    assert files.names == {"new", "here"}
    files = Files({"new", "here"}, bad={("new", "here"), ("before", "here")})
    with pytest.raises(OSError):
        storage.take_name(files, "new", "here", "before")
    assert files.names == {"new", "before"}
    files = Files({"new", "here", "before"})
    with pytest.raises(OSError):
        storage.take_name(files, "new", "here", "before")
    assert files.names == {"new", "here", "before"}


def test_journal(spark, tmp_path):
    rows = spark.range(10)
    book = Journal(spark, str(tmp_path / "run"), {"preset": "balanced"}, {"quality": "sha256:00"})
    with book.step("lookup") as step:
        made = book.write(step, rows, lambda df: df.write.parquet(f"{tmp_path}/a"), n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
        assert made == {"n": 10, "even": 5}
        book.write(step, rows.limit(0), lambda df: df.write.parquet(f"{tmp_path}/b"), n=F.count("*"))
    with pytest.raises(ValueError), book.step("decode"):
        raise ValueError("no picture")
    book.failures(spark.createDataFrame([], incremental.FAILURE))
    book.failures(spark.createDataFrame([("/x", "decode", "ValueError", "=bad")], incremental.FAILURE))
    book.output("report", "/r")
    told = json.loads((tmp_path / "run/run.json").read_text())
    assert [(s["step"], s["outcome"], s["counts"]) for s in told["steps"]] == [("lookup", "done", {"n": 10, "even": 5}), ("decode", "ValueError: no picture", {})]
    assert told["options"] == {"preset": "balanced"} and told["models"] == {"quality": "sha256:00"} and told["files"] == {"report": "/r"} and told["software"]["spark"] == spark.version
    assert {(r["step"], r["rows"]) for r in book.costs().collect()} == {("lookup", 10), ("decode", 0)} and book.table().count() == 2
    assert [r["message"] for r in spark.read.option("header", True).csv(f"{book.folder}/failures").collect()] == ["'=bad"]
    with pytest.raises(FileExistsError):
        Journal(spark, book.folder)


def test_a_run_calls_its_model_once_a_file(spark, tmp_path):
    """However many of its tables are read; its counts take no job of their own."""
    n = 40
    files = spark.range(n).select(F.concat(F.lit("/r/"), F.col("id").cast("string")).alias("file_path"), F.col("id").cast("string").alias("relative_path"), F.lit(1).cast("long").alias("size_bytes"), F.lit(2).cast("long").alias("modified_ns"))
    calls = spark.sparkContext.accumulator(0)

    def model(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch.assign(focus_score=batch["relative_path"].astype(float), error=[None if int(p) % 4 else "ValueError: dark" for p in batch["relative_path"]])

    evaluate = lambda rows: rows.mapInPandas(model, StructType([*rows.schema.fields]).add("focus_score", "double").add("error", "string"))
    base = spark.createDataFrame([], "relative_path string, pipeline_signature string, size_bytes long, modified_ns long, focus_score double")
    presets = spark.createDataFrame([], "relative_path string, pipeline_signature string, preset string, subject_integrity double")
    rescan = files.where("relative_path <> '3'")
    run = incremental.run(files, base, presets, "s", "p", evaluate, lambda rows: rows, rescan)
    assert run.records.count() == 29 and run.fresh.count() == 29 and run.refreshed.count() == 0 and run.failures.count() == 11 and run.kept.count() == 29
    assert calls.value == n
    assert tuple(incremental.phase_counts(run).first()) == (40, 0, 0, 29, 11) and calls.value == n
    assert incremental.run(files, base, presets, "s", "p", evaluate, lambda rows: rows, rescan, mode="none").kept.count() == 0
    assert observed(files.limit(0), lambda df: df.write.parquet(f"{tmp_path}/none"), n=F.count("*")) == {"n": 0}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_times_in_any_session_zone(spark, zone):
    texts = [("2024:01:31 12:00:00Z",), ("2024:03:10 02:30:00",), ("2024:11:03 01:30:00.5-04:00",), ("1969-12-31 23:59:59.25",)]
    rows = spark.createDataFrame(texts, "t string")
    own, berlin = (metadata.capture_time(F.col("t"), zone=z).micros for z in ("UTC", "Europe/Berlin"))
    seen = rows.select(own.alias("ts_us"), berlin.alias("b"), F.lit(-90).alias("tz_offset_minutes"))
    wall = spark.sql("select timestamp_ntz '2024-03-10 02:30:00.123456' as t").select(metadata.wall_micros(F.col("t")))
    want = [tuple(r) for r in reports.iso_times(seen).collect()], wall.first()[0]
    assert want[0][0] == (1706702400000000, 1706702400000000, -90, "2024-01-31T10:30:00.000000-01:30", "2024-01-31T12:00:00.000000+00:00")
    assert want[0][3][0] == -750000 and want[0][3][4] == "1969-12-31T23:59:59.250000+00:00" and want[1] == 1710037800123456
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert ([tuple(r) for r in reports.iso_times(seen).collect()], wall.first()[0]) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_export_checks_its_sources(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"12")
    os.symlink(tmp_path / "x.jpg", tmp_path / "l.jpg")
    plan = lambda *names: spark.createDataFrame([(str(tmp_path / n), f"o/{n}", f"o/{n}") for n in names], "source string, destination string, destination_key string")
    for bad in ("l.jpg", "missing.jpg"):
        with pytest.raises(Exception, match="regular"):
            export.copy_plan(plan("x.jpg", bad), str(tmp_path / "out"))
        assert sorted(os.listdir(tmp_path)) == ["l.jpg", "x.jpg"]
    assert export.required_bytes(plan("x.jpg", "missing.jpg")) == 2
    export.link_or_copy(export.preview(spark.createDataFrame([(str(tmp_path / "x.jpg"), 3)], "source string, place int"), str(tmp_path / "p")))
    assert (tmp_path / "p/0003_x.jpg").read_bytes() == b"12"
    two = '<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:xmp="http://ns.adobe.com/xap/1.0/"><rdf:RDF><rdf:Description rdf:about="a"/><rdf:Description rdf:about="b" xmp:Rating="1"/></rdf:RDF></x:xmpmeta>'
    made = rated_xmp(two, 4)
    assert made.count("Rating") == 1 and re.search('about="b"[^>]*Rating="4"', made)


def test_scan_of_many_folders(spark, tmp_path, monkeypatch):
    for i in range(12):
        (tmp_path / f"d{i % 3}/e{i}/f").mkdir(parents=True)
        (tmp_path / f"d{i % 3}/e{i}/f/{i}.jpg").write_bytes(b"x")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/made.jpg").write_bytes(b"x")
    for shares in (1, 3, 7, 100):
        monkeypatch.setattr(fs, "SHARES", shares)
        reader = fs._Reader(str(tmp_path), str(tmp_path / "out"))
        found = sorted(os.path.basename(r[0]) for part in reader.partitions() for r in reader.read(part))
        assert found == sorted(f"{i}.jpg" for i in range(12))
    assert fs.scan(spark, str(tmp_path), str(tmp_path / "out")).count() == 12 and fs.scan(spark, str(tmp_path)).count() == 13


def test_the_shared_folder_is_named_on_a_cluster():
    conf = types.SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077")))


def test_files_whose_names_fold_alike_collide(spark):
    rows = spark.createDataFrame([("/a", "straße.jpg", 1), ("/a", "STRASSE.arw", 2)], "parent string, name string, size_bytes long")
    assert {r["stem"] for r in families.with_family(rows).collect()} == {"strasse"}
    again = rows.union(spark.createDataFrame([("/a", "STRASSE.jpg", 3)], rows.schema))
    assert families.collisions(families.export_plan(again, again)).count() == 1


def test_small_expressions(spark):
    one = spark.createDataFrame([("f0e1d2c3b4a59687", "algorithm=5;max_dim=1024;preset=wildlife")], "h string, s string")
    plain, preset = ff.strip_preset(F.col("s"))
    r = one.select(vectors.hex_to_hash(F.col("h")).alias("n"), vectors.hash_to_hex(vectors.hex_to_hash(F.col("h"))).alias("t"), plain.alias("p"), preset.alias("q")).first()
    assert tuple(r) == (-1089357896855742841, "f0e1d2c3b4a59687", "algorithm=5;max_dim=1024", "wildlife")
    w, b = vectors.folded([([[1.0, 2.0], [0.0, 1.0]], [1.0, 0.0]), ([[1.0, 1.0]], [0.5])])
    assert (w, b) == ([1.0, 3.0], 1.5)
    with pytest.raises(Exception, match="outside"):
        one.select(ff.relative_key(F.col("h"), "/r")).collect()


def test_review_page_escapes(spark):
    rows = spark.createDataFrame([(1, 1, 1, "<b>.jpg", 1.0, "x & y")], "group long, burst_rank long, burst_id long, file_path string, composite_score double, score_reason string")
    assert "<b>" not in review_page(rows) and "x &amp; y" in review_page(rows)
