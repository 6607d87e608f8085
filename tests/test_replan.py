"""Sessions of changes against fresh runs."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from framewise import storage
from framewise.functions.scoring import PROFILES
from framewise.operators import ranking, selection
from framewise.operators.bursts import BurstRules
from framewise.operators.replan import Session, Settings, command
from framewise.plans import views

from .conftest import DATA

START = Settings(PROFILES["balanced"])
RULES = BurstRules(600.0, 1800.0, 14, 0.1)


def captures(spark):
    rows = views.captures(spark, f"{DATA}/sf0.001")
    mark = F.when(F.col("capture_id") % 50 == 3, "keep").when(F.col("capture_id") % 50 == 4, "reject").otherwise("")
    return rows.withColumn("feedback_decision", mark)


def fresh(rows, s):
    """The same selection by the plain functions, in one go."""
    rules = {"tighter": RULES.tighter(), "normal": RULES, "looser": RULES.looser()}[s.level]
    ranked = ranking.evaluated(rows, s.profile, rules)
    base = ranked.count() if s.mode == "photos" else ranked.where("burst_winner").count()
    count, _ = selection.Target.parse(s.target).of(base)
    pool, keep = selection.pool_of(ranked, s.mode), F.col("feedback_decision") == "keep"
    if s.diversity:
        got = selection.select_diverse(pool.join(rows.select("path_key", "embedding"), "path_key"), count, s.diversity, keep)
        return [r["path_key"] for r in got.orderBy("pick").collect()]
    return [r["path_key"] for r in selection.select_top(pool, count, keep).orderBy("portfolio_selection_order").collect()]


def test_changes_equal_fresh_runs_and_make_only_what_hangs_on_them(spark):
    rows = captures(spark).cache()
    session = Session(rows, START, RULES)
    steps = [
        ("12", ["cut"]), ("target 10%", ["cut"]), ("sharpness 2", ["scores", "sizes", "cut"]), ("mode photos", ["cut"]), ("bursts looser", ["bursts", "scores", "sizes", "cut"]),
        ("start wildlife", ["scores", "sizes", "cut"]), ("diversity 0.3", ["vectors", "cut"]), ("burst-sharpness 0", ["scores", "sizes", "cut"]), ("diversity 0", ["cut"]), ("all", ["cut"]),
    ]
    assert session.selection().where("feedback_decision <> 'keep'").count() == 0
    assert session.built == ["measures", "bursts", "scores", "sizes", "cut"]
    for line, made in steps:
        session.built.clear()
        before = {r["path_key"] for r in session.selection().collect()}
        asked, changes = session.change(line)
        assert asked == "set" and session.built == made, line
        got = [r["path_key"] for r in session.selection().orderBy("portfolio_selection_order").collect()]
        assert got == fresh(rows, session.settings), line
        entered = [r["path_key"] for r in changes.where("change = 'entered'").collect()]
        assert set(entered) <= set(got) - before and len(entered) == min(20, len(set(got) - before))
    session.built.clear()
    session.change("target 12%")
    session.change("all")  # taken back
    assert session.built == ["cut"]
    session.close()


def test_a_changed_target_reads_one_narrow_table(spark):
    session = Session(captures(spark), replace(START, target="5"), RULES)
    session.selection()
    scores = session.table("scores")
    made = session._cut(replace(session.settings, target="7"), scores)
    assert "embedding" not in scores.columns and len(scores.inputFiles()) >= 1
    assert all("/top-" in f for f in made.inputFiles())  # the sorted pool, which came from the scores alone
    session.close()


def test_sessions_of_shared_vectors_write_scores_once(spark):
    s = replace(START, target="10%")
    plain = Session(captures(spark), s, RULES)
    named = views.captures(spark, f"{DATA}/sf0.001", named=True)
    mark = captures(spark).select("capture_id", "feedback_decision")
    session = Session(named.join(mark, "capture_id"), s, RULES, views.vectors(spark, f"{DATA}/sf0.001"))
    picks = lambda one: [r[:] for r in one.selection().orderBy("portfolio_selection_order").select("path_key", "burst_id", "composite_score").collect()]
    assert picks(session) == picks(plain) != []
    files = session.table("scores").inputFiles()
    assert len(files) >= 1 and len({f.rsplit("/", 2)[1] for f in files}) == 1
    assert len([t for t in storage.tables() if "/scores-" in t]) == 2  # one of each session
    session.change("diversity 0.4"), plain.change("diversity 0.4")
    assert {p for p, *_ in picks(session)} == {p for p, *_ in picks(plain)}
    session.close(), plain.close()
    assert not [t for t in storage.tables() if "/scores-" in t]


def test_commands():
    assert [command(line, START)[0] for line in ("", "  ", "help", "?", "SETTINGS", "show", "show me" if False else "show")] == ["export", "export", "help", "help", "settings", "show", "show"]
    assert command("Eyes 1.5", START)[1].profile.eye_weight == 1.5 and command("burst-sharpness 3", START)[1].profile.relative_focus_exponent == 3
    assert command("start portrait", command("eyes 2", START)[1])[1].profile == PROFILES["portrait"]
    assert command("12 %", START)[1].target == "12 %" and command("none", START)[1].target == "none"
    for bad in ("mode", "mode all", "bursts more", "start nothing", "diversity 2", "diversity nan", "diversity x", "eyes 4", "eyes -1", "eyes x", "eyes nan", "eyes 1 2", "colour 1", "target -3", "five", "101%"):
        with pytest.raises(ValueError):
            command(bad, START)
