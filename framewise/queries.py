"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions import files as ff
from framewise.functions import metadata, scoring, vectors
from framewise.operators import bursts, cache, explain, families, feedback, incremental, ordering, ranking, replan, selection
from framewise.operators.bursts import BurstRules
from framewise.operators.features import draft_box as box
from framewise.operators.features import tile_edges
from framewise.operators.store import EvaluationStore
from framewise.plans import views
from framewise.plans.views import CAPTURES, EXIF, FEEDBACK, FILES
from framewise.sinks import reports
from framewise.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Wide enough for the test tables' captures, which lie minutes apart.
RULES = BurstRules(600.0, 1800.0, 14, 0.1)
BALANCED = scoring.PROFILES["balanced"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- SQL parts -------------------------------------------------------------

_PERCENTILE = "(rank() OVER (ORDER BY greatest(0e0, focus_score)) + (count(*) OVER (PARTITION BY greatest(0e0, focus_score)) - 1) / 2e0) / count(*) OVER ()"
_SEQUENCE = r"CASE WHEN regexp_matches(sequence_number, '^\s*[+-]?\d+\s*$') THEN try_cast(sequence_number AS BIGINT) END"
_CAMERA = "CASE WHEN camera_serial <> '' AND p_serial <> '' THEN camera_serial = p_serial WHEN camera_model <> '' AND p_model <> '' THEN camera_model = p_model ELSE true END"


def _lagged() -> str:
    return f"""sequenced AS (SELECT *, {_SEQUENCE} AS sn FROM captures),
lagged AS (
  SELECT *, row_number() OVER w AS rn, lag(ts_us) OVER w AS p_ts, lag(camera_serial) OVER w AS p_serial, lag(camera_model) OVER w AS p_model,
    lag(phash) OVER w AS p_hash, lag(embedding) OVER w AS p_vec
  FROM sequenced WINDOW w AS (ORDER BY ts_us, sn NULLS LAST, CASE WHEN sn IS NULL THEN lower(sequence_number) END, path_key))"""


def _bursts(r: BurstRules) -> str:
    return f"""{_lagged()},
chained AS (
  SELECT *, sum(CASE WHEN p_ts IS NOT NULL AND ts_us - p_ts <= {round(r.window * 1e6)} AND {_CAMERA}
    AND (bit_count(xor(phash, p_hash)) <= {r.hash_bits} OR list_dot_product(embedding::DOUBLE[], p_vec::DOUBLE[]) >= {r.similarity}) THEN 0 ELSE 1 END) OVER (ORDER BY rn) AS chain FROM lagged),
starts(chain, s) AS (
  SELECT chain, min(ts_us) FROM chained GROUP BY chain
  UNION ALL SELECT c.chain, min(c.ts_us) FROM starts JOIN chained c ON c.chain = starts.chain AND c.ts_us > starts.s + {round(r.duration * 1e6)} GROUP BY c.chain),
grouped AS (SELECT c.*, dense_rank() OVER (ORDER BY c.chain, st.s) AS burst_id FROM chained c ASOF JOIN starts st ON c.chain = st.chain AND c.ts_us >= st.s)"""


def _scored(p: scoring.Profile, r: BurstRules | None) -> str:
    """Ends in the relation ``scored``."""
    if r is None:
        groups = "grouped AS (SELECT *, row_number() OVER (ORDER BY ts_us, path_key) AS burst_id FROM captures)"
    else:
        groups = _bursts(r)
    clamp = lambda x, w: f"pow(greatest(0e0, least(1e0, {x})), {float(w)!r}::DOUBLE)"
    return f"""{CAPTURES},
{groups},
sized AS (
  SELECT *, count(*) OVER (PARTITION BY burst_id) AS burst_size, CASE WHEN max(greatest(0e0, focus_score)) OVER (PARTITION BY burst_id) > 0
    THEN greatest(0e0, focus_score) / max(greatest(0e0, focus_score)) OVER (PARTITION BY burst_id) ELSE 1e0 END AS relative_focus_factor,
    {_PERCENTILE} AS focus_percentile FROM grouped),
multiplied AS (
  SELECT *, {clamp(f"{p.absolute_focus_floor!r}::DOUBLE + {1.0 - p.absolute_focus_floor!r}::DOUBLE * focus_percentile", p.absolute_focus_weight)} AS absolute_focus_multiplier,
    {clamp("relative_focus_factor", p.relative_focus_exponent)} AS relative_focus_multiplier, {clamp("musiq_score / 100e0", p.musiq_weight)} AS musiq_multiplier,
    {clamp("exposure_penalty", p.exposure_weight)} AS exposure_multiplier, {clamp("eye_factor", p.eye_weight)} AS eye_multiplier, {clamp("subject_integrity", p.subject_weight)} AS subject_multiplier
  FROM sized),
scored AS (
  SELECT *, pow(greatest(0e0, aesthetic_score), {p.aesthetic_weight!r}::DOUBLE) * {" * ".join(scoring.MULTIPLIERS)} AS composite_score FROM multiplied)"""


def _ranked(p: scoring.Profile, r: BurstRules | None) -> str:
    """Ends in the relation ``ranked``."""
    return f"""{_scored(p, r)},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY composite_score DESC, path_key) AS burst_rank,
    row_number() OVER (ORDER BY composite_score DESC, path_key) AS global_quality_rank FROM scored),
ranked AS (
  SELECT *, burst_rank = 1 AS burst_winner, CASE WHEN burst_rank = 1 THEN row_number() OVER (PARTITION BY burst_rank = 1 ORDER BY composite_score DESC, path_key) END AS selection_rank FROM placed)"""


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.captures(spark, sf_dir)


#: What only explanations and reports want of a capture; the steps write whole rows, so ranks go without.
_TOLD = ("file_path", "file_name", "blown_pct", "crushed_pct", "eye_warning")
#: What only bursts are made by.
_LOOKS = ("sequence_number", "camera_serial", "camera_model", "phash", "ts_us")


def _scores(spark: SparkSession, sf_dir: str, p: scoring.Profile = BALANCED, grouped: bool = True, told: tuple[str, ...] = (), numbered: bool = False) -> DataFrame:
    rows = views.captures(spark, sf_dir, named=True).drop(*(c for c in _TOLD if c not in told))
    return ranking.scored(rows, p, RULES, grouped, numbered, without=_LOOKS, vectors=views.vectors(spark, sf_dir))


# --- scores and ranks --------------------------------------------------------


@query(f"WITH {CAPTURES} SELECT capture_id, round({_PERCENTILE}, 6) AS focus_percentile FROM captures")
def focus_percentile(spark, sf_dir):
    return rounded(ranking.focus_percentile(_captures(spark, sf_dir), BALANCED).select("capture_id", "focus_percentile"), "focus_percentile")


def _multiplier_query(name: str) -> None:
    p = scoring.PROFILES[name]
    columns = ", ".join(f"round({m}, 6) AS {m}" for m in scoring.MULTIPLIERS)

    @query(f"WITH {_scored(p, None)} SELECT capture_id, {columns} FROM scored", name=f"score_multipliers_{name}")
    def run(spark, sf_dir):
        return rounded(_scores(spark, sf_dir, p, grouped=False).select("capture_id", *scoring.MULTIPLIERS), *scoring.MULTIPLIERS)


for _name in scoring.PROFILES:
    _multiplier_query(_name)


@query(f"WITH {_scored(BALANCED, None)} SELECT capture_id, burst_id, round(composite_score, 6) AS composite_score FROM scored")
def composite_ungrouped(spark, sf_dir):
    return rounded(_scores(spark, sf_dir, grouped=False, numbered=True).select("capture_id", "burst_id", "composite_score"), "composite_score")


@query(f"WITH {_ranked(BALANCED, None)} SELECT capture_id, global_quality_rank FROM ranked")
def global_rank_ungrouped(spark, sf_dir):
    scores = _scores(spark, sf_dir, grouped=False).select("capture_id", "path_key", "composite_score")
    return ranking.global_rank(scores).select("capture_id", "global_quality_rank")


def _burst_query(name: str, rules: BurstRules) -> None:
    @query(f"WITH RECURSIVE {CAPTURES}, {_bursts(rules)} SELECT capture_id, burst_id FROM grouped", name=name)
    def run(spark, sf_dir):
        looks = views.captures(spark, sf_dir, named=True).select("capture_id", "path_key", *_LOOKS, "vec_id")
        return bursts.group_bursts(looks, rules, (*_LOOKS, "path_key", "vec_id"), views.vectors(spark, sf_dir)).select("capture_id", "burst_id")


_burst_query("burst_groups", RULES)
_burst_query("burst_groups_looser", RULES.looser())
_burst_query("burst_groups_tighter", RULES.tighter())


@query(f"WITH RECURSIVE {_scored(BALANCED, RULES)} SELECT capture_id, burst_size, round(relative_focus_factor, 6) AS relative_focus_factor FROM scored")
def burst_stats(spark, sf_dir):
    rows = views.captures(spark, sf_dir, named=True).select("capture_id", "path_key", *_LOOKS, "focus_score", "vec_id")
    out = bursts.burst_stats(bursts.group_bursts(rows, RULES, (*_LOOKS, "path_key", "vec_id"), views.vectors(spark, sf_dir)))
    return rounded(out.select("capture_id", "burst_size", "relative_focus_factor"), "relative_focus_factor")


@query(f"WITH RECURSIVE {_scored(BALANCED, RULES)} SELECT capture_id, burst_id, round(composite_score, 6) AS composite_score FROM scored")
def burst_composite(spark, sf_dir):
    return rounded(_scores(spark, sf_dir).select("capture_id", "burst_id", "composite_score"), "composite_score")


@query(f"WITH RECURSIVE {_ranked(BALANCED, RULES)} SELECT capture_id, burst_rank, burst_winner FROM ranked")
def burst_ranks(spark, sf_dir):
    return ranking.burst_ranks(_scores(spark, sf_dir)).select("capture_id", "burst_rank", "burst_winner")


@query(f"WITH RECURSIVE {_ranked(BALANCED, RULES)} SELECT capture_id, global_quality_rank, selection_rank FROM ranked")
def selection_ranks(spark, sf_dir):
    rows = views.captures(spark, sf_dir, named=True).drop(*_TOLD)
    return ranking.evaluated(rows, BALANCED, RULES, without=_LOOKS, vectors=views.vectors(spark, sf_dir)).select("capture_id", "global_quality_rank", "selection_rank")


# --- expressions -------------------------------------------------------------


@query(f"WITH {CAPTURES}, {_lagged()} SELECT capture_id, bit_count(xor(phash, p_hash))::BIGINT AS bits FROM lagged")
def phash_distance(spark, sf_dir):
    rows, keys = bursts.in_capture_order(_captures(spark, sf_dir).select("capture_id", "phash", "ts_us", "sequence_number", "path_key"))
    near = ordering.Ordered(rows, *keys).lag({"p_hash": "phash"})
    return near.select("capture_id", vectors.hamming(F.col("phash"), F.col("p_hash")).cast("long").alias("bits"))


@query(f"WITH {CAPTURES}, {_lagged()} SELECT capture_id, round(list_dot_product(embedding::DOUBLE[], p_vec::DOUBLE[]), 6) AS cosine FROM lagged")
def adjacent_cosine(spark, sf_dir):
    rows, keys = bursts.in_capture_order(_captures(spark, sf_dir).select("capture_id", "embedding", "ts_us", "sequence_number", "path_key"))
    near = ordering.Ordered(rows, *keys).lag({"p_vec": "embedding"})
    return rounded(near.select("capture_id", vectors.dot(F.col("embedding"), F.col("p_vec")).alias("cosine")), "cosine")


@query(f"WITH {CAPTURES}, {_lagged()} SELECT capture_id, {_CAMERA} AS same FROM lagged WHERE p_ts IS NOT NULL")
def same_camera(spark, sf_dir):
    rows, keys = bursts.in_capture_order(_captures(spark, sf_dir).drop("embedding"))
    near = ordering.Ordered(rows, *keys).lag({"p_serial": "camera_serial", "p_model": "camera_model", "p_ts": "ts_us"})
    same = vectors.same_camera(F.col("camera_serial"), F.col("camera_model"), F.col("p_serial"), F.col("p_model"))
    return near.where("p_ts is not null").select("capture_id", same.alias("same"))


@query(f"WITH {CAPTURES}, {_lagged()} SELECT capture_id, rn AS place FROM lagged")
def sequence_order(spark, sf_dir):
    rows, keys = bursts.in_capture_order(_captures(spark, sf_dir).select("capture_id", "ts_us", "sequence_number", "path_key"))
    return ordering.Ordered(rows, *keys).row_number("place").select("capture_id", "place")


@query("""SELECT l_orderkey, l_linenumber, round(greatest(4e-1, 1e0 - 5e0 * greatest(0e0, l_discount::DOUBLE - 2e-2)) * greatest(6e-1, 1e0 - 2e0 * greatest(0e0, l_tax::DOUBLE - 5e-2)), 6) AS penalty FROM lineitem""")
def exposure_penalty(spark, sf_dir):
    value = scoring.exposure_penalty(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"))
    return rounded(views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("penalty")), "penalty")


_HEADS = "p AS (SELECT embedding AS pos FROM embeddings WHERE vec_id = 1), n AS (SELECT embedding AS neg FROM embeddings WHERE vec_id = 2)"


@query(f"""WITH {_HEADS} SELECT vec_id, round(5e-1 + 5e-1 / (1e0 + exp(-1e1 * (list_dot_product(embedding::DOUBLE[], pos::DOUBLE[]) - list_dot_product(embedding::DOUBLE[], neg::DOUBLE[])))), 6) AS subject_integrity FROM embeddings, p, n""")
def subject_integrity(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings")
    prompts = rows.where("vec_id in (1, 2)").groupBy().agg(F.max(F.when(F.col("vec_id") == 1, F.col("embedding"))).alias("positive"), F.max(F.when(F.col("vec_id") == 2, F.col("embedding"))).alias("negative"))
    made = cache.refresh_preset(rows, prompts.withColumn("preset", F.lit("wildlife")), "wildlife")
    return rounded(made.select("vec_id", "subject_integrity"), "subject_integrity")


_WEIGHTS = [((i * 7) % 11 - 5) / 10 for i in range(64)]


@query(f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_WEIGHTS}::DOUBLE[]) + 5e0, 6) AS aesthetic_score FROM embeddings")
def aesthetic_affine(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings")
    return rounded(rows.select("vec_id", vectors.affine(F.col("embedding"), _WEIGHTS, 5.0).alias("aesthetic_score")), "aesthetic_score")


@query("""SELECT event_id, CASE WHEN user_id % 4 > 0 AND event_id % 3 = 0 THEN 7e-1 ELSE 1e0 END AS eye_factor,
  CASE WHEN user_id % 4 = 0 THEN 'No face detected' WHEN event_id % 3 = 0 THEN 'Possible closed/obscured eyes' ELSE '' END AS eye_warning FROM events""")
def eye_factor_rule(spark, sf_dir):
    factor, warning = scoring.eye_rule(F.col("user_id") % 4, F.col("event_id") % 3)
    return views.table(spark, sf_dir, "events").select("event_id", factor.alias("eye_factor"), warning.alias("eye_warning"))


@query("SELECT p_partkey, upper(lpad(printf('%x', p_partkey * 2654435761), 16, '0')) AS hash, p_partkey * 2654435761 AS back FROM part")
def hash_hex(spark, sf_dir):
    text = vectors.hash_to_hex(F.col("p_partkey").cast("long") * F.lit(2654435761))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey"), F.upper(text).alias("hash"), vectors.hex_to_hash(text).alias("back"))


@query("""SELECT n, [(i * (n // 16) + least(i, n % 16))::BIGINT FOR i IN range(17)] AS edges FROM (SELECT DISTINCT 100 + event_id % 300 AS n FROM events)""")
def tile_bounds(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select((100 + F.col("event_id") % 300).alias("n")).distinct()
    return rows.select("n", tile_edges("n", 16).alias("edges"))


@query(f"""WITH {_ranked(BALANCED, None)} SELECT capture_id, CASE WHEN (global_quality_rank - 1) / n < 1e-1 THEN 5 WHEN (global_quality_rank - 1) / n < 4e-1 THEN 4 ELSE 3 END AS rating FROM (SELECT *, count(*) OVER ()::DOUBLE AS n FROM ranked)""")
def xmp_rating_band(spark, sf_dir):
    rows = ranking.global_rank(_scores(spark, sf_dir, grouped=False).select("capture_id", "path_key", "composite_score"))
    total = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(total)).select("capture_id", scoring.rating(F.col("global_quality_rank"), F.col("n")).alias("rating"))


# --- reasons ------------------------------------------------------------------

_FACTORS = "[pow(greatest(0e0, {0}.aesthetic_score), {1}::DOUBLE), {0}.absolute_focus_multiplier * {0}.relative_focus_multiplier, {0}.musiq_multiplier, {0}.exposure_multiplier, {0}.eye_multiplier, {0}.subject_multiplier]"


def _reasons(p: scoring.Profile) -> str:
    """Ends in the relation ``reasons``."""
    loss = "' (-' || printf('%.0f', 1e2 * (1e0 - {0}_multiplier)) || '%)'".format
    factors = lambda t: _FACTORS.format(t, repr(float(p.aesthetic_weight)))
    return f"""{_ranked(p, RULES)},
standing AS (
  SELECT *, {", ".join(f"((100 * (count(*) OVER () - rank() OVER (ORDER BY coalesce({f}, 0e0)) + 1) + count(*) OVER () - 1) // count(*) OVER ())::BIGINT AS top{i}, ((100 * (rank() OVER (ORDER BY coalesce({f}, 0e0)) - 1 + count(*) OVER (PARTITION BY coalesce({f}, 0e0))) + count(*) OVER () - 1) // count(*) OVER ())::BIGINT AS bottom{i}" for i, (_, f) in enumerate(explain.MEASURES))} FROM ranked),
topped AS (
  SELECT *, least(top0, top1, top2) AS top_percent, CASE least(top0, top1, top2) WHEN top0 THEN 0 WHEN top1 THEN 1 ELSE 2 END AS top_i FROM standing),
named AS (SELECT *, CASE WHEN top_percent <= 25 THEN top_i ELSE -1 END AS no FROM topped),
both_ AS (
  SELECT *, list_min([struct_pack(p := CASE WHEN no = 0 THEN 999 ELSE bottom0 END, i := 0), struct_pack(p := CASE WHEN no = 1 THEN 999 ELSE bottom1 END, i := 1), struct_pack(p := CASE WHEN no = 2 THEN 999 ELSE bottom2 END, i := 2)]) AS low FROM named),
stood AS (SELECT *, ['aesthetic', 'sharpness', 'technical quality'][top_i + 1] AS top_label, low.p AS bottom_percent, ['aesthetic', 'sharpness', 'technical quality'][low.i + 1] AS bottom_label FROM both_),
gaps AS (
  SELECT m.*, o.file_name AS other, o.composite_score AS other_score, {factors("m")} AS mine, {factors("o")} AS theirs
  FROM stood m LEFT JOIN ranked o ON o.burst_id = m.burst_id AND o.burst_rank = CASE WHEN m.burst_rank = 1 THEN 2 ELSE 1 END),
turned AS (SELECT *, CASE WHEN burst_rank = 1 THEN mine ELSE theirs END AS hi, CASE WHEN burst_rank = 1 THEN theirs ELSE mine END AS lo, greatest(composite_score, other_score) AS high, least(composite_score, other_score) AS low_score FROM gaps),
ratioed AS (
  SELECT *, 1e2 * (1e0 - low_score / high) AS percent, list_max([struct_pack(r := CASE WHEN lo[k] > 0 THEN hi[k] / lo[k] WHEN hi[k] > 0 THEN 'inf'::DOUBLE ELSE 1e0 END, i := -k) FOR k IN range(1, 7)]) AS best FROM turned),
texts AS (
  SELECT *, CASE WHEN low_score <= 0 THEN '100%' WHEN percent >= 99.5 THEN 'more than 99%' WHEN percent >= 1 THEN printf('%.0f', percent) || '%' ELSE 'less than 1%' END AS amount,
    CASE WHEN best.r > 1 THEN ', mainly on ' || ['aesthetic', 'sharpness', 'technical quality', 'exposure', 'eye check', 'subject check'][-best.i] ELSE '' END AS why,
    burst_rank::VARCHAR || CASE WHEN burst_rank % 100 BETWEEN 10 AND 20 THEN 'th' WHEN burst_rank % 10 = 1 THEN 'st' WHEN burst_rank % 10 = 2 THEN 'nd' WHEN burst_rank % 10 = 3 THEN 'rd' ELSE 'th' END || ' of ' || burst_size::VARCHAR || ' in burst; ' AS place
  FROM ratioed),
reasons AS (
  SELECT capture_id, top_percent, top_label, bottom_percent, bottom_label, CASE WHEN burst_size = 1 THEN NULL WHEN composite_score = other_score THEN NULL ELSE amount END AS amount,
    CASE WHEN burst_size > 1 AND composite_score <> other_score THEN why END AS why,
    concat_ws('; ', CASE WHEN burst_size = 1 THEN 'single shot'
      WHEN burst_rank = 1 AND composite_score = other_score THEN 'best of ' || burst_size::VARCHAR || ' in burst; ties ' || other || ' on score and wins on path order'
      WHEN burst_rank = 1 THEN 'best of ' || burst_size::VARCHAR || ' in burst; next best ' || other || ' scored ' || amount || ' lower' || why
      WHEN composite_score = other_score THEN place || 'ties ' || other || ' on score and loses on path order'
      ELSE place || 'scored ' || amount || ' lower than ' || other || why END,
    CASE WHEN top_percent <= 25 THEN top_label || ' in top ' || top_percent::VARCHAR || '% of all photos' END,
    CASE WHEN bottom_percent <= 25 THEN bottom_label || ' in bottom ' || bottom_percent::VARCHAR || '% of all photos' END,
    CASE WHEN exposure_multiplier <= 0.95 THEN 'clipping' || {loss("exposure")} || ': ' || printf('%.1f', blown_pct) || '% highlights blown, ' || printf('%.1f', crushed_pct) || '% shadows crushed' END,
    CASE WHEN eye_multiplier <= 0.95 THEN CASE WHEN eye_warning <> '' THEN lower(eye_warning[1]) || eye_warning[2:] ELSE 'eye check' END || {loss("eye")}
      WHEN eye_warning <> '' THEN lower(eye_warning[1]) || eye_warning[2:] END,
    CASE WHEN subject_multiplier <= 0.95 THEN 'weak subject check' || {loss("subject")} END) AS score_reason FROM texts)"""


@query(f"WITH RECURSIVE {_reasons(BALANCED)} SELECT capture_id, top_percent, top_label, bottom_percent, bottom_label FROM reasons")
def standing_percent(spark, sf_dir):
    return explain.standings(_captures(spark, sf_dir)).select("capture_id", "top_percent", "top_label", "bottom_percent", "bottom_label")


def _reason_query(name: str, p: scoring.Profile) -> None:
    @query(f"WITH RECURSIVE {_reasons(p)} SELECT capture_id, score_reason FROM reasons", name=name)
    def run(spark, sf_dir):
        ranked = ranking.burst_ranks(_scores(spark, sf_dir, p, told=_TOLD[1:])).drop("path_key")
        return explain.score_reasons(ranked, p.aesthetic_weight).select("capture_id", "score_reason")


_reason_query("score_reason", BALANCED)
_reason_query("score_reason_wildlife", scoring.PROFILES["wildlife"])
_reason_query("score_reason_portrait", scoring.PROFILES["portrait"])


# --- feedback, selection, validation -------------------------------------------


@query(f"WITH {FEEDBACK} SELECT capture_id, decision FROM feedback")
def feedback_last_wins(spark, sf_dir):
    rows = views.feedback_rows(spark, sf_dir).withColumn("file_path", F.col("capture_id").cast("string"))
    return feedback.decisions(rows).select(F.col("file_path").cast("long").alias("capture_id"), "decision")


def _with_feedback(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    rows = views.feedback_rows(spark, sf_dir).select("row_id", F.col("capture_id").cast("string").alias("file_path"), "decision")
    marks = feedback.decisions(rows).select(F.col("file_path").cast("long").alias("capture_id"), F.col("decision").alias("feedback_decision"))
    return df.join(marks, "capture_id", "left").withColumn("feedback_decision", F.coalesce("feedback_decision", F.lit("")))


_POOL = f"""{_ranked(BALANCED, RULES)}, {FEEDBACK},
marked AS (SELECT ranked.*, coalesce(decision, '') AS feedback_decision FROM ranked LEFT JOIN feedback USING (capture_id))"""


@query(f"WITH RECURSIVE {CAPTURES}, {FEEDBACK} SELECT coalesce(decision, '') AS feedback_decision, count(*) AS n FROM captures LEFT JOIN feedback USING (capture_id) GROUP BY 1")
def feedback_overlay(spark, sf_dir):
    return _with_feedback(spark, sf_dir, _captures(spark, sf_dir).drop("embedding")).groupBy("feedback_decision").agg(F.count("*").alias("n"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_feedback(spark, sf_dir, ranking.burst_ranks(_scores(spark, sf_dir)))


_NARROW = ("capture_id", "path_key", "composite_score", "feedback_decision")
_KEPT = "burst_winner OR feedback_decision = 'keep'"


@query(f"""WITH RECURSIVE {_POOL} SELECT capture_id, row_number() OVER (ORDER BY composite_score DESC, path_key) AS portfolio_selection_order FROM (SELECT * FROM marked WHERE ({_KEPT}) AND feedback_decision <> 'reject' ORDER BY composite_score DESC, path_key LIMIT 200)""")
def select_topk_bursts(spark, sf_dir):
    return selection.select_top(selection.pool_of(_marked(spark, sf_dir)).select(*_NARROW), 200).select("capture_id", "portfolio_selection_order")


@query(f"""WITH RECURSIVE {_POOL} SELECT capture_id, row_number() OVER (ORDER BY composite_score DESC, path_key) AS portfolio_selection_order FROM (SELECT *, row_number() OVER (ORDER BY feedback_decision = 'keep' DESC, composite_score DESC, path_key) AS k FROM marked WHERE feedback_decision <> 'reject') WHERE k <= 300 OR feedback_decision = 'keep'""")
def select_with_pins(spark, sf_dir):
    pool = selection.pool_of(_marked(spark, sf_dir), "photos").select(*_NARROW)
    return selection.select_top(pool, 300, F.col("feedback_decision") == "keep").select("capture_id", "portfolio_selection_order")


@query("SELECT o_orderkey, CASE WHEN base = 0 THEN 0 ELSE least(base, greatest(1, floor(base * pct / 1e2 + 5e-1)))::BIGINT END AS target FROM (SELECT o_orderkey, (o_orderkey * 13) % 2000 AS base, ((o_orderkey * 7) % 1000) / 1e1 AS pct FROM orders)")
def select_percent_target(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", ((k * 13) % 2000).cast("long").alias("base"), (((k * 7) % 1000) / F.lit(10.0)).alias("pct"))
    return rows.select("o_orderkey", selection.percent_target(F.col("base"), F.col("pct")).alias("target"))


_MMR = """WITH RECURSIVE c AS (
    SELECT vec_id AS id, embedding::DOUBLE[] AS v, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS q, row_number() OVER (ORDER BY key) AS place
    FROM (SELECT *, 1e0 + ((vec_id * 37) % 101) / 1e2 AS s, lpad(vec_id::VARCHAR, 9, '0') AS key FROM embeddings)),
  m AS (
    SELECT 0 AS k, []::BIGINT[] AS ids, []::DOUBLE[][] AS vs
    UNION ALL
    SELECT k + 1, list_append(ids, best.id), list_append(vs, best.v) FROM (
      SELECT any_value(k) AS k, any_value(ids) AS ids, any_value(vs) AS vs,
        arg_max(struct_pack(id := id, v := v), struct_pack(o := 7e-1 * q - 3e-1 * near, q := q, p := -place)) AS best
      FROM (SELECT m.k, m.ids, m.vs, c.*, coalesce(list_max([(list_cosine_similarity(c.v, x) + 1e0) / 2e0 FOR x IN m.vs]), 0e0) AS near FROM m, c WHERE m.k < 20 AND NOT list_contains(m.ids, c.id)) HAVING count(*) > 0))
  SELECT unnest(ids) AS vec_id, generate_subscripts(ids, 1)::BIGINT AS pick FROM m WHERE k = 20"""


@query(_MMR)
def select_mmr(spark, sf_dir):
    id_ = F.col("vec_id")
    pool = views.table(spark, sf_dir, "embeddings").select(F.lpad(id_.cast("string"), 9, "0").alias("path_key"), (F.lit(1.0) + ((id_ * 37) % 101) / F.lit(100.0)).alias("composite_score"), "embedding")
    return selection.select_diverse(pool, 20, 0.3).select(F.col("path_key").cast("long").alias("vec_id"), "pick")


_SELECTIONS = f"""{_ranked(BALANCED, None)},
other AS (SELECT *, row_number() OVER (ORDER BY aesthetic_score DESC, path_key) AS r2 FROM ranked)"""


@query(f"""WITH {_SELECTIONS} (SELECT 'entered' AS change, capture_id FROM other WHERE r2 <= 300 AND global_quality_rank > 300 ORDER BY aesthetic_score, path_key DESC LIMIT 20)
UNION ALL (SELECT 'left', capture_id FROM other WHERE global_quality_rank <= 300 AND r2 > 300 ORDER BY composite_score DESC, path_key LIMIT 20)""")
def selection_diff(spark, sf_dir):
    rows = _scores(spark, sf_dir, grouped=False).select("capture_id", "path_key", "composite_score", "aesthetic_score")
    before = selection.select_top(rows, 300)
    after = selection.select_top(rows.withColumn("composite_score", F.col("aesthetic_score")), 300)
    changed = selection.selection_changes(before, after)
    return changed.join(_captures(spark, sf_dir).select("path_key", "capture_id"), "path_key").select("change", "capture_id")


@query(f"""WITH RECURSIVE {_POOL}, cut AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, path_key) AS place FROM marked WHERE ({_KEPT}) AND feedback_decision <> 'reject')
(SELECT 'in' AS side, capture_id, place FROM cut WHERE place <= 150 AND feedback_decision <> 'keep' ORDER BY place DESC LIMIT 25) UNION ALL (SELECT 'out', capture_id, place FROM cut WHERE place > 150 ORDER BY place LIMIT 25)""")
def cut_boundary(spark, sf_dir):
    return selection.cut_boundary(selection.pool_of(_marked(spark, sf_dir)).select(*_NARROW), 150).select("side", "capture_id", "place")


@query(f"""WITH RECURSIVE {_ranked(BALANCED, RULES)}, firsts AS (SELECT burst_id, min(global_quality_rank) AS place FROM ranked WHERE burst_winner GROUP BY burst_id),
sizes AS (SELECT f.burst_id, place, n, sum(n) OVER (ORDER BY place) AS upto, row_number() OVER (ORDER BY place) AS grp FROM firsts f JOIN (SELECT burst_id, count(*) AS n FROM ranked GROUP BY burst_id) USING (burst_id))
SELECT capture_id, grp AS "group" FROM ranked JOIN sizes USING (burst_id) WHERE (upto <= 100 OR grp = 1) AND burst_rank <= 100""")
def review_groups(spark, sf_dir):
    ranked = ranking.global_rank(ranking.burst_ranks(_scores(spark, sf_dir)).select("capture_id", "path_key", "composite_score", "burst_id", "burst_rank", "burst_winner"))
    chosen = ranked.where("burst_winner").select("burst_id", F.col("global_quality_rank").alias("place"))
    return selection.review_groups(chosen, ranked, 100).select("capture_id", "group")


@query(f"""WITH {_ranked(BALANCED, None)}, {FEEDBACK}, f AS (SELECT r.*, coalesce(decision, '') AS d FROM ranked r LEFT JOIN feedback USING (capture_id)),
k AS (SELECT count(*) FILTER (d = 'keep') AS keeps, count(*) FILTER (d = 'reject') AS rejects, count(*) FILTER (d <> '') AS labeled, count(*) AS total, avg(global_quality_rank) FILTER (d = 'keep') AS mk, avg(global_quality_rank) FILTER (d = 'reject') AS mr FROM f)
SELECT total AS total_images, labeled AS labeled_images, keeps, rejects, round((SELECT count(*) FROM f, k WHERE d = 'keep' AND global_quality_rank <= keeps) / keeps, 6) AS precision_at_keep_count,
  round((SELECT count(*) FROM f a JOIN f b ON a.composite_score > b.composite_score WHERE a.d = 'keep' AND b.d = 'reject') / (keeps * rejects), 6) AS pairwise_accuracy, round(mk, 6) AS mean_keep_global_rank, round(mr, 6) AS mean_reject_global_rank FROM k""")
def validate_agreement(spark, sf_dir):
    ranked = ranking.global_rank(_scores(spark, sf_dir, grouped=False).select("capture_id", "composite_score", "path_key"))
    out = feedback.agreement(_with_feedback(spark, sf_dir, ranked))
    return rounded(out, "precision_at_keep_count", "pairwise_accuracy", "mean_keep_global_rank", "mean_reject_global_rank")


@query(f"""WITH {FILES}, paths AS (SELECT least((file_id - file_id % 3) % 5, 3) AS k, parent AS p FROM files), sizes AS (SELECT k, count(*) AS n FROM paths GROUP BY k),
above AS (SELECT k, array_to_string(string_split(p, '/')[1:d], '/') AS root FROM (SELECT k, p, unnest(range(1, len(string_split(p, '/')) + 1)) AS d FROM paths))
SELECT k, arg_max(root, length(root)) AS root FROM (SELECT k, root, count(*) AS n FROM above GROUP BY k, root) JOIN sizes USING (k, n) GROUP BY k""")
def common_root(spark, sf_dir):
    """Of each group of files: the longest folder that is above as many of them as there are."""
    rows = views.files(spark, sf_dir).withColumn("file_path", F.concat_ws("/", "parent", "name"))
    k = F.least((F.col("file_id") - F.col("file_id") % 3) % 5, F.lit(3))
    return feedback.common_root(rows.withColumn("k", k), by=("k",))


# --- files ----------------------------------------------------------------------

_SOURCE = r"regexp_matches(lower(name), '[^/]\.(" + "|".join(ff.IMAGE_EXTENSIONS) + r")$') AND NOT starts_with(name, '._') AND parent NOT LIKE '%/.Trash%' AND parent NOT LIKE '%/picks_20260909_120000%'"
_STEM = r"lower(regexp_replace(CASE WHEN name LIKE '%.xmp' THEN regexp_replace(name, '\.xmp$', '') ELSE name END, '\.(ARW|JPG)$', ''))"


@query(f"WITH {FILES} SELECT file_id FROM files WHERE {_SOURCE}")
def scan_supported_files(spark, sf_dir):
    return views.files(spark, sf_dir).where(ff.is_source_image(F.concat_ws("/", "parent", "name"))).select("file_id")


@query(f"WITH {FILES} SELECT file_id, {_STEM} AS stem FROM files")
def asset_stem(spark, sf_dir):
    return families.with_family(views.files(spark, sf_dir)).select("file_id", "stem")


def _primary_query(kind: str, first: str) -> None:
    @query(f"WITH {FILES} SELECT file_id FROM (SELECT *, row_number() OVER (PARTITION BY parent, {_STEM} ORDER BY name NOT LIKE '%{first}', lower(name), name) AS k FROM files WHERE {_SOURCE}) WHERE k = 1", name=f"primary_{kind}")
    def run(spark, sf_dir):
        found = views.files(spark, sf_dir).where(ff.is_source_image(F.concat_ws("/", "parent", "name")))
        return families.primaries(found, kind).select("file_id")


_primary_query("raw", ".ARW")
_primary_query("jpeg", ".JPG")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.files(spark, sf_dir)
    return families.export_plan(rows.where("file_id % 7 = 1").select("parent", "name"), rows)


_PLAN = f"{FILES}, fam AS (SELECT *, {_STEM} AS stem FROM files), plan AS (SELECT DISTINCT f.parent || '/' || f.name AS source, ltrim(f.parent || '/' || f.name, '/') AS destination, lower(f.parent || '/' || f.name) AS destination_key, f.size_bytes FROM fam f JOIN (SELECT DISTINCT parent, stem FROM fam WHERE file_id % 7 = 1) USING (parent, stem))"


@query(f"WITH {_PLAN} SELECT source, destination, size_bytes FROM plan")
def export_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("source", "destination", "size_bytes")


@query(f"WITH {_PLAN} SELECT count(*) AS n_files, sum(size_bytes)::BIGINT AS n_bytes FROM plan")
def family_totals(spark, sf_dir):
    return families.family_totals(_plan(spark, sf_dir))


@query(f"WITH {FILES} SELECT lower(p) AS destination_key, count(DISTINCT p) AS n_sources FROM (SELECT parent || '/' || CASE WHEN file_id % 10 = 0 THEN lower(name) ELSE name END AS p FROM files UNION SELECT parent || '/' || name FROM files) GROUP BY 1 HAVING count(DISTINCT p) > 1")
def export_collisions(spark, sf_dir):
    rows = views.files(spark, sf_dir)
    odd = rows.select(F.concat_ws("/", "parent", F.when(F.col("file_id") % 10 == 0, F.lower("name")).otherwise(F.col("name"))).alias("source"))
    every = odd.union(rows.select(F.concat_ws("/", "parent", "name")))
    return families.collisions(every.withColumn("destination_key", ff.casefold("source")))


@query(f"WITH {_PLAN}, rated AS (SELECT destination || CASE WHEN size_bytes % 2 = 0 THEN '' ELSE '.new' END AS destination FROM plan WHERE destination LIKE '%.xmp') SELECT coalesce(p.destination, r.destination) AS destination, coalesce(size_bytes, 0) AS source_size_bytes, CASE WHEN p.source IS NULL THEN 'generated_xmp' WHEN r.destination IS NOT NULL THEN 'copied_and_rated' ELSE 'copied' END AS kind FROM plan p FULL JOIN rated r ON p.destination = r.destination")
def export_manifest(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    rated = plan.where("destination like '%.xmp'").select(F.concat("destination", F.when(F.col("size_bytes") % 2 == 0, "").otherwise(".new")).alias("destination"))
    return families.manifest(plan, rated).select("destination", "source_size_bytes", "kind")


@query(f"WITH {FILES} SELECT parent, {_STEM} AS stem, arg_min(name, struct_pack(a := length(name), b := lower(name), c := name)) AS sidecar FROM files WHERE name LIKE '%.xmp' GROUP BY 1, 2")
def sidecar_choice(spark, sf_dir):
    return families.sidecars(views.files(spark, sf_dir))


# --- cache ------------------------------------------------------------------------


@query("""WITH b AS (SELECT event_id, event_id % 13 = 0 AS old, event_id % 11 = 0 AS stale FROM events WHERE event_id % 3 <> 0)
SELECT e.event_id AS capture_id, CASE WHEN b.event_id IS NULL OR b.old OR b.stale THEN 'miss' WHEN e.event_id % 2 = 0 THEN 'hit' ELSE 'preset' END AS route FROM events e LEFT JOIN b USING (event_id)""")
def cache_route(spark, sf_dir):
    base, presets = views.cache(spark, sf_dir)
    id_ = F.col("event_id")
    candidates = views.table(spark, sf_dir, "events").select(id_.alias("capture_id"), F.concat(F.lit("d/"), id_.cast("string")).alias("relative_path"), (F.lit(1000) + id_).alias("size_bytes"), (id_ * 7).alias("modified_ns"))
    return cache.route(candidates, base.drop("capture_id"), presets, "algorithm=5", "wildlife").select("capture_id", "route")


@query("SELECT user_id AS relative_path, event_type AS pipeline_signature, arg_max(value, event_id) AS focus_score FROM events GROUP BY 1, 2")
def cache_latest(spark, sf_dir):
    log = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("relative_path"), F.col("event_type").alias("pipeline_signature"), F.col("value").alias("focus_score"), F.col("event_id").alias("written_at"))
    return cache.latest(log).select("relative_path", "pipeline_signature", "focus_score")


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    preset = F.element_at(F.array(F.lit("wildlife"), F.lit("portrait"), F.lit("landscape")), (id_ % 3 + 1).cast("int"))
    text = F.when(id_ % 4 == 0, "algorithm=5;max_dim=1024").otherwise(F.concat(F.lit("algorithm=5;preset="), preset, F.lit(";max_dim=1024")))
    return views.table(spark, sf_dir, "events").select(F.concat(F.lit("d/"), (id_ % 400).cast("string")).alias("relative_path"), text.alias("pipeline_signature"), F.col("value").alias("focus_score"), ((id_ % 50) / F.lit(50.0)).alias("subject_integrity"), id_.alias("row_id"))


@query("SELECT DISTINCT 'algorithm=5;max_dim=1024' AS signature, CASE WHEN event_id % 4 = 0 THEN '' ELSE ['wildlife', 'portrait', 'landscape'][event_id % 3 + 1] END AS preset FROM events")
def signature_strip(spark, sf_dir):
    plain, preset = ff.strip_preset(F.col("pipeline_signature"))
    return _legacy(spark, sf_dir).select(plain.alias("signature"), preset.alias("preset")).distinct()


@query("""SELECT 'd/' || (event_id % 400)::VARCHAR AS relative_path, '' AS preset, arg_max(value, event_id) AS score FROM events GROUP BY 1
UNION ALL SELECT 'd/' || (event_id % 400)::VARCHAR, ['wildlife', 'portrait', 'landscape'][event_id % 3 + 1], round(arg_max((event_id % 50) / 5e1, event_id), 6) FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2""")
def cache_migrate(spark, sf_dir):
    base, presets = cache.migrate(_legacy(spark, sf_dir))
    return base.select("relative_path", F.lit("").alias("preset"), F.col("focus_score").alias("score")).union(presets.select("relative_path", "preset", F.round("subject_integrity", 6)))


@query("""SELECT '/c/' || (event_id % 97)::VARCHAR AS key, 'algorithm=' || (event_id % 2)::VARCHAR AS signature, arg_max(value, event_id) AS focus_score
FROM events WHERE event_id % 4 <> 3 GROUP BY event_id % 97, event_id % 2""")
def cache_rekeyed(spark, sf_dir):
    id_ = F.col("event_id")
    path = F.concat(F.when(id_ % 4 == 3, "/elsewhere/c/").otherwise("/root//c/"), (id_ % 97).cast("string"))
    legacy = views.table(spark, sf_dir, "events").select(
        F.regexp_replace(path, "//", "/").alias("file_path"), F.concat(F.lit("algorithm="), (id_ % 2).cast("string"), F.when(id_ % 3 == 0, ";preset=portrait").otherwise("")).alias("pipeline_signature"),
        F.col("value").alias("focus_score"), F.lit(1.0).alias("subject_integrity"), id_.alias("row_id"),
    )
    base, _ = cache.migrate(legacy, root="/root")
    return base.select(F.concat(F.lit("/"), "relative_path").alias("key"), F.col("pipeline_signature").alias("signature"), "focus_score")


# --- incremental runs -------------------------------------------------------------------


def _run(spark: SparkSession, sf_dir: str, mode: str) -> incremental.Run:
    """The kept rows of :func:`views.cache`, a model that fails on some rows, and files that change meanwhile."""
    base, presets = views.cache(spark, sf_dir)
    id_ = F.col("event_id")
    files = views.table(spark, sf_dir, "events").select(
        id_.alias("capture_id"), F.concat(F.lit("/r/d/"), id_.cast("string")).alias("file_path"), F.concat(F.lit("d/"), id_.cast("string")).alias("relative_path"),
        (F.lit(1000) + id_).alias("size_bytes"), (id_ * 7).alias("modified_ns"),
    )
    base = base.withColumn("focus_score", F.col("capture_id") * 0.5).drop("capture_id")
    presets = presets.withColumn("subject_integrity", F.lit(0.9))
    error = F.when(F.col("capture_id") % 17 == 0, "ValueError: no picture")
    evaluate = lambda rows: rows.withColumns({"focus_score": F.col("capture_id") * 2.0, "subject_integrity": F.lit(0.7), "error": error})
    refresh = lambda rows: rows.withColumn("subject_integrity", F.lit(0.8))
    rescan = files.where("capture_id % 19 <> 0").withColumn("modified_ns", F.col("modified_ns") + F.when(F.col("capture_id") % 23 == 0, 1).otherwise(0))
    return incremental.run(files, base, presets, "algorithm=5", "wildlife", evaluate, refresh, rescan, mode=mode)


_ROUTED = """kept AS (SELECT event_id, event_id % 3 <> 0 AND event_id % 13 <> 0 AND event_id % 11 <> 0 AND {0} AS base, event_id % 2 = 0 AS preset FROM events),
ways AS (SELECT event_id, CASE WHEN NOT base THEN 'miss' WHEN preset THEN 'hit' ELSE 'preset' END AS route FROM kept),
told AS (SELECT event_id, route, CASE WHEN route <> 'miss' THEN NULL WHEN event_id % 17 = 0 THEN 'ValueError' WHEN event_id % 19 = 0 OR event_id % 23 = 0 THEN 'RuntimeError' END AS error FROM ways)"""


def _run_queries(mode: str, known: str) -> None:
    ways = _ROUTED.format(known)

    @query(f"""WITH {ways} SELECT event_id AS capture_id, route <> 'miss' AS cache_hit, event_id * CASE WHEN route = 'miss' THEN 2e0 ELSE 5e-1 END AS focus_score,
  CASE route WHEN 'hit' THEN 9e-1 WHEN 'preset' THEN 8e-1 ELSE 7e-1 END AS subject_integrity FROM told WHERE error IS NULL""", name=f"incremental_records_{mode}")  # fmt: skip
    def records(spark, sf_dir):
        return _run(spark, sf_dir, mode).records.select("capture_id", "cache_hit", "focus_score", "subject_integrity")

    @query(f"""WITH {ways} SELECT count(*) AS discovered, count(*) FILTER (route <> 'miss') AS cached, count(*) FILTER (route = 'preset') AS refreshed,
  count(*) FILTER (route = 'miss' AND error IS NULL) AS evaluated, count(error) AS failed FROM told""", name=f"phase_counts_{mode}")
    def counts(spark, sf_dir):
        return incremental.phase_counts(_run(spark, sf_dir, mode))


_run_queries("use", "true")
_run_queries("refresh", "false")
_run_queries("none", "false")


@query(f"""WITH {_ROUTED.format("true")} SELECT '/r/d/' || event_id::VARCHAR AS file_path, CASE error WHEN 'ValueError' THEN 'evaluation' ELSE 'checkpoint' END AS stage, error AS error_type,
  CASE error WHEN 'ValueError' THEN 'no picture' ELSE 'File changed while it was being evaluated' END AS message FROM told WHERE error IS NOT NULL""")
def incremental_failures(spark, sf_dir):
    return reports.report_rows(_run(spark, sf_dir, "use").failures, reports.FAILURE_COLUMNS)


@query("""SELECT event_id AS capture_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 0 THEN 'T' || (event_id % 5)::VARCHAR ELSE 'E' || (event_id % 7)::VARCHAR END AS camera_model,
  CASE WHEN event_id % 3 = 0 THEN event_id * 2 ELSE event_id END AS ts_us FROM events""")
def tags_over_embedded(spark, sf_dir):
    id_ = F.col("event_id")
    rows = views.table(spark, sf_dir, "events").select(id_.alias("capture_id"), F.concat(F.lit("/r/"), id_.cast("string")).alias("file_path"), F.concat(F.lit("E"), (id_ % 7).cast("string")).alias("camera_model"), id_.alias("ts_us"))
    tags = rows.where("capture_id % 3 = 0").select("file_path", F.when(F.col("capture_id") % 4 == 0, "").otherwise(F.concat(F.lit("T"), (F.col("capture_id") % 5).cast("string"))).alias("camera_model"), (F.col("capture_id") * 2).alias("ts_us"))
    return incremental.with_tags(rows, tags, "camera_model", "ts_us").select("capture_id", "camera_model", "ts_us")


@query(f"WITH {FILES} SELECT file_id FROM (SELECT *, row_number() OVER (PARTITION BY parent, {_STEM} ORDER BY (file_id * 37) % 101, name) AS k FROM files) WHERE k = 1")
def rated_families(spark, sf_dir):
    return families.rated_families(views.files(spark, sf_dir).withColumn("rank", (F.col("file_id") * 37) % 101)).select("file_id")


@query("""SELECT event_id, CASE WHEN w <= 0 OR h <= 0 THEN 1024 WHEN w >= h THEN 1024 ELSE greatest(1, round_even(1024e0 * w / h, 0)::INT) END AS box_width,
  CASE WHEN w <= 0 OR h <= 0 THEN 1024 WHEN w >= h THEN greatest(1, round_even(1024e0 * h / w, 0)::INT) ELSE 1024 END AS box_height FROM (SELECT event_id, (event_id * 7) % 6000 AS w, (event_id * 11) % 4500 AS h FROM events)""")
def draft_box(spark, sf_dir):
    id_ = F.col("event_id")
    made = box((id_ * 7) % 6000, (id_ * 11) % 4500, 1024)
    return views.table(spark, sf_dir, "events").select("event_id", made["width"].alias("box_width"), made["height"].alias("box_height"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024e0) || ' KiB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576e0) || ' MiB' ELSE printf('%.1f', n / 1073741824e0) || ' GiB' END AS size,
  CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h ' || (s // 60 % 60)::VARCHAR || 'm' WHEN s >= 60 THEN (s // 60)::VARCHAR || 'm ' || (s % 60)::VARCHAR || 's' ELSE s::VARCHAR || 's' END AS took
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 2000 WHEN 1 THEN (o_orderkey % 5000) * 205 WHEN 2 THEN (o_orderkey % 9999) * 104858 ELSE (o_orderkey % 9999) * 1073742 END AS n, greatest(0, round_even(o_orderkey % 9000 / 2e0 - 10, 0)::BIGINT) AS s FROM orders)""")
def size_and_duration_text(spark, sf_dir):
    k = F.col("o_orderkey")
    n = F.when(k % 4 == 0, k % 2000).when(k % 4 == 1, (k % 5000) * 205).when(k % 4 == 2, (k % 9999) * 104858).otherwise((k % 9999) * 1073742)
    return views.table(spark, sf_dir, "orders").select("o_orderkey", ff.byte_text(n).alias("size"), ff.duration_text((k % 9000) / F.lit(2.0) - 10).alias("took"))


# --- sessions ------------------------------------------------------------------------

_REPLANNED = replan.Settings(scoring.PROFILES["wildlife"].with_weights(sharpness=2.0), "looser", "photos", "12.5%")


def _session(spark: SparkSession, sf_dir: str, *lines: str) -> replan.Session:
    """A session in which these lines were typed, from balanced settings."""
    session = replan.Session(views.captures(spark, sf_dir, named=True), replan.Settings(BALANCED, target="40"), RULES, views.vectors(spark, sf_dir))
    for line in lines:
        session.change(line)
    return session


@query(f"""WITH RECURSIVE {_ranked(_REPLANNED.profile, RULES.looser())} SELECT capture_id, row_number() OVER (ORDER BY composite_score DESC, path_key) AS place, burst_id FROM ranked
QUALIFY place <= floor((SELECT count(*) FROM ranked) * 125e-3 + 5e-1)""")
def replan_selection(spark, sf_dir):
    """A selection after five changes, each made from the tables that it leaves as they are."""
    session = _session(spark, sf_dir, "start wildlife", "bursts looser", "mode photos", "sharpness 2", "12.5%")
    name = F.regexp_extract("file_path", r"IMG_0*(\d+)", 1).cast("long")
    return session.selection().select(name.alias("capture_id"), F.col("portfolio_selection_order").alias("place"), "burst_id")


@query(f"""WITH RECURSIVE {_ranked(BALANCED, RULES)}, winners AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, path_key) AS k FROM ranked WHERE burst_winner)
SELECT 'entered' AS change, path_key, round(composite_score, 6) AS composite_score FROM winners WHERE k BETWEEN 41 AND 55""")
def replan_changes(spark, sf_dir):
    _, changes = _session(spark, sf_dir).change("target 55")
    return rounded(changes, "composite_score")


@query(f"""WITH RECURSIVE {_POOL}, n AS (SELECT count(*) AS base, CAST(floor(count(*) * 125e-3 + 5e-1) AS BIGINT) AS requested FROM marked),
pinned_first AS (SELECT *, row_number() OVER (ORDER BY feedback_decision = 'keep' DESC, composite_score DESC, path_key) AS k FROM marked WHERE feedback_decision <> 'reject'),
chosen AS (SELECT * FROM pinned_first, n WHERE k <= requested OR feedback_decision = 'keep')
SELECT base AS photos, base, requested, false AS capped, count(*) AS selected, count(*) FILTER (feedback_decision = 'keep') AS keeps, round(min(composite_score) FILTER (feedback_decision <> 'keep'), 6) AS lowest_score,
  concat_ws('; ', CASE WHEN count(*) FILTER (feedback_decision = 'keep') > requested THEN count(*) FILTER (feedback_decision = 'keep') || ' pinned, more than the target; all are chosen' END, CASE WHEN count(*) < requested THEN count(*) || ' are left after rejections' END) AS notes
FROM chosen GROUP BY base, requested""")
def selection_summary(spark, sf_dir):
    """What a session tells of its selection, with the lowest score that was chosen."""
    captures = _with_feedback(spark, sf_dir, views.captures(spark, sf_dir, named=True))
    session = replan.Session(captures, replan.Settings(BALANCED, mode="photos", target="12.5%"), RULES, views.vectors(spark, sf_dir))
    return rounded(session.summary(), "lowest_score").withColumn("notes", F.array_join("notes", "; "))


# --- the store of kept rows -----------------------------------------------------------

_STORE = ("relative_path string, pipeline_signature string, size_bytes long, modified_ns long, focus_score double", "relative_path string, pipeline_signature string, preset string, subject_integrity double")


def _new_store(spark: SparkSession, buckets: int = 8) -> EvaluationStore:
    return EvaluationStore(spark, f"{shared_dir(spark)}/framewise/store-{uuid.uuid4().hex}", *_STORE, buckets=buckets)


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    return views.table(spark, sf_dir, "events").select(
        id_.alias("capture_id"), F.concat(F.lit("/r/d/"), id_.cast("string")).alias("file_path"), F.concat(F.lit("d/"), id_.cast("string")).alias("relative_path"),
        (F.lit(1000) + id_).alias("size_bytes"), (id_ * 7).alias("modified_ns"),
    )


@query("""SELECT event_id AS capture_id, event_id % 4 < 2 AS cache_hit, event_id * CASE WHEN event_id % 4 < 2 THEN 2e0 ELSE 3e0 END AS focus_score FROM events WHERE event_id % 17 <> 0""")
def cache_resumed(spark, sf_dir):
    """A run in four batches that ends after two, and one by another model that takes it up."""
    photos, store = _photos(spark, sf_dir), _new_store(spark)
    error = F.when(F.col("capture_id") % 17 == 0, "ValueError: no picture")
    model = lambda factor: lambda rows: rows.withColumns({"focus_score": F.col("capture_id") * factor, "subject_integrity": F.lit(0.7), "error": error})
    batch = F.col("capture_id") % 4
    store.evaluate(photos.where("capture_id % 4 < 2"), "s", "p", model(2.0), lambda rows: rows, photos, batch, 2)
    runs = store.evaluate(photos, "s", "p", model(3.0), lambda rows: rows, photos, batch, 4)
    return reduce(DataFrame.union, (r.records.select("capture_id", "cache_hit", "focus_score") for r in runs))


def _versions(spark: SparkSession, sf_dir: str) -> EvaluationStore:
    """Three batches of rows, of which each supersedes some; the first two are settled."""
    store, rows = _new_store(spark), views.table(spark, sf_dir, "events")
    for i in range(3):
        some = rows.where(F.col("event_id") % 3 <= 2 - i).select(
            F.concat(F.lit("d/"), F.col("event_id").cast("string")).alias("relative_path"), F.when(F.col("event_id") % 5 == 0, "t").otherwise("s").alias("pipeline_signature"),
            (F.lit(1000) + F.col("event_id")).alias("size_bytes"), (F.col("event_id") * 7).alias("modified_ns"), (F.col("value") + i).alias("focus_score"), F.lit("p").alias("preset"), F.lit(0.5 + i).alias("subject_integrity"),
        )
        store.commit(some, some.where("modified_ns % 2 = 0"))
        if i == 1:
            store.settle()
    return store


@query("""SELECT 'd/' || event_id::VARCHAR AS relative_path, CASE WHEN event_id % 5 = 0 THEN 't' ELSE 's' END AS pipeline_signature, round(value + 2 - event_id % 3, 6) AS focus_score,
  CASE WHEN event_id % 2 = 0 THEN 2.5e0 - event_id % 3 END AS subject_integrity FROM events""")
def cache_compacted(spark, sf_dir):
    store = _versions(spark, sf_dir)
    store.settle()
    store.forget()
    return rounded(store.rows("base").join(store.rows("presets").drop("preset"), ["relative_path", "pipeline_signature"], "left").select("relative_path", "pipeline_signature", "focus_score", "subject_integrity"), "focus_score")


@query("""SELECT event_id AS capture_id, CASE WHEN event_id % 5 = 0 OR event_id % 11 = 0 THEN 'miss' WHEN event_id % 2 = 0 THEN 'hit' ELSE 'preset' END AS route,
  CASE WHEN event_id % 5 <> 0 AND event_id % 11 <> 0 THEN round(value + 2 - event_id % 3, 6) END AS focus_score FROM events""")
def cache_lookup(spark, sf_dir):
    photos = _photos(spark, sf_dir).withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("capture_id") % 11 == 0, 1).otherwise(0))
    found = _versions(spark, sf_dir).known(photos, "s", "p")
    return rounded(found.select("capture_id", "route", F.col("_kept.focus_score").alias("focus_score")), "focus_score")


# --- metadata -----------------------------------------------------------------------

_TIME = r"""CASE WHEN {0} = '' OR try_cast(substr({0}, 1, 4) || '-' || substr({0}, 6, 2) || '-' || substr({0}, 9, 11) AS TIMESTAMP) IS NULL THEN NULL
  ELSE epoch_us(try_cast(substr({0}, 1, 4) || '-' || substr({0}, 6, 2) || '-' || substr({0}, 9, 11) AS TIMESTAMP))
    + rpad(coalesce(nullif(regexp_extract({0}, '\.(\d+)', 1), ''), {1})[:6], 6, '0')::BIGINT
    - CASE WHEN {0} LIKE '%+05:30' THEN 330 WHEN {0} LIKE '%-0400' THEN -240 WHEN {0} LIKE '%Z' THEN 0 WHEN {2} <> '' THEN -240 ELSE 0 END * 60000000::BIGINT END"""
_TIMES = f"""{EXIF}, times AS (SELECT *, {_TIME.format("original", "subsec", "off")} AS t1, {_TIME.format("created", "''", "''")} AS t2 FROM exif),
chosen AS (SELECT *, coalesce(t1, t2, modified_us) AS micros, CASE WHEN t1 IS NOT NULL THEN 'DateTimeOriginal' WHEN t2 IS NOT NULL THEN 'CreateDate' ELSE 'filesystem_mtime' END AS source,
  CASE WHEN t1 IS NOT NULL AND (original LIKE '%Z' OR original LIKE '%+05:30' OR original LIKE '%-0400' OR off <> '') THEN 'embedded_offset' ELSE 'system_local_assumption' END AS zone_source FROM times)"""


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.exif(spark, sf_dir)
    t = lambda k: F.col("tags")[k]
    first = metadata.capture_time(t("DateTimeOriginal"), t("SubSec"), t("Offset"))
    second = metadata.capture_time(t("CreateDate"))
    return rows.withColumn("time", metadata.first_time([("DateTimeOriginal", first), ("CreateDate", second)], F.col("modified_us")))


@query(f"WITH {_TIMES} SELECT capture_id, t1 AS micros FROM times")
def timestamp_parse(spark, sf_dir):
    found = metadata.capture_time(F.col("tags")["DateTimeOriginal"], F.col("tags")["SubSec"], F.col("tags")["Offset"])
    return views.exif(spark, sf_dir).select("capture_id", found.micros.alias("micros"))


@query(f"WITH {_TIMES} SELECT capture_id, micros, source, CASE WHEN model <> '' THEN model ELSE 'M2' END AS camera_model, serial AS camera_serial, image_number AS sequence_number, '' AS autofocus_info FROM chosen")
def metadata_coalesce(spark, sf_dir):
    return _times(spark, sf_dir).select("capture_id", "time.micros", "time.source", *(c.alias(n) for n, c in metadata.camera_columns(F.col("tags")).items()))


@query(f"WITH {_TIMES} SELECT source, zone_source, count(*) AS n FROM chosen GROUP BY 1, 2")
def timestamp_provenance(spark, sf_dir):
    return _times(spark, sf_dir).groupBy("time.source", "time.zone_source").agg(F.count("*").alias("n"))


# --- reports --------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN '''' ELSE '' END || ['=', '+', '-', '@', ''][c_custkey % 5 + 1] || c_name AS text FROM customer")
def csv_escape(spark, sf_dir):
    k = F.col("c_custkey")
    start = F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", ""))), (k % 5 + 1).cast("int"))
    return views.table(spark, sf_dir, "customer").select(k, ff.csv_safe(F.concat(start, "c_name")).alias("text"))


@query(f"""WITH RECURSIVE {_ranked(BALANCED, RULES)} SELECT file_path, global_quality_rank, selection_rank, burst_rank, burst_id, burst_size, burst_winner, round(composite_score, 6) AS composite_score,
  strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp_utc, '' || camera_model AS camera_model FROM ranked""")
def evaluation_report(spark, sf_dir):
    rows = views.captures(spark, sf_dir, named=True).drop(*_TOLD[1:])
    rows = ranking.evaluated(rows, BALANCED, RULES, without=("sequence_number", "camera_serial", "phash"), vectors=views.vectors(spark, sf_dir)).withColumn("tz_offset_minutes", F.lit(0))
    report = reports.report_rows(reports.iso_times(rows))
    return rounded(report.select("file_path", "global_quality_rank", "selection_rank", "burst_rank", "burst_id", "burst_size", "burst_winner", "composite_score", "timestamp_utc", "camera_model"), "composite_score")


@query(f"WITH {_ranked(BALANCED, None)} SELECT file_path, CASE WHEN global_quality_rank <= 50 THEN 'keep' ELSE '' END AS decision, global_quality_rank FROM ranked")
def feedback_template(spark, sf_dir):
    rows = ranking.global_rank(_scores(spark, sf_dir, grouped=False, told=("file_path",)).select("file_path", "path_key", "composite_score")).withColumns({"portfolio_selected": F.col("global_quality_rank") <= 50, "selection_rank": F.col("global_quality_rank")})
    return reports.feedback_template(rows).select("file_path", "decision", "global_quality_rank")


@query(f"WITH {FILES} SELECT file_id, substr(sha256(parent[2:] || '/' || name || '|' || size_bytes || '|' || modified_ns || '|2048'), 1, 32) AS key FROM files")
def thumbnail_key(spark, sf_dir):
    path = ff.relative_key(F.concat_ws("/", "parent", "name"), "/")
    return views.files(spark, sf_dir).select("file_id", ff.thumbnail_key(path, F.col("size_bytes"), F.col("modified_ns")).alias("key"))


@query(f"WITH {FILES} SELECT file_id FROM (SELECT *, row_number() OVER (ORDER BY modified_ns DESC, name) AS k FROM files) WHERE k > 150")
def thumbnail_prune(spark, sf_dir):
    rows = views.files(spark, sf_dir)
    return ordering.Ordered(rows, F.desc("modified_ns"), "name", "parent").row_number("k").where("k > 150").select("file_id")


@query("SELECT event_type AS stage, round(sum(value), 3) AS seconds, count(*) AS n FROM events GROUP BY 1")
def stage_costs(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return reports.stage_costs(rows).withColumn("seconds", F.round("seconds", 3))
