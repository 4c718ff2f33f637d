"""Queries over charts: metrics, scoring, comparison and corpus reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions import scalars as S
from beatloom.operators import compare as C
from beatloom.operators import corpus as P
from beatloom.operators import evaluation as X
from beatloom.operators import metrics as M
from beatloom.plans import views as V
from beatloom.plans.registry import WITH, query, r6
from beatloom.session import cut


def nm(spark, sf):
    return V.notes_base(spark, sf), short_measures(spark, sf)


def short_measures(spark, sf):
    """Measures up to bar 29 for some charts, so that late notes belong to no measure."""
    return V.measures(spark, sf).where((F.col("chart_id") % 3 != 0) | (F.col("bar_index") < 30))


WITH["ms"] = "SELECT * FROM measures WHERE chart_id % 3 <> 0 OR bar_index < 30"
WITH["in_bar"] = "SELECT n.*, m.bar_index FROM notes_a n LEFT JOIN ms m ON n.chart_id = m.chart_id AND n.beat_index >= m.start_beat_index AND n.beat_index < m.start_beat_index + m.beat_count"
WITH["nc"] = "SELECT chart_id, count(*) AS note_count FROM notes_a GROUP BY 1"
WITH["mc"] = "SELECT chart_id, count(*) AS measure_count FROM ms GROUP BY 1"
WITH["lu"] = "SELECT chart_id, lane, count(*) AS n FROM notes_a GROUP BY ALL"


@query("a01_note_counts", "SELECT chart_id, note_count, measure_count, round(note_count/measure_count, 6) AS notes_per_measure FROM nc JOIN mc USING (chart_id)")
def a01(spark, sf):
    return M.note_counts(*nm(spark, sf)).withColumn("notes_per_measure", r6("notes_per_measure"))


@query("a02_distinct_lanes", "SELECT chart_id, string_agg(lane, ',' ORDER BY lane) AS lanes, count(*) AS lane_count FROM lu GROUP BY 1")
def a02(spark, sf):
    return M.distinct_lanes(V.notes_base(spark, sf)).withColumn("lanes", F.array_join("lanes", ","))


@query("a03_lane_usage", "SELECT chart_id, lane, n AS note_count FROM lu")
def a03(spark, sf):
    return M.lane_usage(V.notes_base(spark, sf))


@query("a04_lane_balance", "SELECT chart_id, lane, n AS note_count, round(n/note_count, 6) AS note_share, round(n/measure_count, 6) AS lane_notes_per_measure FROM lu JOIN nc USING (chart_id) JOIN mc USING (chart_id)")
def a04(spark, sf):
    return M.lane_balance(*nm(spark, sf)).withColumns({c: r6(c) for c in ("note_share", "lane_notes_per_measure")})


WITH["foc"] = """SELECT c.chart_id, l.lane, coalesce(u.n, 0) AS n, c.note_count, m.measure_count FROM nc c JOIN mc m USING (chart_id), (VALUES ('kick'), ('snare'), ('hihat_closed')) l(lane)
 LEFT JOIN lu u ON u.chart_id = c.chart_id AND u.lane = l.lane"""


@query("a05_focused_balance", "SELECT chart_id, lane, n AS note_count, round(n/note_count, 6) AS note_share, round(n/measure_count, 6) AS lane_notes_per_measure FROM foc")
def a05(spark, sf):
    return M.focused_balance(*nm(spark, sf)).withColumns({c: r6(c) for c in ("note_share", "lane_notes_per_measure")})


@query("a06_max_simultaneous", "SELECT chart_id, max(n) AS max_simultaneous FROM (SELECT chart_id, tick, count(*) AS n FROM notes_a GROUP BY ALL) GROUP BY 1")
def a06(spark, sf):
    return M.max_simultaneous(V.notes_base(spark, sf))


@query("a07_max_per_beat", "SELECT chart_id, max(n) AS max_per_beat FROM (SELECT chart_id, beat_index, count(*) AS n FROM notes_a GROUP BY ALL) GROUP BY 1")
def a07(spark, sf):
    return M.max_per_beat(V.notes_base(spark, sf))


@query("a08_max_per_measure", "SELECT chart_id, max(n) AS max_per_measure FROM (SELECT chart_id, bar_index, count(*) AS n FROM in_bar GROUP BY ALL) GROUP BY 1")
def a08(spark, sf):
    return M.max_per_measure(*nm(spark, sf))


@query("a09_empty_measures", "SELECT chart_id, greatest(measure_count - coalesce(h, 0), 0) AS empty_measures FROM mc LEFT JOIN (SELECT chart_id, count(DISTINCT bar_index) AS h FROM in_bar GROUP BY 1) USING (chart_id)")
def a09(spark, sf):
    return M.empty_measures(*nm(spark, sf))


@query("a10_burstiness", "SELECT chart_id, round(b/(note_count/measure_count), 6) AS burstiness FROM nc JOIN mc USING (chart_id) JOIN (SELECT chart_id, max(n) AS b FROM (SELECT chart_id, bar_index, count(*) AS n FROM in_bar GROUP BY ALL) GROUP BY 1) USING (chart_id)")
def a10(spark, sf):
    return M.burstiness(*nm(spark, sf)).withColumn("burstiness", r6("burstiness"))


@query("a11_measure_density", "SELECT m.chart_id, m.bar_index, count(n.tick) AS note_count FROM ms m LEFT JOIN in_bar n ON m.chart_id = n.chart_id AND m.bar_index = n.bar_index GROUP BY ALL")
def a11(spark, sf):
    return M.measure_density(*nm(spark, sf))


@query("j04_note_measure", "SELECT chart_id, source_event_id, bar_index FROM in_bar")
def j04(spark, sf):
    return M.note_measure(*nm(spark, sf)).select("chart_id", "source_event_id", "bar_index")


WITH["runs"] = """SELECT chart_id, max(n) AS longest_run FROM (SELECT chart_id, g, lane, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY tick, lane)
 - row_number() OVER (PARTITION BY chart_id, lane ORDER BY tick) AS g FROM notes_a) GROUP BY ALL) GROUP BY 1"""


@query("w06_longest_run", "SELECT * FROM runs")
def w06(spark, sf):
    return M.longest_run(V.notes_base(spark, sf))


WITH["preview_a"] = """SELECT * FROM (SELECT chart_id, row_number() OVER (PARTITION BY chart_id ORDER BY tick, lane, source_event_id) AS position, tick, lane, beat_index, subdivision_index, velocity FROM notes_a) WHERE position <= 12"""
WITH["preview_b"] = """SELECT * FROM (SELECT chart_id, row_number() OVER (PARTITION BY chart_id ORDER BY tick, lane, source_event_id) AS position, tick, lane, beat_index, subdivision_index, velocity FROM notes_b) WHERE position <= 12"""


@query("t01_note_preview", "SELECT chart_id, position, tick, lane, beat_index, subdivision_index, round(velocity, 6) AS velocity FROM preview_a")
def t01(spark, sf):
    return M.note_preview(V.notes_base(spark, sf)).drop("line").withColumn("velocity", r6("velocity"))


WITH["cm"] = """SELECT c.chart_id, c.note_count, m.measure_count, sim AS max_simultaneous, bt AS max_per_beat, br AS max_per_measure, r.longest_run, greatest(m.measure_count - coalesce(h, 0), 0) AS empty_measures,
 c.note_count/m.measure_count AS npm, br/(c.note_count/m.measure_count) AS burstiness, coalesce(k.n, 0) AS n_kick, coalesce(s.n, 0) AS n_snare, coalesce(x.n, 0) AS n_hat, ls.lanes FROM nc c JOIN mc m USING (chart_id)
 JOIN (SELECT chart_id, max(n) AS sim FROM (SELECT chart_id, tick, count(*) AS n FROM notes_a GROUP BY ALL) GROUP BY 1) USING (chart_id)
 JOIN (SELECT chart_id, max(n) AS bt FROM (SELECT chart_id, beat_index, count(*) AS n FROM notes_a GROUP BY ALL) GROUP BY 1) USING (chart_id)
 JOIN (SELECT chart_id, max(n) AS br, count(*) FILTER (bar_index IS NOT NULL) AS h FROM (SELECT chart_id, bar_index, count(*) AS n FROM in_bar GROUP BY ALL) GROUP BY 1) USING (chart_id)
 JOIN runs r USING (chart_id) JOIN (SELECT chart_id, list_sort(list(lane)) AS lanes FROM lu GROUP BY 1) ls USING (chart_id)
 LEFT JOIN (SELECT chart_id, n FROM lu WHERE lane = 'kick') k USING (chart_id) LEFT JOIN (SELECT chart_id, n FROM lu WHERE lane = 'snare') s USING (chart_id)
 LEFT JOIN (SELECT chart_id, n FROM lu WHERE lane = 'hihat_closed') x USING (chart_id)"""


@query("a01_a11_chart_metrics", """SELECT chart_id, note_count, measure_count, max_simultaneous, max_per_beat, max_per_measure, longest_run, empty_measures, round(npm, 6) AS notes_per_measure,
 round(burstiness, 6) AS burstiness, n_kick, n_snare, n_hat AS n_hihat_closed, array_to_string(lanes, ',') AS lanes FROM cm""")
def chart_metrics(spark, sf):
    n, m = nm(spark, sf)
    c = V.tracks(spark, sf).select(F.col("track_id").alias("chart_id"))
    return M.chart_metrics(c, n, m).drop("usage").withColumns(
        {"notes_per_measure": r6("notes_per_measure"), "burstiness": r6("burstiness"), "lanes": F.array_join("lanes", ",")}
    )


# --- scoring ------------------------------------------------------------------------------

WITH["exp"] = """SELECT track_id AS song_id, CASE WHEN track_id % 9 = 0 THEN 'normal' ELSE 'prototype' END AS difficulty, 20 AS nmin, 50 + track_id % 20 AS nmax,
 track_id % 2 = 0 AS has_m, CASE WHEN track_id % 10 = 0 THEN ['kick','snare','percussion','cowbell'] ELSE ['kick','snare'] END AS req,
 CASE WHEN track_id % 3 <> 0 THEN ['kick','snare','hihat_closed','hihat_open','tom_low','tom_mid','tom_high','crash','ride','clap'] END AS allowed,
 CASE WHEN track_id % 4 = 0 THEN 11 ELSE 4 END AS minl, CASE WHEN track_id % 5 <> 0 THEN 2.5::DOUBLE END AS burst FROM tracks"""
WITH["chart_keys"] = "SELECT track_id AS song_id, CASE WHEN track_id % 9 = 0 THEN 'normal' ELSE 'prototype' END AS difficulty FROM tracks WHERE track_id % 13 <> 0"


def _pen(v, lo, hi, cap, floor):
    return (f"CASE WHEN {v} >= {lo} AND {v} <= {hi} THEN 0 WHEN {v} < {lo} THEN least({cap}, ({lo} - {v})::DOUBLE/greatest({lo}, {floor})*{cap}) "
            f"ELSE least({cap}, ({v} - {hi})::DOUBLE/greatest({hi}, {floor})*{cap}) END")


def _step(x, each, cap):
    return f"least({cap}, {each}*({x}))"


_CARD = [
    ("empty_chart", "note_count = 0", "0.45"),
    ("note_count_out_of_range", "note_count < nmin OR note_count > nmax", _pen("note_count", "nmin", "nmax", 0.20, 1)),
    ("measure_count_out_of_range", "has_m AND (measure_count < 1 OR measure_count > 30)", _pen("measure_count", "1", "30", 0.15, 1)),
    ("missing_required_lanes", "len(miss) > 0", _step("len(miss)", 0.08, 0.20)),
    ("unexpected_lanes", "allowed IS NOT NULL AND len(extra) > 0", _step("len(extra)", 0.08, 0.20)),
    ("insufficient_lane_variety", "len(lanes) < minl", _step("minl - len(lanes)", 0.07, 0.15)),
    ("max_simultaneous_notes_exceeded", "max_simultaneous > 1", _step("max_simultaneous - 1", 0.05, 0.20)),
    ("max_notes_per_beat_exceeded", "max_per_beat > 2", _step("max_per_beat - 2", 0.04, 0.20)),
    ("max_notes_per_measure_exceeded", "max_per_measure > 5", _step("max_per_measure - 5", 0.03, 0.15)),
    ("same_lane_streak_too_long", "longest_run > 3", _step("longest_run - 3", 0.04, 0.15)),
    ("measure_burstiness_too_high", "burstiness > burst", _pen("burstiness", "0", "burst", 0.15, 0.001)),
    ("too_many_empty_measures", "empty_measures > 4", _step("empty_measures - 4", 0.05, 0.15)),
]


def _eval_views(suffix, metrics):
    WITH["ev" + suffix] = f"""SELECT e.*, m.*, list_filter(req, lambda x: NOT list_contains(lanes, x)) AS miss, list_filter(lanes, lambda x: NOT list_contains(allowed, x)) AS extra
 FROM exp e JOIN chart_keys k USING (song_id, difficulty) JOIN {metrics} m ON m.chart_id = e.song_id"""
    parts = [
        f"SELECT song_id, difficulty, {i} AS i, '{code}' AS code, ({pen})::DOUBLE AS penalty FROM ev{suffix} WHERE {cond}"
        for i, (code, cond, pen) in enumerate(_CARD)
    ]
    WITH["fx" + suffix] = f"""SELECT song_id, difficulty, l.lane, CASE WHEN l.lane = 'kick' THEN n_kick ELSE 0 END AS n, note_count, measure_count FROM ev{suffix}, (VALUES ('kick'), ('ride')) l(lane) WHERE song_id % 2 = 1"""
    share, dens = "(n/note_count)", "(n/measure_count)"
    foc = [
        ("focused_lane_share_out_of_range", f"{share} < 0.1 OR {share} > 0.2", _pen(share, "0.1::DOUBLE", "0.2::DOUBLE", 0.18, 0.001)),
        ("focused_lane_density_out_of_range", f"song_id % 3 = 0 AND ({dens} < 0.2 OR {dens} > 0.3)", _pen(dens, "0.2::DOUBLE", "0.3::DOUBLE", 0.18, 0.001)),
        ("focused_lane_note_count_too_low", "n < 2", _step("2 - n", 0.04, 0.15)),
        ("focused_lane_note_count_too_high", "n > 5", _step("n - 5", 0.04, 0.15)),
    ]
    parts += [
        f"SELECT song_id, difficulty, 100 + {j} + CASE WHEN lane = 'ride' THEN 10 ELSE 0 END, '{code}', ({pen})::DOUBLE FROM fx{suffix} WHERE {cond}"
        for j, (code, cond, pen) in enumerate(foc)
    ]
    WITH["iss" + suffix] = " UNION ALL ".join(parts)
    WITH["sc" + suffix] = f"""SELECT e.song_id, e.difficulty, greatest(0, 1 - coalesce(sum(i.penalty), 0)) AS score, count(i.code) AS n0, string_agg(i.code, ',' ORDER BY i.i) AS codes0
 FROM ev{suffix} e LEFT JOIN iss{suffix} i USING (song_id, difficulty) GROUP BY ALL"""
    WITH["rep" + suffix] = f"""SELECT song_id, difficulty, score, n0 + CASE WHEN score < 0.5 THEN 1 ELSE 0 END AS n_issues,
 CASE WHEN score < 0.5 THEN concat_ws(',', codes0, 'score_below_threshold') ELSE coalesce(codes0, '') END AS codes FROM sc{suffix}"""


_eval_views("", "cm")


def reports(spark, sf, notes=None, measures=None):
    n, m = nm(spark, sf)
    return P.evaluate_charts(
        V.charts(spark, sf), notes if notes is not None else n, m, V.expectations(spark, sf), V.focused_expectations(spark, sf)
    )


@query("g09_evaluate", "SELECT song_id, difficulty, round(score, 6) AS score, n_issues, n_issues = 0 AS passed, codes FROM rep")
def g09(spark, sf):
    return reports(spark, sf).select(
        "song_id", "difficulty", r6("score").alias("score"), F.size("issues").alias("n_issues"), "passed",
        F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"),
    )


@query("g09_issues", "SELECT song_id, code, round(penalty, 6) AS penalty FROM iss UNION ALL SELECT song_id, 'score_below_threshold', 0 FROM rep WHERE score < 0.5")
def g09_issues(spark, sf):
    return X.issues(reports(spark, sf)).select("song_id", "code", r6("penalty").alias("penalty"))


@query("e02_missing_lanes", "SELECT song_id, array_to_string(miss, ',') AS missing FROM ev")
def e02(spark, sf):
    r = reports(spark, sf)
    return r.select("song_id", F.array_join(X.missing_lanes(F.col("required_lanes"), F.col("lanes")), ",").alias("missing"))


@query("e03_unexpected_lanes", "SELECT song_id, array_to_string(list_sort(extra), ',') AS extra FROM ev WHERE allowed IS NOT NULL")
def e03(spark, sf):
    r = reports(spark, sf).where(F.col("allowed_lanes").isNotNull())
    return r.select("song_id", F.array_join(F.sort_array(X.unexpected_lanes(F.col("lanes"), F.col("allowed_lanes"))), ",").alias("extra"))


@query("f02_range_penalty", f"SELECT event_id, round({_pen('value', '20::DOUBLE', '60::DOUBLE', 0.2, 1)}, 6) AS whole, round({_pen('value/100', '0.1::DOUBLE', '0.0::DOUBLE', 0.18, 0.001)}, 6) AS fine FROM events")
def f02(spark, sf):
    v = F.col("value")
    return V.table(spark, sf, "events").select(
        "event_id", r6(S.range_penalty(v, F.lit(20.0), F.lit(60.0), 0.2, 1)).alias("whole"),
        r6(S.range_penalty(v / 100, F.lit(0.1), F.lit(0.0), 0.18, 0.001)).alias("fine"),
    )


@query("f03_fixed_text", """SELECT event_id, text AS plain, CASE WHEN v >= 0 THEN '+' || text ELSE text END AS with_sign FROM (
 SELECT event_id, v, CASE WHEN v < 0 AND d = 0 THEN '-' ELSE '' END || d::VARCHAR AS text FROM (
 SELECT event_id, v, CAST(round(CAST(CAST(v AS VARCHAR) AS DECIMAL(34, 17)), 2) AS DECIMAL(34, 2)) AS d FROM (SELECT event_id, value - 100 AS v FROM events)))""")
def f03(spark, sf):
    v = F.col("value") - 100
    return V.table(spark, sf, "events").select("event_id", S.fixed2(v).alias("plain"), S.signed(v, True).alias("with_sign"))


@query("f04_trimmed_number", "SELECT event_id, CASE WHEN round(v) = v THEN printf('%.0f', v) ELSE printf('%.2f', v) END AS text FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(value) ELSE value END AS v FROM events)")
def f04(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, F.round("value")).otherwise(F.col("value"))
    return V.table(spark, sf, "events").select("event_id", S.trimmed_number(v).alias("text"))


# --- comparison ----------------------------------------------------------------------------

WITH["nc_b"] = "SELECT chart_id, count(*) AS note_count FROM notes_b GROUP BY 1"
WITH["lu_b"] = "SELECT chart_id, lane, count(*) AS n FROM notes_b GROUP BY ALL"
WITH["in_bar_b"] = WITH["in_bar"].replace("notes_a", "notes_b")
WITH["runs_b"] = WITH["runs"].replace("notes_a", "notes_b")
WITH["cm_b"] = WITH["cm"].replace("FROM nc c", "FROM nc_b c").replace("notes_a", "notes_b").replace("in_bar", "in_bar_b").replace("JOIN runs r", "JOIN runs_b r").replace("FROM lu ", "FROM lu_b ")
_eval_views("_b", "cm_b")
_LINE = "concat(tick, '|', beat_index, '|', subdivision_index, '|', lane, '|', round(velocity*1000000)::BIGINT)"


@query("e01_preview_changes", f"""SELECT chart_id, 'added' AS change, line FROM (SELECT chart_id, {_LINE} AS line FROM preview_b EXCEPT SELECT chart_id, {_LINE} FROM preview_a)
 UNION ALL SELECT chart_id, 'removed', line FROM (SELECT chart_id, {_LINE} AS line FROM preview_a EXCEPT SELECT chart_id, {_LINE} FROM preview_b)""")
def e01(spark, sf):
    text = F.concat_ws("|", "tick", "beat_index", "subdivision_index", "lane", F.round(F.col("velocity") * 1000000).cast("long"))
    side = lambda n: M.note_preview(n).select("chart_id", text.alias("line"))
    return C.preview_changes(side(V.notes_base(spark, sf)), side(V.notes_cand(spark, sf)), ["chart_id"])


WITH["pv_a"] = "SELECT chart_id, list(DISTINCT concat(tick, '|', beat_index, '|', coalesce(subdivision_index::VARCHAR, 'nil'), '|', lane, '|', v2)) AS p FROM (SELECT *, floor(velocity*100 + 0.5)::INT AS v2 FROM preview_a) GROUP BY 1"
WITH["pv_b"] = WITH["pv_a"].replace("preview_a", "preview_b")
WITH["cmp"] = """SELECT c.song_id, c.difficulty, b.n_issues = 0 AS baseline_passed, c.n_issues = 0 AS candidate_passed, c.score - b.score AS score_delta, y.note_count - x.note_count AS note_delta,
 y.measure_count - x.measure_count AS measure_delta, y.npm - x.npm AS density_delta, abs(y.note_count - x.note_count)/greatest(x.note_count, 1) AS note_drift,
 greatest(abs(y.n_kick/y.note_count - x.n_kick/x.note_count), abs(y.n_snare/y.note_count - x.n_snare/x.note_count), abs(y.n_hat/y.note_count - x.n_hat/x.note_count)) AS shift,
 len(list_filter(q.p, lambda z: NOT list_contains(p.p, z))) + len(list_filter(p.p, lambda z: NOT list_contains(q.p, z))) AS churn
 FROM rep_b c JOIN rep b USING (song_id, difficulty) JOIN cm x ON x.chart_id = c.song_id JOIN cm_b y ON y.chart_id = c.song_id JOIN pv_a p ON p.chart_id = c.song_id JOIN pv_b q ON q.chart_id = c.song_id"""
WITH["cmp_status"] = """SELECT *, CASE WHEN baseline_passed AND NOT candidate_passed THEN 'regressed' WHEN NOT baseline_passed AND candidate_passed THEN 'improved'
 WHEN score_delta <= -0.15 OR note_drift >= 0.35 OR abs(density_delta) >= 1.5 OR shift >= 0.18 OR churn >= 8 THEN 'regressed'
 WHEN score_delta <= -0.05 OR note_drift >= 0.18 OR abs(density_delta) >= 0.75 OR shift >= 0.08 OR churn >= 4 THEN 'watch' WHEN score_delta >= 0.10 THEN 'improved' ELSE 'stable' END AS status FROM cmp"""


def candidate_reports(spark, sf):
    return reports(spark, sf, notes=V.notes_cand(spark, sf))


@query("g11_compare", "SELECT song_id, difficulty, baseline_passed, candidate_passed, round(score_delta, 6) AS score_delta, note_delta, measure_delta, round(density_delta, 6) AS density_delta, round(note_drift, 6) AS note_drift, churn, status FROM cmp_status")
def g11(spark, sf):
    c = C.compare(candidate_reports(spark, sf), reports(spark, sf))
    return c.select(
        "song_id", "difficulty", "baseline_passed", "candidate_passed", r6("score_delta").alias("score_delta"), "note_delta", "measure_delta",
        r6("density_delta").alias("density_delta"), r6("note_drift").alias("note_drift"), "churn", "status",
    )


@query("j06_join_baseline", "SELECT song_id, difficulty, round(b.score, 6) AS baseline_score FROM rep_b c LEFT JOIN (SELECT * FROM rep WHERE song_id % 2 = 0) b USING (song_id, difficulty)")
def j06(spark, sf):
    j = C.join_baseline(candidate_reports(spark, sf), reports(spark, sf).where(F.col("song_id") % 2 == 0))
    return j.select("song_id", "difficulty", r6("b_score").alias("baseline_score"))


# --- corpus ------------------------------------------------------------------------------------


@query("j05_join_expectations", """SELECT e.song_id, e.difficulty, CASE WHEN k.song_id IS NULL THEN concat(e.song_id, ':', e.difficulty) END AS missing FROM exp e LEFT JOIN chart_keys k USING (song_id, difficulty)""")
def j05(spark, sf):
    found, missing = P.join_expectations(V.expectations(spark, sf), V.charts(spark, sf))
    return found.select("song_id", "difficulty", F.lit(None).cast("string").alias("missing")).unionByName(missing)


WITH["songs"] = """SELECT track_id AS song_id, CASE track_id % 3 WHEN 0 THEN 'real_clip' WHEN 1 THEN 'fixture_audio' ELSE 'synthetic' END AS source_type,
 CASE WHEN track_id % 6 = 0 THEN '  ' WHEN track_id % 6 = 3 THEN 'field recording' END AS source_provenance,
 CASE WHEN track_id % 4 <> 0 THEN CASE WHEN track_id % 2 = 0 THEN 'approved' ELSE 'pending' END END AS review_status,
 CASE track_id % 5 WHEN 0 THEN 'approved_baseline' WHEN 1 THEN 'draft' END AS baseline_status, CASE WHEN track_id % 10 = 0 THEN 'chart-1' END AS baseline_chart_id,
 track_id % 7 = 0 AS has_notes, track_id % 8 = 0 AS has_list, track_id % 12 = 0 AS smoke FROM tracks"""
WITH["song_tags"] = "SELECT DISTINCT user_id AS song_id, event_type AS tag FROM events UNION ALL SELECT song_id, 'smoke' FROM songs WHERE smoke"
WITH["results"] = """SELECT c.song_id, c.difficulty, c.n_issues = 0 AS passed, s.status AS comparison FROM rep_b c LEFT JOIN (SELECT * FROM cmp_status WHERE song_id % 2 = 0) s USING (song_id, difficulty)"""


def results(spark, sf):
    """Candidate reports with the comparison status of every second song."""
    base = reports(spark, sf).where(F.col("song_id") % 2 == 0)
    c = cut(candidate_reports(spark, sf))
    s = cut(C.compare(c, base).select("song_id", "difficulty", F.col("status").alias("comparison")))
    return c.select("song_id", "difficulty", "passed").join(s.hint("merge"), ["song_id", "difficulty"], "left")


@query("a12_corpus_totals", """SELECT (SELECT count(*) FROM exp) AS total, count(*) FILTER (passed) AS passed, count(*) - count(*) FILTER (passed) + (SELECT count(*) FROM exp) - (SELECT count(*) FROM chart_keys) AS failed,
 (SELECT count(*) FROM exp) - (SELECT count(*) FROM chart_keys) AS missing, count(comparison) AS comparisons, count(*) FILTER (comparison = 'regressed') AS severe FROM results""")
def a12(spark, sf):
    e = V.expectations(spark, sf)
    return P.totals(results(spark, sf), e, P.join_expectations(e, V.charts(spark, sf))[1])


@query("a13_tag_summary", "SELECT tag, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) - count(*) FILTER (passed) AS failed FROM song_tags t JOIN exp e USING (song_id) LEFT JOIN results r USING (song_id, difficulty) GROUP BY 1")
def a13(spark, sf):
    # whether a chart passed needs no comparison, so no baseline is made
    return P.tag_summary(V.expectations(spark, sf), candidate_reports(spark, sf), V.songs(spark, sf))


@query("a14_difficulty_summary", "SELECT difficulty, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (r.song_id IS NULL) AS missing, greatest(count(*) - count(*) FILTER (passed) - count(*) FILTER (r.song_id IS NULL), 0) AS failed FROM exp e LEFT JOIN (SELECT song_id, difficulty AS d, passed FROM results) r ON e.song_id = r.song_id AND e.difficulty = r.d GROUP BY 1")
def a14(spark, sf):
    return P.difficulty_summary(V.expectations(spark, sf), candidate_reports(spark, sf))


@query("a15_value_summaries", """SELECT 'source_type' AS kind, source_type AS key, count(*) AS n FROM songs GROUP BY ALL UNION ALL SELECT 'review_status', coalesce(review_status, 'unspecified'), count(*) FROM songs GROUP BY ALL
 UNION ALL SELECT 'baseline_status', coalesce(baseline_status, 'unspecified'), count(*) FROM songs GROUP BY ALL UNION ALL SELECT 'comparison', comparison, count(*) FROM results WHERE comparison IS NOT NULL GROUP BY ALL""")
def a15(spark, sf):
    return P.value_summaries(V.songs(spark, sf), results(spark, sf))


WITH["songs2"] = "SELECT * FROM songs UNION ALL SELECT * FROM songs WHERE song_id % 17 = 0"
WITH["exp2"] = "SELECT song_id, difficulty FROM exp WHERE song_id % 19 <> 1 UNION ALL SELECT song_id, difficulty FROM exp WHERE song_id % 23 = 0"


def messy_corpus(spark, sf):
    s, e = V.songs(spark, sf), V.expectations(spark, sf)
    i = F.col("song_id")
    return s.unionByName(s.where(i % 17 == 0)), e.where(i % 19 != 1).unionByName(e.where(i % 23 == 0))


@query("g12_lint", """SELECT song_id, 'error' AS severity, 'duplicate_song_id' AS code FROM (SELECT song_id, row_number() OVER (PARTITION BY song_id) AS r FROM songs2) WHERE r > 1
 UNION ALL SELECT song_id, 'error', 'duplicate_expectation_difficulty' FROM (SELECT song_id, row_number() OVER (PARTITION BY song_id, difficulty) AS r FROM exp2) WHERE r > 1
 UNION ALL SELECT song_id, 'warning', 'missing_expectations' FROM songs2 WHERE song_id NOT IN (SELECT song_id FROM exp2)
 UNION ALL SELECT song_id, 'warning', 'missing_source_provenance' FROM songs2 WHERE source_type = 'real_clip' AND trim(coalesce(source_provenance, '')) = ''
 UNION ALL SELECT song_id, 'warning', 'missing_review_status' FROM songs2 WHERE source_type = 'real_clip' AND review_status IS NULL
 UNION ALL SELECT song_id, 'warning', 'missing_review_notes' FROM songs2 WHERE source_type = 'real_clip' AND NOT has_notes
 UNION ALL SELECT song_id, 'warning', 'missing_review_checklist' FROM songs2 WHERE source_type = 'real_clip' AND NOT has_list
 UNION ALL SELECT song_id, 'warning', 'missing_execution_tag' FROM songs2 WHERE source_type = 'real_clip' AND NOT smoke
 UNION ALL SELECT song_id, 'warning', 'missing_baseline_chart_id' FROM songs2 WHERE baseline_status = 'approved_baseline' AND baseline_chart_id IS NULL""")
def g12(spark, sf):
    return P.lint(*messy_corpus(spark, sf)).select("song_id", "severity", "code")


@query("e06_duplicates", "SELECT song_id, difficulty, r AS repeat FROM (SELECT song_id, difficulty, row_number() OVER (PARTITION BY song_id, difficulty) AS r FROM exp2) WHERE r > 1")
def e06(spark, sf):
    return P.duplicates(messy_corpus(spark, sf)[1], ["song_id", "difficulty"])


@query("e05_first_seen", "SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY ALL")
def e05(spark, sf):
    from beatloom.operators import diffs as D

    return D.first_seen(V.table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select(
        "user_id", "event_type", F.col("event_id").alias("first_event")
    )


def corpus(spark, sf):
    n, m = nm(spark, sf)
    c = V.charts(spark, sf)
    return P.evaluate_corpus(
        V.songs(spark, sf), V.expectations(spark, sf), V.focused_expectations(spark, sf), (c, V.notes_cand(spark, sf), m),
        (c.where(F.col("song_id") % 2 == 0), n, m),
    )


WITH["lint1"] = """SELECT song_id FROM songs WHERE source_type = 'real_clip' AND trim(coalesce(source_provenance, '')) = '' UNION ALL SELECT song_id FROM songs WHERE source_type = 'real_clip' AND review_status IS NULL
 UNION ALL SELECT song_id FROM songs WHERE source_type = 'real_clip' AND NOT has_notes UNION ALL SELECT song_id FROM songs WHERE source_type = 'real_clip' AND NOT has_list
 UNION ALL SELECT song_id FROM songs WHERE source_type = 'real_clip' AND NOT smoke UNION ALL SELECT song_id FROM songs WHERE baseline_status = 'approved_baseline' AND baseline_chart_id IS NULL"""


@query("g13_evaluate_corpus", """SELECT (SELECT count(*) FROM exp) AS total, count(*) FILTER (passed) AS passed, count(*) - count(*) FILTER (passed) + (SELECT count(*) FROM exp) - (SELECT count(*) FROM chart_keys) AS failed,
 (SELECT count(*) FROM exp) - (SELECT count(*) FROM chart_keys) AS missing, count(comparison) AS comparisons, count(*) FILTER (comparison = 'regressed') AS severe,
 (SELECT count(*) FROM lint1) AS lint, (SELECT count(DISTINCT tag) FROM song_tags) AS tags, 'FAIL' AS status FROM results""")
def g13(spark, sf):
    return corpus(spark, sf)["totals"].drop("lint_errors")


@query("g10_render_report")
def g10(spark, sf):
    c = corpus(spark, sf)
    n, m = V.notes_cand(spark, sf), short_measures(spark, sf)
    body = P.render_results(c["results"], V.songs(spark, sf), M.measure_density(n, m))
    return P.render_summary(c).unionByName(
        body.select(F.lit(8).alias("section"), F.concat_ws("|", F.col("song_id").cast("string"), "difficulty", F.lpad(F.col("line_no").cast("string"), 3, "0")).alias("sort_key"), "line")
    )
