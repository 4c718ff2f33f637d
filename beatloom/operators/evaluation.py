"""Scoring charts against declared expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions import scalars as S

KEYS = ["song_id", "difficulty"]


def missing_lanes(required: Column, lanes: Column) -> Column:
    """Required lanes a chart lacks; repeats in the requirement stay repeats."""
    return F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda x: ~F.array_contains(lanes, x))


def unexpected_lanes(lanes: Column, allowed: Column) -> Column:
    """Lanes outside the allowed set, null when nothing is declared."""
    return F.when(allowed.isNotNull(), F.array_except(lanes, allowed))


def _issue(code: str, fires: Column, penalty: Column, message: Column) -> Column:
    return F.when(
        F.coalesce(fires, F.lit(False)),
        F.struct(F.lit(code).alias("code"), penalty.cast("double").alias("penalty"), message.alias("message")),
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def chart_rules() -> Column:
    """Array of the issues of one chart row: metrics joined with its expectation."""
    c = F.col
    missing, extra = missing_lanes(c("required_lanes"), c("lanes")), unexpected_lanes(c("lanes"), c("allowed_lanes"))
    joined = lambda a: F.array_join(F.sort_array(a), ", ")

    def ranged(code, what, value, rng, cap):
        lo, hi = c(rng)["min"], c(rng)["max"]
        return _issue(
            code, (c(value) < lo) | (c(value) > hi), S.range_penalty(value, lo, hi, cap, 1),
            _text(f"Expected {what} in ", lo, "...", hi, " but got ", c(value), "."),
        )

    def above(code, value, limit, each, cap, before, after):
        return _issue(
            code, c(value) > c(limit), S.step_penalty(c(value) - c(limit), each, cap),
            _text(f"Expected at most ", c(limit), f" {before} but saw ", c(value), "." if not after else after),
        )

    lanes = F.size("lanes")
    return F.array_compact(
        F.array(
            _issue(
                "difficulty_mismatch", c("chart_difficulty") != c("difficulty"), F.lit(0.20),
                _text("Expected difficulty ", c("difficulty"), " but chart difficulty was ", c("chart_difficulty"), "."),
            ),
            _issue("empty_chart", c("note_count") == 0, F.lit(0.45), F.lit("Chart contains no notes.")),
            ranged("note_count_out_of_range", "note count", "note_count", "note_count_range", 0.20),
            ranged("measure_count_out_of_range", "measure count", "measure_count", "measure_count_range", 0.15),
            _issue(
                "missing_required_lanes", F.size(missing) > 0, S.step_penalty(F.size(missing), 0.08, 0.20),
                _text("Missing required lanes: ", joined(missing), "."),
            ),
            _issue(
                "unexpected_lanes", F.size(extra) > 0, S.step_penalty(F.size(extra), 0.08, 0.20),
                _text("Found lanes outside allowed set: ", joined(extra), "."),
            ),
            _issue(
                "insufficient_lane_variety", lanes < c("min_distinct_lanes"),
                S.step_penalty(c("min_distinct_lanes") - lanes, 0.07, 0.15),
                _text("Expected at least ", c("min_distinct_lanes"), " distinct lanes but saw ", lanes, "."),
            ),
            above("max_simultaneous_notes_exceeded", "max_simultaneous", "max_simultaneous_notes", 0.05, 0.20, "simultaneous notes", None),
            above("max_notes_per_beat_exceeded", "max_per_beat", "max_notes_per_beat", 0.04, 0.20, "notes per beat", None),
            above("max_notes_per_measure_exceeded", "max_per_measure", "max_notes_per_measure", 0.03, 0.15, "notes in any measure", None),
            above("same_lane_streak_too_long", "longest_run", "max_consecutive_same_lane_notes", 0.04, 0.15, "consecutive notes on the same lane", None),
            _issue(
                "measure_burstiness_too_high", c("burstiness") > c("max_measure_burstiness"),
                S.range_penalty("burstiness", F.lit(0.0), "max_measure_burstiness", 0.15, 0.001),
                _text("Expected measure burstiness <= ", S.fixed2("max_measure_burstiness"), " but saw ", S.fixed2("burstiness"), "."),
            ),
            above("too_many_empty_measures", "empty_measures", "allowed_empty_measures", 0.05, 0.15, "empty measures", None),
        )
    )


def focused_rules() -> Column:
    """Issues of one focused-lane expectation row joined with the chart's lane metrics.

    Only kick, snare and closed hat are measured; any other lane counts as having no notes.
    """
    c = F.col
    issues = []
    for code, what, value, rng in (
        ("focused_lane_share_out_of_range", "share", "note_share", "share_range"),
        ("focused_lane_density_out_of_range", "notes/measure", "lane_density", "notes_per_measure_range"),
    ):
        lo, hi = c(rng)["min"], c(rng)["max"]
        issues.append(
            _issue(
                code, (c(value) < lo) | (c(value) > hi), S.range_penalty(value, lo, hi, 0.18, 0.001),
                _text("Lane ", c("lane"), f" expected {what} in ", S.fixed2(lo), "...", S.fixed2(hi), " but got ", S.fixed2(value), "."),
            )
        )
    n, lo, hi = c("lane_count"), c("min_note_count"), c("max_note_count")
    issues.append(
        _issue("focused_lane_note_count_too_low", n < lo, S.step_penalty(lo - n, 0.04, 0.15),
               _text("Lane ", c("lane"), " expected at least ", lo, " notes but got ", n, "."))
    )
    issues.append(
        _issue("focused_lane_note_count_too_high", n > hi, S.step_penalty(n - hi, 0.04, 0.15),
               _text("Lane ", c("lane"), " expected at most ", hi, " notes but got ", n, "."))
    )
    return F.array_compact(F.array(*issues))


def _focused_issues(joined: DataFrame, focused: DataFrame) -> DataFrame:
    """Per expectation the ordered array of focused-lane issues (one expectation, few lanes)."""
    n = F.coalesce(*[F.when(F.col("lane") == x, F.col(f"n_{x}")) for x in K.FOCUSED_LANES], F.lit(0))
    total, measures = F.col("note_count"), F.col("measure_count")
    f = focused.join(
        joined.select("chart_id", *KEYS, "note_count", "measure_count", *[f"n_{x}" for x in K.FOCUSED_LANES]).hint("merge"), KEYS
    ).withColumns(
        {
            "lane_count": n,
            "note_share": F.when(total > 0, n / total).otherwise(F.lit(0.0)),
            "lane_density": F.when(measures > 0, n / measures).otherwise(F.lit(0.0)),
        }
    )
    position = F.col("position") if "position" in focused.columns else F.lit(0)
    f = f.select("chart_id", *KEYS, F.struct(position.alias("p"), F.col("lane"), focused_rules().alias("i")).alias("x"))
    return f.groupBy("chart_id", *KEYS).agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["i"])).alias("focused"))


def evaluate(metrics: DataFrame, pairs: DataFrame, expectations: DataFrame, focused: DataFrame | None = None) -> DataFrame:
    """Score each chart against its expectation.

    ``pairs``: chart_id, song_id, key_difficulty, chart_difficulty - the chart filed under that
    song and difficulty, with the difficulty written in it. Result: the metrics with ``issues``
    (in rule order), ``score`` and ``passed``.
    """
    e = expectations
    keyed = pairs.select("chart_id", "song_id", F.col("key_difficulty").alias("difficulty"), "chart_difficulty")
    # rows of expectations and charts hold arrays and grow with the corpus: no side is a broadcast
    j = keyed.join(e.hint("merge"), KEYS).join(metrics.hint("merge"), "chart_id").withColumn("issues", chart_rules())
    if focused is not None:
        j = j.join(_focused_issues(j, focused).hint("merge"), ["chart_id", *KEYS], "left")
        none = F.array().cast(j.schema["issues"].dataType)
        j = j.withColumn("issues", F.concat("issues", F.coalesce("focused", none))).drop("focused")
    penalty = F.aggregate("issues", F.lit(0.0), lambda a, i: a + i["penalty"])
    score = F.greatest(F.lit(0.0), F.lit(1.0) - penalty)
    j = j.withColumn("score", score)
    low = _issue(
        "score_below_threshold", F.col("score") < F.col("minimum_score"), F.lit(0.0),
        _text("Expected score >= ", S.fixed2("minimum_score"), " but got ", S.fixed2("score"), "."),
    )
    j = j.withColumn("issues", F.concat("issues", F.array_compact(F.array(low))))
    return j.withColumn("passed", F.size("issues") == 0)


def issues(evaluated: DataFrame) -> DataFrame:
    """Issues in long form, in rule order."""
    return evaluated.select("chart_id", *KEYS, F.posexplode("issues").alias("position", "i")).select(
        "chart_id", *KEYS, "position", "i.code", "i.penalty", "i.message"
    )
