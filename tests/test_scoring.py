"""Literal charts through scoring and comparison."""

import pytest
from pyspark.sql import functions as F

from beatloom.operators import compare as C
from beatloom.operators import corpus as P

EXPECTATION = (
    "song_id string, difficulty string, note_count_range struct<min:int,max:int>, measure_count_range struct<min:int,max:int>, required_lanes array<string>, "
    "allowed_lanes array<string>, min_distinct_lanes int, max_simultaneous_notes int, max_notes_per_beat int, max_notes_per_measure int, "
    "max_consecutive_same_lane_notes int, max_measure_burstiness double, allowed_empty_measures int, minimum_score double"
)


def tables(spark, difficulty, measures, notes):
    charts = spark.createDataFrame([("c", "s", difficulty, difficulty)], "chart_id string, song_id string, key_difficulty string, difficulty string")
    m = spark.createDataFrame([("c", i, i * 4, 4) for i in range(measures)], "chart_id string, bar_index int, start_beat_index int, beat_count int")
    n = spark.createDataFrame(
        [("c", lane, tick, beat, None, float(i), None, str(i)) for i, (lane, tick, beat) in enumerate(notes)],
        "chart_id string, lane string, tick long, beat_index int, subdivision_index int, start_seconds double, velocity double, source_event_id string",
    )
    return charts, n, m


def test_overcharted_score(spark):
    e = spark.createDataFrame([("s", "easy", (1, 4), (1, 1), ["kick"], ["kick", "snare"], 1, 1, 2, 4, None, None, 0, 0.9)], EXPECTATION)
    charts, n, m = tables(spark, "hard", 2, [("kick", 0, 0), ("snare", 0, 0), ("crash", 0, 0), ("kick", 120, 0), ("snare", 240, 0)])
    charts = charts.withColumn("key_difficulty", F.lit("easy"))
    r = P.evaluate_charts(charts, n, m, e, None).collect()[0]
    assert {i.code for i in r.issues} == {
        "difficulty_mismatch", "note_count_out_of_range", "measure_count_out_of_range", "unexpected_lanes", "max_simultaneous_notes_exceeded",
        "max_notes_per_beat_exceeded", "max_notes_per_measure_exceeded", "too_many_empty_measures", "score_below_threshold",
    }
    assert r.score == pytest.approx(0.22)
    assert (r.note_count, r.max_simultaneous, r.max_per_beat, r.max_per_measure, r.empty_measures) == (5, 3, 5, 5, 1)


def test_drift_is_a_regression(spark):
    e = spark.createDataFrame(
        [("s", "prototype", (1, 16), (1, 2), ["kick", "snare"], ["kick", "snare", "hihat_closed"], 2, 1, 4, 16, None, None, 0, 0.5)], EXPECTATION
    )
    base = [("kick", 0, 0), ("hihat_closed", 240, 0), ("snare", 480, 1), ("hihat_closed", 720, 1)]
    cand = [("kick", 0, 0), ("kick", 120, 0), ("hihat_closed", 240, 0), ("hihat_closed", 720, 1), ("hihat_closed", 840, 1), ("snare", 960, 2)]
    a = P.evaluate_charts(*tables(spark, "prototype", 1, base), e, None)
    b = P.evaluate_charts(*tables(spark, "prototype", 1, cand), e, None)
    r = C.compare(b, a).collect()[0]
    assert (r.status, r.note_delta, r.density_delta) == ("regressed", 2, 2.0)
    assert "note_drift=+2 (50.00%)" in r.highlights and "density_shift=+2.00" in r.highlights
    assert (len(r.preview_added), len(r.preview_removed)) == (3, 1)
    kick = next(f for f in r.focused if f.lane == "kick")
    assert (kick.count_delta, kick.share_delta) == (1, pytest.approx(2 / 6 - 0.25))
