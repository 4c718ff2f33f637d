"""Literal hits through shaping, comparison and audits."""

import json

import pytest
from pyspark.sql import functions as F

from beatloom.operators import adtof, arbitration, audits, signal, timing
from beatloom.functions import scalars as S
from beatloom.sources import files


def shaped(spark, hits, beats):
    h = spark.createDataFrame([(1, float(t), lane, lane, float(c)) for t, lane, c in hits], "track_id long, onset_seconds double, lane string, label string, confidence double")
    b = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(beats)], "track_id long, beat_index int, start_seconds double")
    r = signal.shape_classified(h, b)
    return sorted(r["hits"].collect(), key=lambda x: x.onset_seconds), r["counts"].collect()[0]


def test_stronger_hit_survives(spark):
    hits, counts = shaped(spark, [(0.0, "kick", 0.62), (0.07, "kick", 0.91), (0.5, "snare", 0.80)], [0, 0.5, 1])
    assert [(h.lane, h.confidence) for h in hits] == [("kick", 0.91), ("snare", 0.8)]
    assert counts.merged == 1


def test_fast_doubles_stay(spark):
    hits, counts = shaped(spark, [(0.0, "kick", 0.82), (0.095, "kick", 0.79), (0.5, "snare", 0.84)], [0, 0.5, 1])
    assert [h.lane for h in hits] == ["kick", "kick", "snare"] and counts.merged == 0


def test_snares_on_even_beats_become_kicks(spark):
    hits, counts = shaped(spark, [(0.0, "snare", 0.76), (0.5, "snare", 0.84), (1.0, "snare", 0.79), (1.5, "snare", 0.83)], [0, 0.5, 1, 1.5, 2])
    assert [h.lane for h in hits] == ["kick", "snare", "kick", "snare"] and counts.any_promoted


def test_weak_isolated_hats_go(spark):
    hits, counts = shaped(spark, [(0.0, "kick", 0.88), (0.125, "closed_hihat", 0.69), (0.25, "closed_hihat", 0.83), (0.5, "snare", 0.86)], [0, 0.5, 1])
    assert [h.onset_seconds for h in hits] == [0.0, 0.25, 0.5] and counts.weak_hats == 1


def parsed(spark, docs):
    return spark.createDataFrame([(k, json.dumps(v) if isinstance(v, dict) else v) for k, v in docs.items()], "track_id string, text string").select(
        "track_id", F.try_parse_json("text").alias("raw")
    )


def test_timing_diff(spark):
    a = {"analysis": {"estimatedTempoBPM": 120.0, "confidence": 0.9}, "beats": [0.0, 0.5, 1.0, 1.5],
         "drumEvents": [{"lane": "kick", "onsetSeconds": 0.0}, {"lane": "snare", "onsetSeconds": 0.5}, {"lane": "closed_hihat", "onsetSeconds": 0.75}]}
    b = {"analysis": {"estimatedTempoBPM": 100.0, "confidence": 0.7}, "beats": [0.1, 0.7, 1.3, 1.9],
         "drumEvents": [{"lane": "kick", "onsetSeconds": 0.02}, {"lane": "kick", "onsetSeconds": 0.9}, {"lane": "snare", "onsetSeconds": 0.5}, {"lane": "tom", "onsetSeconds": 1.2}]}
    rows = timing.timing_diff(parsed(spark, {"t": a}), parsed(spark, {"t": b})).collect()
    v = {(r.measure, r.detail): r.value for r in rows}
    assert v[("tempo_bpm_delta", None)] == -20.0
    assert v[("beats_mismatches", None)] == 4
    assert v[("event_count_delta", None)] == 1
    assert {k[1] for k in v if k[0] == "lane_count_delta"} == {"closed_hihat", "kick", "tom"}
    assert (v[("onsets_matched", None)], v[("onsets_shifted", None)], v[("onsets_primary_only", None)], v[("onsets_fallback_only", None)]) == (1, 1, 1, 2)


def test_loop_warnings(spark):
    w = ["analyzer wrapper merged 12 fallback drum-event candidates onto primary timing output", "event-backend: filtered 2 low-confidence snare candidates",
         "event-backend: deduped 3 near-duplicate same-lane hits while keeping the stronger candidate"]
    s = spark.createDataFrame([("a", w, "b", "p")], "id string, warnings array<string>, timing_backend string, selected_backend string")
    r = audits.loop_totals(audits.loop_counts(s)).collect()[0]
    assert (r.stage2_total, r.filtered_total, r.deduped_total, r.all_stage2_used) == (12, 2, 3, True)


def test_transcription_hits(spark):
    d = {"hits": [{"time": 0.0, "pitch": 35, "velocity": 120, "confidence": 0.95}, {"time": 0.5, "pitch": 38, "velocity": 100, "confidence": 0.88},
                  {"time": 0.75, "pitch": 42, "velocity": 80}, {"pitch": 49}]}
    rows = adtof.normalize_adtof(parsed(spark, {"t": d})).orderBy("pos").collect()
    assert [r.label for r in rows] == ["kick", "snare", "closed hi hat", "crash"]
    assert rows[0].velocity == pytest.approx(120 / 127) and rows[2].confidence == 0.5 and rows[3].velocity == 0.8
    assert [r.dropped for r in rows] == [False, False, False, True]


def test_arbitration_policies(spark):
    timing_only, hits = {"beats": [0.0, 0.5]}, {"hits": [{"time": 0.1, "label": "kick"}]}
    p = parsed(spark, {"ok": {**timing_only, "hits": [{"time": 0}]}, "bare": timing_only, "bad": "{nope", "invalid": {"x": 1}})
    f = parsed(spark, {k: hits for k in ("ok", "bare", "bad", "invalid")})
    got = lambda policy: {r.track_id: r.selected_backend for r in arbitration.arbitrate(p, f, policy, "require-timing").collect()}
    assert got("on-error-or-invalid") == {"ok": "primary", "bare": "primary+fallback-events", "bad": "fallback", "invalid": "fallback"}
    assert got("on-failure") == {"ok": "primary", "bare": "primary", "bad": "fallback", "invalid": "primary"}
    assert set(got("always").values()) == {"fallback"}
    assert got("disabled")["bad"] is None


def test_file_names(spark):
    names = ["song--hard", "a--b--easy", "x__easy", "--hard", "plain", "a__b--", "s--"]
    d = spark.createDataFrame([(n,) for n in names], "stem string").withColumn("k", files.song_and_difficulty("stem"))
    got = [tuple(r.k) if r.k else None for r in d.collect()]
    assert got == [("song", "hard"), ("a--b", "easy"), ("x", "easy"), None, None, ("a", "b--"), None]


def test_octave_fold(spark):
    values = [3.0, 34.9, 35.0, 69.999, 70.0, 190.0, 190.1, 380.0, 381.0, 1520.0, 4000.0]
    d = spark.createDataFrame([(v,) for v in values], "b double").select("b", S.octave_fold("b", 70.0, 190.0).alias("f"))
    for r in d.collect():
        x = r.b
        while x < 70:
            x *= 2
        while x > 190:
            x /= 2
        assert r.f == x
