"""Literal documents through the whole chart job."""

import json

import pytest
from pyspark.sql import functions as F

from beatloom.operators import charts as C


def hit(i, label, onset, velocity=None, confidence=None):
    h = {"eventID": i, "label": label, "onsetSeconds": onset}
    if velocity is not None:
        h["velocity"] = velocity
    if confidence is not None:
        h["confidence"] = confidence
    return h


def doc(raw, tempo=120.0, duration=1.0):
    analysis = {k: v for k, v in (("estimatedTempoBPM", tempo), ("durationSeconds", duration)) if v is not None}
    return {**raw, "analysis": analysis}


def spam():
    out = []
    for b, (i, lane, v) in enumerate([("kick-1", "kick", 0.95), ("snare-2", "snare", 0.92), ("kick-3", "kick", 0.90), ("snare-4", "snare", 0.92)]):
        out.append(hit(i, lane, b * 0.5, v))
        out += [hit(f"hat-{b}{s}", "closed hat", b * 0.5 + s * 0.125, 0.55 - s * 0.02) for s in range(4)]
    return out


DOCS = {
    "quarters": doc({"beats": [0.0, 0.5, 1.0], "drumEvents": [hit("kick-1", "kick", 0.12, 1.0), hit("hat-1", "closed hat", 0.38, 0.5)]}),
    "triplets": doc({"beats": [0.0, 0.5, 1.0], "drumEvents": [hit("k", "bass drum", 0.0, 1.0), hit("s", "snare", 0.333, 0.8), hit("h", "closed hi hat", 0.667, 0.5)]}),
    "explicit": doc({"beats": [0.0, 0.5], "subdivisions": [0.0, 0.18, 0.31, 0.5, 0.68, 0.84], "drumEvents": [hit("k", "kick", 0.18, 1.0), hit("s", "snare", 0.84, 0.8)]}),
    "repaired": doc({"beats": [0.02, 1.0, 2.0, 2.5, 3.0, 3.5, 4.0], "downbeats": [0.02, 2.0, 4.0],
                     "drumEvents": [hit("k1", "kick", 0.03, 1.0), hit("s1", "snare", 1.02, 0.8), hit("k2", "kick", 2.02, 1.0)]}, duration=4.0),
    "dropped": doc({"beats": [0.0, 0.5], "drumEvents": [hit("good", "floor tom", 0.48, 1.3), {"eventID": "m", "label": "snare"}, hit("u", "laser", 0.1)]}),
    "collapsed": doc({"beats": [0.0, 0.5, 1.0], "drumEvents": [hit("snare-weak", "snare", 0.49, 0.4, 0.4), hit("snare-strong", "snare", 0.48, 0.9, 0.9), hit("kick", "kick", 0.0, 1.0, 0.8)]}),
    "hats": doc({"beats": [0.0, 0.5, 1.0, 1.5, 2.0], "drumEvents": spam()}, duration=2.0),
    "fill": doc({"beats": [0.0, 0.5, 1.0, 1.5, 2.0], "drumEvents": [
        hit("kick-1", "kick", 0.0, 0.95), hit("hat-1", "closed hat", 0.0, 0.55), hit("tom-high", "rack tom 1", 1.0, 0.78), hit("kick-under-fill", "kick", 1.0, 0.82),
        hit("hat-fill", "closed hat", 1.125, 0.50), hit("tom-mid", "middle rack tom", 1.5, 0.80), hit("crash-resolve", "crash", 1.5, 0.92),
        hit("snare-under-fill", "snare", 1.5, 0.60), hit("hat-resolve", "closed hat", 1.625, 0.48)]}, duration=2.0),
    "groove": doc({"beats": [0.0, 0.5, 1.0, 1.5, 2.0]}, duration=2.0),
    "bare": doc({}, tempo=None, duration=1.0),
    "nested": {"result": doc({"timing": {"beats": [{"time": {"seconds": 0.0}}, {"position": {"seconds": 0.5}}, {"start": {"seconds": 1.0}}]},
                              "drumEventCandidates": [{"id": "k", "position": {"seconds": 0.24}, "instrument": {"label": "bass drum"}, "velocity": 0.9}]}, duration=1.5)},
}


@pytest.fixture(scope="module")
def result(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in DOCS.items()], "track_id string, text string")
    r = C.generate_charts(df.select("track_id", F.try_parse_json("text").alias("raw")))
    rows = {}
    for name in ("beat_grid", "drum_events", "normalized", "charts", "notes", "measures"):
        key = "track_id" if "track_id" in r[name].columns else "chart_id"
        rows[name] = {}
        for x in r[name].collect():
            rows[name].setdefault(x[key], []).append(x)
    return rows


def ticks(result, k):
    return [n.tick for n in sorted(result["notes"][k], key=lambda n: (n.tick, n.lane))]


def test_quarter_slots(result):
    assert len(result["beat_grid"]["quarters"]) == 12
    assert ticks(result, "quarters") == [120, 360]
    assert "4x" in result["charts"]["quarters"][0].note
    assert result["charts"]["quarters"][0].timing_source == "generated"
    assert result["charts"]["quarters"][0].difficulty == "prototype"


def test_triplets_are_inferred(result):
    assert len(result["beat_grid"]["triplets"]) == 9
    assert ticks(result, "triplets") == [0, 320]
    assert "3x" in result["normalized"]["triplets"][0].note


def test_explicit_slots(result):
    assert len(result["beat_grid"]["explicit"]) == 6
    assert ticks(result, "explicit") == [160, 800]
    assert sorted(n.subdivision_index for n in result["notes"]["explicit"]) == [1, 5]


def test_bars_are_repaired(result):
    beats = sorted(a.start_seconds for a in result["beat_grid"]["repaired"] if a.subdivision_in_beat == 0)
    assert beats == pytest.approx([0.0, 0.495, 0.99, 1.485, 1.98, 2.48, 2.98, 3.48, 3.98])
    assert ticks(result, "repaired") == [40, 1000, 1960]


def test_dropped_candidates(result):
    n = result["normalized"]["dropped"][0]
    assert (n.diagnostics.raw_count, n.diagnostics.mapped_count, n.diagnostics.post_shaping_count) == (3, 1, 1)
    assert [(e.lane, e.velocity) for e in result["drum_events"]["dropped"]] == [("tom_low", 1.0)]
    assert n.lane_summary == "tom_low=1"
    assert n.confidence_summary == "high=1 medium=0 low=0 unknown=0"
    assert any("without onset timing" in w for w in n.warnings)
    assert any("Mapped 1 of 3 analyzer drum-event candidates" in w for w in n.warnings)


def test_duplicates_collapse(result):
    events = sorted(result["drum_events"]["collapsed"], key=lambda e: e.onset_seconds)
    assert [e.event_id for e in events] == ["kick", "snare-strong"]
    assert ticks(result, "collapsed") == [0, 440]
    assert result["normalized"]["collapsed"][0].diagnostics.deduplicated_count == 1


def test_hat_spam_is_thinned(result):
    hats = sorted(n.subdivision_index for n in result["notes"]["hats"] if n.lane == "hihat_closed")
    assert hats == [0, 1, 8, 9]


def test_fill_keeps_toms_and_crash(result):
    strength = lambda e: e.confidence if e.confidence is not None else e.velocity
    events = sorted(result["drum_events"]["fill"], key=lambda e: (e.onset_seconds, -strength(e), e.lane))
    assert [e.event_id for e in events] == ["kick-1", "hat-1", "kick-under-fill", "tom-high", "crash-resolve", "tom-mid", "snare-under-fill"]


def test_groove_without_hits(result):
    events = result["drum_events"]["groove"]
    assert sorted(e.onset_subdivision_index for e in events if e.lane == "hihat_closed") == [0, 8, 10, 16]
    assert sum(e.lane == "crash" for e in events) == 1
    assert "heuristicDrumEvents fallback output" in result["charts"]["groove"][0].note
    assert result["normalized"]["groove"][0].event_source == "heuristicDrumEvents"


def test_grid_without_timing(result):
    assert len(result["beat_grid"]["bare"]) == 8
    assert result["charts"]["bare"][0].timing_source == "fallback"
    assert any("fallback 120 BPM" in w for w in result["normalized"]["bare"][0].warnings)


def test_nested_documents(result):
    assert [e.lane for e in result["drum_events"]["nested"]] == ["kick"]
    assert result["charts"]["nested"][0].timing_source == "generated"
