"""Searches of documents go to any depth, and chosen hits reach the charts."""

import json

import pytest
from pyspark.sql import functions as F

from beatloom.functions import documents as D
from beatloom.operators import arbitration as A
from beatloom.operators import payloads as P

KICK, SNARE = {"label": "kick", "time": 1.0}, {"label": "snare", "time": 2.0}


def wrap(value, keys):
    for key in keys:
        value = {key: value}
    return value


def frame(spark, *documents):
    rows = [(i, None if d is None else d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "track_id long, text string").select("track_id", F.try_parse_json("text").alias("raw"))


@pytest.mark.parametrize(
    ("document", "labels"),
    [
        ({"tracks": [{"events": [{"notes": [KICK]}]}, {"events": [{"notes": [SNARE]}]}]}, ["kick", "snare"]),
        ({"tracks": [{"groups": [{"items": [KICK]}, {"items": [SNARE]}]}]}, ["kick", "snare"]),
        ({"hits": {"event": {"label": "kick"}, "time": 1}}, ["kick"]),
        ({"hits": [], "drums": {"hits": [SNARE]}}, ["snare"]),
        ({"tracks": [{"hits": [KICK], "items": [SNARE]}]}, ["snare"]),
        (wrap({"events": [KICK, SNARE]}, [f"level{i}" for i in range(12)]), ["kick", "snare"]),
        ({"tracks": wrap([KICK], [f"level{i}" for i in range(15)])}, ["kick"]),
        ({"hits": 5}, None),
        ([KICK], None),
    ],
)
def test_hits_at_any_depth(document, labels):
    hits = D.parts(document)["hits"]
    found = hits and [{**json.loads(h["outer"]), **json.loads(h["inner"] or "{}")}["label"] for h in hits]
    assert found == labels


def test_siblings_with_equal_keys_count_once():
    assert [r[:3] for r in D.roots({"a": {"x": 1}, "b": {"x": 2}, "c": [{"y": 3}]})] == [(0, "$", "a|b|c"), (1, "$/a", "x"), (2, "$/c/00000000", "y")]


def test_frames(spark):
    deep = wrap({"beats": [0.5, 1.0, 1.5], "events": [KICK]}, [f"k{i}" for i in range(12)])
    boxes = wrap({"beats": [1], "events": [KICK, SNARE]}, ["result", "output", "payload", "data", "response", "prediction", "result"])
    counted = wrap({"hits": [1, 2, 3]}, ["drums", "timing", "percussion", "drums", "timing"])
    docs = frame(spark, deep, boxes, counted, {}, None, "not json", {"rawAnalyzerOutput": wrap({"beats": {"time": [{"seconds": 2}]}}, ["result", "data"])})
    times = P.extract_times(docs, "beats").groupBy("track_id").count().collect()
    assert {r["track_id"]: r["count"] for r in times} == {0: 3, 1: 1}
    assert {r["track_id"] for r in P.extract_hits(docs).collect()} == {0, 1}
    assert {r["track_id"]: r["n"] for r in docs.select("track_id", P.event_count("raw").alias("n")).collect()} == {0: 0, 1: 0, 2: 3, 3: 0, 4: 0, 5: 0, 6: 0}
    assert [r["track_id"] for r in P.validate_payload(docs).filter("issue is null").orderBy("track_id").collect()] == [1, 6]
    assert [r["n"] for r in docs.select(F.size(P.stage_events("raw")).alias("n")).filter("n >= 0").collect()] == [2, 3]
    inner = P.unwrap_payload(frame(spark, wrap({"beats": [1]}, ["result", "output"] * 6))).select(F.to_json("payload")).first()[0]
    assert json.loads(inner) == {"beats": [1]}


def test_arbitration_reaches_the_charts(spark):
    timing = {"beats": [i / 2 for i in range(16)], "warnings": ["own"]}
    primary = frame(spark, timing, None, {**timing, "hits": [SNARE]})
    fallback = frame(spark, {"events": [KICK, SNARE], "warnings": ["theirs"]}, {"hits": [KICK]}, {"hits": [KICK]})
    chosen = A.arbitrate(primary, fallback, "on-error-or-invalid", "none")
    rows = {r["track_id"]: r for r in chosen.select("track_id", "selected_backend", "warnings", F.to_json("raw").alias("raw")).collect()}
    assert {k: r["selected_backend"] for k, r in rows.items()} == {0: "primary+fallback-events", 1: "fallback", 2: "primary"}
    first = json.loads(rows[0]["raw"])
    assert first["drumEvents"] == [KICK, SNARE] and first["warnings"] == list(rows[0]["warnings"])
    assert first["runtime"]["eventBackendUsed"] is True and first["runtime"]["eventBackendCandidateCount"] == 2 and first["runtime"]["fallbackUsed"] is False
    hits = P.project_hits(P.extract_hits(chosen.select("track_id", "raw"))).groupBy("track_id").agg(F.sort_array(F.collect_list("lane")).alias("l")).collect()
    assert {r["track_id"]: len(r["l"]) for r in hits} == {0: 2, 1: 1, 2: 1}
    merged = A.merge_events(frame(spark, timing), frame(spark, {"hits": [KICK]}))
    facts = P.normalize_analysis(merged.select("track_id", "raw")).select("event_provenance.event_source").first()
    assert facts[0] == "stage2_backend"


def test_analyzer_with_too_few_answers(spark):
    tracks = spark.createDataFrame([(i,) for i in range(4)], "track_id long").coalesce(1)
    got = A.with_analyzer(tracks, lambda batch: batch.iloc[1:].assign(payload="{}")).collect()
    assert len(got) == 4 and all(r["payload"] is None and r["error"] for r in got)
