"""Ordered operators against short sequential rules on random data that spans many chunks."""

import random

import pytest
from pyspark.sql import functions as F

from beatloom.operators import diffs as D
from beatloom.operators import grid as G
from beatloom.operators import ordered as O
from beatloom.operators import signal as SG


@pytest.fixture(scope="module")
def times():
    rnd = random.Random(7)
    # one hot track holding most rows, a sparse one with long gaps, a dense one
    out = {1: [], 2: [], 3: []}
    out[1] = [rnd.uniform(0, 400) for _ in range(3000)]
    out[2] = [rnd.choice([0, 100, 1000, 5000]) + rnd.uniform(0, 5) for _ in range(40)]
    t = 0.0
    for _ in range(500):
        t += rnd.choice([0.0001, 0.0003, 0.0004, 0.0006, 0.02])
        out[3].append(t)
    return {k: sorted(set(v)) for k, v in out.items()}


def frame(spark, times, name="start_seconds"):
    return spark.createDataFrame([(k, x) for k, v in times.items() for x in v], f"track_id long, {name} double")


def by_track(rows, value):
    out = {}
    for r in rows:
        out.setdefault(r.track_id, []).append(value(r))
    return out


def test_neighbors_and_running(spark, times):
    d = frame(spark, times).withColumn("__c", O.time_chunk("start_seconds"))
    d = O.neighbors(d, ["track_id"], ["start_seconds"], "__c", prev={"p": "start_seconds"}, next={"n": "start_seconds"})
    d = O.running(d, ["track_id"], ["start_seconds"], "__c", sums={"i": F.lit(1)}, lasts={"l": F.when(F.floor(F.col("start_seconds") * 1000) % 5 == 0, F.col("start_seconds"))})
    for track, rows in by_track(d.collect(), lambda r: r).items():
        rows.sort(key=lambda r: r.start_seconds)
        last = None
        for i, r in enumerate(rows):
            if int(r.start_seconds * 1000 // 1) % 5 == 0:
                last = r.start_seconds
            assert r.p == (rows[i - 1].start_seconds if i else None)
            assert r.n == (rows[i + 1].start_seconds if i + 1 < len(rows) else None)
            assert (r.i, r.l) == (i + 1, last)


def test_asof(spark, times):
    rnd = random.Random(3)
    left = {k: [rnd.uniform(-20, max(v) + 200) for _ in range(300)] for k, v in times.items()}
    left[9] = [1.0, 2.0]  # a track without right rows
    m = O.asof(frame(spark, left, "t"), frame(spark, times), ["track_id"], "t", "start_seconds", ["start_seconds"])
    rows = m.collect()
    assert len(rows) == sum(map(len, left.values()))
    for r in rows:
        before = [x for x in times.get(r.track_id, []) if x <= r.t]
        assert (r.match.start_seconds if r.match else None) == (max(before) if before else None)


def test_normalize_starts(spark, times):
    got = by_track(G.normalize_starts(frame(spark, times)).collect(), lambda r: r.start_seconds)
    for track, values in times.items():
        kept = []
        for v in values:
            if not kept or abs(kept[-1] - v) > 0.0005:
                kept.append(v)
        assert sorted(got[track]) == kept


def test_match_onsets(spark, times):
    rnd = random.Random(5)
    right = {k: sorted(x + rnd.uniform(-0.06, 0.06) for x in v if rnd.random() < 0.8) for k, v in times.items()}
    pos = lambda t: spark.createDataFrame([(k, i, x) for k, v in t.items() for i, x in enumerate(v)], "track_id long, pos long, onset_seconds double")
    got = D.match_onsets(pos(times), pos(right)).collect()
    pairs = {(r.track_id, r.primary_pos, r.fallback_pos) for r in got if r.primary_pos is not None and r.fallback_pos is not None}
    want = set()
    for k, lefts in times.items():
        used = set()
        for i, x in enumerate(lefts):
            best = None
            for j, y in enumerate(right[k]):
                if j not in used and abs(y - x) <= 0.05 and (best is None or abs(y - x) < abs(right[k][best] - x)):
                    best = j
            if best is not None:
                used.add(best)
                want.add((k, i, best))
    assert pairs == want
    assert len(got) == sum(map(len, times.values())) + sum(map(len, right.values())) - len(want)


def test_dedupe_same_lane(spark, times):
    rnd = random.Random(11)
    lanes = ["kick", "snare", "closed_hihat"]
    rows = [(k, t, lane, lane, rnd.random(), 0.5) for k, v in times.items() for t in v for lane in [rnd.choice(lanes)]]
    df = spark.createDataFrame(rows, "track_id long, onset_seconds double, lane string, label string, confidence double, beat_interval double")
    got = {(r.track_id, r.onset_seconds, r.lane) for r in SG.dedupe_same_lane(df).collect()}
    gaps = {"kick": 0.075, "snare": 0.10, "closed_hihat": 0.055}
    want = set()
    for k in times:
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            gap = min(gaps[r[2]], max(0.5 * 0.24, 0.045))
            if kept and kept[-1][2] == r[2] and r[1] - kept[-1][1] < gap:
                if r[4] > kept[-1][4]:
                    kept[-1] = r
                continue
            kept.append(r)
        want |= {(r[0], r[1], r[2]) for r in kept}
    assert got == want


def test_detect_peaks(spark):
    rnd = random.Random(2)
    series = {1: [rnd.random() for _ in range(9000)], 2: [0.0] * 50 + [rnd.random() for _ in range(50)]}
    df = spark.createDataFrame([(k, i, v) for k, s in series.items() for i, v in enumerate(s)], "track_id long, frame long, novelty double")
    thr = SG.peak_threshold(df)
    got = by_track(SG.detect_peaks(df, thr, 400, 8).collect(), lambda r: r.frame)
    gap = max(1, int(0.07 * 400 / 8))
    for k, s in series.items():
        ordered = sorted(s)
        limit = max(ordered[min(len(s) - 1, max(0, int(round((len(s) - 1) * 0.85))))], sum(s) / len(s) * 1.35)
        peaks = []
        for i in range(1, len(s) - 1):
            if s[i] < limit or s[i] < s[i - 1] or s[i] < s[i + 1]:
                continue
            if peaks and i - peaks[-1] < gap:
                if s[i] > s[peaks[-1]]:
                    peaks[-1] = i
                continue
            peaks.append(i)
        assert sorted(got.get(k, [])) == peaks


def test_ranks_with_an_outlier(spark):
    rnd = random.Random(6)
    values = {1: [rnd.gauss(0, 1) for _ in range(2000)] + [1e300, -1e300, 0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 1e-310, float("inf")], 2: [2.0**k for k in range(-60, 60)] + [3.0] * 50, 3: [7.5], 4: [-1.0, None, -2.0]}
    df = spark.createDataFrame([(k, x) for k, v in values.items() for x in v], "track_id long, x double")
    got = {(r.track_id, r.k): r.rank_value for r in O.at_ranks(df, "x", F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).collect()}
    want = {(k, i): x for k, v in values.items() for i, x in enumerate(sorted(x for x in v if x is not None))}
    assert got == want


def test_streamed_rules_use_one_exchange(spark, times):
    d = frame(spark, times).withColumn("__c", O.time_chunk("start_seconds"))
    d = O.neighbors(d, ["track_id"], ["start_seconds"], "__c", prev={"p": "start_seconds"})
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
