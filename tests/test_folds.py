"""Folds cut where few states are open, and chunk arrays, against short sequential rules."""

import bisect
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beatloom.functions import arrays as A
from beatloom.functions import variants as V
from beatloom.operators import diffs as D
from beatloom.operators import folds
from beatloom.operators import grid as G
from beatloom.operators import ordered as O
from beatloom.operators import signal as SG

TOLERANCE = 0.0005


def spaced(t):
    kept = []
    for v in t:
        if not kept or not abs(kept[-1] - v) <= TOLERANCE:
            kept.append(v)
    return kept


def matching(p, q, tolerance=0.05):
    used, pairs = set(), set()
    for i, x in enumerate(p):
        best = None
        for j in range(bisect.bisect_left(q, x - tolerance - 1e-6), bisect.bisect_right(q, x + tolerance + 1e-6)):
            if j not in used and abs(q[j] - x) <= tolerance and (best is None or abs(q[j] - x) < abs(q[best] - x)):
                best = j
        if best is not None:
            used.add(best)
            pairs.add((i, best))
    return pairs


def test_arrays(spark):
    rnd = random.Random(1)
    rows = []
    for s in range(60):
        t, x = [], rnd.choice([0.0, 16.0, 1000.0])
        for _ in range(rnd.randint(0, 60)):
            x += rnd.choice([0.0001, 0.0005, 0.0005, 0.0003, 0.02])
            t.append(x)
        rows.append((s, sorted(set(t))))
    df = spark.createDataFrame(rows, "i int, t array<double>")
    got = df.select(
        "t", F.expr(A.keep_spaced("t", TOLERANCE)).alias("k"), F.expr(A.keep_spaced("t", TOLERANCE, "2")).alias("k2"),
        F.expr(A.exits("t", TOLERANCE, "least(3, size(t))")).alias("e"),
        F.expr(A.scan("t", "0D", lambda s, x: (f"{s} + {x}", s), "double", "double")).alias("s"),
    ).collect()
    for r in got:
        assert r.k == spaced(r.t) and r.k2 == spaced(r.t[2:])
        for k, e in enumerate(r.e):
            rest = spaced(r.t[k:])
            assert (e.last, e.n) == (rest[-1] if rest else None, len(rest))
        assert r.s.out == [sum(r.t[:i]) for i in range(len(r.t))] or max(abs(a - sum(r.t[:i])) for i, a in enumerate(r.s.out)) < 1e-9


def test_many_near_repeats_in_one_document(spark):
    near = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: i * 0.00012).alias("t"))
    assert near.select(V.normalize_starts("t").alias("k")).first().k[:2] == [0.0, 5 * 0.00012]
    t = time.time()
    assert len(near.select(V.normalize_starts("t").alias("k")).first().k) == 20_000
    assert time.time() - t < 5  # about a second on an idle machine; the quadratic way took minutes


def test_starts_across_chunks(spark):
    rnd = random.Random(4)
    t = {1: [i * 0.0003 for i in range(120_000)], 2: sorted({16 * rnd.randint(0, 3) + rnd.uniform(-0.002, 0.002) for _ in range(400)}), 3: [15.9999, 16.0, 16.0004, 16.0008, 31.9996, 32.0]}
    t[2] = [x for x in t[2] if x >= 0]
    df = spark.createDataFrame([(k, x) for k, v in t.items() for x in v], "track_id long, start_seconds double").repartition(6)
    got = {}
    for r in G.normalize_starts(df).collect():
        got.setdefault(r.track_id, []).append(r.start_seconds)
    for k, v in t.items():
        assert sorted(got[k]) == spaced(v)


@pytest.fixture(scope="module")
def sides():
    """Regular and random onsets, most of them without a gap for minutes."""
    rnd = random.Random(3)
    p, q = {}, {}
    n = 4000
    p[0] = [i * 0.04 for i in range(n)]
    q[0] = [x + 0.01 for x in p[0]]
    p[1], q[1] = (sorted(rnd.uniform(0, n * 0.02) for _ in range(n)) for _ in range(2))
    p[2] = sorted(round(rnd.uniform(0, n * 0.03), 2) for _ in range(n))
    q[2] = sorted(p[2] + [round(x + rnd.choice([0, 0.05, -0.05, 0.03]), 2) for x in p[2]])
    p[3] = [i * 0.03 for i in range(n)]
    q[3] = [i * 0.03 + 0.045 for i in range(n)]
    p[4] = [i * 0.05 for i in range(n)]
    q[4] = [x + (0.025 if i % 3 else 0.05) for i, x in enumerate(p[4])]
    p[5], q[5] = [], [1.0, 1.0]
    p[6], q[6] = [5.0, 5.0, 5.01], []
    p[7] = sorted(rnd.uniform(0, 40) for _ in range(n))  # so dense that no cut is allowed
    q[7] = sorted(x + rnd.uniform(-0.06, 0.06) for x in p[7])
    return p, q


def onsets(spark, t):
    return spark.createDataFrame([(k, i, x) for k, v in t.items() for i, x in enumerate(v)], "track_id long, pos long, onset_seconds double")


def test_matching_of_gap_free_runs(spark, sides):
    p, q = sides
    got = D.match_onsets(onsets(spark, p), onsets(spark, q)).collect()
    for k in p:
        rows = [r for r in got if r.track_id == k]
        want = matching(p[k], q[k])
        assert {(r.primary_pos, r.fallback_pos) for r in rows if r.primary_pos is not None and r.fallback_pos is not None} == want
        assert sorted(r.primary_pos for r in rows if r.primary_pos is not None) == list(range(len(p[k])))
        assert sorted(r.fallback_pos for r in rows if r.fallback_pos is not None) == list(range(len(q[k])))
        assert len(rows) == len(p[k]) + len(q[k]) - len(want)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_kinds_of_track_ids(spark, kind):
    p, q = onsets(spark, {1: [0.0, 1.0, 1.02], 2: [3.0]}), onsets(spark, {1: [0.01, 1.01], 3: [2.0]})
    as_kind = lambda df: df.withColumn("track_id", F.col("track_id").cast(kind))
    got = D.match_onsets(as_kind(p), as_kind(q))
    assert got.schema["track_id"].dataType.simpleString() == kind
    assert sorted(r.kind for r in got.collect()) == ["fallback_only", "primary_only", "primary_only", "shifted", "shifted"]
    hits = as_kind(spark.createDataFrame([(1, 0.0, "kick", "kick", 0.5, 0.5), (1, 0.01, "kick", "kick", 0.9, 0.5), (2, 0.0, "kick", "kick", 0.5, 0.5)], "track_id long, onset_seconds double, lane string, label string, confidence double, beat_interval double"))
    assert sorted((str(r.track_id), r.onset_seconds, r.merged) for r in SG.dedupe_same_lane(hits).collect()) == [("1", 0.01, 1), ("2", 0.0, 0)]


def test_a_gap_free_run_is_split(spark, sides):
    p, q = sides
    both = onsets(spark, {0: p[0]}).withColumn("side", F.lit(0)).unionByName(onsets(spark, {0: q[0]}).withColumn("side", F.lit(1)))
    base = O._placed(both.select("track_id", O.time_chunk("onset_seconds").alias("__c"), F.col("onset_seconds").alias("t"), "side", "pos"), ["track_id"], "__c")
    cuts = folds.streamed(base, ["track_id", "__c"], ["t", "side", "pos"], folds._match_cut(pa.int64(), 0.05, 16.0, 2.0), "track_id long, __c long, low double, high double").collect()
    # 160 seconds without a gap wider than 0.03: a cut in each of ten chunks
    assert len(cuts) == 10 and all(r.low is not None for r in cuts)


def test_last_kept_of_gap_free_runs(spark):
    rnd = random.Random(5)
    rows = []
    for track in range(8):
        t = 0.0
        for i in range(2500):
            t = round(t + (rnd.choice([0.0, 0.03, 0.01, 0.05, 0.0749, 0.075]) if track % 2 else 0.02), 4)
            t += 20 if track == 4 and rnd.random() < 0.01 else 0
            lane = rnd.choice(["kick", "snare", "closed_hihat"]) if track % 3 == 0 else "kick"
            strength = 0.5 if track == 2 else i / 2500 if track == 7 else round(rnd.random(), 2 if track % 4 else 1)
            rows.append((track, t, lane, str(i), strength, 0.5 if track % 3 else None))
    df = spark.createDataFrame(rows, "track_id long, onset_seconds double, lane string, label string, confidence double, beat_interval double").repartition(5)
    got = sorted((r.track_id, r.onset_seconds, r.lane, r.label, r.merged) for r in SG.dedupe_same_lane(df).collect())
    gaps, want = {"kick": 0.075, "snare": 0.10, "closed_hihat": 0.055}, []
    for track in range(8):
        kept = []
        for r in sorted((r for r in rows if r[0] == track), key=lambda r: (r[1], r[2], r[4], r[3])):
            gap = min(gaps[r[2]], max(0.5 * 0.24, 0.045)) if r[5] else gaps[r[2]]
            if kept and kept[-1][0][2] == r[2] and r[1] - kept[-1][0][1] < gap:
                kept[-1][1] += 1
                if r[4] > kept[-1][0][4]:
                    kept[-1][0] = r
                continue
            kept.append([r, 0])
        want += [(r[0], r[1], r[2], r[3], m) for r, m in kept]
    assert got == sorted(want)


def test_beat_grid_starts_no_job(spark):
    beats = spark.createDataFrame([(1, 0.5 * i) for i in range(100)], "track_id long, start_seconds double")
    summary = spark.createDataFrame([(1, 120.0, 0.5)], "track_id long, tempo_bpm double, confidence double")
    spark.sparkContext.setJobGroup("grid", "building a grid")
    try:
        grid = G.beat_grid(beats, beats.where("start_seconds % 2 = 0"), None, summary)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("grid")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = grid.where("is_downbeat").orderBy("start_seconds").collect()
    assert [r.start_seconds for r in rows] == [2.0 * i for i in range(25)] and [r.bar_index for r in rows] == list(range(25))
