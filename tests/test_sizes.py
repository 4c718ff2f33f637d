"""Work that must not grow faster than its input: packed grids, joins of exploded rows, slices of documents, log files."""

import glob
import json

from pyspark.sql import functions as F

from beatloom.functions import documents as D
from beatloom.operators import compare as C
from beatloom.operators import corpus as P
from beatloom.operators import events as E
from beatloom.operators import folds
from beatloom.operators import grid as G
from beatloom.operators import metrics as M
from beatloom.operators import notes as N
from beatloom.operators import ordered as O
from beatloom.operators import signal as SG
from beatloom.plans import catalog_charts as Q
from beatloom.plans import catalog_sources as CS
from beatloom.plans import views as V
from beatloom.sources import files
from beatloom.streaming import jobs as J

SUMMARY = "track_id long, tempo_bpm double, downbeat_offset double, duration_seconds double, confidence double"
TRACKS = [(1, 120.0, 0.0, 72.0, None), (2, None, 0.3, None, 0.5), (3, 97.0, 1.7, 40.3, None), (4, 0.2, -1.0, 3.0, None), (5, 133.7, 15.9, 33.1, None), (6, 60.0, 0.0, 16.0, None), (7, 300.0, 2.0, 0.1, None)]


def broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def rows(df, array, key):
    return {(r[0], r[1]): sorted(map(tuple, r[2])) for r in df.select("track_id", key, array).collect()}


def test_packed_grids_made_from_the_tracks_hold_the_grid(spark):
    s = spark.createDataFrame(TRACKS, SUMMARY)
    grid = G.fallback_grid(s)
    assert rows(G.fallback_beats(s), "beats", "__b") == rows(E.packed_beats(grid), "beats", "__b")
    assert rows(G.fallback_slots(s), "slots", "__s") == rows(N.packed_slots(grid), "slots", "__s")


def test_hits_meet_packed_and_plain_grids_alike(spark):
    s = spark.createDataFrame(TRACKS, SUMMARY)
    hits = spark.range(900).select((F.col("id") % 9).alias("track_id"), F.when(F.col("id") % 50 != 7, F.col("id") / 9 - 2).alias("onset_seconds"), "id")
    grid = G.fallback_grid(s)
    plain, packed = (sorted(map(str, E.nearest_anchor(hits, grid, b).collect())) for b in (None, G.fallback_beats(s)))
    assert plain == packed and len(plain) == 900
    # against every slot of the beat that holds the onset
    g = {}
    for r in grid.collect():
        g.setdefault(r.track_id, {}).setdefault(r.beat_index, []).append((r.start_seconds, r.subdivision_index))
    for r in E.nearest_anchor(hits, grid, G.fallback_beats(s)).collect():
        beats, t = sorted((min(a), sorted(a)) for a in g.get(r.track_id, {}).values()), r.onset_seconds
        if not beats or t is None:
            assert r.anchor is None
            continue
        held = [a for b, a in beats if b[0] <= t]
        want = min((abs(x - t), x, i) for x, i in (held[-1] if held else beats[0][1][:1]))
        assert (r.anchor.distance, r.anchor.start_seconds, r.anchor.subdivision_index) == want


def test_joins_of_exploded_rows_are_no_broadcasts(spark):
    tracks = spark.range(5).select(F.col("id").alias("track_id"))
    beats = tracks.select("track_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n")).select("track_id", "n", (F.col("n") * 0.5).alias("start_seconds"))
    downs = beats.where("n % 4 = 0").select("track_id", "start_seconds")
    s = tracks.select("track_id", F.lit(120.0).alias("tempo_bpm"))
    assert not broadcasts(G.match_downbeats(beats, downs))
    measures = tracks.select(F.col("track_id").alias("chart_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("bar_index")).withColumns({"start_beat_index": F.col("bar_index") * 4, "beat_count": F.lit(4)})
    notes = beats.select(F.col("track_id").alias("chart_id"), F.col("n").alias("beat_index"))
    assert not broadcasts(M.note_measure(notes, measures))
    assert not broadcasts(M.measure_density(notes, measures))
    assert not broadcasts(N.note_anchor(beats.select("track_id", F.col("n").alias("onset_subdivision_index")), beats.select("track_id", F.col("n").alias("beat_index"), F.col("n").alias("subdivision_index"), F.lit(0).alias("subdivision_in_beat"))))
    shift = "BroadcastHashJoin [track_id#"  # the shift of a track is one row and may be broadcast to others, not to its beats
    plan = G.snap_downbeats(downs, s)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan.split(shift)[0]


def test_documents_are_parsed_in_slices(spark):
    import pandas as pd

    text = pd.Series(["x" * 10] * 25 + [None, "y" * 95, "z"])
    parts = [p for (p,) in D.slices((text,), 50)]
    assert [x for p in parts for x in p] == list(text)
    assert all(sum(len(x or "") for x in p[:-1]) < 50 for p in (list(p) for p in parts)) and len(parts) > 4
    docs = spark.range(3000).select("id", F.try_parse_json(F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit(',"t":"'), F.repeat(F.lit("ab"), 600), F.lit('"}'))).alias("v"))
    got = docs.select("id", D.over(lambda d: d["n"] * 2, "long", "v").alias("m"))
    assert got.where("m = id * 2").count() == 3000


def test_logs_many_to_a_file(spark, tmp_path):
    log = lambda i: "starting\n" + json.dumps({"validate_analyzer": [i]})
    root = str(tmp_path / "logs")
    spark.range(300).select(F.udf(log)("id").alias("text")).coalesce(2).write.option("lineSep", files.RECORD).text(root)
    assert len(glob.glob(root + "/part-*")) <= 2
    docs = files.read_log_json(spark, root, files.RECORD)
    assert docs.where("raw is not null").select("batch").distinct().count() == 300


SF = "/root/testdata/sf0.001"


def test_joins_of_charts_and_reports_are_no_broadcasts(spark):
    r = Q.reports(spark, SF)
    assert not broadcasts(r)
    assert not broadcasts(C.compare(r, r))
    assert not broadcasts(C.join_baseline(r, r))


def test_joins_of_a_corpus_are_no_broadcasts(spark):
    e, s, n = V.expectations(spark, SF), V.songs(spark, SF), V.measures(spark, SF).withColumn("note_count", F.lit(1))
    r = Q.reports(spark, SF).withColumn("comparison", F.lit("stable"))
    for df in (*P.join_expectations(e, V.charts(spark, SF)), P.lint(s, e), P.tag_summary(e, r, s), P.difficulty_summary(e, r), P.render_results(r, s, n)):
        assert not broadcasts(df)


def test_tracks_stay_dealt_over_a_fixed_number_of_tasks(spark):
    beats = V.beats(spark, SF).groupBy("track_id", "n").count()
    assert "REPARTITION_BY_NUM" in beats._jdf.queryExecution().executedPlan().toString()


def test_regular_grids_by_arithmetic_hold_the_grid(spark):
    s = spark.createDataFrame(TRACKS, SUMMARY)
    edges = G.fallback_grid(s).select("track_id", F.explode(F.array(F.col("start_seconds"), F.col("start_seconds") + 1e-9, F.col("start_seconds") - 1e-9)).alias("onset_seconds"))
    spread = spark.range(3000).select((F.col("id") % 9).alias("track_id"), F.when(F.col("id") % 50 != 7, F.col("id") / 30 - 3).alias("onset_seconds"))
    far = spark.createDataFrame([(i, t) for i in range(1, 8) for t in (-1e9, 1e9, 0.0, None)], "track_id long, onset_seconds double")
    hits = edges.unionByName(spread).unionByName(far)
    for most in (None, 9):
        grid = G.fallback_grid(s) if most is None else G.fallback_grid(s).where(F.col("beat_index") < most)
        plain, regular = (sorted(map(str, df.collect())) for df in (E.nearest_anchor(hits, grid), E.nearest_anchor(hits, None, regular=G.regular(s, most))))
        assert plain == regular and len(plain) > 3000
        at = spark.range(-3, 400).crossJoin(s.select("track_id")).select("track_id", F.when(F.col("id") % 9 != 5, F.col("id")).cast("int").alias("onset_subdivision_index"))
        plain, regular = (sorted(map(str, df.collect())) for df in (N.note_anchor(at, grid), N.note_anchor(at, None, regular=G.regular(s, most))))
        assert plain == regular and len(plain) == 403 * len(TRACKS)


def test_hits_and_notes_move_no_slots(spark):
    plan = V.notes_base(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "anchors" not in plan and "slots" not in plan and "BroadcastHashJoin [track_id" not in plan


def test_preview_changes_make_each_side_once(spark):
    schema = "chart_id long, line string"
    base = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None), (None, "x"), (3, "q")], schema)
    cand = spark.createDataFrame([(1, "b"), (1, "c"), (1, "c"), (2, None), (None, "y"), (None, "x")], schema)
    got = C.preview_changes(base, cand, ["chart_id"])
    assert sorted(map(tuple, got.select("chart_id", "change", "line").fillna(-1).collect())) == [(-1, "added", "y"), (1, "added", "c"), (1, "removed", "a"), (3, "removed", "q")]
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2


def test_summaries_make_no_reports_they_do_not_count(spark, monkeypatch):
    cuts = []

    def counted(df):
        cuts.append(1)
        return df

    for module in (P, Q):
        monkeypatch.setattr(module, "cut", counted)
    for query, most in ((Q.a13, 1), (Q.a14, 1)):
        cuts.clear()
        query(spark, SF)
        assert len(cuts) <= most  # notes of the candidates


def test_streamed_charts_take_few_batches_and_few_tasks(spark, tmp_path, monkeypatch):
    root, out, seen = tmp_path / "in", str(tmp_path / "out"), []
    root.mkdir()
    for i in range(60):
        (root / f"clip-{i}.json").write_text('{"beats":[0.5]}')

    def charts(batch):
        seen.append((batch.rdd.getNumPartitions(), batch.sparkSession.conf.get(J.LISTING)))
        ids = batch.select(F.col("track_id").alias("chart_id"))
        return {"charts": ids, "measures": ids, "notes": ids}

    monkeypatch.setattr(J.C, "generate_charts", charts)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        J.stream_charts(spark, str(root), out, out + "-checkpoint", files_per_batch=20, bytes_per_batch=1 << 20).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(seen) == 1 and seen[0][0] <= 8 and int(seen[0][1]) == 32
    assert spark.read.parquet(out + "/charts").select("chart_id").distinct().count() == 60


def exploded(spark):
    tracks = spark.range(6).select(F.col("id").alias("track_id"))
    beats = tracks.select("track_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("beat_index"))
    beats = beats.withColumn("start_seconds", F.col("beat_index") * 0.5 + (F.col("beat_index") * 7 + F.col("track_id")) % 11 / 1000)
    hits = tracks.select("track_id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("event_id")).withColumn("onset_seconds", F.col("event_id") * 0.21)
    lane = F.when(F.col("event_id") % 3 == 0, "snare").when(F.col("track_id") == 5, "kick").otherwise("closed_hihat")
    return hits.withColumns({"lane": lane, "label": lane, "confidence": F.least(F.lit(0.4) + F.col("event_id") % 7 / 10, F.when(F.col("track_id") % 3 == 1, 0.69).otherwise(0.99))}), beats


def test_nearest_beats_and_their_medians_are_no_broadcasts(spark):
    hits, beats = exploded(spark)
    assert not broadcasts(E.nearest_beat(hits, beats))
    assert not broadcasts(O.median(beats, "start_seconds"))
    chunked = beats.withColumn("__c", O.time_chunk("start_seconds"))
    assert not broadcasts(O.row_index(chunked, ["track_id"], ["start_seconds"], "__c", "i"))


def test_folds_over_located_hits_are_no_broadcasts(spark):
    hits, beats = exploded(spark)
    assert not broadcasts(SG.dedupe_same_lane(E.nearest_beat(hits, beats)))
    sides = hits.select("track_id", F.col("onset_seconds").alias("t"), (F.col("event_id") % 2).alias("side"), F.col("event_id").alias("pos"))
    assert not broadcasts(folds.match_sides(sides, 0.05))


def test_weak_hits_are_no_broadcasts(spark):
    assert not broadcasts(SG.filter_weak(E.nearest_beat(*exploded(spark))))


def test_promoted_kicks_are_no_broadcasts(spark):
    hits, beats = exploded(spark)
    located = hits.withColumns({"nearest_index": F.col("event_id"), "beat_distance": F.lit(0.2), "beat_interval": F.lit(0.5)})
    got = SG.promote_kicks(located)
    assert not broadcasts(got)
    # 34 snares in each track but the last, none near a beat: the strongest 32 percent, 11 of each
    assert [tuple(r) for r in got.where("promoted").groupBy("track_id").count().orderBy("track_id").collect()] == [(t, 11) for t in range(5)]


def test_streams_are_written_by_all_tasks_and_read_in_parts(spark, tmp_path):
    root, seen = str(tmp_path / "in"), []
    df = spark.range(0, 900, numPartitions=6).select("id", F.concat(F.lit("k"), "id").alias("name"))
    s = CS.as_stream(df, root)
    assert len(glob.glob(root + "/part-*")) == 18
    keep = lambda batch, i: seen.append([r.id for r in batch.collect()])
    s.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and all(200 < len(x) < 400 for x in seen)
    assert sorted(sum(seen, [])) == list(range(900))
