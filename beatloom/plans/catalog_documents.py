"""Queries over analyzer documents built from ``events``.

Sixty-four consecutive events make one clip, so a document's size does not depend on how the
events are spread over users.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from beatloom.functions import labels as L
from beatloom.functions import scalars as S
from beatloom.functions import variants as X
from beatloom.operators import adtof as AD
from beatloom.operators import arbitration as AR
from beatloom.operators import charts as C
from beatloom.operators import contracts as CT
from beatloom.operators import payloads as P
from beatloom.plans import views as V
from beatloom.plans.registry import WITH, query, r6

CLIP = 64


def clip_events(spark, sf):
    e = V.table(spark, sf, "events")
    i = F.col("event_id")
    midi = F.lit(35) + F.get_json_object("props", "$.k").cast("int") % 30
    return e.select(
        F.floor(i / CLIP).alias("track_id"), i.alias("event_id"), midi.alias("midi"),
        F.when(i % 50 != 3, F.round((i % CLIP) * 0.13 + (i % 7) / 100, 6)).alias("onset"),
        F.coalesce(L.midi_lane(midi, "adtof"), F.col("event_type")).alias("label"),
        F.round(F.col("value") / 25, 6).alias("strength"), F.when(i % 10 != 0, F.round(F.col("value") / 500, 6)).alias("confidence"),
    )


WITH["clip_events"] = """SELECT h.event_id // 64 AS track_id, h.event_id, h.midi, CASE WHEN h.event_id % 50 <> 3 THEN round((h.event_id % 64)*0.13::DOUBLE + (h.event_id % 7)/100.0::DOUBLE, 6) END AS onset,
 coalesce(a.label, h.label) AS label, round(e.value/25, 6) AS strength, CASE WHEN h.event_id % 10 <> 0 THEN round(e.value/500, 6) END AS confidence
 FROM hits h JOIN events e USING (event_id) LEFT JOIN midi_adtof a ON a.note = h.midi"""
WITH["clips"] = "SELECT track_id, count(*) AS n, track_id % 31 = 7 AS bad, track_id % 3 AS shape, track_id % 5 AS rt FROM clip_events GROUP BY 1"


def payloads(spark, sf):
    """One document per clip in three shapes, some of them malformed."""
    c = F.col("track_id")
    g = clip_events(spark, sf).groupBy("track_id").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "onset", "label", "strength", "confidence"))).alias("h")
    )
    ident = lambda x: F.concat(F.lit("e"), x["event_id"].cast("string"))
    plain = F.transform("h", lambda x: F.struct(ident(x).alias("eventID"), x["label"].alias("label"), x["onset"].alias("onsetSeconds"), x["strength"].alias("velocity"), x["confidence"].alias("confidence")))
    nested = F.transform("h", lambda x: F.struct(ident(x).alias("id"), F.struct(x["label"].alias("name")).alias("class"), F.struct(x["onset"].alias("seconds")).alias("position"), x["strength"].alias("strength"), x["confidence"].alias("probability")))
    wrapped = F.transform("h", lambda x: F.struct(ident(x).alias("id"), F.struct(x["label"].alias("label"), x["onset"].alias("time")).alias("hit"), x["strength"].alias("amplitude"), x["confidence"].alias("score")))
    beats = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda k: k * 0.5)
    beat_objects = F.transform(beats, lambda b: F.struct(F.struct(b.alias("seconds")).alias("time")))
    downs = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: k * 2.0)
    words = "beat-this-backend.py"
    runtime = (
        F.when(c % 5 == 1, F.to_json(F.struct(F.lit(f"scripts/{words}").alias("backend"), (c % 2 == 0).alias("fallbackUsed"), F.lit("cmd").alias("backendCommand"))))
        .when(c % 5 == 2, F.to_json(F.struct(F.lit("primary").alias("selectedBackend"), F.lit("python scripts/backend-analyzer.py").alias("timingBackendCommand"))))
        .when(c % 5 == 3, F.to_json(F.struct(F.lit(True).alias("eventBackendRan"), F.lit("no").alias("eventBackendUsed"), F.lit(0).alias("eventBackendCandidateCount"))))
        .when(c % 5 == 4, F.to_json(F.struct(F.lit("fallback").alias("selectedBackend"), F.lit("madmom-fallback-backend.py").alias("backendCommand"), F.lit("primary backend failed: status 3").alias("fallbackReason"))))
        .otherwise("{}")
    )
    analysis = F.to_json(
        F.struct(F.when(c % 4 != 1, 100.0 + c % 50).alias("estimatedTempoBPM"), F.when(c % 4 == 2, F.lit("8.5")).otherwise("9.0").alias("durationSeconds"), ((c % 10) / 10).alias("confidence"),
                 F.when(c % 4 == 3, F.lit(2)).alias("audioTrackCount"))
    )
    warn = F.to_json(F.array(F.lit("first"), F.concat(F.lit("clip "), (c % 3).cast("string")), F.lit("first")))
    segs = F.lit('[{"start":0.0,"end":4.0,"label":"intro"},{"startSeconds":4.0,"end_seconds":9.0,"name":"out"}]')
    doc0 = F.format_string('{"beats":%s,"downbeats":%s,"drumEvents":%s,"analysis":%s,"warnings":%s,"runtime":%s,"segments":%s}',
                           F.to_json(beats), F.to_json(downs), F.to_json(plain), analysis, warn, runtime, segs)
    doc1 = F.format_string('{"result":{"timing":{"beats":%s},"drumEventCandidates":%s,"analysis":%s,"warnings":%s,"runtime":%s}}',
                           F.to_json(beat_objects), F.to_json(nested), analysis, warn, runtime)
    doc2 = F.format_string('{"transcription":{"events":%s},"analysis":%s,"warnings":%s,"runtime":%s}', F.to_json(wrapped), analysis, warn, runtime)
    text = F.when(c % 31 == 7, F.lit("{broken")).when(c % 3 == 0, doc0).when(c % 3 == 1, doc1).otherwise(doc2)
    return g.select("track_id", text.alias("text"))


def parsed(spark, sf):
    return payloads(spark, sf).select("track_id", F.try_parse_json("text").alias("raw"))


@query("p01_unwrap_payload", "SELECT track_id, CASE WHEN bad THEN '' WHEN shape = 0 THEN 'analysis,beats,downbeats,drumEvents,runtime,segments,warnings' WHEN shape = 1 THEN 'analysis,drumEventCandidates,runtime,timing,warnings' ELSE 'analysis,runtime,transcription,warnings' END AS keys FROM clips")
def p01(spark, sf):
    keys = F.array_join(F.array_sort(F.map_keys(F.try_variant_get("payload", "$", "map<string,variant>"))), ",")
    return P.unwrap_payload(parsed(spark, sf)).select("track_id", keys.alias("keys"))


@query("p02_candidate_roots")
def p02(spark, sf):
    return P.candidate_roots(parsed(spark, sf)).select("track_id", "depth", "path", "keys")


@query("p03_first_present", "SELECT track_id, CASE WHEN bad THEN NULL WHEN shape = 0 THEN '[' ELSE NULL END AS first_char FROM clips")
def p03(spark, sf):
    v = X.first_present("raw", ["beatTimes", "beats", "beat_times"])
    return parsed(spark, sf).select("track_id", F.substring(F.try_variant_get(v, "$", "string"), 1, 1).alias("first_char"))


@query("p04_extract_times", "SELECT track_id, k AS pos, k*0.5::DOUBLE AS start_seconds FROM clips, range(18) r(k) WHERE NOT bad AND shape <> 2")
def p04(spark, sf):
    return P.extract_times(parsed(spark, sf), "beats")


@query("p04_extract_downbeats", "SELECT track_id, k AS pos, k*2.0::DOUBLE AS start_seconds FROM clips, range(5) r(k) WHERE NOT bad AND shape = 0")
def p04b(spark, sf):
    return P.extract_times(parsed(spark, sf), "downbeats")


@query("p05_p07_values", "SELECT c.event_id, c.onset AS seconds, c.label FROM clip_events c JOIN clips k USING (track_id) WHERE NOT k.bad")
def p05(spark, sf):
    h = P.extract_hits(parsed(spark, sf))
    at = X.reader("outer", "inner")
    ident = F.coalesce(at("eventID"), at("id"))
    return h.select(
        F.substring(X.text(ident), 2, 20).cast("long").alias("event_id"),
        F.coalesce(X.timing_value("outer"), X.timing_value("inner")).alias("seconds"), X.scalar_text(X.lane_value(at)).alias("label"),
    )


WITH["cand"] = """SELECT c.track_id, c.event_id % 64 AS pos, concat('e', c.event_id) AS event_id, c.onset, c.label, a.lane, least(greatest(c.strength, 0), 1) AS velocity, c.confidence,
 CASE WHEN c.onset IS NULL THEN 'missing_onset' WHEN a.lane IS NULL THEN 'unknown_lane' END AS drop_reason FROM clip_events c JOIN clips k USING (track_id)
 LEFT JOIN alias_runtime a ON a.alias = replace(c.label, ' ', '_') WHERE NOT k.bad"""


@query("p06_p24_project_hits", "SELECT track_id, pos, event_id, onset AS onset_seconds, label AS source_label, lane, round(velocity, 6) AS velocity, confidence, drop_reason FROM cand")
def p24(spark, sf):
    return P.project_hits(P.extract_hits(parsed(spark, sf))).select(
        "track_id", "pos", "event_id", "onset_seconds", "source_label", "lane", r6("velocity").alias("velocity"), "confidence", "drop_reason"
    )


@query("p13_normalize_analysis", """SELECT track_id, CASE WHEN bad THEN NULL WHEN track_id % 4 = 2 THEN 8.5 ELSE 9.0 END::DOUBLE AS duration_seconds, CASE WHEN NOT bad AND track_id % 4 <> 1 THEN 100.0 + track_id % 50 END::DOUBLE AS tempo_bpm,
 CASE WHEN NOT bad THEN (track_id % 10)/10 END::DOUBLE AS confidence, CASE WHEN NOT bad AND track_id % 4 = 3 THEN 2 ELSE 0 END AS track_count, CASE WHEN NOT bad AND shape = 0 THEN 2 ELSE 0 END AS segment_count FROM clips""")
def p13(spark, sf):
    return P.normalize_analysis(parsed(spark, sf)).select("track_id", "duration_seconds", "tempo_bpm", "confidence", "track_count", "segment_count")


@query("p14_segments", "SELECT track_id, pos, pos AS index, pos*4.0::DOUBLE AS start_seconds, CASE pos WHEN 0 THEN 4.0 ELSE 9.0 END::DOUBLE AS end_seconds, CASE pos WHEN 0 THEN 'intro' ELSE 'out' END AS label FROM clips, range(2) r(pos) WHERE NOT bad AND shape = 0")
def p14(spark, sf):
    return P.segment_rows(P.normalize_analysis(parsed(spark, sf))).drop("confidence")


@query("p15_warnings", "SELECT track_id, CASE WHEN bad THEN '' ELSE concat('first|clip ', track_id % 3) END AS warnings FROM clips")
def p15(spark, sf):
    return P.normalize_analysis(parsed(spark, sf)).select("track_id", F.array_join("warnings", "|").alias("warnings"))


@query("p16a_timing_provenance", """SELECT track_id, CASE WHEN bad THEN NULL WHEN rt = 1 THEN 'beat_this' WHEN rt = 2 THEN 'heuristic_backend' WHEN rt = 4 THEN 'madmom_fallback' END AS backend,
 CASE WHEN bad THEN NULL WHEN rt = 1 THEN CASE WHEN track_id % 2 = 0 THEN 'fallback' ELSE 'primary' END WHEN rt = 2 THEN 'primary' WHEN rt = 4 THEN 'fallback' END AS timing_source,
 CASE WHEN NOT bad AND rt = 4 THEN 'execution' END AS category FROM clips""")
def p16a(spark, sf):
    p = P.unwrap_payload(parsed(spark, sf)).withColumn("t", P.timing_provenance("payload"))
    return p.select("track_id", "t.backend", "t.timing_source", F.col("t.fallback_summary.category").alias("category"))


@query("p16b_event_provenance", """SELECT track_id, CASE WHEN bad THEN NULL WHEN rt = 3 THEN 'event_backend' ELSE 'analyzer_payload' END AS backend,
 CASE WHEN bad THEN NULL WHEN rt = 3 THEN 'stage2_backend_empty' ELSE 'embedded_candidates' END AS event_source, CASE WHEN NOT bad AND rt = 3 THEN 'empty' END AS category FROM clips""")
def p16b(spark, sf):
    p = P.unwrap_payload(parsed(spark, sf)).withColumn("t", P.event_provenance("payload"))
    return p.select("track_id", "t.backend", "t.event_source", F.col("t.failure_summary.category").alias("category"))


WITH["reasons"] = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'payload did not contain recognizable timing' WHEN 1 THEN concat('backend not configured: ', o_orderpriority) WHEN 2 THEN 'fallback policy forced'
 WHEN 3 THEN concat('failed: status ', o_orderkey % 7, ': ', o_orderstatus) ELSE 'crash: ' END AS reason FROM orders"""


def reasons(spark, sf):
    i = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(
        i.alias("id"),
        F.when(i % 5 == 0, "payload did not contain recognizable timing").when(i % 5 == 1, F.concat(F.lit("backend not configured: "), "o_orderpriority"))
        .when(i % 5 == 2, "fallback policy forced").when(i % 5 == 3, F.concat(F.lit("failed: status "), (i % 7).cast("string"), F.lit(": "), F.col("o_orderstatus"))).otherwise("crash: ").alias("reason"),
    )


@query("p16c_fallback_category", """SELECT id, CASE WHEN contains(reason, 'payload did not contain recognizable') THEN 'validation' WHEN contains(reason, 'not configured') THEN 'configuration' WHEN contains(reason, 'policy') THEN 'policy' ELSE 'execution' END AS category,
 CASE WHEN contains(reason, ': ') THEN nullif(trim(list_extract(string_split(reason, ': '), -1)), '') END AS error FROM reasons""")
def p16c(spark, sf):
    return reasons(spark, sf).select("id", S.fallback_category("reason").alias("category"), S.fallback_error("reason").alias("error"))


@query("p16d_backend_label", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'beat_this' WHEN 1 THEN 'heuristic_backend' WHEN 2 THEN 'madmom_fallback' END AS label FROM orders""")
def p16d(spark, sf):
    i = F.col("o_orderkey")
    cmd = F.when(i % 4 == 0, "python beat-this-backend.py").when(i % 4 == 1, "x/backend-analyzer.py --input").when(i % 4 == 2, "madmom-fallback-backend.py").otherwise(F.col("o_orderpriority"))
    return V.table(spark, sf, "orders").select(i.alias("id"), S.backend_label(cmd).alias("label"))


@query("p17_event_count", "SELECT track_id, CASE WHEN bad THEN 0 ELSE n END AS n FROM clips")
def p17(spark, sf):
    return P.unwrap_payload(parsed(spark, sf)).select("track_id", P.event_count("payload").alias("n"))


@query("p19_validate_payload", "SELECT track_id, NOT bad AND shape <> 2 AS ok FROM clips")
def p19(spark, sf):
    return P.validate_payload(parsed(spark, sf)).select("track_id", F.col("issue").isNull().alias("ok"))


def transcriptions(spark, sf):
    """Transcription documents in two shapes: hits at the root, and hits below instruments."""
    c = F.col("track_id")
    h = clip_events(spark, sf)
    g = h.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "onset", "midi", "strength", "confidence"))).alias("h"))
    flat = F.transform("h", lambda x: F.struct(x["onset"].alias("time"), x["midi"].alias("pitch"), F.round(x["strength"] * 100, 4).alias("velocity"), x["confidence"].alias("confidence")))
    tree = F.transform("h", lambda x: F.struct(x["midi"].alias("midi"), F.array(F.struct(x["onset"].alias("onset"), x["confidence"].alias("score"))).alias("hits")))
    text = F.when(c % 2 == 0, F.format_string('{"hits":%s}', F.to_json(flat))).otherwise(F.format_string('{"instruments":%s}', F.to_json(tree)))
    return g.select("track_id", F.try_parse_json(text).alias("raw"))


@query("p18_normalize_adtof", """SELECT c.track_id, event_id % 64 AS pos, onset AS onset_seconds, coalesce(a.label, midi::VARCHAR) AS label, coalesce(confidence, 0.5) AS confidence, concat('adtof_midi_', midi) AS source_label, onset IS NULL AS dropped,
 round(CASE WHEN c.track_id % 2 = 0 THEN least(CASE WHEN round(strength*100, 4) > 1 THEN round(strength*100, 4)/127.0 ELSE round(strength*100, 4) END, 1) ELSE 0.8 END, 6) AS velocity FROM clip_events c LEFT JOIN midi_adtof a ON a.note = c.midi""")
def p18(spark, sf):
    return AD.normalize_adtof(transcriptions(spark, sf)).select(
        "track_id", "pos", "onset_seconds", "label", "confidence", "source_label", "dropped", r6("velocity").alias("velocity")
    )


def loose_notes(spark, sf):
    i = F.col("event_id")
    return V.hits(spark, sf).select(
        "event_id", F.when(i % 11 != 0, i.cast("string")).alias("note_id"), F.when(i % 7 == 0, "cowbell").when(i % 13 != 0, "kick").alias("lane"),
        (i - 5).alias("tick"), F.lit(0).alias("beat_index"), F.when(i % 3 == 0, i - 20).alias("subdivision_index"),
        F.col("onset_seconds").alias("start_seconds"), F.lit(0).alias("duration_ticks"), (F.col("velocity") * 1.2).alias("velocity"),
        F.when(i % 5 == 0, "").otherwise("x").alias("source_event_id"),
    )


@query("p20_validate_contract", """SELECT event_id, 'note_id' AS "column", 'required' AS rule FROM hits WHERE event_id % 11 = 0 UNION ALL SELECT event_id, 'lane', 'enum' FROM hits WHERE event_id % 7 = 0
 UNION ALL SELECT event_id, 'lane', 'required' FROM hits WHERE event_id % 7 <> 0 AND event_id % 13 = 0 UNION ALL SELECT event_id, 'tick', 'min' FROM hits WHERE event_id < 5
 UNION ALL SELECT event_id, 'subdivision_index', 'min' FROM hits WHERE event_id % 3 = 0 AND event_id < 20 UNION ALL SELECT event_id, 'velocity', 'max' FROM hits WHERE velocity*1.2::DOUBLE > 1
 UNION ALL SELECT event_id, 'source_event_id', 'text' FROM hits WHERE event_id % 5 = 0""")
def p20(spark, sf):
    return CT.validate_contract(loose_notes(spark, sf), "chart_notes", ["event_id"])


def chart_docs(spark, sf):
    """Chart documents of clips, new and legacy shape."""
    c = F.col("track_id")
    g = clip_events(spark, sf).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "onset", "label"))).alias("h"))
    n = F.to_json(F.transform("h", lambda x: F.struct(F.concat(F.lit("n"), x["event_id"].cast("string")).alias("noteID"), x["label"].alias("lane"), x["onset"].alias("startSeconds"))))
    text = F.when(c % 2 == 0, F.format_string('{"title":"t","chart":{"notes":%s}}', n)).otherwise(F.format_string('{"notes":%s}', n))
    return g.select(c.cast("string").alias("path"), F.try_parse_json(text).alias("raw"))


@query("p22_extract_chart_notes", "SELECT track_id::VARCHAR AS path, event_id % 64 AS pos, concat('n', event_id) AS note_id, label AS lane, onset AS time FROM clip_events")
def p22(spark, sf):
    return P.extract_chart_notes(chart_docs(spark, sf))


@query("a30_chart_summary", """SELECT track_id::VARCHAR AS path, CASE WHEN track_id % 2 = 0 THEN 'chart,title' ELSE 'notes' END AS top_level_keys, count(*) AS note_count, string_agg(DISTINCT label, ',' ORDER BY label) AS unique_lanes FROM clip_events GROUP BY track_id""")
def a30(spark, sf):
    return P.chart_summary(chart_docs(spark, sf)).drop("lane_counts", "sample_notes")


@query("f05_operator_line", """SELECT track_id, CASE WHEN bad THEN 'segments=0 | tracks=0' ELSE concat_ws(' | ', CASE WHEN track_id % 4 = 2 THEN 'duration=8.50s' ELSE 'duration=9s' END, CASE WHEN track_id % 4 <> 1 THEN concat('tempo≈', 100 + track_id % 50, ' bpm') END,
 CASE WHEN shape = 0 THEN 'segments=2' ELSE 'segments=0' END, CASE WHEN track_id % 4 = 3 THEN 'tracks=2' ELSE 'tracks=0' END, concat('confidence=', CASE WHEN track_id % 10 = 0 THEN '0' ELSE printf('%.2f', (track_id % 10)/10) END),
 CASE rt WHEN 1 THEN CASE WHEN track_id % 2 = 0 THEN 'timing=beat_this via fallback, fallback=yes' ELSE 'timing=beat_this via primary, fallback=no' END WHEN 2 THEN 'timing=heuristic_backend via primary, selected=primary, fallback=no'
 WHEN 4 THEN 'timing=madmom_fallback via fallback, selected=fallback, fallback=execution: status 3' END,
 CASE WHEN rt = 3 THEN 'events=event_backend via stage2_backend_empty, used=no, fallback=empty: stage-2 event backend returned no drum-event candidates' ELSE 'events=analyzer_payload via embedded_candidates, used=yes' END) END AS line FROM clips""")
def f05(spark, sf):
    return P.operator_summary(P.normalize_analysis(parsed(spark, sf))).select("track_id", F.col("operator_summary").alias("line"))


@query("f11_notable_warnings", """SELECT id, concat_ws(' ', concat('a=', id), CASE WHEN id % 2 = 0 THEN concat('b=', reason) END) AS kv, CASE WHEN id % 3 = 0 THEN 'Dropped 2|heuristic x' WHEN id % 3 = 1 THEN 'heuristic x' ELSE '' END AS notable FROM reasons""")
def f11(spark, sf):
    i = F.col("id")
    w = F.when(i % 3 == 0, F.array(F.lit("Dropped 2"), F.lit("plain"), F.lit("heuristic x"))).when(i % 3 == 1, F.array(F.lit("heuristic x"))).otherwise(F.array(F.lit("plain")))
    return reasons(spark, sf).select("id", S.kv_text(a=i, b=F.when(i % 2 == 0, F.col("reason"))).alias("kv"), F.array_join(S.notable(w), "|").alias("notable"))


# --- choosing between documents --------------------------------------------------------------------


def two_sources(spark, sf):
    """Primary: every document, malformed ones included. Fallback: all but every seventh clip."""
    p = parsed(spark, sf)
    f = transcriptions(spark, sf).where(F.col("track_id") % 7 != 0)
    # transcriptions below instruments are no event list at the root; they count as empty
    return p, f


WITH["fb"] = "SELECT track_id, n, track_id % 2 = 0 AS has_events FROM clips WHERE track_id % 7 <> 0"


@query("j11_merge_events", """SELECT c.track_id, coalesce(f.track_id IS NOT NULL, false) AS event_backend_ran, coalesce(f.has_events, false) AS event_backend_used, CASE WHEN f.has_events THEN f.n ELSE 0 END AS event_backend_count,
 CASE WHEN f.has_events THEN f.n WHEN c.bad THEN NULL ELSE CASE c.shape WHEN 0 THEN c.n WHEN 2 THEN c.n ELSE NULL END END AS n_events FROM clips c LEFT JOIN fb f USING (track_id)""")
def j11(spark, sf):
    p, f = two_sources(spark, sf)
    m = AR.merge_events(p, f, "optional")
    n = F.array_size(F.when(F.col("event_backend_used") | (F.col("track_id") % 3 != 1), F.col("events")))
    return m.select("track_id", "event_backend_ran", "event_backend_used", "event_backend_count", n.alias("n_events"))


@query("j12_arbitrate", """SELECT c.track_id, CASE WHEN f.track_id IS NULL AND c.bad THEN 'fallback' WHEN c.bad OR c.shape = 2 THEN 'fallback' WHEN c.shape = 1 AND f.has_events THEN 'primary+fallback-events' ELSE 'primary' END AS selected_backend, c.bad OR c.shape = 2 AS fallback_used FROM clips c LEFT JOIN fb f USING (track_id)""")
def j12(spark, sf):
    p, f = two_sources(spark, sf)
    return AR.arbitrate(p, f, "on-error-or-invalid", "require-timing").select("track_id", "selected_backend", "fallback_used")


@query("j12_chosen_hits", """SELECT c.track_id, f.n AS events, f.n AS told, 'primary+fallback-events' AS selected_backend, 'stage2_backend' AS event_source
 FROM clips c JOIN fb f USING (track_id) WHERE c.shape = 1 AND NOT c.bad AND f.has_events""")
def j12_hits(spark, sf):
    """Hits and runtime facts as later steps read them from documents onto which hits were merged."""
    p, f = two_sources(spark, sf)
    docs = AR.arbitrate(p, f, "on-error-or-invalid", "require-timing").where(F.col("selected_backend") == "primary+fallback-events")
    told = X.integer(X.get("raw", "runtime", "eventBackendCandidateCount"))
    return docs.select(
        "track_id", P.event_count("raw").alias("events"), told.alias("told"), X.text(X.get("raw", "runtime", "selectedBackend")).alias("selected_backend"),
        P.event_provenance("raw")["event_source"].alias("event_source"),
    )


@query("u01_with_analyzer", "SELECT track_id, CASE WHEN track_id % 5 = 0 THEN NULL ELSE concat('{\"beats\":[', n, ']}') END AS payload, CASE WHEN track_id % 5 = 0 THEN 'no signal' END AS error FROM clips")
def u01(spark, sf):
    def analyze(batch):
        if (batch["track_id"] % 5 == 0).any():
            raise ValueError("no signal")
        return batch.assign(payload='{"beats":[' + batch["n"].astype(str) + "]}")

    t = clip_events(spark, sf).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    return AR.with_analyzer(t, analyze)


@query("g08_generate_charts")
def g08(spark, sf):
    r = C.generate_charts(parsed(spark, sf))
    return r["charts"].select("chart_id", "bpm", "offset_seconds", "timing_source", F.array_join("lanes", ",").alias("lanes"), "difficulty", F.array_join("warnings", "|").alias("warnings"), "note")


@query("g08_diagnostics", """SELECT k.track_id, coalesce(r, 0) AS raw_count, coalesce(m, 0) AS mapped_count, coalesce(o, 0) AS dropped_missing_onset, coalesce(u, 0) AS dropped_unknown_lane, NOT k.bad AND k.shape <> 2 AS timed FROM clips k LEFT JOIN (
 SELECT track_id, count(*) AS r, count(*) FILTER (drop_reason IS NULL) AS m, count(*) FILTER (drop_reason = 'missing_onset') AS o, count(*) FILTER (drop_reason = 'unknown_lane') AS u FROM cand GROUP BY 1) USING (track_id)""")
def g08d(spark, sf):
    n = C.generate_charts(parsed(spark, sf))["normalized"]
    return n.select("track_id", "diagnostics.raw_count", "diagnostics.mapped_count", "diagnostics.dropped_missing_onset", "diagnostics.dropped_unknown_lane", (F.col("timing_source") == "analyzer").alias("timed"))
