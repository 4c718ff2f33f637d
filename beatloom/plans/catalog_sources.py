"""Queries over source diffs, audits, samples, the ledger, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions import scalars as S
from beatloom.operators import audits as A
from beatloom.operators import diffs as D
from beatloom.operators import events as E
from beatloom.operators import ledger as LG
from beatloom.operators import ordered as O
from beatloom.operators import signal as SG
from beatloom.operators import timing as TM
from beatloom.plans import catalog_charts as CC
from beatloom.plans import catalog_documents as CD
from beatloom.plans import views as V
from beatloom.plans.registry import WITH, query, r6
from beatloom.session import cut, work_dir
from beatloom.sources import files, sinks
from beatloom.streaming import jobs as ST

# --- differences -------------------------------------------------------------------------------


def ranked(spark, sf, source):
    h = source(spark, sf).withColumn("__c", O.time_chunk("onset_seconds"))
    return O.row_index(h, ["track_id"], ["onset_seconds", "event_id"], "__c", "pos").drop("__c")


WITH["pos_a"] = "SELECT track_id, onset_seconds, label, row_number() OVER (PARTITION BY track_id ORDER BY onset_seconds, event_id) - 1 AS pos FROM hits"
WITH["pos_b"] = "SELECT track_id, onset_seconds, label, row_number() OVER (PARTITION BY track_id ORDER BY onset_seconds, event_id) - 1 AS pos FROM hits_b"


@query("j09_compare_positions", """SELECT track_id, pos, round(a.onset_seconds, 6) AS "primary", round(b.onset_seconds, 6) AS fallback, round(b.onset_seconds - a.onset_seconds, 6) AS delta FROM pos_a a FULL JOIN pos_b b USING (track_id, pos)
 WHERE abs(b.onset_seconds - a.onset_seconds) > 0.0005 OR a.onset_seconds IS NULL OR b.onset_seconds IS NULL""")
def j09(spark, sf):
    d = D.compare_positions(ranked(spark, sf, V.hits), ranked(spark, sf, V.hits_b), "onset_seconds")
    return d.select("track_id", "pos", r6("primary").alias("primary"), r6("fallback").alias("fallback"), r6("delta").alias("delta"))


@query("j10_compare_counts", """SELECT track_id, label, coalesce(a.n, 0) AS "primary", coalesce(b.n, 0) AS fallback, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT track_id, label, count(*) AS n FROM hits GROUP BY ALL) a
 FULL JOIN (SELECT track_id, label, count(*) AS n FROM hits_b GROUP BY ALL) b USING (track_id, label) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def j10(spark, sf):
    n = lambda s: s(spark, sf).groupBy("track_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return D.compare_counts(n(V.hits), n(V.hits_b), ["track_id", "label"])


@query("e04_union_keys", """SELECT track_id, label, coalesce(a.n, 0) AS "primary", coalesce(b.n, 0) AS fallback FROM (SELECT track_id, label, count(*) AS n FROM hits GROUP BY ALL) a
 FULL JOIN (SELECT track_id, label, count(*) AS n FROM hits_b GROUP BY ALL) b USING (track_id, label)""")
def e04(spark, sf):
    n = lambda s: s(spark, sf).groupBy("track_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return D.union_keys(n(V.hits), n(V.hits_b), ["track_id", "label"])


def _pairs(a, b):
    """The sequential matching of two views with track_id, pos and onset_seconds, as one fold over a list."""
    return f"""SELECT track_id, fl, unnest(list_reduce(l, lambda s, x: {{'m': s.m || list_transform(x.m, lambda z: CASE WHEN z.b IS NOT NULL THEN {{'i': z.i, 't': z.t, 'b': z.b}} ELSE
 {{'i': z.i, 't': z.t, 'b': list_sort(list_transform(list_filter(fl, lambda y: abs(y.t - z.t) <= 0.05 AND NOT list_contains(list_transform(s.m, lambda o: o.b.p), y.p)), lambda y: {{'d': abs(y.t - z.t), 'p': y.p, 't': y.t}}))[1]}} END)}}).m) AS m
 FROM (SELECT track_id, list_prepend({{'m': []::STRUCT(i BIGINT, t DOUBLE, b STRUCT(d DOUBLE, p BIGINT, t DOUBLE))[]}}, list({{'m': [{{'i': pos::BIGINT, 't': onset_seconds, 'b': NULL::STRUCT(d DOUBLE, p BIGINT, t DOUBLE)}}]}} ORDER BY pos)) AS l FROM {a} GROUP BY 1)
 LEFT JOIN (SELECT track_id, list({{'p': pos::BIGINT, 't': onset_seconds}} ORDER BY pos) AS fl FROM {b} GROUP BY 1) USING (track_id)"""


WITH["pairs"] = _pairs("pos_a", "pos_b")


@query("j08_match_onsets", """SELECT track_id, CASE WHEN m.b IS NULL THEN 'primary_only' WHEN abs(round(m.b.t - m.t, 6)) > 0.0005 THEN 'shifted' ELSE 'matched' END AS kind, m.i AS primary_pos, m.b.p AS fallback_pos, round(m.b.t - m.t, 6) AS delta FROM pairs
 UNION ALL SELECT track_id, 'fallback_only', NULL, pos, NULL FROM pos_b b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.track_id = b.track_id AND p.m.b.p = b.pos)""")
def j08(spark, sf):
    m = D.match_onsets(ranked(spark, sf, V.hits), ranked(spark, sf, V.hits_b))
    return m.select("track_id", "kind", "primary_pos", "fallback_pos", "delta")


def provenance(spark, sf, shift):
    i = F.col("c_custkey")
    c = V.table(spark, sf, "customer")
    cols = [F.when((i + k) % 5 != 0, F.concat(F.lit(name), ((i + (shift if k % 3 == 0 else 0)) % 4).cast("string"))).alias(name) for k, name in enumerate(K.PROVENANCE_KEYS)]
    return c.select(i.alias("track_id"), *cols)


_PROV = " UNION ALL ".join(
    f"SELECT c_custkey AS track_id, '{name}' AS key, concat('{name}', c_custkey % 4) AS \"primary\", concat('{name}', (c_custkey + 1) % 4) AS fallback FROM customer WHERE (c_custkey + {k}) % 5 <> 0"
    for k, name in enumerate(K.PROVENANCE_KEYS) if k % 3 == 0
)


@query("j18_diff_provenance", _PROV)
def j18(spark, sf):
    return D.diff_provenance(provenance(spark, sf, 0), provenance(spark, sf, 1))


@query("t06_previews", "SELECT track_id, event_id, r AS rank FROM (SELECT track_id, event_id, row_number() OVER (PARTITION BY track_id ORDER BY onset_seconds, event_id) AS r FROM hits) WHERE r <= 12")
def t06(spark, sf):
    h = V.hits(spark, sf).select("track_id", "event_id", "onset_seconds")
    return D.preview(h, ["track_id"], ["onset_seconds", "event_id"]).select("track_id", "event_id", "rank")


@query("t08_order_events", "SELECT track_id, event_id, CASE WHEN event_id % 9 <> 0 THEN round(onset_seconds, 6) END AS onset_seconds, lane FROM mapped")
def t08(spark, sf):
    e = V.mapped_hits(spark, sf).withColumn("onset_seconds", F.when(F.col("event_id") % 9 != 0, r6("onset_seconds")))
    return E.order_events(e.select("track_id", "event_id", "onset_seconds", "lane"))


@query("a29_payload_summary", """SELECT c.track_id, CASE WHEN bad OR shape = 1 OR track_id % 4 = 1 THEN NULL ELSE 100.0 + track_id % 50 END::DOUBLE AS tempo_bpm, CASE WHEN NOT bad AND shape = 0 THEN 18 ELSE 0 END AS beat_count,
 CASE WHEN NOT bad AND shape = 0 THEN 5 ELSE 0 END AS downbeat_count, CASE WHEN NOT bad AND shape = 0 THEN n ELSE 0 END AS event_count FROM clips c""")
def a29(spark, sf):
    return TM.summarize(CD.parsed(spark, sf))["summary"].select("track_id", "tempo_bpm", "beat_count", "downbeat_count", "event_count")


@query("a29_event_preview", """SELECT track_id, i AS rank, i - 1 AS index, round(onset, 6) AS onset_seconds, 'unknown' AS lane, 'unknown' AS source, round(confidence, 4) AS confidence FROM (
 SELECT e.*, row_number() OVER (PARTITION BY track_id ORDER BY event_id) AS i FROM clip_events e JOIN clips c USING (track_id) WHERE NOT c.bad AND c.shape = 0) WHERE i <= 12""")
def a29_events(spark, sf):
    e = TM.summarize(CD.parsed(spark, sf))["events_preview"]
    return e.select("track_id", "rank", "index", r6("onset_seconds").alias("onset_seconds"), "lane", "source", F.round("confidence", 4).alias("confidence"))


def _timings(spark, sf):
    """Documents and the same with one beat moved and all hits of the first second a second later."""
    moved = F.replace("text", F.lit('"beats":[0.0,0.5,'), F.lit('"beats":[0.0,0.6,'))
    moved = F.replace(moved, F.lit('"onsetSeconds":0.'), F.lit('"onsetSeconds":1.'))
    return CD.parsed(spark, sf), CD.payloads(spark, sf).select("track_id", F.try_parse_json(moved).alias("raw"))


WITH["timing_a"] = """SELECT track_id, onset_seconds, row_number() OVER (PARTITION BY track_id ORDER BY onset_seconds) - 1 AS pos FROM (
 SELECT track_id, round(onset, 6) AS onset_seconds FROM clip_events JOIN clips USING (track_id) WHERE NOT bad AND shape = 0 AND onset IS NOT NULL)"""
WITH["timing_b"] = """SELECT track_id, onset_seconds, row_number() OVER (PARTITION BY track_id ORDER BY onset_seconds) - 1 AS pos FROM (
 SELECT track_id, round(CASE WHEN onset = 0 OR (onset >= 0.001 AND onset < 1) THEN onset + 1 ELSE onset END, 6) AS onset_seconds FROM clip_events JOIN clips USING (track_id) WHERE NOT bad AND shape = 0 AND onset IS NOT NULL)"""
WITH["timing_pairs"] = _pairs("timing_a", "timing_b")
WITH["timing_kinds"] = """SELECT track_id, 'onsets_' || CASE WHEN m.b IS NULL THEN 'primary_only' WHEN abs(round(m.b.t - m.t, 6)) > 0.0005 THEN 'shifted' ELSE 'matched' END AS measure, m.i AS pos, m.t AS "primary", m.b.t AS fallback, round(m.b.t - m.t, 6) AS delta FROM timing_pairs
 UNION ALL SELECT track_id, 'onsets_fallback_only', pos, NULL, onset_seconds, NULL FROM timing_b b WHERE NOT EXISTS (SELECT 1 FROM timing_pairs p WHERE p.track_id = b.track_id AND p.m.b.p = b.pos)"""


@query("g14_timing_diff", """SELECT track_id, m || '_delta' AS measure, CASE WHEN m = 'tempo_bpm' AND (bad OR shape = 1 OR track_id % 4 = 1) OR m = 'downbeat_offset' OR m = 'confidence' AND (bad OR shape = 1) THEN NULL ELSE 0 END::DOUBLE AS value, NULL::VARCHAR AS detail
 FROM clips, (SELECT unnest(['tempo_bpm', 'downbeat_offset', 'confidence', 'beat_count', 'downbeat_count', 'segment_count', 'event_count', 'interval_count']) AS m)
 UNION ALL SELECT track_id, unnest(['beats_mismatches', 'intervals_mismatches']), unnest([1.0, 2.0])::DOUBLE, NULL FROM clips WHERE NOT bad AND shape = 0
 UNION ALL SELECT track_id, measure, count(*)::DOUBLE, NULL FROM timing_kinds GROUP BY 1, 2""")
def g14(spark, sf):
    return TM.timing_diff(*_timings(spark, sf))


@query("g14_timing_previews", """SELECT track_id, 'beats' AS measure, 1 AS rank, 1 AS pos, 0.5::DOUBLE AS "primary", 0.6::DOUBLE AS fallback, 0.1::DOUBLE AS delta FROM clips WHERE NOT bad AND shape = 0
 UNION ALL SELECT track_id, 'intervals', i, i - 1, 0.5, CASE i WHEN 1 THEN 0.6 ELSE 0.4 END, CASE i WHEN 1 THEN 0.1 ELSE -0.1 END FROM clips, range(1, 3) r(i) WHERE NOT bad AND shape = 0
 UNION ALL SELECT * FROM (SELECT track_id, measure, row_number() OVER (PARTITION BY track_id, measure ORDER BY pos) AS rank, pos, round("primary", 6), round(fallback, 6), delta FROM timing_kinds WHERE measure <> 'onsets_matched') WHERE rank <= 12""")
def g14_previews(spark, sf):
    p = TM.timing_previews(*_timings(spark, sf))
    return p.select("track_id", "measure", "rank", "pos", *[r6(c).alias(c) for c in ("primary", "fallback", "delta")])


# --- audits -----------------------------------------------------------------------------------------

WITH["lab"] = "SELECT event_id % 7 AS artifact, label, note, event_id FROM labelled"
WITH["lab_mapped"] = r"""SELECT l.artifact, coalesce(trim(regexp_replace(regexp_replace(lower(l.label), '[^\p{L}\p{M}\p{N}]', '_', 'g'), '_+', '_', 'g'), '_'), '<missing>') AS norm, coalesce(m.lane, a.lane) AS lane FROM lab l
 LEFT JOIN midi_audit m ON l.note = m.note LEFT JOIN alias_audit a ON a.alias = trim(regexp_replace(regexp_replace(lower(l.label), '[^\p{L}\p{M}\p{N}]', '_', 'g'), '_+', '_', 'g'), '_')"""
WITH["audit_long"] = """SELECT artifact, 'raw' AS counter, norm AS key FROM lab_mapped UNION ALL SELECT artifact, 'mapped', lane FROM lab_mapped WHERE lane IS NOT NULL UNION ALL SELECT artifact, 'family', split_part(lane, '_', 1) FROM lab_mapped WHERE lane IS NOT NULL
 UNION ALL SELECT artifact, 'unmapped', norm FROM lab_mapped WHERE lane IS NULL UNION ALL SELECT track_id % 7, 'normalized', lane FROM mapped WHERE lane IS NOT NULL UNION ALL SELECT track_id % 7, 'chart', lane FROM mapped_b WHERE lane IS NOT NULL"""
WITH["audit_counts"] = "SELECT artifact, counter, key, count(*) AS n FROM audit_long GROUP BY GROUPING SETS ((artifact, counter, key), (counter, key))"


def _audit(spark, sf):
    from beatloom.plans.catalog_tracks import labelled

    c = labelled(spark, sf).select((F.col("event_id") % 7).alias("artifact"), "label", "note")
    lane = lambda s: V.mapped_hits(spark, sf, s).select((F.col("track_id") % 7).alias("artifact"), "lane")
    return A.lane_audit(c, lane(V.hits), lane(V.hits_b))


@query("a19_g15_lane_audit", "SELECT artifact, counter, key, n FROM audit_counts")
def a19(spark, sf):
    return _audit(spark, sf)


@query("t07_rank_counters", "SELECT artifact, counter, key, n, row_number() OVER (PARTITION BY artifact, counter ORDER BY n DESC, key) AS rank FROM audit_counts")
def t07(spark, sf):
    return A.rank_counters(_audit(spark, sf))


@query("a20_lane_family", "SELECT split_part(lane, '_', 1) AS family, count(*) AS n FROM mapped WHERE lane IS NOT NULL GROUP BY 1")
def a20(spark, sf):
    m = V.mapped_hits(spark, sf).where(F.col("lane").isNotNull())
    return m.groupBy(A.lane_family("lane").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def loop_sources(spark, sf):
    i = F.col("o_orderkey")
    n = lambda x: x.cast("string")
    return V.table(spark, sf, "orders").select(
        i.alias("source_id"), F.when(i % 3 == 0, "madmom").otherwise("beat_this").alias("timing_backend"), F.when(i % 4 != 0, "primary").alias("selected_backend"),
        F.array_compact(F.array(
            F.when(i % 2 == 0, F.concat(F.lit("analyzer wrapper merged "), n(i % 40), F.lit(" fallback drum-event candidates onto primary timing output"))),
            F.when(i % 3 == 0, F.concat(F.lit("filtered "), n(i % 9), F.lit(" low-confidence snare candidates"))), F.when(i % 5 == 0, F.lit("filtered few of 7 hats")),
            F.when(i % 7 == 0, F.concat(F.lit("deduped "), n(i % 11), F.lit(" near-duplicate same-lane hits"))), F.lit("plain 99 warning"),
        )).alias("warnings"),
    )


WITH["loop"] = """SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 40 ELSE 0 END AS stage2_count, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE 0 END AS filtered_count,
 CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 11 ELSE 0 END AS deduped_count FROM orders"""


@query("a27_loop_counts", "SELECT source_id, stage2_count, filtered_count, deduped_count FROM loop")
def a27(spark, sf):
    return A.loop_counts(loop_sources(spark, sf)).select("source_id", "stage2_count", "filtered_count", "deduped_count")


@query("a27_loop_totals", "SELECT count(*) AS source_count, false AS all_stage2_used, sum(stage2_count) AS stage2_total, sum(filtered_count) AS filtered_total, sum(deduped_count) AS deduped_total, 'beat_this, madmom' AS timing_backends, 'primary' AS selected_backends FROM loop")
def a27t(spark, sf):
    return A.loop_totals(A.loop_counts(loop_sources(spark, sf)))


def runs_and_items(spark, sf):
    """Orders as runs in small batches of thirty-two, with every third item under a changed URI."""
    i = F.col("o_orderkey")
    batch, pos = F.floor(i / 32), i % 32
    o = V.table(spark, sf, "orders")
    runs = o.select(batch.alias("batch"), pos.alias("pos"), F.concat(F.lit("u"), ((i * 7) % 16).cast("string")).alias("source_uri"), i.cast("string").alias("run_id"), F.col("o_orderstatus").alias("status"))
    items = o.select(batch.alias("batch"), pos.alias("pos"), F.when(i % 3 == 0, F.lit("gone")).otherwise(F.concat(F.lit("u"), (i % 16).cast("string"))).alias("source_uri"))
    return items, runs


@query("j16_attach_runs", """SELECT i.o_orderkey // 32 AS batch, i.o_orderkey % 32 AS pos, coalesce(u.run_id, p.o_orderkey::VARCHAR) AS run_id FROM orders i LEFT JOIN (SELECT o_orderkey // 32 AS b, concat('u', (o_orderkey*7) % 16) AS uri,
 arg_min(o_orderkey::VARCHAR, o_orderkey % 32) AS run_id FROM orders GROUP BY ALL) u ON u.b = i.o_orderkey // 32 AND u.uri = CASE WHEN i.o_orderkey % 3 = 0 THEN 'gone' ELSE concat('u', i.o_orderkey % 16) END
 LEFT JOIN orders p ON p.o_orderkey = i.o_orderkey""")
def j16(spark, sf):
    return A.attach_runs(*runs_and_items(spark, sf)).select("batch", "pos", "run_id")


@query("j17_first_artifact", "SELECT l_orderkey AS run_id, l_returnflag AS type, arg_min(concat('uri-', l_partkey), l_linenumber*1000000 + l_partkey) AS uri FROM lineitem GROUP BY ALL")
def j17(spark, sf):
    a = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("type"), F.concat(F.lit("uri-"), F.col("l_partkey").cast("string")).alias("uri"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"),
    )
    return A.first_artifact(a)


def loop_documents(spark, sf):
    """Validation documents of sixteen orders each, with the analyzer's log as escaped JSON."""
    i = F.col("o_orderkey")
    o = V.table(spark, sf, "orders").select(F.floor(i / 16).alias("batch"), (i % 16).alias("pos"), F.concat(F.lit("u"), i.cast("string")).alias("uri"), F.col("o_orderstatus").alias("status"), i.alias("id"))
    log = F.format_string('{"analysis":{"runtimeBackend":"beat_this","runtimeSelectedBackend":"primary","confidence":0.5},"warnings":["analyzer merged %d fallback drum-event candidates","filtered 2 low"]}', F.col("id") % 10)
    item = F.struct(F.struct(F.col("uri").alias("source_uri"), F.col("uri").alias("source_name")).alias("source"), F.struct(F.lit(True).alias("imports_ok")).alias("validation"),
                    F.array(F.struct(F.lit("not json").alias("stdout")), F.struct(log.alias("stdout"))).alias("logs"))
    run = F.struct(F.col("id").cast("string").alias("run_id"), "uri", F.col("uri").alias("source_uri"), "status", F.array(F.struct(F.lit("base_chart").alias("type"), F.concat(F.lit("f-"), "uri").alias("uri"))).alias("artifacts"))
    g = o.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("a"), run.alias("r")))).alias("x"))
    doc = F.to_json(F.struct(F.transform("x", lambda v: v["a"]).alias("validate_analyzer"), F.transform("x", lambda v: v["r"]).alias("runs_final")))
    return g.select("batch", F.concat(F.lit("starting\n"), doc).alias("text"))


@query("g16_loop_audit", "SELECT concat('u', o_orderkey) AS source_uri, o_orderkey::VARCHAR AS run_id, o_orderkey % 10 AS stage2_count, 2 AS filtered_count, concat('f-u', o_orderkey) AS base_chart FROM orders")
def g16(spark, sf):
    docs = loop_documents(spark, sf).select("batch", files.log_document("text").alias("raw"))
    return A.loop_audit(docs)["sources"].select("source_uri", "run_id", "stage2_count", "filtered_count", "base_chart")


@query("g16_loop_markdown")
def g16m(spark, sf):
    docs = cut(loop_documents(spark, sf).select("batch", files.log_document("text").alias("raw")))
    r = A.loop_audit(docs)
    return A.loop_markdown(r["sources"], r["totals"])


# --- samples ------------------------------------------------------------------------------------------

FRAME, HOP, RATE = 16, 8, 400


def samples(spark, sf):
    h = V.hits(spark, sf).select("track_id", "event_id", "onset_seconds", (F.col("velocity") - (F.col("event_id") % 3) * 0.3).alias("value"))
    h = h.withColumn("__c", O.time_chunk("onset_seconds"))
    return O.row_index(h, ["track_id"], ["onset_seconds", "event_id"], "__c", "idx").select("track_id", "idx", "value")


WITH["samples"] = "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY onset_seconds, event_id) - 1 AS idx, velocity - (event_id % 3)*0.3::DOUBLE AS value FROM hits"
WITH["rms"] = """SELECT s.track_id, f.i AS frame, sqrt(avg(s.value*s.value)) AS rms FROM samples s JOIN (SELECT track_id, n, unnest(range(greatest((n - 16)//8 + 1, 1))) AS i FROM (SELECT track_id, count(*) AS n FROM samples GROUP BY 1)) f
 ON s.track_id = f.track_id AND s.idx >= f.i*8 AND s.idx < f.i*8 + 16 GROUP BY ALL"""
WITH["nov"] = "SELECT track_id, frame, CASE WHEN p IS NULL THEN 0 ELSE greatest(sm - p, 0) END AS novelty FROM (SELECT *, lag(sm) OVER (PARTITION BY track_id ORDER BY frame) AS p FROM (SELECT *, avg(rms) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM rms))"
WITH["thr"] = "SELECT track_id, greatest(list_sort(list(novelty))[round_even((count(*) - 1)*0.85::DOUBLE, 0)::INT + 1], avg(novelty)*1.35) AS threshold FROM nov GROUP BY 1"


@query("w14_frame_rms", "SELECT track_id, frame, round(rms, 6) AS rms FROM rms")
def w14(spark, sf):
    return SG.frame_rms(samples(spark, sf), FRAME, HOP).withColumn("rms", r6("rms"))


def curve(spark, sf):
    return SG.novelty(SG.frame_rms(samples(spark, sf), FRAME, HOP))


@query("w15_novelty", "SELECT track_id, frame, round(novelty, 6) AS novelty FROM nov")
def w15(spark, sf):
    return curve(spark, sf).withColumn("novelty", r6("novelty"))


@query("a26_peak_threshold", "SELECT track_id, round(threshold, 6) AS threshold FROM thr")
def a26(spark, sf):
    return SG.peak_threshold(cut(curve(spark, sf))).withColumn("threshold", r6("threshold"))


@query("a26_nearest_rank", "SELECT track_id, round(list_sort(list(onset_seconds))[round_even((count(*) - 1)*0.85::DOUBLE, 0)::INT + 1], 6) AS rank_value FROM hits GROUP BY 1")
def a26r(spark, sf):
    return SG.nearest_rank(V.hits(spark, sf), "onset_seconds", 0.85).withColumn("rank_value", r6("rank_value"))


WITH["peaks"] = """SELECT track_id, frame, novelty FROM (SELECT *, lag(novelty) OVER w AS before, lead(novelty) OVER w AS behind FROM nov WINDOW w AS (PARTITION BY track_id ORDER BY frame)) JOIN thr USING (track_id)
 WHERE novelty >= before AND novelty >= behind AND novelty >= threshold"""


@query("w16_detect_peaks", """SELECT track_id, frame, frame*8/400.0::DOUBLE AS onset_seconds FROM (SELECT track_id, unnest(list_reduce(list({'k': [frame], 'f': frame, 'v': novelty} ORDER BY frame), lambda s, x:
 CASE WHEN x.f - s.f >= 3 THEN {'k': s.k || x.k, 'f': x.f, 'v': x.v} WHEN x.v > s.v THEN {'k': s.k[:len(s.k) - 1] || x.k, 'f': x.f, 'v': x.v} ELSE s END).k) AS frame FROM peaks GROUP BY 1)""")
def w16(spark, sf):
    c = cut(curve(spark, sf))
    return SG.detect_peaks(c, SG.peak_threshold(c), RATE, HOP)


WITH["gaps"] = "SELECT track_id, onset_seconds - lag(onset_seconds) OVER (PARTITION BY track_id ORDER BY onset_seconds) AS g FROM hits"


def _fold(lo, hi):
    return f"CASE WHEN b < {lo} THEN b*pow(2, ceil(log2({lo}/b))) WHEN b > {hi} THEN b/pow(2, ceil(log2(b/{hi}))) ELSE b END"


@query("a21_tempo", f"SELECT track_id, round(coalesce({_fold('70.0', '190.0')}, 120), 4) AS tempo_bpm FROM (SELECT track_id, 60/median(g) FILTER (g BETWEEN 0.07 AND 1.5) AS b FROM gaps GROUP BY 1)")
def a21(spark, sf):
    return SG.tempo(V.hits(spark, sf)).withColumn("tempo_bpm", F.round("tempo_bpm", 4))


@query("a21_beat_tempo", f"SELECT track_id, round_even({_fold('70.0', '220.0')}, 3) AS tempo_bpm, round(b, 6) AS plain FROM (SELECT track_id, 60/median(g) FILTER (g > 0) AS b FROM gaps GROUP BY 1)")
def a21b(spark, sf):
    h = V.hits(spark, sf)
    return SG.tempo(h, "beat").join(SG.tempo(h, "plain").select("track_id", r6("tempo_bpm").alias("plain")), "track_id")


@query("a22_timing_confidence", """SELECT s.track_id, round(least(greatest(greatest(1 - sd/greatest(m, 1e-6), 0), 0.2), 0.99), 3) AS plain, round(least(greatest(greatest(1 - sd/greatest(m, 1e-6), 0) + CASE WHEN s.track_id % 3 = 0 THEN 0.08 ELSE -0.05 END, 0.2), 0.99), 3) AS beat
 FROM (SELECT track_id, stddev_pop(g) AS sd, avg(g) AS m FROM (SELECT track_id, start_seconds - lag(start_seconds) OVER (PARTITION BY track_id ORDER BY start_seconds) AS g FROM uneven) WHERE g > 0 GROUP BY 1) s""")
def a22(spark, sf):
    b = V.uneven_beats(spark, sf)
    d = V.downbeats(spark, sf).where(F.col("track_id") % 3 == 0)
    plain = SG.timing_confidence(b, None, "start_seconds").select("track_id", F.round("confidence", 3).alias("plain"))
    return plain.join(SG.timing_confidence(b, d, "start_seconds").select("track_id", F.round("confidence", 3).alias("beat")), "track_id")


@query("f10_octave_fold", f"SELECT event_id, round({_fold('70.0', '190.0')}, 6) AS onset_fold, round({_fold('70.0', '220.0')}, 6) AS beat_fold FROM (SELECT event_id, value*3 + 0.5::DOUBLE AS b FROM events)")
def f10(spark, sf):
    b = F.col("value") * 3 + 0.5
    return V.table(spark, sf, "events").select("event_id", r6(S.octave_fold(b, 70.0, 190.0)).alias("onset_fold"), r6(S.octave_fold(b, 70.0, 220.0)).alias("beat_fold"))


@query("w17_bar_segments", """SELECT track_id, i AS index, round(s, 6) AS start_seconds, round(e, 6) AS end_seconds, concat('bar_', i + 1) AS label FROM (SELECT d.track_id, row_number() OVER w - 1 AS i, d.start_seconds AS s, coalesce(lead(d.start_seconds) OVER w, duration_seconds) AS e
 FROM downbeats d JOIN summary USING (track_id) WHERE d.track_id % 5 <> 0 WINDOW w AS (PARTITION BY d.track_id ORDER BY d.start_seconds)) WHERE e > s UNION ALL SELECT track_id, 0, 0, round(duration_seconds, 6), 'full_track' FROM summary WHERE track_id % 5 = 0 AND duration_seconds > 0""")
def w17(spark, sf):
    d = V.downbeats(spark, sf).where(F.col("track_id") % 5 != 0)
    return SG.bar_segments(d, V.summary(spark, sf).select("track_id", "duration_seconds"))


def classified(spark, sf):
    """Hits as classified onsets: lanes by event type, no kicks in two of three tracks."""
    t = F.col("track_id")
    lane = (
        F.when(F.col("label") == "view", F.when(t % 3 == 0, "kick").otherwise("snare")).when(F.col("label") == "click", "snare")
        .when(F.col("label") == "purchase", "closed_hihat").when(F.col("label") == "signup", "open_hihat").otherwise("crash")
    )
    cap = F.when(t % 3 == 1, 0.69).otherwise(0.99)
    return V.hits(spark, sf).select("track_id", "event_id", "onset_seconds", lane.alias("lane"), lane.alias("label"), F.least(F.lit(0.3) + F.col("velocity") * 0.6, cap).alias("confidence"))


WITH["cls"] = """SELECT *, least(0.3::DOUBLE + velocity*0.6::DOUBLE, CASE WHEN track_id % 3 = 1 THEN 0.69 ELSE 0.99 END::DOUBLE) AS conf, CASE label WHEN 'view' THEN CASE WHEN track_id % 3 = 0 THEN 'kick' ELSE 'snare' END WHEN 'click' THEN 'snare'
 WHEN 'purchase' THEN 'closed_hihat' WHEN 'signup' THEN 'open_hihat' ELSE 'crash' END AS ln FROM near_beat"""
WITH["prom"] = """SELECT *, CASE WHEN kicks > 0 THEN false WHEN anchored > 0 THEN an ELSE ln = 'snare' AND r <= greatest(round_even(snares*0.32::DOUBLE, 0), 1) END AS promoted FROM (SELECT *, count(*) FILTER (ln = 'kick') OVER p AS kicks, count(*) FILTER (ln = 'snare') OVER p AS snares,
 count(*) FILTER (an) OVER p AS anchored, row_number() OVER (PARTITION BY track_id, ln ORDER BY conf DESC, onset_seconds) AS r FROM (SELECT *, ln = 'snare' AND abs(bd) <= g*0.16 AND bi % 2 = 0 AND conf >= 0.7 AS an FROM cls) WINDOW p AS (PARTITION BY track_id))"""
WITH["weak"] = """SELECT *, CASE WHEN ln = 'snare' AND conf < 0.54 THEN 'snare' WHEN ln = 'closed_hihat' AND conf < 0.62 THEN 'hihat' WHEN ln = 'closed_hihat' AND NOT abs(bd) <= g*0.16 AND NOT abs(bd - g/2.0) <= g*0.12 AND conf < 0.78 THEN 'hihat' END AS weak FROM cls"""


def located(spark, sf):
    b = V.uneven_beats(spark, sf).withColumnRenamed("n", "beat_index")
    return E.nearest_beat(classified(spark, sf), b)


@query("w21_promote_kicks", "SELECT event_id, promoted, round(CASE WHEN promoted THEN least(greatest(conf + 0.05, 0.56), 0.94) ELSE conf END, 6) AS confidence FROM prom")
def w21(spark, sf):
    return SG.promote_kicks(cut(located(spark, sf))).select("event_id", "promoted", r6("confidence").alias("confidence"))


@query("w20_filter_weak", "SELECT event_id, weak FROM weak")
def w20(spark, sf):
    return SG.filter_weak(located(spark, sf)).select("event_id", "weak")


WITH["lane_gaps"] = """SELECT *, CASE WHEN g > 0 THEN least(base, greatest(g*0.24, 0.045)) ELSE base END AS gap FROM (SELECT *, CASE ln WHEN 'kick' THEN 0.075 WHEN 'snare' THEN 0.10 WHEN 'closed_hihat' THEN 0.055
 WHEN 'open_hihat' THEN 0.08 WHEN 'crash' THEN 0.16 ELSE 0.14 END::DOUBLE AS base FROM cls)"""


@query("w13_dedupe_same_lane", """SELECT track_id, k.t AS onset_seconds, k.lane AS lane, k.label AS label, k.c AS confidence, k.m AS merged FROM (SELECT track_id, unnest(list_reduce(
 list({'k': [{'t': onset_seconds, 'lane': ln, 'label': ln, 'c': conf, 'm': 0}], 'gap': gap} ORDER BY onset_seconds, ln, conf, label), lambda s, x: {'gap': x.gap, 'k':
 CASE WHEN s.k[len(s.k)].lane <> x.k[1].lane OR x.k[1].t - s.k[len(s.k)].t >= x.gap THEN s.k || x.k
 WHEN x.k[1].c > s.k[len(s.k)].c THEN s.k[:len(s.k) - 1] || list_transform(x.k, lambda z: {'t': z.t, 'lane': z.lane, 'label': z.label, 'c': z.c, 'm': s.k[len(s.k)].m + 1})
 ELSE s.k[:len(s.k) - 1] || list_transform(s.k[len(s.k):], lambda z: {'t': z.t, 'lane': z.lane, 'label': z.label, 'c': z.c, 'm': z.m + 1}) END}).k) AS k FROM lane_gaps GROUP BY 1)""")
def w13(spark, sf):
    return SG.dedupe_same_lane(cut(located(spark, sf)))


def _onsets(spark, sf):
    """An onset every twelve samples, to the end of each track."""
    n = samples(spark, sf).groupBy("track_id").agg(F.floor(F.count(F.lit(1)) / 12).alias("n")).where(F.col("n") > 0)
    return n.select("track_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select("track_id", (F.col("k") * 0.03).alias("onset_seconds"))


WITH["on5"] = "SELECT track_id, k*0.03::DOUBLE AS t, floor(k*0.03::DOUBLE*400)::INT AS c FROM (SELECT track_id, unnest(range(1, count(*)//12 + 1)) AS k FROM samples GROUP BY track_id)"
WITH["win"] = "SELECT o.track_id, o.t, s.idx, s.value, lag(s.value) OVER (PARTITION BY o.track_id, o.t ORDER BY s.idx) AS p FROM on5 o JOIN samples s ON s.track_id = o.track_id AND s.idx >= greatest(c - 12, 0) AND s.idx < c + 24"
WITH["feat"] = """SELECT w.track_id, w.t, avg(abs(value)) AS a, count(*) FILTER ((p <= 0 AND value > 0) OR (p >= 0 AND value < 0))::DOUBLE/greatest(count(*) - 1, 1) AS z, avg(abs(value - p)) AS m FROM win w GROUP BY ALL"""
WITH["tails"] = "SELECT o.track_id, o.t, avg(abs(s.value)) AS tail FROM on5 o JOIN samples s ON s.track_id = o.track_id AND s.idx >= greatest(c + 6, 0) AND s.idx < c + 36 GROUP BY ALL"


@query("g17_onset_features", """SELECT o.track_id, round(o.t, 6) AS onset_seconds, round(coalesce(a, 0), 6) AS avg_abs, round(coalesce(z, 0), 6) AS zcr, round(coalesce(tail, 0)/greatest(coalesce(a, 0), 1e-6), 5) AS sustain_ratio, round(coalesce(m, 0)/greatest(coalesce(a, 0), 1e-6), 5) AS mid_ratio
 FROM on5 o LEFT JOIN feat f ON o.track_id = f.track_id AND o.t = f.t LEFT JOIN tails x ON o.track_id = x.track_id AND o.t = x.t""")
def g17(spark, sf):
    f = SG.onset_features(samples(spark, sf), _onsets(spark, sf), RATE)
    return f.select("track_id", r6("onset_seconds").alias("onset_seconds"), r6("avg_abs").alias("avg_abs"), r6("zcr").alias("zcr"), F.round("sustain_ratio", 5).alias("sustain_ratio"), F.round("mid_ratio", 5).alias("mid_ratio"))


# at this rate the low and middle steps are one sample, so both motions are the mean step
WITH["ratios"] = """SELECT o.track_id, o.t, a, z, tail/greatest(a, 1e-6) AS s, a/greatest(tail, 1e-6) AS p, a/greatest(m, 1e-6) AS b, m/greatest(a, 1e-6) AS m, m/greatest(m, 1e-6) AS q FROM (
 SELECT o.track_id, o.t, coalesce(a, 0) AS a, coalesce(z, 0) AS z, coalesce(m, 0) AS m, coalesce(tail, 0) AS tail FROM on5 o LEFT JOIN feat f ON o.track_id = f.track_id AND o.t = f.t LEFT JOIN tails x ON o.track_id = x.track_id AND o.t = x.t) o"""
WITH["lanes_of"] = """SELECT *, CASE WHEN (z < 0.14 AND p > 1.01 AND b > 1.03) OR (z < 0.09 AND p > 0.98) THEN 'kick' WHEN z > 0.46 AND s > 0.8 AND a > 0.18 THEN 'crash' WHEN z > 0.33 AND s > 0.72 THEN 'open_hihat'
 WHEN z > 0.3 OR (m > 1.55 AND p < 1.08) THEN 'closed_hihat' WHEN s > 0.86 AND z >= 0.12 AND z <= 0.3 AND b < 1.18 AND q < 1.45 THEN CASE WHEN q < 0.72 THEN 'tom_low' WHEN q < 0.98 THEN 'tom_mid' ELSE 'tom_high' END ELSE 'snare' END AS lane FROM ratios"""


@query("g17_classify", """SELECT track_id, round(t, 6) AS onset_seconds, lane, CASE lane WHEN 'open_hihat' THEN 'open hi hat' WHEN 'closed_hihat' THEN 'closed hi hat' WHEN 'tom_low' THEN 'floor tom' WHEN 'tom_mid' THEN 'mid tom' WHEN 'tom_high' THEN 'high tom' ELSE lane END AS label,
 round(least(0.99, CASE lane WHEN 'kick' THEN 0.48 + a*1.15 + greatest(0, b - 1)*0.32 WHEN 'crash' THEN 0.46 + least(z, 0.65)*0.48 + least(s, 1.4)*0.16 WHEN 'open_hihat' THEN 0.4 + least(z, 0.55)*0.58 + least(s, 1.2)*0.1
 WHEN 'closed_hihat' THEN 0.38 + greatest(z, least(m/2.2, 0.45))*1.1 WHEN 'snare' THEN 0.46 + a*0.95 + least(m, 1)*0.06 ELSE 0.44 + least(s, 1.25)*0.18 + greatest(0, 1.22 - q)*0.16 END), 6) AS confidence FROM lanes_of""")
def g17c(spark, sf):
    c = SG.classify(SG.onset_features(samples(spark, sf), _onsets(spark, sf), RATE))
    return c.select("track_id", r6("onset_seconds").alias("onset_seconds"), "lane", "label", r6("confidence").alias("confidence"))


@query("g19_analyze_samples")
def g19(spark, sf):
    r = SG.analyze_samples(cut(samples(spark, sf)), RATE, FRAME, HOP)
    return r["summary"].withColumn("warnings", F.array_join("warnings", "|"))


# --- ledger ----------------------------------------------------------------------------------------------


def jobs(spark, sf):
    i = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    return V.table(spark, sf, "orders").select(
        i.alias("id"), F.col("o_custkey").alias("workflow_id"), F.when(i % 3 == 0, "audio_ingest").when(i % 3 == 1, "audio_analyze").otherwise("chart_generate").alias("type"),
        status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("run_after"),
        (i % 6).alias("attempt"), F.lit(5).alias("max_attempts"), F.when(i % 4 != 0, F.col("o_orderdate")).alias("completed_at"), F.when(i % 5 != 0, F.concat(F.lit("k"), (i % 1000).cast("string"))).alias("idempotency_key"),
    )


WITH["jobs"] = """SELECT o_orderkey AS id, o_custkey AS workflow_id, CASE o_orderkey % 3 WHEN 0 THEN 'audio_ingest' WHEN 1 THEN 'audio_analyze' ELSE 'chart_generate' END AS type, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status,
 substr(o_orderpriority, 1, 1)::INT AS priority, o_orderdate AS created_at, o_orderkey % 6 AS attempt, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS completed_at, CASE WHEN o_orderkey % 5 <> 0 THEN concat('k', o_orderkey % 1000) END AS idempotency_key FROM orders"""


@query("s09_append_ledger", """SELECT id FROM jobs WHERE id % 4 <> 0 AND idempotency_key IS NULL UNION ALL SELECT min(id) FROM jobs WHERE id % 4 <> 0 AND idempotency_key IS NOT NULL AND idempotency_key NOT IN (SELECT idempotency_key FROM jobs WHERE id % 4 = 0 AND idempotency_key IS NOT NULL) GROUP BY idempotency_key""")
def s09(spark, sf):
    j = jobs(spark, sf)
    return LG.append_ledger(j, j.where(F.col("id") % 4 == 0), "id", "idempotency_key").select("id")


@query("p23_filter_ledger", "SELECT id, status FROM jobs WHERE workflow_id = 7 AND status = 'queued'")
def p23(spark, sf):
    return LG.filter_ledger(jobs(spark, sf), workflow_id=7, status="queued").select("id", "status")


@query("t02_list_newest", "SELECT id, strftime(created_at, '%Y-%m-%d') AS day FROM jobs ORDER BY created_at DESC, id LIMIT 50")
def t02(spark, sf):
    return LG.list_newest(jobs(spark, sf), 50).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("t03_list_jobs", "SELECT id FROM jobs WHERE status = 'running'")
def t03(spark, sf):
    return LG.list_jobs(jobs(spark, sf), "running").select("id")


@query("t04_find_job", "SELECT id, type, status FROM jobs WHERE id = 42")
def t04(spark, sf):
    return LG.find_job(jobs(spark, sf), 42).select("id", "type", "status")


@query("t05_runnable_jobs", "SELECT id, priority FROM jobs WHERE status = 'queued' AND created_at <= TIMESTAMP '1998-06-01' ORDER BY priority, created_at, id LIMIT 10")
def t05(spark, sf):
    return LG.runnable_jobs(jobs(spark, sf), F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), 10).select("id", "priority")


@query("a31_job_counts", "SELECT status, type, count(*) AS n FROM jobs GROUP BY ALL")
def a31(spark, sf):
    return LG.job_counts(jobs(spark, sf))


@query("f06_retry_time", "SELECT id, CASE WHEN attempt < 5 THEN epoch(completed_at)::BIGINT + least(pow(2, greatest(attempt - 1, 0)), 60)::BIGINT END AS retry_epoch FROM jobs")
def f06(spark, sf):
    j = jobs(spark, sf).withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    return LG.next_retry(j).select("id", F.unix_seconds("retry_at").alias("retry_epoch"))


def job_events(spark, sf):
    n = F.col("l_linenumber")
    kind = F.when(n % 4 == 1, "job_claimed").when(n % 4 == 2, "job_requeued").when(n % 4 == 3, "job_claimed").otherwise(F.when(F.col("l_orderkey") % 2 == 0, "job_succeeded").otherwise("job_failed"))
    return V.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", F.lpad(n.cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("id"),
        F.col("l_orderkey").alias("job_id"), kind.alias("event_type"), F.concat(F.lit("m"), n.cast("string")).alias("message"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


WITH["job_events"] = """SELECT concat_ws('-', l_orderkey, lpad(l_linenumber::VARCHAR, 3, '0'), lpad(l_partkey::VARCHAR, 9, '0'), lpad(l_suppkey::VARCHAR, 9, '0')) AS id, l_orderkey AS job_id, CASE l_linenumber % 4 WHEN 1 THEN 'job_claimed' WHEN 2 THEN 'job_requeued' WHEN 3 THEN 'job_claimed'
 ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'job_succeeded' ELSE 'job_failed' END END AS event_type, concat('m', l_linenumber) AS message, l_shipdate AS created_at FROM lineitem"""
_STATE = """SELECT e.job_id, CASE e.event_type WHEN 'job_claimed' THEN 'running' WHEN 'job_succeeded' THEN 'succeeded' WHEN 'job_requeued' THEN 'queued' ELSE 'failed' END AS status, c.attempt, CASE WHEN e.event_type IN ('job_requeued', 'job_failed') THEN e.message END AS last_error
 FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS r FROM job_events) e JOIN (SELECT job_id, count(*) FILTER (event_type = 'job_claimed') AS attempt FROM job_events GROUP BY 1) c USING (job_id) WHERE r = 1"""


@query("g20_job_state", _STATE)
def g20(spark, sf):
    return LG.job_state(job_events(spark, sf)).select("job_id", "status", "attempt", "last_error")


@query("g21_artifact_catalog", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN concat('duration=', o_orderkey % 90, 's | tempo≈', 90 + o_orderkey % 40, ' bpm | segments=', o_orderkey % 9, ' | tracks=1 | backend=primary') END AS summary FROM orders""")
def g21(spark, sf):
    i = F.col("o_orderkey")
    meta = F.to_json(F.struct((i % 90).cast("double").alias("durationSeconds"), F.lit(1).alias("audioTrackCount"), (i % 9).alias("estimatedSegmentCount"), (F.lit(90.0) + i % 40).alias("estimatedTempoBPM"), F.lit("primary").alias("runtimeSelectedBackend")))
    a = V.table(spark, sf, "orders").select(i.alias("id"), F.when(i % 3 == 0, "audio_analysis").otherwise("base_chart").alias("artifact_type"), meta.alias("metadata_json"))
    return LG.artifact_catalog(a).select("id", "summary")


@query("f07_f08_names", r"""SELECT p_partkey AS id, coalesce(nullif(trim(regexp_replace(regexp_replace(concat('--', p_name, ' ', p_brand, '_'), '[^\p{L}\p{M}\p{N}\-_]', '-', 'g'), '-+', '-', 'g'), '-_'), ''), 'chart') AS base,
 strftime(TIMESTAMP '2024-01-01' + INTERVAL (p_partkey) SECOND, '%Y%m%dT%H%M%S000Z') AS stamp, CASE p_partkey % 4 WHEN 0 THEN 'audio/wav' WHEN 1 THEN 'audio/aiff' WHEN 2 THEN 'audio/flac' END AS content_type FROM part""")
def f07(spark, sf):
    i = F.col("p_partkey")
    ts = F.timestamp_seconds(F.lit(V.EPOCH) + i)
    ext = F.when(i % 4 == 0, "WAV").when(i % 4 == 1, "aif").when(i % 4 == 2, "flac").otherwise("txt")
    return V.table(spark, sf, "part").select(
        i.alias("id"), S.chart_base_name(F.concat(F.lit("--"), "p_name", F.lit(" "), "p_brand", F.lit("_"))).alias("base"), S.file_timestamp(ts).alias("stamp"), S.content_type(ext).alias("content_type")
    )


# --- files: each query writes what it derives from the tables to the shared folder and reads it back --------


@query("s01_read_charts", "SELECT chart_id::VARCHAR AS song_id, 'normal' AS key_difficulty, count(*) AS n, sum(tick) AS ticks, count(DISTINCT lane) AS lanes FROM notes_a WHERE chart_id % 13 <> 0 GROUP BY ALL")
def s01(spark, sf):
    charts = V.charts(spark, sf).select("chart_id")
    n = V.notes_base(spark, sf).join(charts, "chart_id").select("chart_id", F.struct("tick", "lane", F.col("beat_index").alias("beatIndex")).alias("n"))
    # one file per chart: a chart is one document
    docs = n.groupBy("chart_id").agg(F.sort_array(F.collect_list("n")).alias("notes")).select(
        F.col("chart_id"), F.to_json(F.struct(F.struct(F.lit("normal").alias("difficulty"), "notes").alias("chart"))).alias("value")
    )
    root = work_dir(spark, "charts")
    sinks.write_documents(docs.select(F.concat(F.col("chart_id").cast("string"), F.lit("--normal.json")).alias("name"), "value"), root)
    t = files.chart_tables(files.read_charts(spark, root))
    return t["notes"].join(t["charts"], "chart_id").groupBy("song_id", "key_difficulty").agg(F.count(F.lit(1)).alias("n"), F.sum("tick").alias("ticks"), F.count_distinct("lane").alias("lanes"))


@query("s02_read_corpus", "SELECT song_id::VARCHAR AS song_id, 'prototype' AS difficulty, len(req) AS required, smoke FROM exp JOIN songs USING (song_id) WHERE smoke")
def s02(spark, sf):
    s, e = V.songs(spark, sf), V.expectations(spark, sf)
    j = s.join(e, "song_id").select(F.struct(
        F.col("song_id").cast("string").alias("id"), "title", F.col("source_fixture").alias("sourceFixture"), F.col("source_type").alias("sourceType"), "tags",
        F.array(F.struct(F.lit("prototype").alias("difficulty"), F.col("required_lanes").alias("requiredLanes"))).alias("expectations"),
    ).alias("s"))
    # manifests of at most 256 songs each
    j = j.withColumn("part", F.floor(F.col("s.id").cast("long") / 256))
    root = work_dir(spark, "corpus")
    j.groupBy("part").agg(F.collect_list("s").alias("songs")).repartition("part").write.partitionBy("part").json(root)
    c = files.read_corpus(spark, root, tag="smoke")
    return c["expectations"].join(c["songs"].select("song_id", F.array_contains("tags", "smoke").alias("smoke")), "song_id").select("song_id", "difficulty", F.size("required_lanes").alias("required"), "smoke")


@query("s03_read_payloads", "SELECT concat('clip-', track_id) AS track_id, NOT bad AS is_valid FROM clips")
def s03(spark, sf):
    root = work_dir(spark, "payloads")
    sinks.write_documents(CD.payloads(spark, sf).select(F.concat(F.lit("clip-"), F.col("track_id").cast("string"), F.lit(".json")).alias("name"), F.col("text").alias("value")), root)
    return files.read_payloads(spark, root).select("track_id", "is_valid")


@query("s04_read_log_json", "SELECT o_orderkey // 16 AS first_batch, count(*) AS items FROM orders GROUP BY 1")
def s04(spark, sf):
    root = work_dir(spark, "logs")
    # logs of sixteen orders, many to a file
    loop_documents(spark, sf).select("text").write.option("lineSep", files.RECORD).text(root)
    docs = files.read_log_json(spark, root, files.RECORD)
    items = docs.select(F.explode(F.try_variant_get("raw", "$.validate_analyzer", "array<variant>")).alias("a"))
    uri = F.substring(F.try_variant_get("a", "$.source.source_uri", "string"), 2, 20).cast("long")
    return items.groupBy(F.floor(uri / 16).alias("first_batch")).agg(F.count(F.lit(1)).alias("items"))


@query("s05_read_beat_text", "SELECT count(*) AS n, count(*) FILTER (n % 4 = 0) AS down, round(sum(n*0.5), 3) AS total FROM beats")
def s05(spark, sf):
    root = work_dir(spark, "beats")
    b = V.beats(spark, sf)
    line = F.concat(F.format_string("%.6f", "start_seconds"), F.lit(" "), (F.col("n") % 4 + 1).cast("string"))
    texts = b.select(F.explode(F.array(line, F.lit("# comment"), F.lit("bad 1"), F.lit(""))).alias("value"))
    texts.write.text(root)
    r = files.read_beat_text(spark, root)
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_downbeat").alias("down"), F.round(F.sum("start_seconds"), 3).alias("total"))


@query("s06_audio_manifest")
def s06(spark, sf):
    root = work_dir(spark, "audio")
    h = V.hits(spark, sf).select(F.floor(F.col("event_id") / 5000).alias("b"), F.col("onset_seconds").cast("string").alias("value"))
    h.repartition("b").write.partitionBy("b").text(root)
    return files.audio_manifest(spark, root).select("path", "size", "content_type", "sha256")


@query("s07_write_artifacts", "SELECT count(*) AS documents, count(DISTINCT o_custkey % 20) AS workflows FROM orders")
def s07(spark, sf):
    i = F.col("o_orderkey")
    a = V.table(spark, sf, "orders").select(
        F.lit("audio-analysis").alias("category"), (F.col("o_custkey") % 20).alias("workflow_id"), F.concat(F.lit("file:///in/track "), i.cast("string"), F.lit(".wav")).alias("source_uri"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_totalprice").alias("value"),
    )
    root = work_dir(spark, "artifacts")
    sinks.write_artifacts(sinks.artifact_names(a), root)
    back = spark.read.schema("file_name string, document string, category string, workflow_id string").json(root)
    return back.agg(F.count("file_name").alias("documents"), F.count_distinct("workflow_id").alias("workflows"))


@query("s08_write_report")
def s08(spark, sf):
    r = CC.corpus(spark, sf)
    root = work_dir(spark, "report")
    sinks.write_report(cut_lines(r), r["results"].select("song_id", "difficulty", "score", "passed"), f"{root}/json", f"{root}/text")
    return spark.read.text(f"{root}/text")


def cut_lines(r):
    from beatloom.operators import corpus as P2

    return P2.render_summary(r)


# --- streams: written tables read back as streams until they are drained --------------------------------------


def as_stream(df, root, parts=3):
    """A stream that reads the rows in ``parts`` batches, dealt by a hash of what is cheap to compute.

    Each part is written by all tasks that read the rows, one part after the other, so that none is made by one task.
    """
    keys = [c for c, kind in df.dtypes if kind != "string"] or df.columns
    for k in range(parts):
        df.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == k).write.mode("append").parquet(root)
    files = max(1, df.rdd.getNumPartitions())
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(root)


@query("st01_stream_charts")
def st01(spark, sf):
    root, out = work_dir(spark, "stream-in"), work_dir(spark, "stream-charts")
    sinks.write_documents(CD.payloads(spark, sf).select(F.concat(F.lit("clip-"), F.col("track_id").cast("string"), F.lit(".json")).alias("name"), F.col("text").alias("value")), root)
    ST.stream_charts(spark, root, out, out + "-checkpoint", bytes_per_batch=256 << 20).awaitTermination()
    return spark.read.option("basePath", f"{out}/charts").parquet(f"{out}/charts").select("chart_id", "timing_source", "difficulty")


@query("st02_stream_dedupe", "SELECT count(*) AS n, count(DISTINCT idempotency_key) AS keys FROM (SELECT DISTINCT idempotency_key FROM jobs WHERE idempotency_key IS NOT NULL)")
def st02(spark, sf):
    j = jobs(spark, sf).select("id", "idempotency_key", F.col("created_at").cast("timestamp").alias("created_at"))
    root, out = work_dir(spark, "submissions"), work_dir(spark, "unique")
    s = ST.dedupe_submissions(as_stream(j, root), delay="36500 days")
    ST.run_to_folder(s, out, out + "-checkpoint").awaitTermination()
    return spark.read.schema("idempotency_key string").parquet(out).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idempotency_key").alias("keys"))


@query("st03_stream_job_state", _STATE)
def st03(spark, sf):
    root, out = work_dir(spark, "events"), work_dir(spark, "state")
    s = ST.stream_job_state(as_stream(job_events(spark, sf), root))
    ST.run_to_folder(s, out, out + "-checkpoint", "update").awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    latest = rows.groupBy("job_id").agg(F.max_by(F.struct("status", "attempt", "last_error"), "batch").alias("s"))
    return latest.select("job_id", "s.status", "s.attempt", "s.last_error")
