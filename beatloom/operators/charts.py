"""Documents to charts: the composite job over a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions import scalars as S
from beatloom.operators import events as E
from beatloom.operators import grid as G
from beatloom.operators import notes as N
from beatloom.operators import payloads as P
from beatloom.operators import shaping as H
from beatloom.session import cut


def _join_text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def combined_warnings() -> Column:
    """Analyzer warnings plus what normalisation noticed, each once. Texts are fixed values."""
    c = F.col
    timed, fallback = c("timed"), c("used_fallback")
    return F.array_distinct(
        F.concat(
            c("warnings"),
            F.array_compact(
                F.array(
                    F.when(c("tempo_bpm").isNull(), "No analyzer tempo found; fallback 120 BPM grid used for chart-generation staging."),
                    F.when(c("duration_seconds").isNull(), "No analyzer duration found; normalized beat grid may be truncated."),
                    F.when(c("anchor_count") == 0, "No usable beat grid anchors were available; chart timing may be incomplete."),
                    F.when(
                        fallback,
                        F.when(timed, "Analyzer timing was preserved, but analyzer drum-event candidates were unusable; heuristicDrumEvents supplied the playable drum events instead.")
                        .otherwise("Analyzer did not provide usable timing or drum-event candidates; emitted heuristic playable groove instead."),
                    ),
                    F.when(c("dropped_missing_onset") > 0, _join_text("Dropped ", c("dropped_missing_onset"), " drum-event candidates without onset timing.")),
                    F.when(c("dropped_unknown_lane") > 0, _join_text("Dropped ", c("dropped_unknown_lane"), " drum-event candidates with unmapped lanes.")),
                    F.when(c("deduplicated_count") > 0, _join_text("Collapsed ", c("deduplicated_count"), " analyzer drum-event duplicates that landed on the same lane and quantized slot.")),
                    F.when(c("shaping_reduction") > 0, _join_text("Reduced analyzer-driven drum events by ", c("shaping_reduction"), " during normalization shaping before base-chart note generation.")),
                    F.when(
                        (c("raw_count") > 0) & (c("mapped_count") < c("raw_count")),
                        _join_text("Mapped ", c("mapped_count"), " of ", c("raw_count"), " analyzer drum-event candidates into gameplay lanes."),
                    ),
                    F.when(
                        timed | (c("raw_count") > 0),
                        _join_text("Timing/events split: timing source=", F.when(timed, "analyzer").otherwise("heuristic"), "; drum-event source=",
                                   F.when(fallback, "heuristicDrumEvents").otherwise("analyzer"), "."),
                    ),
                    F.when(
                        c("raw_count") > 0,
                        _join_text("Analyzer drum-event diagnostics: raw=", c("raw_count"), " mapped=", c("mapped_count"), " post-shaping=", c("post_shaping_count"), "."),
                    ),
                    F.when(c("max_drift") > 0.05, F.format_string("Quantization drift reached %.3f seconds at the furthest mapped drum event.", c("max_drift"))),
                )
            ),
        )
    )


def _notes_text(what: str) -> Column:
    """Closing remark of the normalised analysis or the chart. Texts are fixed values."""
    n = F.col("slots_per_beat")
    if what == "normalized":
        texts = (
            ("Normalized analysis generated from analyzer-provided timing and analyzer drum-event candidates with ", "x subdivision anchors per beat."),
            ("Normalized analysis generated from analyzer-provided timing, while drum events came from heuristicDrumEvents fallback shaping, with ", "x subdivision anchors per beat."),
            ("Heuristic normalization generated from coarse analysis summary with ", "x fallback subdivision anchors per beat."),
        )
    else:
        texts = (
            ("Base chart generated from analyzer-provided timing and mapped analyzer drum-event candidates using ", "x quantization."),
            ("Base chart generated from analyzer-provided timing, while note placement came from heuristicDrumEvents fallback output, using ", "x quantization."),
            ("Heuristic base chart intended as a deterministic playable scaffold using ", "x fallback quantization."),
        )
    a, b, c = (_join_text(t[0], n, t[1]) for t in texts)
    return F.when(F.col("analyzer_events"), a).when(F.col("timed"), b).otherwise(c)


def grids(parts: DataFrame, analysis: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grid of every document, and the tracks whose own timing was used."""
    beats, downs, subs = (P.long_times(parts, x) for x in ("beats", "downbeats", "subdivisions"))
    summary = analysis.select("track_id", "tempo_bpm", "downbeat_offset", "duration_seconds", "confidence", "subdivisions_per_beat")
    timed = beats.select("track_id").distinct()
    onsets = candidates.select("track_id", F.col("candidate_seconds").alias("onset_seconds")).where(F.col("onset_seconds").isNotNull())
    own = G.beat_grid(beats, downs, subs, summary.join(timed, "track_id", "left_semi"), onsets)
    made = G.fallback_grid(summary.join(timed, "track_id", "left_anti"))
    return cut(own.unionByName(made)), timed


def generate_charts(payloads: DataFrame, generated_at: str = "1970-01-01 00:00:00") -> dict[str, DataFrame]:
    """Analysis, grid, events, summary, charts, measures and notes of every document."""
    analysis = cut(P.normalize_analysis(payloads).drop("raw"))
    parts = cut(P.document_parts(payloads))
    candidates = cut(P.project_hits(P.long_hits(parts)))
    grid, timed = grids(parts, analysis, candidates)
    quantized = cut(E.quantize(candidates.where(F.col("drop_reason").isNull()), grid))
    shaped = cut(H.shape_events(quantized).drop("drift_seconds"))
    events = cut(H.with_groove(shaped, grid))
    measures = G.measures(grid)
    notes = N.chart_notes(events, grid)

    diag = E.diagnostics(candidates.withColumn("drift_seconds", F.lit(None).cast("double")), shaped).drop("max_drift")
    drift = E.max_drift(quantized).select("track_id", F.col("max_drift").alias("drift"))
    g = grid.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("anchor_count"),
        F.count_distinct("beat_index").alias("beat_count"),
        F.count_distinct("bar_index").alias("bar_count"),
        (F.max("subdivision_in_beat") + 1).alias("slots_per_beat"),
        F.min(F.when((F.col("beat_index") == 0) & (F.col("subdivision_in_beat") == 0), F.col("start_seconds"))).alias("first_beat"),
    )
    ev = events.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.bool_or(~F.coalesce(F.col("source_label").startswith("heuristic_"), F.lit(False))).alias("analyzer_events"),
        F.sort_array(F.collect_set("lane")).alias("lanes"),
    )
    d = analysis
    for other in (diag, drift, g, ev, E.lane_summary(events), E.confidence_bands(events), timed.withColumn("timed", F.lit(True))):
        d = d.join(other, "track_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in (
        "raw_count", "mapped_count", "post_shaping_count", "dropped_missing_onset", "dropped_unknown_lane", "deduplicated_count",
        "shaping_reduction", "anchor_count", "beat_count", "bar_count", "event_count", "high", "medium", "low", "unknown")}
    d = d.withColumns({
        **zeros, "used_fallback": F.coalesce("used_fallback", F.lit(True)), "timed": F.coalesce("timed", F.lit(False)),
        "analyzer_events": F.coalesce("analyzer_events", F.lit(False)), "slots_per_beat": F.coalesce("slots_per_beat", F.lit(1)),
    })
    d = d.withColumn("max_drift", F.when(~F.col("used_fallback"), F.col("drift")))
    d = d.withColumn("post_shaping_count", F.when(F.col("used_fallback"), F.col("event_count")).otherwise(F.col("post_shaping_count")))
    c = F.col
    fb = c("used_fallback")
    d = d.withColumns({
        "timing_source": F.when(c("timed"), "analyzer").otherwise("heuristic"),
        "timing_backend": F.coalesce("timing_provenance.backend", "selected_backend", "runtime_backend"),
        "event_source": F.when(fb, "heuristicDrumEvents").otherwise(F.coalesce("event_provenance.event_source", F.lit("analyzer"))),
        "event_backend": F.when(fb, "heuristicDrumEvents").otherwise(F.coalesce("event_provenance.backend", "runtime_backend")),
        "event_backend_command": F.when(~fb, c("event_provenance.backend_command")),
        "all_warnings": combined_warnings(),
    })
    top = F.slice(S.notable("all_warnings"), 1, 3)
    normalized = d.select(
        "track_id", "duration_seconds", "tempo_bpm", F.coalesce("first_beat", "downbeat_offset").alias("downbeat_offset"),
        "beat_count", "bar_count", c("event_count").alias("drum_event_count"), "confidence",
        "timing_source", "timing_backend", "event_source", "event_backend", "event_backend_command",
        F.struct("raw_count", "mapped_count", "post_shaping_count", "used_fallback", "dropped_missing_onset", "dropped_unknown_lane",
                 "deduplicated_count", "shaping_reduction").alias("diagnostics"),
        S.kv_text(timing=c("timing_source"), timing_backend=c("timing_backend"), events=c("event_source"), event_backend=c("event_backend")).alias("source_summary"),
        F.coalesce("lane_summary", F.lit("none")).alias("lane_summary"),
        S.kv_text(high=c("high"), medium=c("medium"), low=c("low"), unknown=c("unknown")).alias("confidence_summary"),
        F.when(F.size(top) > 0, F.array_join(top, " | ")).alias("warning_summary"),
        c("all_warnings").alias("warnings"), _notes_text("normalized").alias("note"),
    )
    charts = d.select(
        c("track_id").alias("chart_id"), c("tempo_bpm").alias("bpm"), F.coalesce("first_beat", "downbeat_offset", F.lit(0.0)).alias("offset_seconds"),
        F.lit(K.TICKS_PER_BEAT).alias("ticks_per_beat"), F.when(c("timed"), "generated").otherwise("fallback").alias("timing_source"),
        F.when(F.size("lanes") > 0, c("lanes")).otherwise(F.array(F.lit("kick"))).alias("lanes"),
        F.when(c("analyzer_events"), "prototype").otherwise("normal").alias("difficulty"),
        c("all_warnings").alias("warnings"), _notes_text("chart").alias("note"), F.lit(generated_at).cast("timestamp").alias("generated_at"),
    )
    rename = lambda x: x.withColumnRenamed("track_id", "chart_id")
    return {
        "analysis": analysis, "beat_grid": grid, "drum_events": events, "normalized": normalized, "charts": charts,
        "measures": rename(measures), "notes": rename(notes),
    }


def chart_documents(result: dict[str, DataFrame]) -> DataFrame:
    """Charts with nested measures and notes, one row per chart, for JSON sinks.

    A chart is one document by definition, so its notes end up in one row.
    """
    m = result["measures"].groupBy("chart_id").agg(
        F.sort_array(F.collect_list(F.struct("bar_index", "start_beat_index", "beat_count", "time_signature"))).alias("measures")
    )
    n = result["notes"].groupBy("chart_id").agg(
        F.sort_array(F.collect_list(F.struct("tick", "lane", "note_id", "beat_index", "subdivision_index", "start_seconds", "duration_ticks", "velocity", "source_event_id"))).alias("notes")
    )
    return result["charts"].join(m, "chart_id", "left").join(n, "chart_id", "left")
