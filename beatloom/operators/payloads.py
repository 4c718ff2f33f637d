"""Loose analyzer documents to typed tables.

Input: ``track_id, raw`` with one VARIANT document per row (null for malformed text). Everything
is a projection or an explode of one document, so nothing here shuffles. Searches that go to any
depth run over the document's text, see ``functions.documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions import documents as D
from beatloom.functions import scalars as S
from beatloom.functions import variants as V


def unwrap(v) -> Column:
    """Follow result/output/payload/data while an object is there."""
    v = S.col(v)
    inner = F.coalesce(*[V.obj(v, k) for k in K.PAYLOAD_CONTAINERS])
    # most documents are wrapped once at most; only the others are searched
    return F.coalesce(D.over(D.unwrapped, "variant", inner), inner, v)


def unwrap_payload(payloads: DataFrame) -> DataFrame:
    """Adds ``payload``: the unwrapped document, an empty object when there is none."""
    return payloads.withColumn("payload", F.coalesce(unwrap("raw"), F.parse_json(F.lit("{}"))))


def candidate_roots(payloads: DataFrame) -> DataFrame:
    """Objects that may hold timing or hits, in (depth, path) order.

    Of objects with the same keys only the first is kept.
    """
    found = D.over(lambda doc: [{"depth": d, "path": p, "keys": k, "v": D.json.dumps(v)} for d, p, k, v in D.roots(doc)], "array<struct<depth:int,path:string,keys:string,v:string>>", "raw")
    rows = payloads.select("track_id", F.explode(found).alias("o"))
    return rows.select("track_id", "o.depth", "o.path", "o.keys", F.parse_json("o.v").alias("v"))


def document_parts(payloads: DataFrame, *only: str) -> DataFrame:
    """Beats, downbeats, subdivisions and hits of every document in one pass.

    Of each the first object that holds any counts, the document itself first. ``only`` names the
    parts that are wanted.
    """
    wanted = list(only or (*D.TIMES, "hits"))
    found = payloads.select("track_id", F.get(D.over(lambda doc: [D.parts(doc)], f"array<struct<{D.PARTS}>>", "raw"), 0).alias("p"))
    parse = lambda h: F.struct(F.parse_json(h["outer"]).alias("outer"), F.parse_json(h["inner"]).alias("inner"))
    pick = {k: V.normalize_starts(f"p.{k}") if k != "hits" else F.transform("p.hits", parse) for k in wanted}
    return found.select("track_id", *[c.alias(k) for k, c in pick.items()])


def long_times(parts: DataFrame, what: str) -> DataFrame:
    return parts.select("track_id", F.posexplode(what).alias("pos", "start_seconds"))


def long_hits(parts: DataFrame) -> DataFrame:
    return parts.select("track_id", F.posexplode("hits").alias("pos", "h")).select("track_id", "pos", "h.outer", "h.inner")


def extract_times(payloads: DataFrame, what: str) -> DataFrame:
    """Beats, downbeats or subdivisions in long form: track_id, pos, start_seconds."""
    return long_times(document_parts(payloads, what), what)


# --- hits ---------------------------------------------------------------------------------


def extract_hits(payloads: DataFrame) -> DataFrame:
    """Raw hits of each document: track_id, pos, outer, inner.

    Twenty-three container paths are tried in order, the first non-empty one wins; a hit wrapped
    in event/hit/drum keeps both objects, inner keys winning. A container is searched to any depth.
    """
    return long_hits(document_parts(payloads, "hits"))


def project_hits(raw_hits: DataFrame, version: str = "runtime") -> DataFrame:
    """Typed candidates with ``lane`` and ``drop_reason``.

    The onset is the first onset key that exists, then coerced, without falling through to later
    keys. A missing onset is reported before an unknown lane.
    """
    from beatloom.functions import labels as L

    at = V.reader("outer", "inner")
    first = lambda *keys: F.coalesce(*[at(k) for k in keys])
    lane = V.lane_value(at)
    df = raw_hits.withColumn("__lane", lane)
    df = df.select(
        "track_id",
        "pos",
        F.coalesce(V.scalar_text(first("eventID", "event_id", "id")), F.concat(F.lit("evt-"), F.col("pos").cast("string"))).alias("event_id"),
        V.timing_value(first(*K.ONSET_KEYS)).alias("onset_seconds"),
        F.coalesce(V.timing_value("outer"), V.timing_value("inner")).alias("candidate_seconds"),
        V.scalar_text("__lane").alias("label"),
        V.integer("__lane").cast("int").alias("note_number"),
        S.norm_velocity(V.number(first("velocity", "strength", "amplitude"))).alias("velocity"),
        V.number(first("confidence", "probability", "score")).alias("confidence"),
        V.scalar_text(F.coalesce("__lane", first("sourceLabel", "source_label"))).alias("source_label"),
    )
    df = L.map_lane(df, "label", "note_number", version)
    reason = F.when(F.col("onset_seconds").isNull(), "missing_onset").when(F.col("lane").isNull(), "unknown_lane")
    return df.withColumn("drop_reason", reason)


# --- summary, segments, warnings, provenance -------------------------------------------------


def _summary_value(payload, analysis, keys: list[str]) -> Column:
    return F.coalesce(V.first_present(analysis, keys), V.first_present(payload, keys))


def segments_array(payload) -> Column:
    """Segments as an array of structs; entries that are no objects are left out."""
    source = F.coalesce(*[V.items(V.get(payload, k)) for k in ("segments", "sections")])

    def segment(x, i):
        one = lambda *keys: V.first_present(x, list(keys))
        return F.when(
            V.is_object(x),
            F.struct(
                F.coalesce(V.integer(one("index", "segmentIndex", "segment_index")), i.cast("long")).alias("index"),
                V.number(one("startSeconds", "start_seconds", "start", "beginSeconds", "begin_seconds")).alias("start_seconds"),
                V.number(one("endSeconds", "end_seconds", "end", "stopSeconds", "stop_seconds")).alias("end_seconds"),
                V.text(one("label", "name", "type")).alias("label"),
                V.number(one("confidence", "score")).alias("confidence"),
            ),
        )

    return F.array_compact(F.transform(source, segment))


def _warnings_of(v) -> Column:
    keys = ["warnings", "warningMessages", "warning_messages"]

    def texts(x):
        listed = F.array_compact(F.transform(V.items(x), V.text))
        one = V.text(x)
        return F.coalesce(listed, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))

    return F.concat(
        texts(V.first_present(v, keys)),
        texts(V.first_present(V.obj(v, "analysis"), keys)),
        texts(V.get(V.obj(v, "runtime"), "warnings")),
    )


def warnings_array(raw, payload) -> Column:
    """Warnings of document, analysis and runtime, each once in first-seen order."""
    return F.array_distinct(F.concat(_warnings_of(raw), _warnings_of(payload)))


FALLBACK_WARNING = "beat_this unavailable/failed; used fallback backend:"


def timing_provenance(payload) -> Column:
    """Where the timing came from: four rules in order, null when none applies."""
    rt = V.obj(payload, "runtime")
    word = lambda *keys: V.text(V.first_present(rt, list(keys)))
    selected, reason = word("selectedBackend"), word("fallbackReason")
    used = F.coalesce(V.flag(V.get(rt, "fallbackUsed")), F.lit(False))
    backend, primary, fallback_cmd = word("backend"), word("primaryBackend"), word("fallbackBackendCommand")
    command = word("backendCommand", "timingBackendCommand")
    warning = F.get(F.filter(_warnings_of(payload), lambda w: w.contains(FALLBACK_WARNING)), F.lit(0))
    warned = F.trim(F.replace(warning, F.lit(FALLBACK_WARNING), F.lit("")))

    def row(b, source, cmd, sel, fb, why):
        return F.struct(
            b.alias("backend"), source.alias("timing_source"), cmd.alias("backend_command"), sel.alias("selected_backend"),
            fb.alias("fallback_used"), S.fallback_summary(why).alias("fallback_summary"),
        )

    fell = F.lit("fallback")
    return (
        F.when(
            backend.contains("beat-this-backend.py"),
            row(F.lit("beat_this"), F.when(used, "fallback").otherwise("primary"), word("backendCommand"), selected, used, reason),
        )
        .when(
            primary.contains("beat-this-backend.py"),
            row(F.coalesce(S.backend_label(fallback_cmd), F.lit("fallback_backend")), fell, fallback_cmd, F.coalesce(selected, fell), F.lit(True), reason),
        )
        .when(
            selected.isNotNull() & command.isNotNull(),
            row(
                F.when(command.contains("beat-this-backend.py"), "beat_this").otherwise(F.coalesce(S.backend_label(command), selected)),
                F.when(selected == "fallback", "fallback").otherwise("primary"), command, selected, used | (selected == "fallback"), reason,
            ),
        )
        .when(
            warning.isNotNull(),
            row(F.lit("fallback_backend"), fell, fallback_cmd, F.coalesce(selected, fell), F.lit(True), warned),
        )
    )


def event_count(payload) -> Column:
    """Length of the first event list, else the first non-zero count in a container."""
    return F.coalesce(D.over(D.event_count, "int", payload), F.lit(0))


def event_provenance(payload) -> Column:
    """Where the hits came from."""
    rt = V.obj(payload, "runtime")
    command, failure = V.text(V.get(rt, "eventBackendCommand")), V.text(V.get(rt, "eventBackendFailure"))
    used = F.coalesce(V.flag(V.get(rt, "eventBackendUsed")), F.lit(False))
    ran = F.coalesce(V.flag(V.get(rt, "eventBackendRan")), used)
    n = F.coalesce(V.integer(V.get(rt, "eventBackendCandidateCount")), F.lit(0))
    erun = V.obj(rt, "eventBackendRuntime")
    backend = F.coalesce(V.text(V.first_present(erun, ["backend", "wrapper"])), S.backend_label(command), F.lit("event_backend"))
    source = F.when(used, "stage2_backend").when(ran, "stage2_backend_empty").otherwise("timing_only")
    empty = F.struct(
        F.lit("stage-2 event backend returned no drum-event candidates").alias("reason"), F.lit("empty").alias("category"),
        F.lit(None).cast("string").alias("error_summary"),
    )
    summary = F.coalesce(S.fallback_summary(failure), F.when(ran & ~used & (n == 0), empty))
    nothing = F.lit(None).cast("struct<reason:string,category:string,error_summary:string>")

    def row(b, s, c, u, f):
        return F.struct(b.alias("backend"), s.alias("event_source"), c.alias("backend_command"), u.alias("backend_used"), f.alias("failure_summary"))

    return F.when(ran | command.isNotNull() | failure.isNotNull(), row(backend, source, command, used, summary)).when(
        event_count(payload) > 0,
        row(F.lit("analyzer_payload"), F.lit("embedded_candidates"), F.lit(None).cast("string"), F.lit(True), nothing),
    )


def normalize_analysis(payloads: DataFrame) -> DataFrame:
    """One typed row per document: summary, segments, warnings, provenance."""
    p = unwrap_payload(payloads)
    a = V.obj("payload", "analysis")
    value = lambda *keys: _summary_value("payload", a, list(keys))
    ints = lambda *keys: F.coalesce(V.integer(V.first_present(a, list(keys))), V.integer(V.first_present("payload", list(keys))))
    segs = F.coalesce(segments_array("payload"), F.array().cast("array<struct<index:bigint,start_seconds:double,end_seconds:double,label:string,confidence:double>>"))
    rt = V.obj("payload", "runtime")
    note = lambda v: V.text(V.first_present(v, ["note", "message", "summary"]))
    return p.withColumn("segments", segs).select(
        *[c for c in payloads.columns],
        V.number(value("durationSeconds", "duration_seconds", "duration")).alias("duration_seconds"),
        F.coalesce(ints("audioTrackCount", "audio_track_count", "trackCount", "track_count"), F.lit(0)).alias("track_count"),
        F.coalesce(
            ints("estimatedSegmentCount", "estimated_segment_count", "segmentCount", "segment_count"), F.size("segments").cast("long")
        ).alias("segment_count"),
        V.number(value("estimatedTempoBPM", "estimated_tempo_bpm", "tempoBPM", "tempo_bpm")).alias("tempo_bpm"),
        V.number(value("downbeatOffsetSeconds", "downbeat_offset_seconds")).alias("downbeat_offset"),
        V.number(value("confidence", "score")).alias("confidence"),
        "segments",
        warnings_array("raw", "payload").alias("warnings"),
        timing_provenance("payload").alias("timing_provenance"),
        event_provenance("payload").alias("event_provenance"),
        V.text(V.first_present(rt, ["backend", "wrapper", "primaryBackend"])).alias("runtime_backend"),
        V.text(V.get(rt, "selectedBackend")).alias("selected_backend"),
        V.flag(V.get(rt, "fallbackUsed")).alias("fallback_used"),
        F.coalesce(note("payload"), note(V.obj("payload", "analysis")), note("raw"), note(V.obj("raw", "analysis"))).alias("note"),
        F.coalesce(
            V.integer(F.coalesce(*[V.get("payload", *p) for p in (("subdivisionsPerBeat",), ("subdivisions_per_beat",), ("timing", "subdivisionsPerBeat"), ("timing", "subdivisions_per_beat"))])),
        ).cast("int").alias("subdivisions_per_beat"),
    )


def operator_summary(analysis: DataFrame) -> DataFrame:
    """Adds the operator's summary line of an analysis."""
    return analysis.withColumn(
        "operator_summary",
        S.operator_line(
            "duration_seconds", "tempo_bpm", "segment_count", "track_count", "confidence", "timing_provenance", "selected_backend", "event_provenance"
        ),
    )


def segment_rows(analysis: DataFrame) -> DataFrame:
    """Segments in long form."""
    return analysis.select("track_id", F.posexplode("segments").alias("pos", "s")).select("track_id", "pos", "s.*")


# --- validation --------------------------------------------------------------------------------

def has_timing(v) -> Column:
    """Any of twelve timing keys at the root, under timing, in the raw output or a container."""
    return F.coalesce(D.over(D.has_timing, "boolean", v), F.lit(False))


NO_TIMING = "payload did not contain recognizable beat/downbeat/subdivision timing"


def validate_payload(payloads: DataFrame, mode: str = "require-timing") -> DataFrame:
    """Adds ``issue``, null when the document is fine."""
    if mode == "none":
        return payloads.withColumn("issue", F.lit(None).cast("string"))
    return payloads.withColumn("issue", F.when(~has_timing("raw"), NO_TIMING))


def stage_events(v) -> Column:
    """Event list of a stage document as array<variant>, null when there is none."""
    return V.items(D.over(D.stage_events, "variant", v))


# --- charts in JSON --------------------------------------------------------------------------------


def extract_chart_notes(charts: DataFrame) -> DataFrame:
    """Notes of chart documents, new or legacy shape (P22): path, pos, note_id, lane, time."""
    notes = F.coalesce(V.items(V.get("raw", "chart", "notes")), V.items(V.get("raw", "notes")))
    n = F.filter(notes, V.is_object)
    return charts.select("path", F.posexplode(n).alias("pos", "n")).select(
        "path", "pos", V.scalar_text(V.first_present("n", ["noteID", "id"])).alias("note_id"), V.text(V.get("n", "lane")).alias("lane"),
        V.number(V.first_present("n", ["startSeconds", "time", "onsetSeconds"])).alias("time"),
    )


def chart_summary(charts: DataFrame) -> DataFrame:
    """Note count, lane counts, keys and first notes of each chart document."""
    notes = F.filter(F.coalesce(V.items(V.get("raw", "chart", "notes")), V.items(V.get("raw", "notes")), F.array().cast("array<variant>")), V.is_object)
    lanes = F.array_compact(F.transform(notes, lambda n: V.text(V.get(n, "lane"))))
    unique = F.array_sort(F.array_distinct(lanes))
    tally = F.array_join(F.transform(unique, lambda u: F.concat(u, F.lit("="), F.size(F.filter(lanes, lambda x: x == u)).cast("string"))), " ")
    keys = F.array_join(F.array_sort(F.map_keys(F.try_variant_get("raw", "$", "map<string,variant>"))), ",")
    sample = F.array_join(
        F.transform(F.slice(notes, 1, 5), lambda n: F.concat_ws(":", V.scalar_text(V.first_present(n, ["noteID", "id"])), V.text(V.get(n, "lane")))), " "
    )
    return charts.select(
        "path", keys.alias("top_level_keys"), F.size(notes).alias("note_count"), F.array_join(unique, ",").alias("unique_lanes"),
        tally.alias("lane_counts"), sample.alias("sample_notes"),
    )
