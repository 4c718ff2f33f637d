"""Summaries of timing payloads and their differences.

The comparison reads documents more narrowly than chart generation does: lists at the root,
under ``timing`` or under ``analysis`` only, with its own key lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions import scalars as S
from beatloom.functions import variants as V
from beatloom.operators import diffs as D
from beatloom.operators import payloads as P
from beatloom.session import cut


def _first_list(v, keys: list[str]) -> Column:
    return F.coalesce(*[V.items(V.get(v, k)) for k in keys], F.array().cast("array<variant>"))


def _times(keys: list[str]) -> Column:
    """Times of the root list and the timing list together, six places."""
    found = F.concat(_first_list("raw", keys), _first_list(V.get("raw", "timing"), keys))

    def value(x):
        inside = [V.number(V.get(x, k)) for k in ("seconds", "time", "start", "offset", "position")]
        return F.coalesce(V.number(x), *inside)

    return F.transform(F.array_compact(F.transform(found, value)), lambda t: F.bround(t, 6))


def _events() -> Column:
    found = F.concat(*[_first_list(v, K.STAGE_EVENT_KEYS) for v in (F.col("raw"), V.get("raw", "timing"), V.get("raw", "analysis"))])
    word = lambda v: F.when(F.trim(V.scalar_text(v)) != "", F.trim(V.scalar_text(v)))

    def event(x, i):
        one = lambda *keys: V.first_present(x, list(keys))
        return F.when(
            V.is_object(x),
            F.struct(
                i.alias("index"), F.bround(V.number(one("onsetSeconds", "onset_seconds", "seconds", "time", "start")), 6).alias("onset_seconds"),
                F.coalesce(word(one("lane", "instrument", "type", "class")), F.lit("unknown")).alias("lane"),
                F.coalesce(word(one("sourceLabel", "source", "origin", "backend")), F.lit("unknown")).alias("source"),
                F.bround(V.number(one("confidence", "score", "probability")), 4).alias("confidence"),
            ),
        )

    return F.array_compact(F.transform(found, event))


def summarize(payloads: DataFrame) -> dict[str, DataFrame]:
    """Summary rows, beats, intervals, downbeats, segments, events and the first of them, tallies and provenance."""
    payloads = payloads.withColumns({"__t0": _times(K.BEAT_KEYS), "__t1": _times(K.DOWNBEAT_KEYS)})  # near repeats are dropped from named arrays
    a, rt = V.obj("raw", "analysis"), V.obj("raw", "runtime")
    base = cut(payloads.select(
        "track_id",
        V.number(V.first_present(a, ["estimatedTempoBPM", "tempoBPM"])).alias("tempo_bpm"),
        V.number(V.first_present(a, ["downbeatOffsetSeconds", "downbeat_offset_seconds"])).alias("downbeat_offset"),
        V.number(V.get(a, "confidence")).alias("confidence"),
        V.normalize_starts("__t0").alias("beats"), V.normalize_starts("__t1").alias("downbeats"), _events().alias("events"),
        F.coalesce(P.segments_array("raw"), F.array().cast("array<struct<index:bigint,start_seconds:double,end_seconds:double,label:string,confidence:double>>")).alias("segments"),
        *[V.scalar_text(V.get(rt, k)).alias(k) for k in K.PROVENANCE_KEYS],
    ))
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    events = base.select("track_id", F.explode("events").alias("e")).select("track_id", "e.*")
    gaps = F.filter(F.zip_with(F.slice("beats", F.lit(2), F.greatest(F.size("beats") - 1, F.lit(0))), "beats", lambda b, x: F.bround(b - x, 6)), lambda g: g.isNotNull())
    kinds = F.explode(F.array(
        F.struct(F.lit("lane").alias("counter"), F.col("lane").alias("key")), F.struct(F.lit("source").alias("counter"), F.col("source").alias("key")),
        F.struct(F.lit("confidence").alias("counter"), S.confidence_bucket("confidence").alias("key")),
    )).alias("k")
    tallies = events.select("track_id", kinds).groupBy("track_id", "k.counter", "k.key").agg(F.count(F.lit(1)).alias("n"))
    onset_list = F.transform(F.array_sort(F.filter(F.transform("events", lambda e: F.struct(e["onset_seconds"].alias("t"), e["lane"], e["index"])), lambda e: e["t"].isNotNull())), lambda e: e["t"])
    rows = lambda c, name: base.select("track_id", F.posexplode(c).alias("pos", name))
    return {
        "summary": base.select("track_id", "tempo_bpm", "downbeat_offset", "confidence", size("beats").alias("beat_count"), size("downbeats").alias("downbeat_count"),
                               size("segments").alias("segment_count"), size("events").alias("event_count"), size(gaps).alias("interval_count")),
        "beats": rows("beats", "t"), "intervals": rows(gaps, "t"), "downbeats": rows("downbeats", "t"),
        "segments": rows(F.transform("segments", lambda s: F.to_json(F.struct(s["index"], F.bround(s["start_seconds"], 6), F.bround(s["end_seconds"], 6), s["label"]))), "s"),
        "events": events, "events_preview": D.preview(events, ["track_id"], ["index"]), "onsets": rows(onset_list, "onset_seconds"), "tallies": tallies, "provenance": base.select("track_id", *K.PROVENANCE_KEYS),
    }


def timing_diff(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """What two timing documents of each track disagree on (G14), long form: track_id, measure, value, detail."""
    a, b = summarize(primary), summarize(fallback)
    n = lambda df, name: df.groupBy("track_id").agg(F.count(F.lit(1)).cast("double").alias("value")).select("track_id", F.lit(name).alias("measure"), "value", F.lit(None).cast("string").alias("detail"))
    numbers = ["tempo_bpm", "downbeat_offset", "confidence", "beat_count", "downbeat_count", "segment_count", "event_count", "interval_count"]
    cast = lambda df: df.select("track_id", *[F.col(c).cast("double").alias(c) for c in numbers])
    x = cast(a["summary"]).unpivot("track_id", numbers, "measure", "l").join(cast(b["summary"]).unpivot("track_id", numbers, "measure", "r"), ["track_id", "measure"])
    out = x.select("track_id", F.concat("measure", F.lit("_delta")).alias("measure"), F.bround(F.col("r") - F.col("l"), 6).alias("value"), F.lit(None).cast("string").alias("detail"))
    for name, col in (("beats", "t"), ("intervals", "t"), ("downbeats", "t"), ("segments", "s")):
        out = out.unionByName(n(D.compare_positions(a[name], b[name], col), f"{name}_mismatches"))
    t = D.compare_counts(a["tallies"], b["tallies"], ["track_id", "counter", "key"])
    out = out.unionByName(t.select("track_id", F.concat("counter", F.lit("_count_delta")).alias("measure"), F.col("delta").cast("double").alias("value"), F.col("key").alias("detail")))
    m = D.match_onsets(a["onsets"], b["onsets"]).groupBy("track_id", "kind").agg(F.count(F.lit(1)).cast("double").alias("value"))
    out = out.unionByName(m.select("track_id", F.concat(F.lit("onsets_"), "kind").alias("measure"), "value", F.lit(None).cast("string").alias("detail")))
    p = D.diff_provenance(a["provenance"], b["provenance"])
    text = F.concat_ws(" -> ", F.coalesce("primary", F.lit("None")), F.coalesce("fallback", F.lit("None")))
    return out.unionByName(p.select("track_id", F.concat(F.lit("provenance_"), "key").alias("measure"), F.lit(None).cast("double").alias("value"), text.alias("detail")))


def timing_previews(primary: DataFrame, fallback: DataFrame, n: int = D.PREVIEW) -> DataFrame:
    """The first ``n`` differences of each kind (G14): track_id, measure, rank, pos, key, primary, fallback,
    delta, primary_text, fallback_text.

    Measures: beats, intervals, downbeats, segments (by position), lane_counts, source_counts and
    confidence_counts (by key), onsets_shifted and onsets_primary_only (by primary position) and
    onsets_fallback_only (by its own).
    """
    a, b = summarize(primary), summarize(fallback)
    blank = {"pos": "long", "key": "string", "primary": "double", "fallback": "double", "delta": "double", "primary_text": "string", "fallback_text": "string"}

    def rows(df: DataFrame, measure: str | Column, order: list[str], **columns: Column | str) -> DataFrame:
        given = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
        name = F.lit(measure) if isinstance(measure, str) else measure
        df = D.preview(df.withColumn("measure", name), ["track_id", "measure"], order, n)
        return df.select("track_id", "measure", "rank", *[given.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in blank.items()])

    six = lambda c: F.bround(c, 6)
    parts = [
        rows(D.compare_positions(a[k], b[k], "t"), k, ["pos"], pos="pos", primary=six("primary"), fallback=six("fallback"), delta=six("delta")) for k in ("beats", "intervals", "downbeats")
    ]
    parts.append(rows(D.compare_positions(a["segments"], b["segments"], "s"), "segments", ["pos"], pos="pos", primary_text="primary", fallback_text="fallback"))
    t = D.compare_counts(a["tallies"], b["tallies"], ["track_id", "counter", "key"])
    parts.append(rows(t, F.concat("counter", F.lit("_counts")), ["key"], key="key", primary="primary", fallback="fallback", delta="delta"))
    m = D.match_onsets(a["onsets"], b["onsets"]).where(F.col("kind") != "matched").withColumn("pos", F.coalesce("primary_pos", "fallback_pos"))
    parts.append(rows(m, F.concat(F.lit("onsets_"), "kind"), ["pos"], pos="pos", primary="primary_onset", fallback="fallback_onset", delta="delta"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
