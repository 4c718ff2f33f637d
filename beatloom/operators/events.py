"""Detected hits: lanes, beats, anchors, duplicates and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatloom import constants as K
from beatloom.functions import labels as L
from beatloom.functions import scalars as S
from beatloom.operators import grid as G
from beatloom.operators import ordered as O

TRACK = ["track_id"]
BEFORE = -1.0e9  # earlier than any time of a track


def map_hit_lanes(hits: DataFrame, label: str | None = None, note: str | None = None, version: str = "runtime") -> DataFrame:
    """Attach ``lane``; unmatched hits keep null for the drop counters."""
    return L.map_lane(hits, label, note, version)


def _beat_rows(grid: DataFrame) -> DataFrame:
    """One row per beat with its anchors; a beat has as many anchors as it has slots."""
    anchor = F.struct("start_seconds", "subdivision_index", "subdivision_in_beat", "duration_seconds")
    return grid.groupBy("track_id", "beat_index").agg(
        F.min("start_seconds").alias("beat_start"), F.sort_array(F.collect_list(anchor)).alias("anchors")
    )


def assign_beat(hits: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds ``beat_index`` of the beat whose span holds the onset, null outside all beats.

    A beat ends where the next one starts; the last one ends with its last anchor.
    """
    b = _beat_rows(grid).withColumn("__c", O.index_chunk("beat_index"))
    b = O.neighbors(b, TRACK, ["beat_index"], "__c", next={"next_start": "beat_start"})
    last = F.element_at("anchors", -1)
    b = b.select(
        "track_id", "beat_index", "beat_start",
        F.coalesce("next_start", last["start_seconds"] + last["duration_seconds"]).alias("beat_end"),
    )
    m = O.asof(hits, b, TRACK, "onset_seconds", "beat_start", ["beat_index", "beat_end"], "__m")
    return m.withColumn("beat_index", F.when(F.col("onset_seconds") < F.col("__m.beat_end"), F.col("__m.beat_index"))).drop("__m")


def packed_beats(grid: DataFrame) -> DataFrame:
    """A grid as one row per track and time bucket of beat starts: track_id, __b, beats in order of start.

    A bucket holds its beats in one array, so that placing hits moves few rows instead of one for each slot.
    """
    anchor = F.struct("start_seconds", "subdivision_index", "subdivision_in_beat")
    b = grid.groupBy("track_id", "beat_index").agg(
        F.min("start_seconds").alias("beat_start"), F.sort_array(F.collect_list(anchor)).alias("anchors")
    ).where(F.col("beat_start").isNotNull())
    return b.groupBy("track_id", O.time_chunk("beat_start").alias("__b")).agg(
        F.sort_array(F.collect_list(F.struct("beat_start", "beat_index", "anchors"))).alias("beats")
    )


def nearest_anchor(hits: DataFrame, grid: DataFrame | None, beats: DataFrame | None = None, regular: DataFrame | None = None) -> DataFrame:
    """Adds the struct ``anchor``: the nearest slot of the beat that holds the onset.

    An onset never moves into the next beat. Before the first beat the first anchor is taken,
    after the last beat the nearest of its anchors. Ties go to the earlier anchor. ``beats``: the grid as
    packed_beats() gives it, for grids that are made in that form. ``regular``: the grid as grid.regular() gives
    it; each hit then works its slot out from its track's row, and no grid is made, moved or sorted.

    Hits meet their bucket's beats, with the last beat of the buckets before in front of them. The joins are
    never broadcasts: a packed grid grows with the tracks, whatever the size of the rows it is made from.
    """
    if regular is not None:
        m = G.on_regular(hits, O.time_chunk("onset_seconds"), regular)
        return G.regular_anchors(m, "onset_seconds").select(*hits.columns, F.col("__a").alias("anchor"))
    beats = packed_beats(grid) if beats is None else beats
    t = F.col("onset_seconds")
    # hits without an onset match nothing; spread them so that they cannot pile up in one task
    cols = hits.columns
    h = hits.withColumn("__b", F.coalesce(O.time_chunk(t), -F.lit(1 << 40) - F.pmod(F.xxhash64(*cols), F.lit(4096))))
    first, last = F.element_at("beats", 1), F.element_at("beats", -1)
    lead_in = F.struct(F.lit(BEFORE).alias("beat_start"), first["beat_index"].alias("beat_index"), F.slice(first["anchors"], 1, 1).alias("anchors"))
    edge = beats.select("track_id", "__b", F.lit(1).alias("__k"), lead_in.alias("__i"), last.alias("__e"))
    none = [F.lit(None).cast(edge.schema[c].dataType).alias(c) for c in ("__i", "__e")]
    asked = h.where(t.isNotNull()).select("track_id", "__b").distinct().select("track_id", "__b", F.lit(0).alias("__k"), *none)
    w = Window.partitionBy("track_id").orderBy("__b", "__k")
    before = F.last("__e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = F.first("__i", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = (
        edge.unionByName(asked).select("track_id", "__b", "__k", F.coalesce(before, start).alias("__p")).where((F.col("__k") == 0) & F.col("__p").isNotNull())
        .join(beats.hint("merge"), ["track_id", "__b"], "left")
        .select("track_id", "__b", F.concat(F.array("__p"), F.coalesce("beats", F.array().cast(beats.schema["beats"].dataType))).alias("__m"))
    )
    m = h.join(near.hint("merge"), ["track_id", "__b"], "left").withColumn("__m", F.try_element_at(F.filter("__m", lambda b: b["beat_start"] <= t), F.lit(-1)))
    best = F.array_min(
        F.transform(
            "__m.anchors",
            lambda a: F.struct(
                F.abs(a["start_seconds"] - t).alias("distance"),
                a["start_seconds"].alias("start_seconds"),
                a["subdivision_index"].alias("subdivision_index"),
                a["subdivision_in_beat"].alias("subdivision_in_beat"),
            ),
        )
    )
    return m.withColumn("__n", best).select(
        *cols,
        F.when(
            F.col("__n").isNotNull(),
            F.struct(
                F.col("__m.beat_index").alias("beat_index"),
                F.col("__n.start_seconds").alias("start_seconds"),
                F.col("__n.subdivision_index").alias("subdivision_index"),
                F.col("__n.subdivision_in_beat").alias("subdivision_in_beat"),
                F.col("__n.distance").alias("distance"),
            ),
        ).alias("anchor"),
    )


def quantize(hits: DataFrame, grid: DataFrame | None, beats: DataFrame | None = None, regular: DataFrame | None = None) -> DataFrame:
    """Mapped hits to detected events with beat and slot, and the drift to the anchor."""
    m = nearest_anchor(hits, grid, beats, regular)
    source = F.col("source_label") if "source_label" in hits.columns else (F.col("label") if "label" in hits.columns else F.lit(None).cast("string"))
    return m.select(
        "track_id", "event_id", "onset_seconds",
        F.col("anchor.beat_index").alias("onset_beat_index"),
        F.col("anchor.subdivision_index").alias("onset_subdivision_index"),
        "lane",
        S.norm_velocity("velocity").alias("velocity"),
        source.alias("source_label"),
        "confidence",
        F.col("anchor.distance").alias("drift_seconds"),
    )


def nearest_beat(hits: DataFrame, beats: DataFrame) -> DataFrame:
    """Adds ``nearest_index``, signed ``beat_distance`` and ``beat_interval``.

    ``beats`` needs beat_index and start_seconds; ties go to the lower index. The interval is the
    median of the track's positive beat gaps, computed once per track. No join is a broadcast: beats are often
    exploded from tracks, and Spark takes them for no larger than these.
    """
    b = beats.select("track_id", "beat_index", F.col("start_seconds").alias("s")).withColumn("__c", O.time_chunk("s"))
    b = O.neighbors(b, TRACK, ["s", "beat_index"], "__c", next={"next_s": "s", "next_index": "beat_index"})
    gap = F.col("next_s") - F.col("s")
    middle = O.median(b.select("track_id", gap.alias("gap")).where(gap > 0), "gap").withColumnRenamed("median", "beat_interval")
    info = b.groupBy("track_id").agg(F.min(F.struct("s", "beat_index")).alias("f")).join(middle.hint("merge"), "track_id", "left")
    rows = b.join(info.hint("merge"), "track_id").select("track_id", "s", "beat_index", "next_s", "next_index", "beat_interval")
    # before the first beat the only neighbour is the first beat
    lead_in = info.select(
        "track_id", F.lit(BEFORE).alias("s"), F.lit(None).cast(b.schema["beat_index"].dataType).alias("beat_index"),
        F.col("f.s").alias("next_s"), F.col("f.beat_index").alias("next_index"), "beat_interval",
    )
    m = O.asof(
        hits, rows.unionByName(lead_in), TRACK, "onset_seconds", "s",
        ["s", "beat_index", "next_s", "next_index", "beat_interval"], "__m",
    )
    back = F.col("onset_seconds") - F.col("__m.s")
    fwd = F.col("__m.next_s") - F.col("onset_seconds")
    take_next = F.col("__m.beat_index").isNull() | (F.coalesce(fwd < back, F.lit(False)))
    return m.withColumns(
        {
            "nearest_index": F.when(take_next, F.col("__m.next_index")).otherwise(F.col("__m.beat_index")),
            "beat_distance": F.when(take_next, F.col("onset_seconds") - F.col("__m.next_s")).otherwise(back),
            "beat_interval": F.col("__m.beat_interval"),
        }
    ).drop("__m")


def collapse_duplicates(events: DataFrame) -> DataFrame:
    """Best event per slot and lane (W5): confidence, velocity, later onset, larger id.

    A plain maximum, so duplicates disappear on the map side before anything is shuffled.
    """
    keys = ["track_id", "onset_subdivision_index", "onset_beat_index", "lane"]
    rest = [c for c in events.columns if c not in keys]
    rank = F.struct(
        F.coalesce("confidence", F.lit(-1.0)), F.coalesce("velocity", F.lit(-1.0)), F.col("onset_seconds"),
        F.col("event_id").cast("string"),
    )
    best = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("b"), F.count(F.lit(1)).alias("collapsed_from"))
    return best.select(*keys, *[F.col("b")[c].alias(c) for c in rest]).select(*events.columns)


def diagnostics(candidates: DataFrame, shaped: DataFrame) -> DataFrame:
    """Counters per track.

    ``candidates``: track_id, onset_seconds, lane, onset_beat_index, onset_subdivision_index,
    drift_seconds, before anything is dropped. ``shaped``: the kept events. The duplicate count
    includes what shaping removed; a track with nothing kept uses the fallback groove.
    """
    has_onset = F.col("onset_seconds").isNotNull()
    mapped = has_onset & F.col("lane").isNotNull()
    raw = candidates.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.count_if(mapped).alias("mapped_count"),
        F.count_if(~has_onset).alias("dropped_missing_onset"),
        F.count_if(has_onset & F.col("lane").isNull()).alias("dropped_unknown_lane"),
        F.max(F.when(mapped, F.abs("drift_seconds"))).alias("drift"),
    )
    kept = shaped.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    d = raw.join(kept, "track_id", "left")
    used = F.col("n").isNull()
    lost = F.when(used, 0).otherwise(F.greatest(F.col("mapped_count") - F.col("n"), F.lit(0)))
    return d.select(
        "track_id", "raw_count", "mapped_count", F.coalesce("n", F.lit(0)).alias("post_shaping_count"),
        used.alias("used_fallback"), "dropped_missing_onset", "dropped_unknown_lane",
        lost.alias("deduplicated_count"), lost.alias("shaping_reduction"),
        F.when(~used, F.col("drift")).alias("max_drift"),
    )


def max_drift(events: DataFrame, limit: float = 0.05) -> DataFrame:
    """Largest quantization drift per track and whether it deserves a warning."""
    return events.groupBy("track_id").agg(F.max(F.abs("drift_seconds")).alias("max_drift")).withColumn(
        "warn", F.coalesce(F.col("max_drift") > limit, F.lit(False))
    )


def lane_summary(events: DataFrame) -> DataFrame:
    """``lane=n`` text per track, lanes in order (A17). At most eleven lanes are collected."""
    counts = events.groupBy("track_id", "lane").agg(F.count(F.lit(1)).alias("n"))
    pair = F.sort_array(F.collect_list(F.struct("lane", "n")))
    text = F.array_join(F.transform(pair, lambda p: F.concat(p["lane"], F.lit("="), p["n"].cast("string"))), " ")
    return counts.groupBy("track_id").agg(text.alias("lane_summary"))


def confidence_bands(events: DataFrame) -> DataFrame:
    """Events per confidence band; velocity stands in for a missing confidence."""
    band = S.confidence_band(F.coalesce("confidence", "velocity"))
    return events.withColumn("__band", band).groupBy("track_id").agg(
        *[F.count_if(F.col("__band") == b).alias(b) for b in ("high", "medium", "low", "unknown")]
    )


def order_events(events: DataFrame) -> DataFrame:
    """Total order for listings: missing onsets last, then onset, lane, position."""
    return events.orderBy("track_id", F.asc_nulls_last("onset_seconds"), "lane", "event_id")
