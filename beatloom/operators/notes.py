"""Events to chart notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions import scalars as S
from beatloom.operators import grid as G
from beatloom.operators import ordered as O


def packed_slots(grid: DataFrame) -> DataFrame:
    """A grid as one row per track and range of slots: track_id, __s, slots."""
    beats = grid.groupBy("track_id", "beat_index").agg(
        F.count(F.lit(1)).alias("steps"), F.collect_list(F.struct("subdivision_index", "subdivision_in_beat")).alias("a")
    )
    slots = beats.select("track_id", "steps", F.explode("a").alias("a")).select(
        "track_id", F.struct(F.col("a.subdivision_index").alias("subdivision_index"), F.col("a.subdivision_in_beat").alias("step"), "steps").alias("slot")
    ).where(F.col("slot.subdivision_index").isNotNull())
    return slots.groupBy("track_id", O.index_chunk("slot.subdivision_index").alias("__s")).agg(F.collect_list("slot").alias("slots"))


def note_anchor(events: DataFrame, grid: DataFrame | None, slots: DataFrame | None = None, regular: DataFrame | None = None) -> DataFrame:
    """Adds ``step`` and ``steps`` of the event's slot, null when the slot is unknown.

    ``slots``: the grid as packed_slots() gives it, for grids that are made in that form. Never a broadcast:
    slots grow with the tracks, whatever the size of the rows they are made from. ``regular``: the grid as
    grid.regular() gives it, so that an event's slot follows from its track's row.
    """
    if regular is not None:
        step, steps = G.regular_step(F.col("onset_subdivision_index"))
        m = G.on_regular(events, O.index_chunk("onset_subdivision_index"), regular)
        return m.select(*events.columns, step.alias("step"), steps.alias("steps"))
    slots = packed_slots(grid) if slots is None else slots
    at = F.col("onset_subdivision_index")
    m = events.withColumn("__s", O.index_chunk("onset_subdivision_index")).join(slots.hint("merge"), ["track_id", "__s"], "left")
    m = m.select(*events.columns, F.explode_outer(F.filter("slots", lambda s: s["subdivision_index"] == at)).alias("__f"))
    return m.select(*events.columns, F.col("__f.step").alias("step"), F.col("__f.steps").alias("steps"))


def chart_notes(events: DataFrame, grid: DataFrame | None, slots: DataFrame | None = None, regular: DataFrame | None = None) -> DataFrame:
    """Notes in ticks (G7, F1); an event without a slot sits on its beat."""
    beat = F.coalesce("onset_beat_index", F.lit(0))
    on_beat = (beat * K.TICKS_PER_BEAT).cast("long")
    at = F.when(F.col("step").isNull(), on_beat).otherwise(S.tick(beat, "step", "steps"))
    key = F.concat_ws("|", F.col("track_id").cast("string"), "lane", at.cast("string"), F.col("event_id").cast("string"))
    return note_anchor(events, grid, slots, regular).select(
        "track_id",
        F.sha2(key, 256).alias("note_id"),
        "lane",
        at.alias("tick"),
        beat.cast("int").alias("beat_index"),
        F.col("onset_subdivision_index").cast("int").alias("subdivision_index"),
        F.col("onset_seconds").alias("start_seconds"),
        F.lit(0).alias("duration_ticks"),
        "velocity",
        F.col("event_id").cast("string").alias("source_event_id"),
    )
