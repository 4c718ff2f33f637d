"""Thinning of hits beat by beat.

Runs after duplicate collapse, so a beat holds at most one event per slot and lane and every
window here is over a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatloom import constants as K
from beatloom.operators import events as E
from beatloom.operators import grid as G
from beatloom.operators import ordered as O

BEAT = ["track_id", "__c", "__beat"]


def _strength() -> Column:
    return F.coalesce("confidence", "velocity", F.lit(0.0))


def preference() -> list[Column]:
    """Preference order inside a beat (W12): onset, then stronger, then lane."""
    return [F.col("onset_seconds").asc(), F.col("__strength").desc(), F.col("lane").asc()]


def beat_context(df: DataFrame) -> DataFrame:
    """Adds what a beat looks like and how its occupied neighbours do.

    ``df`` is partitioned by (track, range of beats). The tom counts of the occupied beats next
    to a range come from a summary with one row per range.
    """
    lane = F.col("lane")
    bb = lane.isin(*K.BACKBONE_LANES)
    beat, rng = Window.partitionBy(*BEAT), Window.partitionBy("track_id", "__c")
    tom = F.count_if(lane.isin(*K.TOM_LANES))
    pad = F.first(F.struct(*[F.col(c) for c in df.columns])).alias("pad")
    per_beat = df.groupBy(*BEAT).agg(tom.alias("toms"), pad)
    wc = Window.partitionBy("track_id").orderBy("__c")
    edge = per_beat.groupBy("track_id", "__c").agg(
        F.min(F.struct("__beat", "toms", "pad")).alias("f"), F.max(F.struct("__beat", "toms", "pad")).alias("l")
    ).select("track_id", "__c", F.lag("l").over(wc)["toms"].alias("__pt"), F.lead("f").over(wc)["toms"].alias("__nt"))
    df = df.withColumns(
        {
            "tom_count": tom.over(beat),
            "__non_hats": F.count_if(~lane.isin(*K.HAT_LANES)).over(beat),
            "__n_bb": F.count_if(bb).over(beat),
            "__bb_slots": F.size(F.collect_set(F.when(bb, F.col("onset_subdivision_index"))).over(beat)),
        }
    )
    before = rng.orderBy("__beat").rangeBetween(Window.unboundedPreceding, -1)
    after = rng.orderBy(F.col("__beat").desc()).rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"__p": F.last("tom_count").over(before), "__n": F.last("tom_count").over(after)})
    df = df.join(edge, ["track_id", "__c"], "left")
    prev, nxt = F.coalesce("__p", "__pt", F.lit(0)), F.coalesce("__n", "__nt", F.lit(0))
    has = F.col("tom_count") > 0
    return df.withColumns(
        {
            "tom_heavy": has,
            "fill_like": has & ((F.col("__non_hats") >= 2) | (prev > 0) | (nxt > 0)),
            "continues_toms": (prev > 0) | (nxt > 0),
            "ends_fill": has & (nxt == 0),
            "dense_backbone": (F.col("__n_bb") >= 2) & (F.col("__bb_slots") >= 2),
        }
    ).drop("__non_hats", "__n_bb", "__bb_slots", "__p", "__n", "__pt", "__nt")


def pick_backbone(df: DataFrame) -> DataFrame:
    """Adds ``keep_backbone``, ``bb_lane`` (lane of the beat's first pick)."""
    lane, pos = F.col("lane"), F.pmod("__beat", F.lit(4))
    is_bb = lane.isin(*K.BACKBONE_LANES)
    kick = lane == "kick"
    priority = F.when(F.col("fill_like"), F.when(kick, 0).otherwise(1)).otherwise(
        F.when(kick, F.when(pos.isin(0, 2), 0).otherwise(1)).otherwise(F.when(pos.isin(1, 3), 0).otherwise(2))
    )
    df = df.withColumns({"__bb": is_bb, "__prio": priority})
    slot = Window.partitionBy(*BEAT, "onset_subdivision_index", "__bb")
    ranked = slot.orderBy(F.col("__prio"), *preference())
    strongest = slot.orderBy(F.col("__strength").desc(), F.col("__prio"), *preference())
    df = df.withColumns(
        {
            "__rank": F.row_number().over(ranked),
            "__best": F.first(F.struct("event_id", "__strength")).over(ranked),
            "__srank": F.row_number().over(strongest),
            "__top": F.first(F.struct("event_id", "__strength")).over(strongest),
        }
    )
    override = (F.col("__top.event_id") != F.col("__best.event_id")) & (
        F.col("__top.__strength") - F.col("__best.__strength") >= K.BACKBONE_OVERRIDE
    )
    df = df.withColumn("keep_backbone", F.col("__bb") & F.when(override, F.col("__srank") == 1).otherwise(F.col("__rank") == 1))
    # the first pick: by slot (missing slot first), or by onset when the backbone is dense
    slot_key = F.coalesce(F.col("onset_subdivision_index").cast("double"), F.lit(float("-inf")))
    order = F.struct(
        F.when(F.col("dense_backbone"), F.col("onset_seconds")).otherwise(slot_key).alias("a"), F.col("lane").alias("lane")
    )
    beat = Window.partitionBy(*BEAT)
    df = df.withColumn("bb_lane", F.min(F.when(F.col("keep_backbone"), order)).over(beat)["lane"])
    return df.drop("__bb", "__prio", "__rank", "__best", "__srank", "__top")


def pick_accent(df: DataFrame) -> DataFrame:
    """Adds ``keep_accent`` and ``accent_lane``: at most one crash or ride per beat."""
    is_acc = F.col("lane").isin(*K.ACCENT_LANES)
    df = df.withColumn("__acc", is_acc)
    rank = F.row_number().over(Window.partitionBy(*BEAT, "__acc").orderBy(*preference()))
    bb = F.col("bb_lane")
    rule = (
        F.when(F.col("fill_like") & (F.col("ends_fill") | F.col("continues_toms") | F.coalesce(bb == "kick", F.lit(False))), True)
        .when(F.coalesce(bb == "snare", F.lit(False)), False)
        .when((F.col("__beat") >= 0) & (F.col("__beat") % 4 == 0), True)
        .otherwise(bb.isNull())
    )
    df = df.withColumn("keep_accent", F.col("__acc") & (rank == 1) & rule)
    return df.withColumn(
        "accent_lane", F.max(F.when(F.col("keep_accent"), F.col("lane"))).over(Window.partitionBy(*BEAT))
    ).drop("__acc")


def dedupe_hats(df: DataFrame) -> DataFrame:
    """Adds ``unique_hat``: one hat per slot, open before closed, then by preference."""
    df = df.withColumn("__hat", F.col("lane").isin(*K.HAT_LANES))
    w = Window.partitionBy(*BEAT, "onset_subdivision_index", "__hat").orderBy(
        (F.col("lane") != "hihat_open").cast("int"), *preference()
    )
    first = F.row_number().over(w) == 1
    return df.withColumn(
        "unique_hat", F.col("__hat") & F.col("onset_subdivision_index").isNotNull() & first
    ).drop("__hat")


def pick_hats(df: DataFrame) -> DataFrame:
    """Adds ``keep_hat``: pulse, one open accent and texture.

    The kept roles never exceed the final cap of pulse + texture + open accent, so no extra cut
    is needed. ``subdivision % 4`` uses the absolute slot index.
    """
    beat, slot = F.col("__beat"), F.col("onset_subdivision_index")
    no = F.lit(False)
    anchor = F.coalesce(F.col("bb_lane") == "kick", no) | F.coalesce(F.col("accent_lane") == "crash", no)
    limit = F.when(F.col("dense_backbone"), 2).otherwise(1)
    open_hat = F.col("unique_hat") & (F.col("lane") == "hihat_open")
    closed = F.col("unique_hat") & (F.col("lane") == "hihat_closed")
    df = df.withColumns({"__anchor": anchor, "__limit": limit, "__open": open_hat, "__closed": closed})
    quarter_first = F.when(F.col("__anchor"), 0).otherwise((F.pmod(slot, F.lit(4)) != 0).cast("int"))
    open_rank = F.row_number().over(Window.partitionBy(*BEAT, "__open").orderBy(quarter_first, *preference()))
    closed_rank = F.row_number().over(Window.partitionBy(*BEAT, "__closed").orderBy(*preference()))
    pulse = F.col("__closed") & (F.col("__anchor") | (F.pmod(beat, F.lit(4)) == 0)) & (closed_rank <= F.col("__limit"))
    df = df.withColumns({"__accent": F.col("__open") & (open_rank == 1), "__pulse": pulse})
    texture = F.col("__closed") & ~F.col("__pulse") & slot.isNotNull() & F.pmod(slot, F.lit(4)).isin(1, 3)
    df = df.withColumn("__texture", texture)
    texture_rank = F.row_number().over(Window.partitionBy(*BEAT, "__texture").orderBy(*preference()))
    keep_texture = (
        F.col("__texture") & F.col("__anchor") & F.pmod(beat, F.lit(4)).isin(0, 2) & (texture_rank <= F.col("__limit"))
    )
    df = df.withColumn("keep_hat", ~F.col("tom_heavy") & (F.col("__pulse") | F.col("__accent") | keep_texture))
    return df.drop("__anchor", "__limit", "__open", "__closed", "__accent", "__pulse", "__texture")


def by_beat(collapsed: DataFrame) -> DataFrame:
    """Collapsed events partitioned once for all the windows below: by track and range of beats."""
    df = collapsed.withColumn("__beat", F.coalesce("onset_beat_index", F.lit(-1)).cast("int"))
    df = df.withColumns({"__c": O.index_chunk("__beat"), "__strength": _strength()})
    return df.where(F.col("track_id").isNotNull() & F.col("__c").isNotNull()).repartition("track_id", "__c")


def shape_roles(collapsed: DataFrame) -> DataFrame:
    """Collapsed events with every shaping decision as a column."""
    return pick_hats(dedupe_hats(pick_accent(pick_backbone(beat_context(by_beat(collapsed))))))


def shape_collapsed(collapsed: DataFrame) -> DataFrame:
    df = shape_roles(collapsed)
    lane = F.col("lane")
    supporting = ~lane.isin(*K.BACKBONE_LANES, *K.ACCENT_LANES, *K.HAT_LANES)
    return df.where(F.col("keep_backbone") | F.col("keep_accent") | F.col("keep_hat") | supporting).select(*collapsed.columns)


def shape_events(events: DataFrame) -> DataFrame:
    """Collapse and shape mapped, quantized events (G4); toms, claps and percussion all stay."""
    return shape_collapsed(E.collapse_duplicates(events))


def drum_events(hits: DataFrame, grid: DataFrame, beats: DataFrame | None = None, regular: DataFrame | None = None) -> DataFrame:
    """Final events per track (G5): quantize, shape; tracks left empty get the groove."""
    usable = hits.where(F.col("onset_seconds").isNotNull() & F.col("lane").isNotNull())
    shaped = shape_events(E.quantize(usable, grid, beats, regular)).drop("drift_seconds")
    shaped = shaped.withColumn("event_id", F.col("event_id").cast("string"))
    return with_groove(shaped, grid)


def with_groove(shaped: DataFrame, grid: DataFrame) -> DataFrame:
    empty = grid.join(shaped.select("track_id").distinct(), "track_id", "left_anti")
    return shaped.unionByName(G.heuristic_groove(empty).select(*shaped.columns))
