"""Density, balance and streak metrics of charts.

``notes``: chart_id, lane, tick, beat_index, ...; ``measures``: chart_id, bar_index,
start_beat_index, beat_count, in list order of bar_index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatloom import constants as K
from beatloom.functions import scalars as S
from beatloom.operators import ordered as O


def note_measure(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Adds ``bar_index`` of the first listed measure holding the note's beat, else null.

    Measures are expanded to one row per beat, which turns the range test into an equi-join. It is never a
    broadcast: Spark takes what an explode gives for no larger than what it reads.
    """
    beats = measures.select(
        "chart_id", "bar_index",
        F.explode(F.sequence(F.lit(0), F.greatest(F.col("beat_count") - 1, F.lit(0)))).alias("k"),
        "start_beat_index", "beat_count",
    ).where(F.col("beat_count") > 0).select("chart_id", "bar_index", (F.col("start_beat_index") + F.col("k")).alias("beat_index"))
    beats = beats.groupBy("chart_id", "beat_index").agg(F.min("bar_index").alias("bar_index"))
    return notes.join(beats.hint("merge"), ["chart_id", "beat_index"], "left")


def _beat_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("chart_id", "beat_index").agg(F.count(F.lit(1)).alias("n"))


def note_counts(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Notes, measures and notes per measure of every chart that has either (A1)."""
    n = notes.groupBy("chart_id").agg(F.count(F.lit(1)).alias("note_count"))
    m = measures.groupBy("chart_id").agg(F.count(F.lit(1)).alias("measure_count"))
    nc, mc = F.coalesce("note_count", F.lit(0)), F.coalesce("measure_count", F.lit(0))
    return n.join(m.hint("merge"), "chart_id", "full").select(
        "chart_id", nc.alias("note_count"), mc.alias("measure_count"),
        F.when(mc > 0, nc / mc).otherwise(F.lit(0.0)).alias("notes_per_measure"),
    )


def lane_usage(notes: DataFrame) -> DataFrame:
    """Notes per lane (A3)."""
    return notes.groupBy("chart_id", "lane").agg(F.count(F.lit(1)).alias("note_count"))


def distinct_lanes(notes: DataFrame) -> DataFrame:
    """Lanes used by a chart, sorted (A2); the lane set is closed, so at most eleven."""
    return notes.groupBy("chart_id").agg(F.sort_array(F.collect_set("lane")).alias("lanes")).withColumn(
        "lane_count", F.size("lanes")
    )


def lane_balance(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Share and density per lane (A4)."""
    u = lane_usage(notes).join(
        note_counts(notes, measures).select("chart_id", F.col("note_count").alias("total"), "measure_count"), "chart_id"
    )
    n = F.col("note_count")
    return u.select(
        "chart_id", "lane", "note_count",
        F.when(F.col("total") > 0, n / F.col("total")).otherwise(F.lit(0.0)).alias("note_share"),
        F.when(F.col("measure_count") > 0, n / F.col("measure_count")).otherwise(F.lit(0.0)).alias("lane_notes_per_measure"),
    )


def focused_balance(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Kick, snare and closed hat of every chart, zero filled (A5)."""
    counts = note_counts(notes, measures)
    lanes = F.explode(F.array(*[F.lit(x) for x in K.FOCUSED_LANES])).alias("lane")
    frame = counts.select("chart_id", F.col("note_count").alias("total"), "measure_count", lanes)
    n = F.coalesce("note_count", F.lit(0))
    return frame.join(lane_usage(notes), ["chart_id", "lane"], "left").select(
        "chart_id", "lane", n.alias("note_count"),
        F.when(F.col("total") > 0, n / F.col("total")).otherwise(F.lit(0.0)).alias("note_share"),
        F.when(F.col("measure_count") > 0, n / F.col("measure_count")).otherwise(F.lit(0.0)).alias("lane_notes_per_measure"),
    )


def max_simultaneous(notes: DataFrame) -> DataFrame:
    """Most notes on one tick."""
    t = notes.groupBy("chart_id", "tick").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("chart_id").agg(F.max("n").alias("max_simultaneous"))


def max_per_beat(notes: DataFrame) -> DataFrame:
    """Most notes in one beat."""
    return _beat_counts(notes).groupBy("chart_id").agg(F.max("n").alias("max_per_beat"))


def measure_totals(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Notes per measure; notes outside all measures form one group with a null bar."""
    return note_measure(_beat_counts(notes), measures).groupBy("chart_id", "bar_index").agg(F.sum("n").alias("n"))


def max_per_measure(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Most notes in one measure; the unassigned group counts too."""
    return measure_totals(notes, measures).groupBy("chart_id").agg(F.max("n").alias("max_per_measure"))


def empty_measures(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Measures without notes."""
    hit = measure_totals(notes, measures).groupBy("chart_id").agg(F.count("bar_index").alias("hit"))
    m = measures.groupBy("chart_id").agg(F.count(F.lit(1)).alias("measure_count"))
    return m.join(hit, "chart_id", "left").select(
        "chart_id", F.greatest(F.col("measure_count") - F.coalesce("hit", F.lit(0)), F.lit(0)).alias("empty_measures")
    )


def burstiness(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Fullest measure over the average measure (A10)."""
    avg = F.col("notes_per_measure")
    return note_counts(notes, measures).join(max_per_measure(notes, measures), "chart_id", "left").select(
        "chart_id", F.when(avg > 0, F.col("max_per_measure") / avg).otherwise(F.lit(0.0)).alias("burstiness")
    )


def measure_density(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """Notes of every measure, zero filled."""
    return measures.select("chart_id", "bar_index").hint("merge").join(
        measure_totals(notes, measures), ["chart_id", "bar_index"], "left"
    ).select("chart_id", "bar_index", F.coalesce("n", F.lit(0)).alias("note_count"))


def longest_run(notes: DataFrame) -> DataFrame:
    """Longest run of notes on one lane in (tick, lane) order.

    Notes of one tick and lane are adjacent, so they are counted first. Inside each range of
    beats the runs are islands; only a range's first and last runs can continue in the next
    range, and those few are merged per chart.
    """
    cells = notes.groupBy("chart_id", "tick", "lane").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("__c", F.floor(F.col("tick") / (K.TICKS_PER_BEAT * O.BEAT_CHUNK)))
    w = Window.partitionBy("chart_id", "__c").orderBy("tick", "lane")
    wl = Window.partitionBy("chart_id", "__c", "lane").orderBy("tick")
    runs = cells.withColumn("__i", F.row_number().over(w) - F.row_number().over(wl)).groupBy(
        "chart_id", "__c", "lane", "__i"
    ).agg(F.sum("n").alias("n"), F.min("tick").alias("t0"))
    # a range touches its neighbours only through its first and last run
    inner = Window.partitionBy("chart_id", "__c")
    key = F.struct("t0", "lane")
    runs = runs.withColumns({"first": F.min(key).over(inner), "last": F.max(key).over(inner)}).withColumn("k", key)
    edge = (F.col("k") == F.col("first")) | (F.col("k") == F.col("last"))
    best = runs.groupBy("chart_id").agg(F.max("n").alias("n"))
    e = runs.where(edge).select("chart_id", "__c", "k", "lane", "n", (F.col("first") == F.col("last")).alias("only"))
    we = Window.partitionBy("chart_id").orderBy("__c", "k")
    e = e.withColumns({"pl": F.lag("lane").over(we), "pc": F.lag("__c").over(we)})
    # a new merged run starts when the lane changes, or inside one range between its two edge runs
    e = e.withColumn("s", (F.col("pl").isNull() | (F.col("pl") != F.col("lane")) | (F.col("pc") == F.col("__c"))).cast("int"))
    e = e.withColumn("g", F.sum("s").over(we))
    merged = e.groupBy("chart_id", "g").agg(F.sum("n").alias("n")).select("chart_id", "n")
    return best.unionByName(merged).groupBy("chart_id").agg(F.max("n").alias("longest_run"))


def note_preview(notes: DataFrame, n: int = 12) -> DataFrame:
    """First notes of a chart as text, in (tick, lane) order.

    A first cut per (chart, range of beats) keeps at most ``n`` rows each, so the window over a
    chart sees only those.
    """
    order = ["tick", "lane", "source_event_id"]
    c = notes.withColumn("__c", F.floor(F.col("tick") / (K.TICKS_PER_BEAT * O.BEAT_CHUNK)))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("chart_id", "__c").orderBy(*order))).where(F.col("r") <= n)
    c = c.withColumn("position", F.row_number().over(Window.partitionBy("chart_id").orderBy(*order))).where(F.col("position") <= n)
    text = F.concat(
        F.lit("tick="), F.col("tick").cast("string"), F.lit(":beat="), F.col("beat_index").cast("string"),
        F.lit(":sub="), F.coalesce(F.col("subdivision_index").cast("string"), F.lit("nil")),
        F.lit(":lane="), F.col("lane"), F.lit(":vel="), F.coalesce(S.fixed2("velocity"), F.lit("nil")),
    )
    return c.select("chart_id", "position", "tick", "lane", "beat_index", "subdivision_index", "velocity", text.alias("line"))


def chart_metrics(charts: DataFrame, notes: DataFrame, measures: DataFrame) -> DataFrame:
    """One wide row per chart (A1-A10, W6), zeros for charts without notes.

    Notes are counted once per (beat, tick, lane, measure) with map-side combine; the four
    groupings over those cells come from one grouping-set aggregate. Rows of charts are never broadcast: they
    grow with the charts, and Spark takes their arrays for shorter than they are.
    """
    cells = note_measure(
        notes.groupBy("chart_id", "beat_index", "tick", "lane").agg(F.count(F.lit(1)).alias("n")), measures
    ).withColumn("hit", F.col("bar_index").isNotNull())
    sets = cells.groupingSets(
        [["chart_id", "lane"], ["chart_id", "tick"], ["chart_id", "beat_index"], ["chart_id", "hit", "bar_index"]],
        "chart_id", "lane", "tick", "beat_index", "hit", "bar_index",
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    # grouping ids: bits lane, tick, beat, hit, bar from high to low, 1 = not part of the set
    lane, tick, beat, bar = (F.col("g") == v for v in (0b01111, 0b10111, 0b11011, 0b11100))
    n = F.col("n")
    m = sets.groupBy("chart_id").agg(
        F.sum(F.when(lane, n)).alias("note_count"),
        F.sort_array(F.collect_set(F.when(lane, F.struct(F.col("lane").alias("lane"), n.alias("n"))))).alias("usage"),
        F.max(F.when(tick, n)).alias("max_simultaneous"),
        F.max(F.when(beat, n)).alias("max_per_beat"),
        F.max(F.when(bar, n)).alias("max_per_measure"),
        F.count_if(bar & F.col("hit")).alias("hit_measures"),
    )
    mc = measures.groupBy("chart_id").agg(F.count(F.lit(1)).alias("measure_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = charts.select("chart_id")
    for part in (m, mc, longest_run(notes)):
        out = out.join(part.hint("merge"), "chart_id", "left")
    avg = F.when(zero("measure_count") > 0, zero("note_count") / zero("measure_count")).otherwise(F.lit(0.0))
    empty = F.array().cast("array<struct<lane:string,n:bigint>>")
    out = out.withColumn("usage", F.coalesce("usage", empty))
    focus = lambda lane: F.coalesce(F.get(F.filter("usage", lambda u: u["lane"] == lane), F.lit(0))["n"], F.lit(0))
    return out.select(
        "chart_id",
        zero("note_count").alias("note_count"),
        zero("measure_count").alias("measure_count"),
        F.transform("usage", lambda u: u["lane"]).alias("lanes"),
        "usage",
        zero("max_simultaneous").alias("max_simultaneous"),
        zero("max_per_beat").alias("max_per_beat"),
        zero("max_per_measure").alias("max_per_measure"),
        zero("longest_run").alias("longest_run"),
        F.greatest(zero("measure_count") - zero("hit_measures"), F.lit(0)).alias("empty_measures"),
        avg.alias("notes_per_measure"),
        F.when(avg > 0, zero("max_per_measure") / avg).otherwise(F.lit(0.0)).alias("burstiness"),
        *[focus(x).alias(f"n_{x}") for x in K.FOCUSED_LANES],
    )
