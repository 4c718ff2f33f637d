"""From sample tables to onsets, beats and drum-event candidates.

``samples``: track_id, idx (contiguous from zero), value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatloom import constants as K
from beatloom.functions import scalars as S
from beatloom.operators import events as E
from beatloom.operators import folds
from beatloom.operators import grid as G
from beatloom.operators import ordered as O
from beatloom.session import cut

FRAME_CHUNK = 4096
TRACK = ["track_id"]


def frame_rms(samples: DataFrame, frame: int = K.FRAME_SIZE, hop: int = K.HOP_SIZE) -> DataFrame:
    """Root mean square of full frames; a signal shorter than one frame gives one.

    Each sample goes to the few frames it lies in and is summed on the map side. A frame is full
    when it has all its samples, so no track length is needed.
    """
    i = F.col("idx")
    first = F.greatest(F.ceil((i - (frame - 1)) / F.lit(hop)), F.lit(0)).cast("long")
    s = samples.select("track_id", F.explode(F.sequence(first, F.floor(i / hop))).alias("frame"), "value")
    f = s.groupBy("track_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value") * F.col("value")).alias("p"))
    return f.where((F.col("n") == frame) | (F.col("frame") == 0)).select("track_id", "frame", F.sqrt("p").alias("rms"))


def novelty(rms: DataFrame) -> DataFrame:
    """Positive first difference of the centred five-frame mean.

    Frames are contiguous, so ranges of frames get copies of the three before and two after them
    and every window stays inside one range.
    """
    f = F.col("frame")
    home = F.floor(f / FRAME_CHUNK)
    ranges = F.array_distinct(F.array(F.floor((f - 2) / FRAME_CHUNK), home, F.floor((f + 3) / FRAME_CHUNK)))
    r = rms.select("track_id", "frame", "rms", home.alias("home"), F.explode(F.filter(ranges, lambda x: x >= 0)).alias("__c"))
    w = Window.partitionBy("track_id", "__c").orderBy("frame")
    r = r.withColumn("smooth", F.avg("rms").over(w.rowsBetween(-2, 2)))
    r = r.withColumn("novelty", F.greatest(F.col("smooth") - F.lag("smooth").over(w), F.lit(0.0)))
    return r.where(F.col("home") == F.col("__c")).select("track_id", "frame", F.coalesce("novelty", F.lit(0.0)).alias("novelty"))


def nearest_rank(series: DataFrame, value: str, fraction: float) -> DataFrame:
    """Value at rank round-half-even((n - 1) * fraction) of each track, exactly."""
    return O.at_ranks(series, value, F.array(F.bround((F.col("n") - 1) * F.lit(fraction), 0).cast("long"))).drop("k")


def peak_threshold(series: DataFrame) -> DataFrame:
    """Larger of the 85th nearest-rank percentile and 1.35 times the mean."""
    mean = series.groupBy("track_id").agg(F.avg("novelty").alias("m"))
    p = nearest_rank(series, "novelty", 0.85)
    return mean.join(p, "track_id").select("track_id", F.greatest(F.col("rank_value"), F.col("m") * 1.35).alias("threshold"))


def detect_peaks(series: DataFrame, threshold: DataFrame, rate: int = K.SAMPLE_RATE, hop: int = K.HOP_SIZE) -> DataFrame:
    """Onsets: local maxima over the threshold, at least the minimum gap apart."""
    gap = max(1, int(K.MIN_EVENT_GAP * rate / hop))
    f = F.col("frame")
    ranges = F.array_distinct(F.array(F.floor((f - 1) / FRAME_CHUNK), F.floor(f / FRAME_CHUNK), F.floor((f + 1) / FRAME_CHUNK)))
    r = series.select("track_id", "frame", "novelty", F.explode(F.filter(ranges, lambda x: x >= 0)).alias("__c"))
    w = Window.partitionBy("track_id", "__c").orderBy("frame")
    v = F.col("novelty")
    r = r.withColumns({"before": F.lag("novelty").over(w), "after": F.lead("novelty").over(w)})
    r = r.where((F.floor(f / FRAME_CHUNK) == F.col("__c")) & (v >= F.col("before")) & (v >= F.col("after")))
    c = r.join(threshold, "track_id").where(v >= F.col("threshold")).select("track_id", "frame", "novelty", "__c")
    c = c.select("track_id", "__c", F.col("frame").alias("n"), F.col("frame").cast("double").alias("t"), F.col("novelty").alias("v"), F.lit(float(gap)).alias("gap"), F.lit(0).alias("lane"))
    # of equally strong peaks of a run the first stays
    kept = folds.last_kept_runs(c).groupBy("track_id", "run").agg(F.max(F.struct("v", (-F.col("n")).alias("n"))).alias("b")).select("track_id", (-F.col("b.n")).alias("frame"))
    return kept.select("track_id", "frame", (F.col("frame") * hop / F.lit(float(rate))).alias("onset_seconds"))


def onset_gaps(onsets: DataFrame, time: str = "onset_seconds") -> DataFrame:
    """Gap to the previous onset of the track."""
    t = onsets.select("track_id", F.col(time).alias("t")).withColumn("__c", O.time_chunk("t"))
    return O.neighbors(t, TRACK, ["t"], "__c", prev={"p": "t"}).select("track_id", "t", (F.col("t") - F.col("p")).alias("gap"))


def tempo(onsets: DataFrame, variant: str = "onset", time: str = "onset_seconds") -> DataFrame:
    """Tempo from the median interval.

    ``onset``: intervals of 0.07 to 1.5 s, folded to 70-190, 120 when there is none; ``beat``:
    positive intervals, folded to 70-220, three decimals; ``plain``: positive intervals, no fold.
    """
    g = F.col("gap")
    usable = g.between(K.MIN_EVENT_GAP, K.MAX_EVENT_GAP) if variant == "onset" else g > 0
    gaps = onset_gaps(onsets, time)
    m = gaps.select("track_id").distinct().join(O.median(gaps.where(usable), "gap").withColumnRenamed("median", "m"), "track_id", "left")
    bpm = F.when(F.col("m") > 0, 60.0 / F.col("m"))
    if variant == "onset":
        out = F.coalesce(S.octave_fold(bpm, 70.0, 190.0), F.lit(K.DEFAULT_TEMPO))
    elif variant == "beat":
        out = F.bround(S.octave_fold(bpm, 70.0, 220.0), 3)
    else:
        out = bpm
    return m.select("track_id", out.alias("tempo_bpm"))


def timing_confidence(onsets: DataFrame, downbeats: DataFrame | None = None, time: str = "onset_seconds") -> DataFrame:
    """One minus the relative spread of intervals, clamped to 0.2-0.99.

    With ``downbeats`` the beat variant applies: a bonus of 0.08 for tracks that have some, minus
    0.05 for others. Without, tracks that have no usable interval get 0.25.
    """
    g = F.col("gap")
    s = onset_gaps(onsets, time).groupBy("track_id").agg(
        F.stddev_pop(F.when(g > 0, g)).alias("sd"), F.avg(F.when(g > 0, g)).alias("mean"), F.count(F.lit(1)).alias("n"),
        F.count_if(g.between(K.MIN_EVENT_GAP, K.MAX_EVENT_GAP)).alias("usable"),
    )
    stability = F.greatest(1.0 - F.col("sd") / F.greatest(F.col("mean"), F.lit(1e-6)), F.lit(0.0))
    if downbeats is None:
        c = F.bround(F.least(F.greatest(stability, F.lit(0.2)), F.lit(0.99)), 4)
        return s.select("track_id", F.when((F.col("usable") > 0) & F.col("sd").isNotNull(), c).otherwise(F.lit(0.25)).alias("confidence"))
    s = s.join(downbeats.select("track_id").distinct().withColumn("d", F.lit(True)), "track_id", "left")
    bonus = F.when(F.col("d"), F.lit(0.08)).otherwise(F.lit(-0.05))
    c = F.bround(F.least(F.greatest(stability + bonus, F.lit(0.2)), F.lit(0.99)), 4)
    return s.select("track_id", F.when(F.col("n") < 2, F.lit(0.35)).when(F.col("sd").isNotNull(), c).alias("confidence"))


def bar_segments(downbeats: DataFrame, durations: DataFrame) -> DataFrame:
    """Bars between downbeats, the last one ending with the track.

    ``durations``: track_id, duration_seconds. Tracks without downbeats give one full_track row;
    empty bars are dropped but keep their number.
    """
    d = downbeats.withColumn("__c", O.time_chunk("start_seconds"))
    d = O.row_index(d, TRACK, ["start_seconds"], "__c", "index")
    d = O.neighbors(d, TRACK, ["start_seconds"], "__c", next={"next_start": "start_seconds"}).join(durations, "track_id", "left")
    dur = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    end = F.coalesce("next_start", dur)
    bars = d.where(end > F.col("start_seconds")).select(
        "track_id", "index", F.round("start_seconds", 6).alias("start_seconds"), F.round(end, 6).alias("end_seconds"),
        F.concat(F.lit("bar_"), (F.col("index") + 1).cast("string")).alias("label"),
    )
    whole = durations.join(downbeats.select("track_id").distinct(), "track_id", "left_anti").where(F.col("duration_seconds") > 0).select(
        "track_id", F.lit(0).cast("long").alias("index"), F.lit(0.0).alias("start_seconds"), F.round("duration_seconds", 6).alias("end_seconds"),
        F.lit("full_track").alias("label"),
    )
    return bars.unionByName(whole)


# --- classification -----------------------------------------------------------------------------


def onset_features(samples: DataFrame, onsets: DataFrame, rate: int = K.SAMPLE_RATE) -> DataFrame:
    """Loudness, crossings and motion around each onset.

    Samples meet the windows they lie in through buckets of one window length, so a sample is
    compared only with nearby onsets.
    """
    ms = lambda s: int(s * rate)
    width = max(1, ms(0.03) + ms(0.09))
    center = F.floor(F.col("onset_seconds") * rate).cast("long")
    o = onsets.select("track_id", "onset_seconds", F.greatest(center - ms(0.03), F.lit(0)).alias("w0"), (center + ms(0.06)).alias("w1"),
                      F.greatest(center + ms(0.015), F.lit(0)).alias("t0"), (center + ms(0.09)).alias("t1"))
    buckets = F.sequence(F.floor(F.col("w0") / width), F.floor((F.greatest("w1", "t1") - 1) / width))
    o = o.withColumn("__b", F.explode(buckets))
    s = samples.select("track_id", "idx", "value", F.floor(F.col("idx") / width).alias("__b"))
    j = s.join(o, ["track_id", "__b"]).where((F.col("idx") >= F.col("w0")) & (F.col("idx") < F.greatest("w1", "t1")))
    i, v = F.col("idx"), F.col("value")
    low, mid = max(1, rate // 220), max(1, rate // 880)
    inside = i < F.col("w1")
    j = j.withColumns({
        "in_w": inside, "in_t": (i >= F.col("t0")) & (i < F.col("t1")),
        "low": inside & ((i - F.col("w0")) % low == 0), "mid": inside & ((i - F.col("w0")) % mid == 0),
    })
    part = ["track_id", "onset_seconds"]
    before = lambda flag: F.lag("value").over(Window.partitionBy(*part, flag).orderBy("idx"))
    j = j.withColumns({"pw": before("in_w"), "pl": before("low"), "pm": before("mid")})
    crossing = ((F.col("pw") <= 0) & (v > 0)) | ((F.col("pw") >= 0) & (v < 0))
    f = j.groupBy(*part).agg(
        F.avg(F.when(F.col("in_w"), F.abs(v))).alias("avg_abs"), F.count_if("in_w").alias("n"), F.count_if(F.col("in_w") & crossing).alias("zc"),
        F.avg(F.when(F.col("in_t"), F.abs(v))).alias("tail"),
        F.avg(F.when(F.col("low"), F.abs(v - F.col("pl")))).alias("low_motion"), F.avg(F.when(F.col("mid"), F.abs(v - F.col("pm")))).alias("mid_motion"),
    )
    f = onsets.select(*part).join(f, part, "left").fillna(0.0, ["avg_abs", "tail", "low_motion", "mid_motion"]).fillna(0, ["n", "zc"])
    c, eps = F.col, F.lit(1e-6)
    return f.select(
        *part, "avg_abs",
        (c("zc") / F.greatest(c("n") - 1, F.lit(1))).alias("zcr"),
        (c("tail") / F.greatest(c("avg_abs"), eps)).alias("sustain_ratio"), (c("avg_abs") / F.greatest(c("tail"), eps)).alias("punch_ratio"),
        (c("avg_abs") / F.greatest(c("low_motion"), eps)).alias("bass_ratio"), (c("mid_motion") / F.greatest(c("avg_abs"), eps)).alias("mid_ratio"),
        (c("mid_motion") / F.greatest(c("low_motion"), eps)).alias("spectral_balance"),
    )


def classify(features: DataFrame) -> DataFrame:
    """Adds lane, label and confidence by an ordered rule list of eight classes."""
    z, s, p, b, m, q, a = (F.col(x) for x in ("zcr", "sustain_ratio", "punch_ratio", "bass_ratio", "mid_ratio", "spectral_balance", "avg_abs"))
    L = F.lit
    cap = lambda x: F.least(L(0.99), x)
    up = lambda x, y: F.greatest(x, y)
    kick = ((z < 0.14) & (p > 1.01) & (b > 1.03)) | ((z < 0.09) & (p > 0.98))
    crash = (z > 0.46) & (s > 0.8) & (a > 0.18)
    open_ = (z > 0.33) & (s > 0.72)
    closed = (z > 0.3) | ((m > 1.55) & (p < 1.08))
    tom = (s > 0.86) & (z >= 0.12) & (z <= 0.3) & (b < 1.18) & (q < 1.45)
    tom_conf = cap(L(0.44) + F.least(s, L(1.25)) * 0.18 + up(L(0.0), L(1.22) - q) * 0.16)

    def row(lane, label, conf):
        return F.struct(L(lane).alias("lane"), L(label).alias("label"), conf.alias("confidence"))

    rules = (
        F.when(kick, row("kick", "kick", cap(L(0.48) + a * 1.15 + up(L(0.0), b - 1.0) * 0.32)))
        .when(crash, row("crash", "crash", cap(L(0.46) + F.least(z, L(0.65)) * 0.48 + F.least(s, L(1.4)) * 0.16)))
        .when(open_, row("open_hihat", "open hi hat", cap(L(0.4) + F.least(z, L(0.55)) * 0.58 + F.least(s, L(1.2)) * 0.1)))
        .when(closed, row("closed_hihat", "closed hi hat", cap(L(0.38) + up(z, F.least(m / 2.2, L(0.45))) * 1.1)))
        .when(tom & (q < 0.72), row("tom_low", "floor tom", tom_conf))
        .when(tom & (q < 0.98), row("tom_mid", "mid tom", tom_conf))
        .when(tom, row("tom_high", "high tom", tom_conf))
        .otherwise(row("snare", "snare", cap(L(0.46) + a * 0.95 + F.least(m, L(1.0)) * 0.06)))
    )
    return features.withColumn("__c", rules).select("*", "__c.*").drop("__c")


# --- shaping of classified events ------------------------------------------------------------------


def promote_kicks(located: DataFrame) -> DataFrame:
    """Turn snares into kicks in tracks without any kick.

    ``located``: track_id, onset_seconds, lane, label, confidence and the nearest beat. Snares
    near an even beat and confident enough are promoted; failing that, the strongest 32 percent.
    The strongest are found from counts per confidence, so no track is ranked in one task unless
    its confidences are all distinct. No join is a broadcast, as tracks and their confidences grow with the hits.
    """
    snare = F.col("lane") == "snare"
    window = F.coalesce("beat_interval", F.lit(0.5)) * K.BEAT_WINDOW
    anchored = snare & (F.abs("beat_distance") <= window) & (F.col("nearest_index") % 2 == 0) & (F.col("confidence") >= K.KICK_PROMOTION_FLOOR)
    d = located.withColumns({"__snare": snare, "__anchored": F.coalesce(anchored, F.lit(False))})
    info = d.groupBy("track_id").agg(
        F.count_if(F.col("lane") == "kick").alias("kicks"), F.count_if("__snare").alias("snares"), F.count_if("__anchored").alias("anchored_n"),
        F.count("nearest_index").alias("beaten"),
    ).where((F.col("kicks") == 0) & (F.col("snares") > 0) & (F.col("beaten") > 0))
    quota = F.greatest(F.bround(F.col("snares") * K.KICK_PROMOTION_SHARE, 0).cast("long"), F.lit(1))
    info = info.select("track_id", F.col("anchored_n").alias("n_anchored"), quota.alias("quota"))
    need = info.where(F.col("n_anchored") == 0).select("track_id", "quota")
    # cut-off confidence: all above it are promoted, those at it in onset order while places remain
    by_conf = d.where("__snare").groupBy("track_id", "confidence").agg(F.count(F.lit(1)).alias("c")).join(need.hint("merge"), "track_id")
    w = Window.partitionBy("track_id").orderBy(F.col("confidence").desc())
    by_conf = by_conf.withColumn("upto", F.sum("c").over(w)).withColumn("left", F.col("quota") - (F.col("upto") - F.col("c"))).where(F.col("left") > 0)
    take = by_conf.select("track_id", "confidence", F.lit(True).alias("__snare"), F.least("left", "c").alias("places"), "c")
    d = d.join(info.select("track_id", "n_anchored").hint("merge"), "track_id", "left").join(take.hint("merge"), ["track_id", "confidence", "__snare"], "left")
    partial = F.col("places").isNotNull() & (F.col("places") < F.col("c"))
    rank = F.row_number().over(Window.partitionBy("track_id", "confidence", "__snare").orderBy("onset_seconds"))
    d = d.withColumn("__rank", F.when(partial, rank))
    chosen = F.when(F.col("n_anchored") > 0, F.col("__anchored")).otherwise(
        F.col("places").isNotNull() & (F.col("__rank").isNull() | (F.col("__rank") <= F.col("places")))
    )
    promoted = F.col("__snare") & F.col("n_anchored").isNotNull() & F.coalesce(chosen, F.lit(False))
    conf = F.least(F.greatest(F.col("confidence") + 0.05, F.lit(0.56)), F.lit(0.94))
    return d.withColumns({
        "promoted": promoted, "lane": F.when(promoted, "kick").otherwise(F.col("lane")), "label": F.when(promoted, "kick").otherwise(F.col("label")),
        "confidence": F.when(promoted, conf).otherwise(F.col("confidence")),
    }).drop("__snare", "__anchored", "n_anchored", "places", "c", "__rank")


def filter_weak(located: DataFrame) -> DataFrame:
    """Adds ``weak``: snare, hihat or null - why a hit is too weak to keep."""
    interval = F.col("beat_interval")
    near = F.coalesce(F.abs("beat_distance") <= F.coalesce(interval, F.lit(0.5)) * K.BEAT_WINDOW, F.lit(False))
    # distance to the upbeat after the nearest beat
    upbeat = F.coalesce((interval != 0) & (F.abs(F.col("beat_distance") - interval / 2.0) <= interval * K.UPBEAT_WINDOW), F.lit(False))
    c, lane = F.col("confidence"), F.col("lane")
    weak = (
        F.when((lane == "snare") & (c < K.SNARE_FLOOR), "snare")
        .when((lane == "closed_hihat") & (c < K.HAT_FLOOR), "hihat")
        .when((lane == "closed_hihat") & ~near & ~upbeat & (c < K.ISOLATED_HAT_FLOOR), "hihat")
    )
    return located.withColumn("weak", weak)


def _gap_of() -> Column:
    base = F.coalesce(S.lookup(F.col("lane"), K.LANE_MIN_GAP), F.lit(K.DEFAULT_LANE_GAP))
    interval = F.col("beat_interval")
    return F.when(interval > 0, F.least(base, F.greatest(interval * 0.24, F.lit(0.045)))).otherwise(base)


def dedupe_same_lane(hits: DataFrame) -> DataFrame:
    """Merge same-lane hits closer than the lane's gap to the last kept hit.

    ``hits``: track_id, onset_seconds, lane, label, confidence, beat_interval. The stronger of two hits stays,
    the earlier on a tie; a lane change ends a run. ``merged`` counts what each kept hit absorbed. Runs come
    from ``folds``, which splits a long run where few hits could still be the last kept one.
    """
    cols = ["track_id", "onset_seconds", "lane", "label", "confidence"]
    h = O._placed(hits.select(*cols, _gap_of().alias("gap"), O.time_chunk("onset_seconds").alias("__c")), TRACK, "__c")
    w = Window.partitionBy("track_id", "__c").orderBy("onset_seconds", "lane", "confidence", "label")
    h = h.withColumn("n", F.shiftleft(F.col("__c"), 32) + F.row_number().over(w))
    rows = h.select("track_id", "__c", "n", F.col("onset_seconds").alias("t"), F.coalesce("confidence", F.lit(float("-inf"))).alias("v"), "gap", "lane")
    best = folds.last_kept_runs(rows).groupBy("track_id", "run").agg(F.max(F.struct("v", (-F.col("n")).alias("n"))).alias("b"), (F.count(F.lit(1)) - 1).alias("merged"))
    best = best.select("track_id", (-F.col("b.n")).alias("n"), "merged")
    return h.join(best.hint("merge"), ["track_id", "n"]).select(*cols, "merged")


def shape_classified(classified: DataFrame, beats: DataFrame) -> dict[str, DataFrame]:
    """Promotion, weak-hit filter and same-lane merge over classified onsets."""
    located = E.nearest_beat(classified, beats)
    promoted = cut(promote_kicks(located))
    marked = filter_weak(promoted)
    kept = cut(dedupe_same_lane(marked.where(F.col("weak").isNull())))
    counts = marked.groupBy("track_id").agg(
        F.count_if(F.col("weak") == "snare").alias("weak_snares"), F.count_if(F.col("weak") == "hihat").alias("weak_hats"), F.bool_or("promoted").alias("any_promoted")
    ).join(kept.groupBy("track_id").agg(F.sum("merged").alias("merged")), "track_id", "left")
    out = O.row_index(kept.withColumn("__c", O.time_chunk("onset_seconds")), TRACK, ["onset_seconds", "lane"], "__c", "i")
    hits = out.select(
        "track_id", F.concat(F.lit("evt-"), (F.col("i") + 1).cast("string")).alias("event_id"), F.round("onset_seconds", 6).alias("onset_seconds"),
        "lane", "label", F.bround("confidence", 4).alias("confidence"), F.bround(F.least(F.lit(1.0), F.col("confidence") + 0.35), 4).alias("velocity"),
        F.lit("heuristic_backend").alias("source_label"),
    )
    return {"hits": hits, "counts": counts}


def analyze_samples(samples: DataFrame, rate: int = K.SAMPLE_RATE, frame: int = K.FRAME_SIZE, hop: int = K.HOP_SIZE) -> dict[str, DataFrame]:
    """Samples to summary, beats, downbeats, segments and drum events."""
    curve = cut(novelty(frame_rms(samples, frame, hop)))
    onsets = cut(detect_peaks(curve, peak_threshold(curve), rate, hop).select("track_id", "onset_seconds"))
    durations = samples.groupBy("track_id").agg(((F.max("idx") + 1) / F.lit(float(rate))).alias("duration_seconds"))
    bpm = cut(durations.join(tempo(onsets), "track_id", "left").withColumn("tempo_bpm", F.coalesce("tempo_bpm", F.lit(K.DEFAULT_TEMPO))))
    beats = cut(G.number_beats(G.synth_grid(bpm, onsets)))
    downs = beats.where(F.col("beat_index") % 4 == 0).select("track_id", "start_seconds")
    classified = classify(onset_features(samples, onsets, rate)).select("track_id", "onset_seconds", "lane", "label", "confidence")
    shaped = shape_classified(cut(classified), beats)
    n_beats = beats.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_beats"), F.count_if(F.col("beat_index") % 4 == 0).alias("n_down"), F.min("start_seconds").alias("first"))
    n_on = onsets.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_onsets"))
    n_hits = shaped["hits"].groupBy("track_id").agg(F.count(F.lit(1)).alias("n_hits"))
    s = bpm
    for other in (n_beats, n_on, n_hits, timing_confidence(onsets), shaped["counts"]):
        s = s.join(other, "track_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # --- fixed values: warning texts
    said = lambda n, before, after: F.when(zero(n) > 0, F.concat(F.lit(before), F.col(n).cast("string"), F.lit(after)))
    warnings = F.array_compact(F.array(
        F.when(F.coalesce("any_promoted", F.lit(False)), "promoted beat-anchored snare-like hits to kick to preserve a playable backbone"),
        said("weak_snares", "filtered ", " low-confidence snare candidates"), said("weak_hats", "filtered ", " low-confidence hi-hat candidates"),
        said("merged", "deduped ", " near-duplicate same-lane hits while keeping the stronger candidate"),
        F.when(zero("n_onsets") < 2, "insufficient onset peaks for stable tempo inference; fell back to default beat grid"),
        F.when(zero("n_hits") == 0, "no drum-event candidates detected"),
        F.when(zero("n_beats") < 4, "sparse beat grid; downbeat segmentation is approximate"),
    ))
    summary = s.select(
        "track_id", F.lit(1).alias("track_count"), F.round("duration_seconds", 6).alias("duration_seconds"), F.greatest(zero("n_down"), F.lit(1)).alias("segment_count"),
        F.bround("tempo_bpm", 3).alias("tempo_bpm"), F.round(F.coalesce("first", F.lit(0.0)), 6).alias("downbeat_offset"),
        F.coalesce("confidence", F.lit(0.25)).alias("confidence"), warnings.alias("warnings"),
    )
    return {"summary": summary, "beats": beats, "downbeats": downs, "segments": bar_segments(downs, durations), "hits": shaped["hits"], "onsets": onsets}
