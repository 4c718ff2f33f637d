"""Number and text functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatloom import constants as K


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def tick(beat, step, subdivisions) -> Column:
    """Chart tick of a step inside a beat; halves round away from zero."""
    n = F.greatest(col(subdivisions), F.lit(1))
    s = F.least(F.greatest(col(step), F.lit(0)), n - 1)
    offset = F.round(s.cast("double") / n.cast("double") * F.lit(float(K.TICKS_PER_BEAT)))
    return (col(beat) * K.TICKS_PER_BEAT + offset).cast("long")


def range_penalty(actual, low, high, cap: float, floor: float) -> Column:
    """Penalty that grows with the distance from [low, high], up to ``cap``."""
    a, lo, hi = col(actual), col(low), col(high)
    delta = F.when(a < lo, lo - a).otherwise(a - hi).cast("double")
    scale = F.when(a < lo, F.greatest(lo, F.lit(floor))).otherwise(F.greatest(hi, F.lit(floor))).cast("double")
    return F.when((a >= lo) & (a <= hi), F.lit(0.0)).otherwise(
        F.least(F.lit(cap), delta / scale * F.lit(cap))
    )


def step_penalty(excess, each: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.lit(each) * col(excess).cast("double"))


def fixed2(c) -> Column:
    """Two decimals as text."""
    return F.format_string("%.2f", col(c).cast("double"))


def signed(c, decimals: bool = False) -> Column:
    c = col(c)
    text = fixed2(c) if decimals else c.cast("string")
    return F.when(c >= 0, F.concat(F.lit("+"), text)).otherwise(text)


def trimmed_number(c) -> Column:
    """No decimals for whole numbers, otherwise two."""
    c = col(c).cast("double")
    return F.when(F.round(c) == c, F.format_string("%.0f", c)).otherwise(fixed2(c))


def norm_velocity(v, mode: str = "runtime", default: float | None = None) -> Column:
    """Clamp to [0, 1]. Adapter mode divides values above one by 127 and may apply a default."""
    x = col(v).cast("double")
    if mode == "adapter":
        x = F.when(x > 1.0, x / 127.0).otherwise(x)
    clamped = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(clamped, F.lit(default)) if default is not None else clamped


def confidence_band(x) -> Column:
    c = col(x)
    return (
        F.when(c.isNull(), "unknown").when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")
    )


def confidence_bucket(x) -> Column:
    """Band used when comparing sources: values outside [0, 1.01) count as high."""
    c = col(x)
    return (
        F.when(c.isNull(), "unknown")
        .when((c >= 0.0) & (c < 0.5), "low")
        .when((c >= 0.5) & (c < 0.8), "medium")
        .otherwise("high")
    )


def octave_fold(bpm, low: float, high: float) -> Column:
    """Double a tempo until it reaches ``low``, then halve it until it is at most ``high``.

    Scaling by a power of two is exact in binary floating point, so one multiplication gives
    what repeated doubling would; one correction step covers rounding of the logarithm.
    """
    def let(value, body):
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def fold(x, steps, scale, back, outside, inside):
        # one power of two, then one step either way when the logarithm was off by a rounding error
        moved = let(F.struct(x.alias("x"), F.when(outside(x), F.ceil(F.log2(steps(x)))).otherwise(F.lit(0)).alias("k")),
                    lambda s: F.struct(scale(s["x"], F.pow(F.lit(2.0), s["k"])).alias("y"), s["k"].alias("k")))
        return let(moved, lambda s: F.when(outside(s["y"]), scale(s["y"], F.lit(2.0)))
                   .when((s["k"] > 0) & inside(back(s["y"])), back(s["y"])).otherwise(s["y"]))

    times, over = (lambda v, f: v * f), (lambda v, f: v / f)
    raised = fold(F.when(col(bpm) > 0, col(bpm)), lambda v: F.lit(low) / v, times, lambda v: v / 2, lambda v: v < low, lambda v: v >= low)
    return fold(raised, lambda v: v / F.lit(high), over, lambda v: v * 2, lambda v: v > high, lambda v: v <= high)


def retry_time(completed_at, attempt, max_attempts) -> Column:
    a = col(attempt)
    delay = F.least(F.pow(F.lit(2.0), F.greatest(a - 1, F.lit(0))), F.lit(60.0))
    return F.when(
        a < col(max_attempts),
        F.timestamp_micros(F.unix_micros(col(completed_at)) + (delay * 1000000).cast("long")),
    )


def chart_base_name(s) -> Column:
    x = F.regexp_replace(col(s), r"[^\p{L}\p{M}\p{N}\-_]", "-")
    x = F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^[-_]+|[-_]+$", "")
    return F.when(x == "", F.lit("chart")).otherwise(x)


def file_timestamp(ts) -> Column:
    return F.date_format(col(ts), "yyyyMMdd'T'HHmmssSSS'Z'")


def iso_timestamp(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def content_type(extension) -> Column:
    return lookup(F.lower(col(extension)), K.CONTENT_TYPES)


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table, null when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def fallback_category(reason) -> Column:
    r = col(reason)
    return (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(r.contains("payload did not contain recognizable"), "validation")
        .when(r.contains("not configured"), "configuration")
        .when(r.contains("policy"), "policy")
        .otherwise("execution")
    )


def fallback_error(reason) -> Column:
    """Text after the last colon-space, null when there is none."""
    r = col(reason)
    tail = F.trim(F.substring_index(r, ": ", -1))
    return F.when(r.contains(": ") & (tail != ""), tail)


def fallback_summary(reason) -> Column:
    return F.when(
        col(reason).isNotNull(),
        F.struct(
            col(reason).alias("reason"),
            fallback_category(reason).alias("category"),
            fallback_error(reason).alias("error_summary"),
        ),
    )


def backend_label(command) -> Column:
    c = col(command)
    return (
        F.when(c.contains("beat-this-backend.py"), "beat_this")
        .when(c.contains("backend-analyzer.py"), "heuristic_backend")
        .when(c.contains("madmom-fallback-backend.py"), "madmom_fallback")
    )


def notable(warnings) -> Column:
    """Warnings an operator should see first."""
    return F.filter(
        col(warnings), lambda w: reduce(lambda a, b: a | b, [w.contains(t) for t in K.NOTABLE_WARNINGS])
    )


def kv_text(**parts) -> Column:
    """``k=v`` pairs joined by a space; null values are left out."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), col(v).cast("string")) for k, v in parts.items()])


def fallback_line(summary: Column) -> Column:
    err = summary["error_summary"]
    return F.when(
        summary.isNotNull(),
        F.concat(
            summary["category"], F.lit(": "), F.when(err.isNotNull() & (err != ""), err).otherwise(summary["reason"])
        ),
    )


def timing_line(p: Column) -> Column:
    fallback = F.when(
        p["fallback_used"], F.coalesce(F.concat(F.lit("fallback="), fallback_line(p["fallback_summary"])), F.lit("fallback=yes"))
    ).otherwise("fallback=no")
    return F.when(
        p.isNotNull(),
        F.concat_ws(
            ", ",
            F.concat(p["backend"], F.lit(" via "), p["timing_source"]),
            F.concat(F.lit("selected="), p["selected_backend"]),
            fallback,
        ),
    )


def event_line(p: Column) -> Column:
    return F.when(
        p.isNotNull(),
        F.concat_ws(
            ", ",
            F.concat(p["backend"], F.lit(" via "), p["event_source"]),
            F.when(p["backend_used"], "used=yes").otherwise("used=no"),
            F.concat(F.lit("fallback="), fallback_line(p["failure_summary"])),
        ),
    )


def operator_line(duration, tempo, segments, tracks, confidence, timing=None, selected=None, events=None) -> Column:
    """One line an operator reads for an analysed track; missing values are skipped."""

    def part(prefix, c, suffix=""):
        c = col(c)
        return F.when(c.isNotNull(), F.concat(F.lit(prefix), trimmed_number(c), F.lit(suffix)))

    parts = [
        part("duration=", duration, "s"),
        part("tempo≈", tempo, " bpm"),
        F.concat(F.lit("segments="), col(segments).cast("string")),
        F.concat(F.lit("tracks="), col(tracks).cast("string")),
        part("confidence=", confidence),
    ]
    if timing is not None:
        t = F.concat(F.lit("timing="), timing_line(col(timing)))
        s = F.concat(F.lit("backend="), col(selected)) if selected is not None else F.lit(None).cast("string")
        parts.append(F.coalesce(t, s))
    elif selected is not None:
        parts.append(F.concat(F.lit("backend="), col(selected)))
    if events is not None:
        parts.append(F.concat(F.lit("events="), event_line(col(events))))
    return F.concat_ws(" | ", *parts)
