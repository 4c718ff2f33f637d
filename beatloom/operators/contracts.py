"""Contract checks as rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom import constants as K

# --- fixed values: rules per contract table, (column, rule, argument) ---------------------
# required: not null; text: at least one character when present; min/max/above: numeric bounds;
# enum: one of; unique: array without repeats; filled: array with at least one entry
CONTRACTS = {
    "charts": [
        ("offset_seconds", "required", None), ("ticks_per_beat", "required", None), ("ticks_per_beat", "min", 1), ("bpm", "above", 0),
        ("timing_source", "required", None), ("timing_source", "enum", ["analyzer", "fallback"]),
        ("lanes", "filled", None), ("lanes", "unique", None), ("lanes", "enum_items", K.LANES),
        ("difficulty", "required", None), ("difficulty", "text", None), ("note", "text", None),
    ],
    "chart_measures": [
        ("bar_index", "required", None), ("bar_index", "min", 0), ("start_beat_index", "required", None), ("start_beat_index", "min", 0),
        ("beat_count", "required", None), ("beat_count", "min", 1),
    ],
    "chart_notes": [
        ("note_id", "required", None), ("note_id", "text", None), ("lane", "required", None), ("lane", "enum", K.LANES),
        ("tick", "required", None), ("tick", "min", 0), ("beat_index", "required", None), ("beat_index", "min", 0),
        ("subdivision_index", "min", 0), ("start_seconds", "required", None), ("start_seconds", "min", 0),
        ("duration_ticks", "required", None), ("duration_ticks", "min", 0), ("velocity", "min", 0), ("velocity", "max", 1),
        ("source_event_id", "text", None),
    ],
    "beat_grid": [
        ("beat_index", "required", None), ("beat_index", "min", 0), ("bar_index", "required", None), ("bar_index", "min", 0),
        ("beat_in_bar", "required", None), ("beat_in_bar", "min", 1), ("subdivision_index", "required", None), ("subdivision_index", "min", 0),
        ("subdivision_in_beat", "required", None), ("subdivision_in_beat", "min", 0), ("start_seconds", "required", None),
        ("start_seconds", "min", 0), ("duration_seconds", "min", 0), ("is_downbeat", "required", None), ("tempo_bpm", "above", 0),
        ("confidence", "min", 0), ("confidence", "max", 1),
    ],
    "drum_events": [
        ("event_id", "required", None), ("event_id", "text", None), ("onset_seconds", "required", None), ("onset_seconds", "min", 0),
        ("onset_beat_index", "min", 0), ("onset_subdivision_index", "min", 0), ("lane", "required", None), ("lane", "enum", K.LANES),
        ("velocity", "min", 0), ("velocity", "max", 1), ("source_label", "text", None), ("confidence", "min", 0), ("confidence", "max", 1),
    ],
    "analysis": [
        ("track_count", "required", None), ("track_count", "min", 0), ("segment_count", "required", None), ("segment_count", "min", 0),
        ("duration_seconds", "min", 0), ("tempo_bpm", "above", 0), ("downbeat_offset", "min", 0), ("confidence", "min", 0), ("confidence", "max", 1),
    ],
    "segments": [
        ("index", "required", None), ("index", "min", 0), ("start_seconds", "required", None), ("start_seconds", "min", 0),
        ("end_seconds", "required", None), ("end_seconds", "min", 0), ("label", "required", None), ("label", "text", None),
        ("confidence", "min", 0), ("confidence", "max", 1),
    ],
}


def _broken(column: str, rule: str, arg) -> Column:
    c = F.col(column)
    return {
        "required": lambda: c.isNull(),
        "text": lambda: F.length(c) < 1,
        "min": lambda: c < arg,
        "max": lambda: c > arg,
        "above": lambda: c <= arg,
        "enum": lambda: ~c.isin(*arg),
        "enum_items": lambda: F.exists(c, lambda x: ~x.isin(*arg)),
        "unique": lambda: F.size(c) != F.size(F.array_distinct(c)),
        "filled": lambda: F.coalesce(F.size(c), F.lit(0)) < 1,
    }[rule]()


def validate_contract(df: DataFrame, contract: str, keys: list[str]) -> DataFrame:
    """One row per violation: keys, column, rule (P20). Rules on absent columns are skipped."""
    rules = [r for r in CONTRACTS[contract] if r[0] in df.columns]
    found = F.array_compact(
        F.array(*[
            F.when(F.coalesce(_broken(*r), F.lit(False)), F.struct(F.lit(r[0]).alias("column"), F.lit(r[1]).alias("rule"))) for r in rules
        ])
    )
    return df.select(*keys, F.explode(found).alias("v")).select(*keys, "v.column", "v.rule")
