"""Label normalisation and the lane lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions.scalars import col, lookup


def normalize_label(s, collapse: str = "single") -> Column:
    """Lower case, non-alphanumeric to ``_``, collapse, trim; empty becomes null.

    ``single`` replaces each pair of underscores once; ``full`` collapses whole runs.
    """
    x = F.regexp_replace(F.lower(col(s)), r"[^\p{L}\p{M}\p{N}]", "_")
    x = F.regexp_replace(x, "_+", "_") if collapse == "full" else F.replace(x, F.lit("__"), F.lit("_"))
    x = F.regexp_replace(x, "^_+|_+$", "")
    return F.when(x != "", x)


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def alias_table(spark: SparkSession, version: str) -> DataFrame:
    """(alias, alias_lane): fixed size, the first lane listing an alias owns it."""
    seen: dict[str, str] = {}
    for lane, words in K.LANE_ALIASES[version].items():
        for w in words:
            seen.setdefault(w, lane)
    return _values(spark, list(seen.items()), "alias, alias_lane")


def midi_table(spark: SparkSession, version: str) -> DataFrame:
    """(midi_note, midi_lane): fixed size."""
    src = K.MIDI_LABELS if version == "adtof" else K.MIDI_LANES[version]
    return _values(spark, [(n, lane) for lane, notes in src.items() for n in notes], "midi_note, midi_lane")


def game_table(spark: SparkSession) -> DataFrame:
    rows = [(lane, *v) for lane, v in K.GAME_LANES.items()]
    return _values(spark, rows, "lane, game_lane, colour, game_key")


def midi_lane(note, version: str) -> Column:
    """Lane (or plain label for ``adtof``) of a note number."""
    src = K.MIDI_LABELS if version == "adtof" else K.MIDI_LANES[version]
    return lookup(col(note).cast("int"), {n: lane for lane, notes in src.items() for n in notes})


def map_lane(df: DataFrame, label: str | None, note: str | None, version: str, out: str = "lane") -> DataFrame:
    """Attach the lane of a label and/or note number; the note number is tried first.

    Both lookup tables are constants of well under two hundred rows, so broadcasting them is
    always safe. Unmatched rows keep a null lane for the drop counters.
    """
    spark = df.sparkSession
    parts = []
    if note is not None:
        df = df.join(F.broadcast(midi_table(spark, version)), F.col(note).cast("int") == F.col("midi_note"), "left").drop("midi_note")
        parts.append(F.col("midi_lane"))
    if label is not None:
        collapse = "full" if version == "audit" else "single"
        df = (
            df.withColumn("__alias", normalize_label(label, collapse))
            .join(F.broadcast(alias_table(spark, version)), F.col("__alias") == F.col("alias"), "left")
            .drop("alias", "__alias")
        )
        parts.append(F.col("alias_lane"))
    return df.withColumn(out, F.coalesce(*parts)).drop("midi_lane", "alias_lane")


def game_lane(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(game_table(df.sparkSession)), "lane", "left")
