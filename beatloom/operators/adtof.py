"""Transcription output to drum-event candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions import labels as L
from beatloom.functions import scalars as S
from beatloom.functions import variants as V

LISTS = ["hits", "events", "notes", "detections", "predictions", "candidates"]
BOXES = [*K.WRAPPER_CONTAINERS, "transcription", "drums", "percussion"]
INSTRUMENT_LISTS = ["instruments", "tracks", "sources"]


def _objects(v, keys):
    return F.filter(F.coalesce(*[V.items(V.get(v, k)) for k in keys]), V.is_object)


def flatten_hits(payloads: DataFrame) -> DataFrame:
    """Hits of a document: track_id, pos, outer, inner (the hit itself).

    Lists at the root, then in a container, then below instruments, whose label and note number
    their hits inherit.
    """
    boxed = F.filter(F.transform(F.array(*[V.obj("raw", k) for k in BOXES]), lambda b: F.when(b.isNotNull(), _objects(b, LISTS))), lambda x: F.size(x) > 0)
    own = _objects("raw", LISTS)
    direct = F.when(F.size(own) > 0, own).otherwise(F.get(boxed, F.lit(0)))
    nothing = F.lit(None).cast("variant")
    pair = lambda outer, inner: F.struct(outer.alias("outer"), inner.alias("inner"))
    below = F.flatten(
        F.transform(
            _objects("raw", INSTRUMENT_LISTS),
            lambda i: F.transform(F.coalesce(_objects(i, ["hits", "events", "notes", "detections"]), F.array().cast("array<variant>")), lambda h: pair(i, h)),
        )
    )
    all_hits = F.when(direct.isNotNull(), F.transform(direct, lambda h: pair(nothing, h))).otherwise(below)
    return payloads.select("track_id", F.posexplode(all_hits).alias("pos", "h")).select("track_id", "pos", "h.outer", "h.inner")


def normalize_adtof(
    payloads: DataFrame, confidence_default: float = 0.5, velocity_default: float = 0.8, prefix: str = "adtof", zero_confidence_is_missing: bool = False
) -> DataFrame:
    """Typed candidates of transcription documents (P18); ``dropped`` marks hits without onset.

    ``zero_confidence_is_missing`` follows the older adapter, which replaces a confidence of zero
    by the default.
    """
    h = flatten_hits(payloads)
    one = lambda *keys: V.first_present("inner", list(keys))
    position = one("position", "offset")
    onset = F.coalesce(
        V.number(one("onsetSeconds", "onset", "time", "start", "start_seconds", "time_seconds", "timestamp")),
        V.number(V.first_present(position, ["seconds", "timeSeconds", "time_seconds", "value"])),
    )
    inherits_label = V.first_present("inner", ["label", "instrument"]).isNull()
    inherits_midi = V.first_present("inner", ["midi", "pitch"]).isNull()
    label_up = F.when(inherits_label, V.first_present("outer", ["label", "name", "instrument", "class"]))
    midi_up = F.when(inherits_midi, V.first_present("outer", ["midi", "pitch", "note"]))
    midi = F.coalesce(V.get("inner", "pitch"), V.get("inner", "midi"), midi_up, one("class", "note", "instrument_id"))
    raw_label = F.coalesce(V.get("inner", "label"), V.get("inner", "name"), V.get("inner", "instrument"), label_up, one("class_name", "drum"))
    h = h.withColumns({"__midi": midi, "__label": raw_label})
    is_number = ~V.kind("__midi").isin("STRING", "OBJECT", "ARRAY", "VOID", "BOOLEAN")
    note = F.when(is_number, F.try_variant_get("__midi", "$", "double").cast("int"))
    midi_text = F.coalesce(F.when(note.isNotNull(), F.coalesce(L.midi_lane(note, "adtof"), note.cast("string"))), V.scalar_text("__midi"))
    confidence = V.number(one("confidence", "probability", "score"))
    if zero_confidence_is_missing:
        confidence = F.when(confidence != 0, confidence)
    plain = V.scalar_text("__label")
    source = (
        F.when(note.isNotNull(), F.concat(F.lit(f"{prefix}_midi_"), note.cast("string")))
        .when(V.scalar_text("__midi").isNotNull(), F.concat(F.lit(f"{prefix}_"), V.scalar_text("__midi")))
        .when(plain.isNotNull(), F.concat(F.lit(f"{prefix}_"), F.replace(F.lower(F.trim(plain)), F.lit(" "), F.lit("_"))))
        .otherwise(f"{prefix}_unknown")
    )
    event_id = V.scalar_text(one("eventID", "event_id", "id"))
    return h.select(
        "track_id", "pos",
        F.coalesce(F.when(event_id != "", event_id), F.concat(F.lit(f"{prefix}-"), F.col("pos").cast("string"))).alias("event_id"),
        onset.alias("onset_seconds"),
        F.coalesce(midi_text, plain, F.lit("unknown")).alias("label"),
        S.norm_velocity(V.number(one("velocity", "amplitude", "strength", "value")), "adapter", velocity_default).alias("velocity"),
        F.coalesce(confidence, F.lit(confidence_default)).alias("confidence"),
        source.alias("source_label"),
        onset.isNull().alias("dropped"),
    )
