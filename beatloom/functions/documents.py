"""Searches of one JSON document that go to any depth.

Columns can read a path but not recurse, so these few searches run as Arrow-batched functions over the
document's text: every container at every level is looked at, in a defined order, and nothing is cut off.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions.scalars import col

NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*")
ABSENT = object()
SLICE = 1 << 20  # characters of JSON text parsed at a time
TIMES = {"beats": K.BEAT_KEYS, "downbeats": K.DOWNBEAT_KEYS, "subdivisions": K.SUBDIVISION_KEYS}
VALIDATED = K.BEAT_KEYS + K.DOWNBEAT_KEYS + K.SUBDIVISION_KEYS
STAGE_BOXES = [*K.WRAPPER_CONTAINERS, "transcription", "drums", "percussion", "timing"]
PARTS = "beats:array<double>,downbeats:array<double>,subdivisions:array<double>,hits:array<struct<outer:string,inner:string>>"


def child(value, *path: str):
    for key in path:
        value = value.get(key, ABSENT) if isinstance(value, dict) else ABSENT
    return value


def present(value, keys: list[str]):
    """Value of the first key that exists, null included."""
    return next((value[k] for k in keys if k in value), ABSENT) if isinstance(value, dict) else ABSENT


def number(value) -> float | None:
    if isinstance(value, str):
        return float(value) if NUMBER.fullmatch(value) else None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def seconds(value) -> float | None:
    """A time in a number, a numeric string or one of the object shapes."""
    nested = (present(child(value, p), K.TIMING_NESTED_KEYS) for p in K.TIMING_NESTED_PARENTS)
    found = map(number, (value, present(value, K.TIMING_DIRECT_KEYS), *nested))
    return next((x for x in found if x is not None), None)


def labelled(hit: dict) -> bool:
    """Whether a hit has a usable label: the first direct or nested one settles it."""
    label = present(hit, K.LABEL_KEYS)
    if label is ABSENT:
        label = next((x for p in K.LABEL_NESTED_PARENTS if (x := present(child(hit, p), K.LABEL_NESTED_KEYS)) is not ABSENT), ABSENT)
    if isinstance(label, (str, int, float)):
        return True
    return present(label, K.LABEL_NESTED_KEYS) is not ABSENT


def objects(document) -> Iterator[tuple[int, str, dict]]:
    """Every object with its depth and path, level by level in the order of paths."""
    level, depth = [("$", document)], 0
    while level:
        level.sort(key=lambda item: item[0].encode())
        yield from ((depth, path, value) for path, value in level if isinstance(value, dict))
        below = []
        for path, value in level:
            inside = value.items() if isinstance(value, dict) else ((f"{i:08d}", x) for i, x in enumerate(value))
            below += [(f"{path}/{key}", x) for key, x in inside if isinstance(x, (dict, list))]
        level, depth = below, depth + 1


def roots(document) -> list[tuple[int, str, str, dict]]:
    """Objects that may hold timing or hits; of objects with equal keys only the first."""
    found: dict[str, tuple[int, str, str, dict]] = {}
    if isinstance(document, dict):
        for depth, path, value in objects(document):
            keys = "|".join(sorted(value, key=str.encode))
            found.setdefault(keys, (depth, path, keys, value))
    return list(found.values())


def hits_below(value) -> list[tuple[dict, dict | None]]:
    """Hits of a container at any depth, with the wrapped object apart.

    Lists give the hits of all elements. An object that is no hit gives those of its first child with any,
    the usual child keys before the others, these by name.
    """
    if isinstance(value, list):
        return [hit for x in value for hit in hits_below(x)]
    if not isinstance(value, dict):
        return []
    wrapped = next((value[k] for k in ("event", "hit", "drum") if isinstance(value.get(k), dict)), None)
    if wrapped is not None or labelled(value) or seconds(value) is not None:
        return [(value, wrapped)]
    order = [k for k in K.HIT_CHILD_KEYS if k in value]
    order += sorted(value.keys() - set(order))
    return next((found for k in order if (found := hits_below(value[k]))), [])


def parts(document) -> dict:
    """Beats, downbeats, subdivisions and hits: of each, what the first root with any holds."""
    out: dict = dict.fromkeys([*TIMES, "hits"])
    for _, _, _, root in roots(document):
        for what, keys in TIMES.items():
            if out[what] is None:
                listed = (x if isinstance(x, list) else [x] for x in [*(child(root, k) for k in keys), *(child(root, "timing", k) for k in keys)])
                times = ([t for x in values if (t := seconds(x)) is not None] for values in listed)
                out[what] = next((t for t in times if t), None)
        if out["hits"] is None:
            found = next((h for path in K.HIT_PATHS if (h := hits_below(child(root, *path.split("."))))), None)
            out["hits"] = found and [{"outer": json.dumps(o), "inner": None if i is None else json.dumps(i)} for o, i in found]
    return out


def event_count(document) -> int:
    """Length of the first event list, else the first count above zero in a container."""
    if not isinstance(document, dict):
        return 0
    own = next((document[k] for k in K.EVENT_COUNT_KEYS if isinstance(document.get(k), list)), None)
    if own is not None:
        return len(own)
    return next((n for k in K.EVENT_COUNT_CONTAINERS if (n := event_count(document.get(k)))), 0)


def stage_events(document) -> list | None:
    """The first event list, else the first non-empty one in a container."""
    if not isinstance(document, dict):
        return None
    own = next((document[k] for k in K.STAGE_EVENT_KEYS if isinstance(document.get(k), list)), None)
    return own if own is not None else next((e for k in STAGE_BOXES if (e := stage_events(document.get(k)))), None)


def has_number(value) -> bool:
    """Whether a timing value leads to a number, through lists and the keys of a time."""
    if isinstance(value, list):
        return any(map(has_number, value))
    if isinstance(value, dict):
        return has_number(present(value, ["seconds", "time", "start", "offset", "position"]))
    return isinstance(value, (int, float))


def has_timing(document) -> bool:
    """Timing at the root, under timing, in the raw output or else in a container, at any depth."""
    if not isinstance(document, dict):
        return False
    if any(has_number(child(document, *at, k)) for at in ((), ("timing",)) for k in VALIDATED):
        return True
    if isinstance(document.get("rawAnalyzerOutput"), dict):
        return has_timing(document["rawAnalyzerOutput"])
    return any(has_timing(document.get(k)) for k in K.WRAPPER_CONTAINERS)


def unwrapped(document):
    """The innermost object below result, output, payload or data."""
    while isinstance(inner := next((document[k] for k in K.PAYLOAD_CONTAINERS if isinstance(document.get(k), dict)), None), dict):
        document = inner
    return document


def settled(document, events, warnings, defaults, overrides):
    """A document with chosen hits, warnings and runtime facts written into it."""
    if not isinstance(document, dict):
        return document
    out = dict(document)
    if events is not None:
        out["drumEvents"] = events
    if isinstance(out.get("warnings", []), list):
        out["warnings"] = list(warnings)
    runtime = out.get("runtime", {})
    if overrides and not isinstance(runtime, dict):
        runtime = {}
    if isinstance(runtime, dict):
        out["runtime"] = {**defaults, **runtime, **overrides}
    return out


def slices(series: tuple[pd.Series, ...], size: int = SLICE) -> Iterator[tuple[pd.Series, ...]]:
    """A batch in runs of rows with about ``size`` characters of text, at least one row each.

    Parsed documents take many times their text, so no more than a slice of them is held at a time.
    """
    start, held = 0, 0
    n = len(series[0])
    for i in range(n):
        held += sum(len(x) for s in series if (x := s.iat[i]) is not None)
        if held >= size or i == n - 1:
            yield tuple(s.iloc[start : i + 1] for s in series)
            start, held = i + 1, 0


def over(rule: Callable, kind: str, *columns) -> Column:
    """Apply a rule to JSON columns (variants); its result is of the SQL type ``kind``, or JSON text that is
    parsed again for ``variant``."""
    text = kind == "variant"

    @F.pandas_udf("string" if text else kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            # one column comes bare
            for part in slices(series if isinstance(series, tuple) else (series,)):
                found = [None if row[0] is None else rule(*(None if x is None else json.loads(x) for x in row)) for row in zip(*part, strict=True)]
                yield pd.Series([None if x is None else json.dumps(x) for x in found] if text else found, dtype=object)

    out = run(*[F.to_json(col(c)) for c in columns])
    return F.try_parse_json(out) if text else out
