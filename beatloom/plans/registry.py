"""Registry of queries and of the SQL that checks them.

``WITH`` holds named SQL views over the supplied tables; a check's text names the views it uses
and ``compose`` puts their definitions in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatloom import constants as K

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
WITH: dict[str, str] = {}
#: Views that others name many times over; the checking engine computes them once.
SHARED = {
    "collapsed", "bb", "acc", "sh0", "hats", "open_hat", "closed_hat", "texture", "tracks", "beats", "subdivisions", "grid0", "mapped", "q_asof", "quant", "pos_a", "pos_b", "pairs", "nov", "thr", "peaks",
    "lane_gaps", "timing_a", "timing_b", "timing_pairs", "timing_kinds", "samples", "on5",
}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def compose(sql: str) -> str:
    """Prefix a statement with the views it needs, in dependency order."""
    order: list[str] = []

    def need(text: str, within: tuple = ()):
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            # a view may have a column of its own name
            if word in WITH and word not in order and word not in within:
                need(WITH[word], (*within, word))
                if word not in order:
                    order.append(word)

    need(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in SHARED)}({WITH[n]})" for n in order) + "\n" + sql


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def _aliases(version):
    seen = {}
    for lane, words in K.LANE_ALIASES[version].items():
        for w in words:
            seen.setdefault(w, lane)
    return list(seen.items())


WITH.update(
    midi_runtime=values([(n, l) for l, ns in K.MIDI_LANES["runtime"].items() for n in ns], "note, lane"),
    midi_audit=values([(n, l) for l, ns in K.MIDI_LANES["audit"].items() for n in ns], "note, lane"),
    midi_adtof=values([(n, l) for l, ns in K.MIDI_LABELS.items() for n in ns], "note, label"),
    alias_runtime=values(_aliases("runtime"), "alias, lane"),
    alias_audit=values(_aliases("audit"), "alias, lane"),
    game_lanes=values([(l, *v) for l, v in K.GAME_LANES.items()], "lane, game_lane, colour, game_key"),
    hits="""SELECT user_id AS track_id, event_id, (epoch_us(ts) - 1704067200000000)/1e6/36000.0::DOUBLE AS onset_seconds,
 35 + CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 30 AS midi, least(value/50, 1.0::DOUBLE) AS velocity,
 event_type AS label, CASE WHEN event_id % 10 <> 0 THEN least(value/50, 1.0::DOUBLE) END AS confidence FROM events""",
    hits_b="""SELECT track_id, event_id, onset_seconds + (event_id % 5)/100.0::DOUBLE AS onset_seconds, midi, velocity, label,
 confidence FROM hits WHERE label <> 'error'""",
    tracks="SELECT DISTINCT user_id AS track_id FROM events",
    beats="SELECT track_id, n, n*0.5::DOUBLE AS start_seconds FROM tracks, range(144) r(n)",
    uneven="SELECT track_id, n, n*0.5::DOUBLE + ((n*7+track_id) % 11)/1000.0::DOUBLE AS start_seconds FROM tracks, range(144) r(n)",
    downbeats="SELECT track_id, start_seconds FROM beats WHERE n % 4 = 0 OR (track_id % 2 = 1 AND n % 7 = 3)",
    subdivisions="""SELECT track_id, start_seconds + k AS start_seconds FROM beats,
 (VALUES (0.0::DOUBLE), (0.13::DOUBLE), (0.26::DOUBLE), (0.39::DOUBLE)) v(k) WHERE (track_id + n) % 3 = 0""",
    summary="""SELECT track_id, CASE WHEN track_id % 5 <> 0 THEN 90.0::DOUBLE + track_id % 60 END AS tempo_bpm,
 CASE WHEN track_id % 3 <> 0 THEN (track_id % 7)/10.0::DOUBLE END AS downbeat_offset,
 CASE WHEN track_id % 11 <> 0 THEN 20.0::DOUBLE + track_id % 13 END AS duration_seconds,
 CASE WHEN track_id % 4 <> 0 THEN (track_id % 10)/10.0::DOUBLE END AS confidence FROM tracks""",
    mapped="SELECT h.*, m.lane FROM hits h LEFT JOIN midi_runtime m ON h.midi = m.note",
    mapped_b="SELECT h.*, m.lane FROM hits_b h LEFT JOIN midi_runtime m ON h.midi = m.note",
    grid0="""SELECT track_id, b.i AS beat_index, s.i AS sub_in_beat, b.i*4 + s.i AS subdivision_index,
 b.i*0.5::DOUBLE + s.i*0.125::DOUBLE AS start_seconds FROM tracks, range(144) b(i), range(4) s(i)""",
    q_asof="""SELECT h.*, g.beat_index AS gb, g.sub_in_beat AS gs, g.start_seconds AS ga FROM mapped h ASOF JOIN grid0 g
 ON h.track_id = g.track_id AND h.onset_seconds >= g.start_seconds WHERE h.lane IS NOT NULL""",
    quant="""SELECT track_id, event_id, onset_seconds, gb AS beat,
 CASE WHEN gs < 3 AND abs(ga + 0.125::DOUBLE - onset_seconds) < abs(ga - onset_seconds) THEN gb*4 + gs + 1 ELSE gb*4 + gs END AS sub,
 lane, velocity, label, confidence FROM q_asof""",
    collapsed="""SELECT track_id, event_id, onset_seconds, beat, sub, lane, velocity, label, confidence FROM (SELECT *, row_number() OVER (
 PARTITION BY track_id, sub, beat, lane ORDER BY coalesce(confidence,-1) DESC, coalesce(velocity,-1) DESC, onset_seconds DESC,
 event_id::VARCHAR DESC) AS rn FROM quant) WHERE rn = 1""",
    q_asof_b="""SELECT h.*, g.beat_index AS gb, g.sub_in_beat AS gs, g.start_seconds AS ga FROM mapped_b h ASOF JOIN grid0 g
 ON h.track_id = g.track_id AND h.onset_seconds >= g.start_seconds WHERE h.lane IS NOT NULL""",
    quant_b="""SELECT track_id, event_id, onset_seconds, gb AS beat,
 CASE WHEN gs < 3 AND abs(ga + 0.125::DOUBLE - onset_seconds) < abs(ga - onset_seconds) THEN gb*4 + gs + 1 ELSE gb*4 + gs END AS sub,
 lane, velocity, label, confidence FROM q_asof_b""",
    collapsed_b="""SELECT track_id, event_id, onset_seconds, beat, sub, lane, velocity, label, confidence FROM (SELECT *, row_number() OVER (
 PARTITION BY track_id, sub, beat, lane ORDER BY coalesce(confidence,-1) DESC, coalesce(velocity,-1) DESC, onset_seconds DESC,
 event_id::VARCHAR DESC) AS rn FROM quant_b) WHERE rn = 1""",
    notes_a="""SELECT track_id AS chart_id, lane, beat*480 + (sub % 4)*120 AS tick, beat AS beat_index, sub AS subdivision_index,
 onset_seconds AS start_seconds, velocity, event_id::VARCHAR AS source_event_id FROM collapsed""",
    notes_b="""SELECT track_id AS chart_id, lane, beat*480 + (sub % 4)*120 AS tick, beat AS beat_index, sub AS subdivision_index,
 onset_seconds AS start_seconds, velocity, event_id::VARCHAR AS source_event_id FROM collapsed_b""",
    measures="SELECT track_id AS chart_id, i AS bar_index, i*4 AS start_beat_index, 4 AS beat_count FROM tracks, range(36) r(i)",
)
