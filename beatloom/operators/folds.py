"""Sequential rules over long tracks, split where little is open.

A rule that walks a track in order ties all of its rows together. Here each chunk of a track offers the
cut at which fewest states are possible (none but one, at a gap). Segments between cuts run in parallel,
each from every state that its first cut allows, until the runs agree; what differs before that is
marked with the state. One fold over the segments' tables, a row for each state, tells which state each began in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from beatloom.functions import arrays as A
from beatloom.operators import ordered as O

#: Candidate states at a cut are all sets of open rows, so few rows may be open.
MOST_OPEN = 6


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Groups of a stream sorted by ``keys``: key values and the other columns as arrays."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None

    def done() -> tuple[tuple, dict[str, np.ndarray]]:
        t = pa.Table.from_batches(held)
        return key, {n: t.column(n).to_numpy() for n in t.column_names if n not in keys}

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            if at == end:
                continue
            now = tuple(c[at] for c in columns)
            if now != key and held:
                yield done()
                held = []
            key = now
            held.append(batch.slice(at, end - at))
    if held:
        yield done()


def streamed(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """``step`` over a frame already partitioned by ``keys``: sorted in the task, group after group."""
    return df.sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: step(grouped(batches, keys)), schema)


def with_segments(base: DataFrame, cuts: DataFrame, cut: list[str]) -> DataFrame:
    """Rows with ``own``, ``prior`` and the columns of their chunk's cut.

    ``own`` is the segment that begins at the chunk's cut (null without one), ``prior`` the one before it.
    """
    w = Window.partitionBy("track_id").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col(cut[0]).isNotNull(), F.col("__c"))
    prior = F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit(-(1 << 62)))
    cuts = cuts.select("track_id", "__c", own.alias("own"), prior.alias("prior"), *cut)
    # never a broadcast: there are as many cuts as chunks, whatever Spark makes of their size
    return base.join(cuts.hint("merge"), ["track_id", "__c"])


def entered(tables: DataFrame, state: str, start: str, step: Callable[[str, str], str], alt: Callable[[str, str], str]) -> DataFrame:
    """Rows (track_id, seg, entry, real): the state in which each segment of a track really begins.

    ``tables`` holds track_id, seg and ``t``, the segment's table; ``step(state, t)`` is the state after it
    and ``alt(state, t)`` the number under which the segment knows the state, both as SQL text.
    """
    walk = lambda s, x: (step(s, f"{x}.t"), f"named_struct('seg', {x}.seg, 'entry', {s}, 'real', {alt(s, f'{x}.t')})")
    # a track has each segment once
    out = A.scan("array_sort(collect_list(struct(seg, t)), (a, b) -> if(a.seg < b.seg, -1, 1))", start, walk, state, f"struct<seg:bigint,entry:{state},real:bigint>")
    return tables.groupBy("track_id").agg(F.expr(f"{out}.out").alias("o")).selectExpr("track_id", "inline(o)")


# --- the last kept row, replaced by a stronger one close to it (W13, W16) ---------------------


def _last_kept_cut(kind: pa.DataType, groups: Iterator) -> Iterator[pa.RecordBatch]:
    """For each chunk the row before which fewest rows could still be the last kept one."""
    out: list[tuple] = []
    for (track, chunk), g in groups:
        t, gap, lane = g["t"], g["gap"], g["lane"]
        i = np.arange(1, len(t))
        change = np.concatenate([[True], lane[1:] != lane[:-1]])
        run = np.maximum.accumulate(np.where(change, np.arange(len(t)), 0))
        low = np.searchsorted(t, t - gap, "right")[1:]
        # rounding: the rule asks whether the difference is below the gap
        low = np.where((low > 0) & (t[i] - t[np.maximum(low - 1, 0)] < gap[i]), low - 1, low)
        low = np.where((low < i) & (t[i] - t[np.minimum(low, len(t) - 1)] >= gap[i]), low + 1, low)
        free = change[1:]
        count = np.where(free, 0, i - np.maximum(low, run[1:]))
        known = free | (run[1:] > 0) | (low > 0)
        row = (None, None)
        if known.any():
            best = int(np.flatnonzero(known)[np.argmin(count[known])])
            if count[best] <= MOST_OPEN:
                row = (int(g["n"][best + 1]), int(count[best]))
        out.append((track, chunk, *row))
    names = ["track_id", "__c", "cut", "open"]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k else kind) for k in range(4)], names=names)


def _last_kept_fold(kind: pa.DataType) -> Callable:
    def fold(groups: Iterator) -> Iterator[pa.RecordBatch]:
        names = ["track_id", "seg", "alt", "n", "run", "last", "v"]
        types = [kind, *[pa.int64()] * 5, pa.float64()]
        out: list[list] = [[] for _ in names]

        def put(*row) -> None:
            for column, v in zip(out, row, strict=True):
                column.append(v)

        for (track, seg), g in groups:
            entry = g["entry"].astype(bool)
            t, v, gap, lane, n = (g[k].tolist() for k in ("t", "v", "gap", "lane", "n"))
            opened = np.flatnonzero(entry).tolist()
            a = len(opened)
            last, start = [-1] * len(t), [-1] * len(t)

            def walk(at: int, now: int, begun: int, until: Callable[[int, int, int], bool]) -> int:
                """Fill ``last`` and ``start`` from a row on; stops where ``until`` finds agreement."""
                for i in range(at, len(t)):
                    if now < 0 or lane[i] != lane[now] or t[i] - t[now] >= gap[i]:
                        now, begun = i, i
                    elif v[i] > v[now]:
                        now = i
                    if until(i, now, begun):
                        return i
                    last[i], start[i] = now, begun
                return len(t)

            # entry -1: nothing before matters; entry k: the k-th open row is the last one kept
            walk(a, -1, -1, lambda i, now, begun: False)
            base_last, base_start = last[:], start[:]
            ways = [(-1, a, base_last, base_start)]
            for k in opened:
                end = walk(a, k, -2, lambda i, now, begun: now == base_last[i] and begun == base_start[i])
                ways.append((k, end, last[:end], start[:end]))
            shared = max(w[1] for w in ways)
            for k, end, l, s in ways:
                alt = None if a == 0 else (-1 if k < 0 else n[k])
                for i in range(a, shared):
                    b = s[i] if i < end else base_start[i]
                    put(track, seg, alt, n[i], None if b == -2 else n[b], None, v[i])
                exit_last, exit_start = (l[-1], s[-1]) if end == len(t) and len(t) > a and k >= 0 else (base_last[-1], base_start[-1])
                put(track, seg, -1 if k < 0 else n[k], None, None if exit_start == -2 else n[exit_start], n[exit_last], None)
            for i in range(shared, len(t)):
                put(track, seg, None, n[i], n[base_start[i]], None, v[i])
            if len(out[0]) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names=names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names=names)

    return fold


def last_kept_runs(rows: DataFrame) -> DataFrame:
    """Rows (track_id, n, v, run): which run each row belongs to, named by the ``n`` of its first row.

    ``rows``: track_id, n (a number unique in the track that grows with the order), t, v, gap, lane
    (a number), __c (a chunk that grows with n). A row joins the run of the row before it if it has its
    lane and is closer than its own gap to the run's last kept row, which a stronger row replaces.
    """
    key, kind = rows.schema["track_id"].dataType.simpleString(), to_arrow_type(rows.schema["track_id"].dataType)
    base = O._placed(rows.select("track_id", "__c", "n", "t", "v", "gap", "lane"), ["track_id"], "__c")
    cuts = streamed(base, ["track_id", "__c"], ["n"], partial(_last_kept_cut, kind), f"track_id {key}, __c long, cut long, open long")
    d = with_segments(base, cuts, ["cut", "open"])
    n = F.col("n")
    after = F.col("own").isNotNull() & (n >= F.col("cut"))
    seg = F.when(after, F.col("own")).otherwise(F.col("prior"))
    own = lambda s, e: F.struct(s.alias("seg"), F.lit(e).alias("entry"))
    # the open rows before a cut go to both sides
    place = F.col("own").isNotNull() & (n < F.col("cut")) & (F.col("ahead") <= F.col("open"))
    w = Window.partitionBy("track_id", "__c").orderBy(F.col("n").desc())
    d = d.withColumn("ahead", F.sum(F.when(F.col("own").isNotNull() & (n < F.col("cut")), 1).otherwise(0)).over(w))
    d = d.select("track_id", "n", "t", "v", "gap", "lane", F.inline(F.array_compact(F.array(own(seg, False), F.when(place, own(F.col("own"), True))))))
    d = d.repartition("track_id", "seg")
    folded = streamed(d, ["track_id", "seg"], ["n"], _last_kept_fold(kind), f"track_id {key}, seg long, alt long, n long, run long, last long, v double")
    table = folded.where(F.col("n").isNull()).groupBy("track_id", "seg").agg(F.collect_list(F.struct("alt", "run", "last")).alias("t"))

    # a state that is not open at the cut can no longer matter: it counts as none
    alt = lambda s, t: f"if(exists({t}, e -> e.alt = {s}.last), {s}.last, -1)"
    way = lambda s, t: A.let(alt(s, t), lambda k: f"get({A.only(t, lambda x: f'{x}.alt = {k}')}, 0)")
    step = lambda s, t: A.let(way(s, t), lambda x: f"named_struct('last', {x}.last, 'run', coalesce({x}.run, {s}.run))")
    known = entered(table, "struct<last:bigint,run:bigint>", "named_struct('last', -1, 'run', null)", step, alt)
    out = folded.where(F.col("n").isNotNull()).join(known.hint("merge"), ["track_id", "seg"])
    out = out.where(F.col("alt").isNull() | (F.col("alt") == F.col("real")))
    return out.select("track_id", "n", "v", F.coalesce("run", "entry.run").alias("run"))


# --- one-to-one matching of onsets (J8) --------------------------------------------------------


def _match_cut(kind: pa.DataType, tolerance: float, chunk: float, margin: float) -> Callable:
    def cut(groups: Iterator) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (track, c), g in groups:
            p, f = g["t"][g["side"] == 0], g["t"][g["side"] == 1]
            begin = c * chunk
            before = np.concatenate([[begin], p[:-1]]) if len(p) else p
            able = (p > before) & (p >= begin + margin) & (p <= begin + chunk - margin)
            row = (None, None)
            if able.any():
                p, before = p[able], before[able]
                # a hair wider than the rule, so that rounding opens a row too many rather than one too few
                wide = tolerance * (1 + 1e-9) + 1e-12
                count = np.maximum(np.searchsorted(f, before + wide, "right") - np.searchsorted(f, p - wide, "left"), 0)
                best = int(np.argmin(count))
                if count[best] <= MOST_OPEN:
                    row = (float(before[best]), float(p[best]))
            out.append((track, c, *row))
        kinds = [kind, pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], names=["track_id", "__c", "low", "high"])

    return cut


class _Matcher:
    """Nearest free fallback for each primary, in order, by pointers to the next free one on either side."""

    def __init__(self, p: np.ndarray, f: np.ndarray, tolerance: float) -> None:
        self.p, self.f, self.tolerance = p.tolist(), f.tolist(), tolerance
        self.at = np.searchsorted(f, p, "left").tolist()
        wide = tolerance * (1 + 1e-9) + 1e-12
        self.low = np.searchsorted(f, p - wide, "left").tolist()
        self.high = np.searchsorted(f, p + wide, "right").tolist()
        same = np.concatenate([[True], f[1:] != f[:-1]]) if len(f) else np.zeros(0, bool)
        self.first = np.maximum.accumulate(np.where(same, np.arange(len(f)), 0)).tolist() if len(f) else []

    def run(self) -> tuple[list[int], list[int]]:
        """Matches of all primaries with nothing taken before; and which primary takes each fallback."""
        n = len(self.f)
        right, left = list(range(n + 1)), list(range(n + 1))  # left is shifted by one
        taken = [len(self.p)] * n

        def find(link: list[int], i: int) -> int:
            root = i
            while link[root] != root:
                root = link[root]
            while link[i] != root:
                link[i], i = root, link[i]
            return root

        match = []
        for i, (t, at) in enumerate(zip(self.p, self.at, strict=True)):
            r, l = find(right, at), find(left, at) - 1
            best, least = -1, self.tolerance
            if l >= 0 and abs(self.f[l] - t) <= least:
                best, least = find(right, self.first[l]), abs(self.f[l] - t)
            if r < n and abs(self.f[r] - t) <= self.tolerance and (best < 0 or abs(self.f[r] - t) < least):
                best = r
            match.append(best)
            if best >= 0:
                taken[best], right[best], left[best + 1] = i, best + 1, best
        return match, taken

    def differs(self, used: set[int], taken: list[int]) -> tuple[list[int], set[int]]:
        """Matches when ``used`` is taken before, up to where they agree with the plain run, and every
        fallback whose fate differed on the way."""
        delta, ever, match = set(used), set(used), []
        for i, t in enumerate(self.p):
            delta = {j for j in delta if j >= self.low[i]}
            if not delta:
                break
            best, least = -1, float("inf")
            for j in range(self.low[i], self.high[i]):
                d = abs(self.f[j] - t)
                if d <= self.tolerance and d < least and (taken[j] < i) == (j in delta):
                    best, least = j, d
            plain = self.plain[i]
            match.append(best)
            if best != plain:
                delta ^= {j for j in (best, plain) if j >= 0}
                ever |= delta
        return match, ever


def _match_fold(tolerance: float, kind: pa.DataType) -> Callable:
    names = ["track_id", "seg", "alt", "kind", "primary_pos", "fallback_pos", "primary_onset", "fallback_onset"]
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def fold(groups: Iterator) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]

        def put(*row) -> None:
            for column, v in zip(out, row, strict=True):
                column.append(v)

        for (track, seg), g in groups:
            first, second = g["side"] == 0, g["side"] == 1
            p, f = g["t"][first], g["t"][second]
            pp, fp = g["pos"][first].tolist(), g["pos"][second].tolist()
            entry, leaving = np.flatnonzero(g["entry"][second]).tolist(), np.flatnonzero(g["leaving"][second]).tolist()
            m = _Matcher(p, f, tolerance)
            match, taken = m.run()
            m.plain = match
            ways, shared, touched = [], 0, set()
            for alt in range(1 << len(entry)):
                used = {j for b, j in enumerate(entry) if alt >> b & 1}
                own, ever = m.differs(used, taken) if used else ([], set())
                ways.append((alt, used, own))
                shared, touched = max(shared, len(own)), touched | ever
            stay = set(leaving)

            def pair(alt, i, j):
                if j < 0:
                    put(track, seg, alt, "primary_only", pp[i], None, m.p[i], None)
                else:
                    put(track, seg, alt, "matched", pp[i], fp[j], m.p[i], m.f[j])

            for alt, used, own in ways:
                mine = [*own, *match[len(own) :]]
                took = {j for j in mine[:shared] if j >= 0}
                gone = used | took | {j for j in touched | stay if shared <= taken[j] < len(m.p)}
                label = None if len(ways) == 1 else alt
                for i in range(shared):
                    pair(label, i, mine[i])
                for j in sorted(touched - gone - stay):
                    put(track, seg, label, "fallback_only", None, fp[j], None, m.f[j])
                put(track, seg, alt, "state", sum(1 << b for b, j in enumerate(leaving) if j in gone), None, None, None)
            for i in range(shared, len(m.p)):
                pair(None, i, match[i])
            for j in range(len(m.f)):
                if taken[j] == len(m.p) and j not in touched and j not in stay:
                    put(track, seg, None, "fallback_only", None, fp[j], None, m.f[j])
            if len(out[0]) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names=names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names=names)

    return fold


def match_sides(both: DataFrame, tolerance: float) -> DataFrame:
    """Rows (track_id, kind, primary_pos, fallback_pos, primary_onset, fallback_onset) of a matching.

    ``both``: track_id, t, side (0 primary, 1 fallback), pos in onset order. Primaries take, in order, the
    nearest fallback within the tolerance that none before them took, the earlier on a tie.
    """
    key, kind = both.schema["track_id"].dataType.simpleString(), to_arrow_type(both.schema["track_id"].dataType)
    chunk, margin = max(O.TIME_CHUNK, 64 * tolerance), max(2.0, 8 * tolerance)
    base = O._placed(both.select("track_id", O.time_chunk("t", chunk).alias("__c"), "t", "side", "pos"), ["track_id"], "__c")
    order = ["t", "side", "pos"]
    cuts = streamed(base, ["track_id", "__c"], order, _match_cut(kind, tolerance, chunk, margin), f"track_id {key}, __c long, low double, high double")
    d = with_segments(base, cuts, ["low", "high"])
    t, low, high, cut = F.col("t"), F.col("low"), F.col("high"), F.col("own").isNotNull()
    wide = tolerance * (1 + 1e-9) + 1e-12
    fallback = F.col("side") == 1
    # what the side before the cut can reach, and what still matters after it
    behind = F.when(~cut, True).when(fallback, t <= low + wide).otherwise(t < high)
    ahead = cut & F.when(fallback, t >= high - wide).otherwise(t >= high)
    # a fallback in the gap between both reaches goes to the earlier segment
    behind = behind | ~ahead
    place = lambda seg, entry, leaving: F.struct(seg.alias("seg"), entry.alias("entry"), leaving.alias("leaving"))
    no = F.lit(False)
    spots = F.array_compact(F.array(F.when(behind, place(F.col("prior"), no, behind & ahead)), F.when(ahead, place(F.col("own"), behind & ahead, no))))
    d = d.select("track_id", "t", "side", "pos", F.inline(spots)).repartition("track_id", "seg")
    schema = f"track_id {key}, seg long, alt long, kind string, primary_pos long, fallback_pos long, primary_onset double, fallback_onset double"
    folded = streamed(d, ["track_id", "seg"], order, _match_fold(tolerance, kind), schema)
    table = folded.where(F.col("kind") == "state").groupBy("track_id", "seg").agg(F.collect_list(F.struct("alt", F.col("primary_pos").alias("exit"))).alias("t"))
    step = lambda s, t: f"get({A.only(t, lambda x: f'{x}.alt = {s}')}, 0).exit"
    known = entered(table, "bigint", "0", step, lambda s, t: s)
    out = folded.where(F.col("kind") != "state").join(known.hint("merge"), ["track_id", "seg"])
    return out.where(F.col("alt").isNull() | (F.col("alt") == F.col("real"))).drop("seg", "alt", "entry", "real")
