"""Packing of documents into training windows with a controlled mixture of sources.

Every source is a queue of token slices (``quantum`` tokens each). Deficit round-robin serves the queues so
that each has received, after any window, its share of the tokens to within one quantum; what a window could
not give is carried to the next. Run as a loop this is one long sequence. Here the same schedule is written
in closed form: slice j of a queue with weight w is due at virtual time (j + 1/2) / w, and its place in the
schedule is the number of slices of all queues that are due before it. That number needs the queues' sizes
and nothing else, so every task places its own slices, and deficits carry over windows and partitions alike.
That takes time with the number of queues for every slice; beyond ``QUEUES`` sources the same due times are
sorted instead, and slices meet their places in a join.

Steps: encode and stage the ids with each document's place among its partition's tokens of the same source;
sum tokens by partition and source (a small table) to get each document's place in its queue; place slices.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatloom.llm.staging import stage
from beatloom.llm.tokens import MEMO, encoder, slices

QUEUES = 256  # up to so many sources tasks count the slices due before; beyond, slices are sorted
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_documents(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, doc_id: str, text: str, source: str, memo: int) -> DataFrame:
    """Staged rows (part, source, local, doc_id, n, ids): ``local`` counts the part's earlier tokens of the
    same source. The source is prefixed by "s", so that a null source is a key as well."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen, part_id = encoder(tokenizer, spaced, memo), defaultdict(int), TaskContext.get().partitionId()
        end = np.array([end_id], codes.dtype).tobytes()
        for batch in batches:
            for part, texts in slices(batch, 1):
                ids = [i + end for i in codes.encode(texts)]
                sizes, local = [len(i) // codes.dtype.itemsize for i in ids], []
                sources = part.column(2).to_pylist()
                for key, n in zip(sources, sizes, strict=True):
                    local.append(seen[key])
                    seen[key] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part_id] * len(ids), pa.int32()), pa.array(sources), pa.array(local, pa.int64()), part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "source", "local", "doc_id", "n", "ids"],
                )

    key = F.concat(F.lit("s"), F.col(source).cast("string"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(key, F.lit("")).alias("source"))
    return stage(rows.mapInArrow(encode, "part int, source string, local long, doc_id long, n long, ids binary"), "packing-ids")


class Schedule:
    """Places of tokens: queue sizes in tokens and weights in, positions out."""

    def __init__(self, tokens: list[int], weights: list[float] | None, window: int, quantum: int) -> None:
        self.window, self.quantum = window, quantum
        self.sizes = np.array([t // quantum for t in tokens], np.int64)
        self.weights = np.array(weights if weights else np.maximum(self.sizes, 1), np.float64)
        self.total = int(sum(tokens))
        tails = np.array([t % quantum for t in tokens], np.int64)
        self.tail_at = int(self.sizes.sum()) * quantum + np.cumsum(tails) - tails
        rest = self.total % window
        chunks = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.full = self.total - rest
        # Sequence bounds of the rest: powers of two need no padding.
        self.bounds = self.full + np.cumsum([0, *chunks])

    def due(self, queue: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        return (j + 0.5) / self.weights[queue]

    def rank(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many slices are due before slice j of a queue; of equals, the earlier queue comes first."""
        when, rank = self.due(queue, j), np.zeros(len(j), np.int64)
        for other in np.flatnonzero(self.sizes):
            m = np.ceil(when * self.weights[other] - 0.5).astype(np.int64)
            m -= self.due(other, m - 1) >= when  # rounding may be off by one either way
            m += self.due(other, m) < when
            m += (self.due(other, m) == when) & (other < queue)
            rank += np.clip(m, 0, self.sizes[other])
        return rank

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document number, start in the document, length and position of every piece."""
        g = self.quantum
        whole = np.minimum(start + n, self.sizes[queue] * g)
        first, last = start // g, np.maximum(-(-whole // g), start // g)
        count = last - first
        doc = np.repeat(np.arange(len(n)), count)
        j = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
        lo = np.maximum(j * g, start[doc])
        hi = np.minimum((j + 1) * g, whole[doc])
        position = self.rank(queue[doc], j) * g + lo - j * g
        late = np.flatnonzero(start + n > self.sizes[queue] * g)
        lo_t = np.maximum(start[late], self.sizes[queue[late]] * g)
        hi_t = start[late] + n[late]
        position_t = self.tail_at[queue[late]] + lo_t - self.sizes[queue[late]] * g
        doc, lo, hi, position = (np.concatenate(x) for x in ((doc, late), (lo, lo_t), (hi, hi_t), (position, position_t)))
        return self._split(doc, lo - start[doc], hi - lo, position)

    def _split(self, doc: np.ndarray, lo: np.ndarray, length: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut the few pieces that cross the end of a sequence."""
        crossing = (position // self.window != (position + length - 1) // self.window) | (position + length > self.full)
        rows = []
        for d, a, n, p in zip(doc[crossing].tolist(), lo[crossing].tolist(), length[crossing].tolist(), position[crossing].tolist(), strict=True):
            while n:
                end = (p // self.window + 1) * self.window if p < self.full else int(self.bounds[np.searchsorted(self.bounds, p, "right")])
                take = min(n, end - p)
                rows.append((d, a, take, p))
                a, n, p = a + take, n - take, p + take
        cut = np.array(rows, np.int64).reshape(-1, 4).T
        return tuple(np.concatenate([x[~crossing], y]) for x, y in zip((doc, lo, length, position), cut, strict=True))

    def sequence(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of positions."""
        late = position >= self.full
        k = np.maximum(np.searchsorted(self.bounds, position, "right") - 1, 0)
        return np.where(late, self.full // self.window + k, position // self.window), np.where(late, position - self.bounds[k], position % self.window)


def portions(batches: Iterator[pa.RecordBatch], sizes: int) -> Iterator[pa.RecordBatch]:
    """The batches, about four million tokens at a time; ``sizes`` is the number of the column of token counts."""
    for batch in batches:
        n, at = batch.column(sizes).to_numpy(), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), 1 << 22, "right")) + at)
            yield batch.slice(at, end - at)
            at = end


def sorted_slices(bases: DataFrame, totals: DataFrame, weights: dict[str, float], quantum: int) -> DataFrame:
    """Rows (source, j, place): the position of the first token of every slice, the same as by ``Schedule``.

    Slices are sorted by due time over all tasks, those of equal time by queue (larger first, then by name);
    what a queue has left below one quantum comes last, in the order of queues. A slice is made where its
    first token lies, so the work is spread as the tokens are.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array([task] * len(n), pa.int32()), pa.array(at + np.cumsum(n) - n)], names=["source", "j", "n", "task", "local"])
            at += int(n.sum())

    queues = totals.withColumn("size", F.expr(f"total div {quantum}"))
    if weights:
        given = totals.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        queues = queues.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        queues = queues.withColumn("weight", F.greatest("size", F.lit(1)).cast("double"))
    first, last = F.expr(f"(base + {quantum - 1}) div {quantum}"), F.expr(f"(base + n - 1) div {quantum}")
    slices_of = bases.where(first <= last).select("source", F.explode(F.sequence(first, last)).alias("j")).join(queues, "source")
    late = F.col("j") >= F.col("size")
    due = [late, F.when(late, 0.0).otherwise((F.col("j") + 0.5) / F.col("weight")), F.desc("total"), "source"]
    ordered = slices_of.repartitionByRange(*due).sortWithinPartitions(*due)
    length = F.when(late, F.col("total") - F.col("size") * quantum).otherwise(quantum).cast("long")
    numbered = stage(ordered.select("source", "j", length.alias("n")).mapInArrow(number, "source string, j long, n long, task int, local long"), "packing-slices")
    starts, at = [], 0
    for task, n in sorted(map(tuple, numbered.groupBy("task").agg(F.sum("n")).collect())):
        starts.append((task, at))
        at += n
    return numbered.join(F.broadcast(totals.sparkSession.createDataFrame(starts, "task int, before long")), "task").select("source", "j", (F.col("before") + F.col("local")).alias("place"))


def pack(
    docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, window: int = 2048, quantum: int = 128, weights: dict[str | None, float] | None = None,
    with_ids: bool = True, doc_id: str = "doc_id", text: str = "text", source: str = "source", memo: int = MEMO,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    ``with_ids``, ids (little-endian unsigned 32-bit).

    ``weights`` are target token proportions by source; by default those of the corpus itself, so that all
    queues end together. If some are given, a source without one has weight 1. Every source, however many, is a
    queue of its own. A queue that is used up leaves its share to the others. All sequences are full but
    for the last few, whose lengths are powers of two. Null texts are empty (one end id), null sources are one
    queue, rows with equal ids are separate documents, an empty table gives no rows. ``memo`` bounds the bytes
    of token ids that a worker keeps.
    """
    if window % quantum:
        raise ValueError("the quantum must divide the window")
    ids = encode_documents(docs, tokenizer, spaced, end_id, doc_id, text, source, memo)
    sums = stage(ids.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-sums")
    totals = sums.groupBy("source").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part and source
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    width = encoder(tokenizer, spaced).dtype
    queues = totals.orderBy(F.desc("total"), "source").limit(QUEUES + 1).collect()
    rows = ids.join(bases.select("part", "source", "base"), ["part", "source"]).withColumn("at", F.col("base") + F.col("local"))
    given = {f"s{k}" if k is not None else "": float(w) for k, w in (weights or {}).items()}

    def emit(held: pa.Array, keys: pa.Array, tokens: np.ndarray, sizes: np.ndarray, first: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        """Pieces (row, place in the document, length, position) of rows that hold ``sizes`` ids from place ``first`` on."""
        doc, lo, length, position = found
        order = np.argsort(doc, kind="stable")
        doc, lo, length, position = (x[order] for x in (doc, lo, length, position))
        sequence, offset = plan.sequence(position)
        crcs, parts = np.empty(len(doc), np.int64), []
        flat = np.frombuffer(b"".join(held.to_pylist()), width).astype("<u4").tobytes()
        view, begin = memoryview(flat), (np.cumsum(sizes) - sizes - first)[doc] + lo
        for i, (a, b) in enumerate(zip((begin * 4).tolist(), ((begin + length) * 4).tolist(), strict=True)):
            crcs[i] = zlib.crc32(view[a:b])
            if with_ids:
                parts.append(view[a:b])
        columns = [keys.take(pa.array(doc)), *(pa.array(x) for x in (lo, length, crcs, tokens[doc], sequence, offset))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            queue, starts, sizes = (batch.column(i).to_numpy() for i in range(3))
            yield emit(batch.column(4), batch.column(3), sizes, sizes, np.zeros(len(sizes), np.int64), plan.pieces(queue.astype(np.int64), starts, sizes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            starts, sizes = (batch.column(i).to_numpy() for i in (1, 2))
            first = starts // quantum
            count = (starts + sizes - 1) // quantum - first + 1
            doc = np.repeat(np.arange(len(sizes)), count)
            j = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
            lo, hi = np.maximum(j * quantum, starts[doc]), np.minimum((j + 1) * quantum, (starts + sizes)[doc])
            bounds = np.cumsum([0, *(hi - lo)]) * width.itemsize
            pieces = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(b"".join(batch.column(4).to_pylist()))])
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(j), batch.column(3).take(at), pa.array(lo - starts[doc]), pa.array(lo - j * quantum), pa.array(hi - lo), pa.array(sizes[doc]), pieces],
                names=["source", "j", "doc_id", "start", "inside", "n", "doc_tokens", "ids"],
            )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            position, first, sizes, tokens = (batch.column(i).to_numpy() for i in range(4))
            yield emit(batch.column(5), batch.column(4), tokens, sizes, first, plan._split(np.arange(len(sizes)), first, sizes, position))

    out = PIECES + (", ids binary" if with_ids else "")
    if len(queues) > QUEUES:
        plan = Schedule([totals.agg(F.sum("total")).first()[0]], None, window, quantum)
        pieces = rows.select("source", "at", "n", "doc_id", "ids").mapInArrow(cut, "source string, j long, doc_id long, start long, inside long, n long, doc_tokens long, ids binary")
        pieces = pieces.join(sorted_slices(bases, totals, given, quantum), ["source", "j"])
        return pieces.select((F.col("place") + F.col("inside")).alias("position"), "start", "n", "doc_tokens", "doc_id", "ids").mapInArrow(finish, out)
    plan = Schedule([r["total"] for r in queues], [given.get(r["source"], 1.0) for r in queues] if given else None, window, quantum)
    queue = F.element_at(F.create_map(*[F.lit(x) for q, r in enumerate(queues) for x in (r["source"], q)]), F.col("source")) if queues else F.lit(0)
    return rows.select(queue.alias("queue"), "at", "n", "doc_id", "ids").mapInArrow(place, out)


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents; the sources' shares of the corpus are the target of every window."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=1, with_ids=False)
