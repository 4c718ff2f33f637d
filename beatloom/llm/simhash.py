"""Near-duplicate documents by SimHash fingerprints.

A fingerprint is split into halves, and each half into sixteen segments of two bits; the segments' bit
counts embed the half as a point of a grid. The Manhattan distance of two points never exceeds the number of
bits in which the halves differ, so fingerprints that differ in three bits at most have a half whose points
are at distance one at most: they share a grid cell, or one lies in the next cell along one axis. A range
join over cells finds them, and the differing bits are counted exactly.

Equal fingerprints are one class from the start. Within a cell only a spanning forest of the links is kept,
never all pairs; a cell with many classes is cut into blocks, and pairs of blocks are compared by separate
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm.components import connected_components
from beatloom.llm.staging import stage, unused

SEED = 42
MOST_BITS = 3
BLOCK = 1024  # classes of a crowded cell that are compared with another block by one task


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: majority of the bits of all shingles' hashes; zero without words."""
    tokens = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not tokens:
        return 0
    columns = [tokens[i:] for i in range(words)] if len(tokens) >= words else [[b" ".join(tokens)]]
    n = len(columns[-1])
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = zip(*(c[at : min(at + (1 << 15), n)] for c in columns), strict=True)
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in map(b" ".join, part)])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, bits): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, bits long")


def _counts(half: Column) -> Column:
    """Bit counts of the sixteen two-bit segments, packed in two bits each."""
    low = F.lit(0x55555555)
    return half.bitwiseAND(low) + F.shiftrightunsigned(half, 1).bitwiseAND(low)


def cells(classes: DataFrame) -> DataFrame:
    """Rows (cell, bits): each class in its own cell and the next one along every axis, for both halves."""
    halves = [F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("bits", 32)]
    axes = F.array(*[F.lit(1 << (2 * i)).cast("long") for i in range(16)])

    def around(number: int, half: Column) -> Column:
        own = _counts(half)
        room = F.filter(axes, lambda axis: own.bitwiseAND(axis * 2) == 0)  # a count of two is the most
        near = F.concat(F.array(own), F.transform(room, lambda axis: own + axis))
        return F.transform(near, lambda cell: cell + F.lit(number << 33))

    return classes.select(F.explode(F.concat(*[around(i, h) for i, h in enumerate(halves)])).alias("cell"), "bits")


def _forest(bits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among a run of fingerprints, one per newly reached member."""
    out, left = [], np.ones(len(bits), bool)
    for seed in range(len(bits)):
        if not left[seed]:
            continue
        left[seed] = False
        todo = [seed]
        while todo:
            i = todo.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(bits[rest] ^ bits[i]) <= MOST_BITS]
            left[near] = False
            todo += near.tolist()
            if len(near):
                out.append((np.full(len(near), bits[i]), bits[near]))
    return out


def _links_of_runs(run: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    """Verified links within runs of rows with equal keys."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    starts = np.flatnonzero(np.diff(run, prepend=run[:1] - 1)) if len(run) else np.zeros(0, int)
    sizes = np.diff(starts, append=len(run))
    for start, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        found += _forest(bits[start : start + size])
    small = np.repeat((sizes > 1) & (sizes <= 32), sizes)
    run, bits = run[small], bits[small]
    at, offset = np.arange(len(run)), 0
    while len(at):
        offset += 1
        at = at[at + offset < len(run)]
        at = at[run[at + offset] == run[at]]
        near = at[np.bitwise_count(bits[at] ^ bits[at + offset]) <= MOST_BITS]
        found.append((bits[near], bits[near + offset]))
    a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])


def _links_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (cell, part, bits) sorted by cell and part; the last run waits for the next batch."""
    rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in batches:
        new = [batch.column(i).to_numpy() for i in range(3)]
        cell, part, bits = (np.concatenate([r, n.view(r.dtype)]) for r, n in zip(rest, new, strict=True))
        if not len(cell):
            continue
        run = np.cumsum(np.diff(cell, prepend=cell[0]).astype(bool) | np.diff(part, prepend=part[0]).astype(bool))
        last = int(np.searchsorted(run, run[-1]))
        yield _links_of_runs(run[:last], bits[:last])
        rest = [cell[last:], part[last:], bits[last:]]
    yield _links_of_runs(np.zeros(len(rest[0]), np.int64), rest[2])


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly what is linked."""
    rows = cells(classes)
    crowded = stage(rows.groupBy("cell").count().filter(F.col("count") > BLOCK), "simhash-crowded")
    blocks = F.ceil(F.col("count") / BLOCK)
    own = F.pmod(F.xxhash64("bits"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.least(own, other) * blocks + F.greatest(own, other))
    parts = F.when(F.col("count").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    dealt = rows.join(crowded, "cell", "left").select("cell", F.explode(parts).alias("part"), "bits")
    dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(_links_of_partition, "a long, b long")


def group_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable).

    Null texts are empty and have fingerprint zero, like all texts without words. Null doc_ids take part in
    links but are never a component's id unless it has no other. Repeated rows are kept. An empty table
    gives no rows.
    """
    marks = stage(fingerprints(docs, doc_id, text), "simhash-marks")
    classes = stage(marks.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    groups = connected_components(links(classes), "a", "b").select(F.col("node").alias("bits"), "component")
    named = classes.join(groups, "bits").groupBy("component").agg(F.min("first_id").alias("least_id"))
    moved = groups.join(named, "component").select("bits", "least_id")
    of_class = stage(classes.join(moved, "bits", "left").select("bits", F.coalesce("least_id", "first_id").alias("component_id")), "simhash-components")
    mark = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return marks.join(of_class, "bits").select("doc_id", mark.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same columns, one document of each group: that with the smallest doc_id. A doc_id stands for
    one document, so rows that repeat it stay or go together; rows without doc_id stay."""
    name = unused(docs, "lost_id")
    lost = group_documents(docs, doc_id, text).filter("doc_id != component_id").select(F.col("doc_id").alias(name))
    return docs.join(stage(lost, "simhash-lost"), F.col(doc_id).cast("long") == F.col(name), "left_anti")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return group_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
