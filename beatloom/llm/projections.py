"""Near-duplicate vectors by counting collisions on one-dimensional projections.

Each of many lines holds the projections of all vectors, in order. Two vectors collide on a line if one
lies in the window centred at the other; near vectors collide on most lines, others on few, and pairs that
collide often enough are compared exactly. A lone line's window holds a fixed share of all vectors, so each
line is drawn within the cells that the signs of further projections cut: their number grows with the
logarithm of the table, and the vectors in a window do not grow at all. The least count is two, the
number of lines follows from the chance that a pair just at the threshold collides, for a stated recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm.components import connected_components
from beatloom.llm.staging import stage

COSINE = 0.95
RECALL = 0.998  # of pairs just at the threshold; nearer ones collide more often
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def calibrate(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, float, int, int]:
    """Sign projections per line, half-width of the window, lines and least count for n vectors."""
    angle, spread = math.acos(cosine), math.sqrt(2 - 2 * cosine)
    signs, half = max(0, round(math.log2(max(n, 1))) - 3), 2 * spread
    p = (1 - angle / math.pi) ** signs * math.erf(half / spread / math.sqrt(2))
    least, lines = 2, 2
    while sum(math.comb(lines, k) * p**k * (1 - p) ** (lines - k) for k in range(least)) > 1 - recall:
        lines += 1
    return signs, half, lines, least


def usable(vector: Column) -> Column:
    """Vectors that can be compared: there, without null or non-finite components, and not zero."""
    size = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    fine = size.isNotNull() & ~F.isnan(size) & (size > 0) & (size < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def place(classes: DataFrame, signs: int, half: float, lines: int, seed: int = 5) -> DataFrame:
    """Rows (key, at, id, guest): each vector on each line, in its own slab and as a guest in the next.

    A slab is as wide as half a window, so vectors that collide share a slab or sit in neighbouring ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                if dim not in drawn:
                    drawn[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, lines * (signs + 1)))
                own = np.flatnonzero(sizes == dim)
                for at in range(0, len(own), 1024):
                    rows = own[at : at + 1024]
                    x = flat[offsets[rows, None] + np.arange(dim)]
                    y = (x / np.linalg.norm(x, axis=1, keepdims=True) @ drawn[dim]).reshape(len(rows), lines, signs + 1)
                    value = y[:, :, 0]
                    bits = ((y[:, :, 1:] > 0) << np.arange(signs)).sum(2)
                    slab = np.floor(value / half).astype(np.int64)
                    base = (np.arange(lines) * lines + dim).astype(np.uint64) * MIXERS[0] + bits.astype(np.uint64) * MIXERS[1]
                    base = (base ^ base >> np.uint64(29)) * MIXERS[2]
                    keys = [(base + (slab + k).astype(np.uint64) * MIXERS[3]).view(np.int64).ravel() for k in (0, 1)]
                    n = len(keys[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.tile(value.ravel(), 2)), pa.array(np.tile(np.repeat(ids[rows], lines), 2)), pa.array(np.repeat([False, True], n))],
                        names=["key", "at", "id", "guest"],
                    )

    return classes.select("id", "vector").mapInArrow(run, "key long, at double, id long, guest boolean")


def linked_pairs(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Pairs (a, b) of distinct vectors whose cosine, in double precision, is at least the threshold."""
    signs, half, lines, least = calibrate(classes.count(), cosine, recall)
    spots = stage(place(classes, signs, half, lines), "projection-spots")
    left = spots.filter("not guest").select("key", F.col("at").alias("at_a"), F.col("id").alias("a"))
    right = spots.select("key", F.col("at").alias("at_b"), F.col("id").alias("b"), "guest")
    meet = left.join(right, "key").filter((F.abs(F.col("at_a") - F.col("at_b")) <= half) & (F.col("a") != F.col("b")) & (F.col("guest") | (F.col("a") < F.col("b"))))
    often = meet.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).count().filter(F.col("count") >= least).select("a", "b")
    one = classes.select(F.col("id").alias("a"), F.col("vector").alias("va"), F.col("length").alias("na"))
    two = classes.select(F.col("id").alias("b"), F.col("vector").alias("vb"), F.col("length").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)
    pairs = often.join(one, "a").join(two, "b").filter(F.size("va") == F.size("vb"))
    return pairs.filter(dot / (F.col("na") * F.col("nb")) >= cosine).select("a", "b")


def group_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are one class from the start and count as links of one another. Vectors that are null,
    zero or hold null or non-finite components link with nothing, nor do vectors of different lengths. Null
    vec_ids are never a component's id unless it has no other. Repeated rows count as vectors of their own;
    an empty table gives no rows. Classes go by a 64-bit hash of the vector.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.withColumn("id", F.when(usable(F.col("vector")), F.xxhash64("vector")))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    grouped = rows.filter("id is not null").groupBy("id").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = stage(grouped.withColumn("length", length), "projection-classes")
    links = stage(linked_pairs(classes, cosine, recall), "projection-links")
    both = links.union(links.select("b", "a"))
    copies = classes.select(F.col("id").alias("b"), "copies")
    degree = both.join(copies, "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("others"))
    groups = connected_components(links, "a", "b").select(F.col("node").alias("id"), "component")
    named = groups.join(classes.select("id", "first_id"), "id").groupBy("component").agg(F.min("first_id").alias("least_id"))
    moved = groups.join(named, "component").select("id", "least_id")
    known = classes.select("id", "first_id", "copies").join(degree, "id", "left").join(moved, "id", "left")
    known = stage(known.select("id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least_id", "first_id").alias("component_id")), "projection-components")
    out = rows.select("vec_id", "id").join(known, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_projection_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors."""
    return group_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
with recursive v as (
    select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), l as materialized (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), r as (
    select a as node, a as reach from l union select r.node, l.b from r join l on r.reach = l.a
), c as (select node, min(reach) as least from r group by node), d as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(d.n, 0) as n_links, coalesce(c.least, e.vec_id) as component_id, e.vec_id = coalesce(c.least, e.vec_id) as kept
from embeddings e left join c on c.node = e.vec_id left join d on d.a = e.vec_id
"""
