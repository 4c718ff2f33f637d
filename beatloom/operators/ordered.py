"""Ordered operators that do not put a whole key into one task.

A window over ``track_id`` alone sends every row of a track to one task, and one track may hold
a third of a table. The helpers here work inside ``(key, chunk)`` instead, where ``chunk`` is a
column that grows with the order (a time bucket, a beat range). What a chunk needs from its
neighbours is taken from a per-chunk summary: one row per chunk, built with map-side combine, so
the only window over a bare key runs on summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from beatloom.functions.scalars import col

TIME_CHUNK = 16.0  # seconds per chunk
BEAT_CHUNK = 64  # beats per chunk


def time_chunk(t, seconds: float = TIME_CHUNK) -> Column:
    return F.floor(col(t) / F.lit(seconds)).cast("long")


def index_chunk(i, size: int = BEAT_CHUNK) -> Column:
    return F.floor(col(i) / F.lit(size)).cast("long")


def _struct(names: list[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def _local(by: list[str], chunk: str, order: list[str]):
    return Window.partitionBy(*by, chunk).orderBy(*order)


def _placed(df: DataFrame, by: list[str], chunk: str) -> DataFrame:
    """The frame partitioned by (key, chunk).

    Rows without a key or a place in the order are left out. Saying so here, before the frame is
    used twice, also keeps the two uses identical: a join would add that filter to one side only.
    """
    keys = [F.col(c) for c in [*by, chunk]]
    return df.where(reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])).repartition(*keys)


def _edges(base: DataFrame, by: list[str], chunk: str, aggs: list[Column]) -> DataFrame:
    """Summary of each chunk of an already partitioned frame.

    The summary asks for every column of ``base``, so that it needs exactly the exchange the
    main branch needs: Spark then runs that exchange, and all that is below it, once.
    """
    pad = F.first(F.struct(*[F.col(c) for c in base.columns])).alias("__pad")
    return base.groupBy(*by, chunk).agg(*aggs, pad).where(F.col("__pad").isNotNull())


def neighbors(
    df: DataFrame,
    by: list[str],
    order: list[str],
    chunk: str,
    prev: dict[str, str] | None = None,
    next: dict[str, str] | None = None,
) -> DataFrame:
    """``lag``/``lead`` by one row: ``{new column: source column}`` for each direction."""
    prev, next = prev or {}, next or {}
    base = _placed(df, by, chunk)
    w = _local(by, chunk, order)
    wc = Window.partitionBy(*by).orderBy(chunk)
    before, after = _struct(sorted(set(prev.values()))), _struct(sorted(set(next.values())))
    edge = _edges(
        base,
        by,
        chunk,
        [F.max_by(before, _struct(order)).alias("__last")] * bool(prev)
        + [F.min_by(after, _struct(order)).alias("__first")] * bool(next),
    ).select(
        *by,
        chunk,
        *[F.lag("__last").over(wc).alias("__nb_b")] * bool(prev),
        *[F.lead("__first").over(wc).alias("__nb_a")] * bool(next),
    )
    out = base
    if prev:
        out = out.withColumn("__nb_p", F.lag(before).over(w))
    if next:
        out = out.withColumn("__nb_n", F.lead(after).over(w))
    # never a broadcast: Spark takes summaries of exploded rows for no larger than what the rows are made from
    out = out.join(edge.hint("merge"), [*by, chunk], "left")
    if prev:
        p = F.coalesce(F.col("__nb_p"), F.col("__nb_b"))
        out = out.withColumns({new: p[src] for new, src in prev.items()})
    if next:
        n = F.coalesce(F.col("__nb_n"), F.col("__nb_a"))
        out = out.withColumns({new: n[src] for new, src in next.items()})
    return out.drop("__nb_p", "__nb_n", "__nb_b", "__nb_a")


def running(
    df: DataFrame,
    by: list[str],
    order: list[str],
    chunk: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums and last non-null values up to and including each row."""
    sums, lasts = sums or {}, lasts or {}
    base = _placed(df, by, chunk)
    w = _local(by, chunk, order).rowsBetween(Window.unboundedPreceding, 0)
    wc = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    edge = _edges(
        base,
        by,
        chunk,
        [F.sum(c.cast("long")).alias(f"__t_{n}") for n, c in sums.items()]
        + [F.max_by(c, F.when(c.isNotNull(), _struct(order))).alias(f"__t_{n}") for n, c in lasts.items()],
    ).select(
        *by,
        chunk,
        *[F.sum(f"__t_{n}").over(wc).alias(f"__c_{n}") for n in sums],
        *[F.last(f"__t_{n}", ignorenulls=True).over(wc).alias(f"__c_{n}") for n in lasts],
    )
    out = base.withColumns(
        {
            **{f"__l_{n}": F.sum(c.cast("long")).over(w) for n, c in sums.items()},
            **{f"__l_{n}": F.last(c, ignorenulls=True).over(w) for n, c in lasts.items()},
        }
    ).join(edge.hint("merge"), [*by, chunk], "left")
    out = out.withColumns(
        {
            **{n: F.coalesce(F.col(f"__l_{n}"), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums},
            **{n: F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n in lasts},
        }
    )
    return out.drop(*[f"__{p}_{n}" for p in "lc" for n in [*sums, *lasts]])


def row_index(df: DataFrame, by: list[str], order: list[str], chunk: str, name: str) -> DataFrame:
    """Zero-based position of each row inside its key."""
    out = running(df, by, order, chunk, sums={name: F.lit(1)})
    return out.withColumn(name, F.col(name) - 1)


def asof(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    name: str = "match",
    chunk_seconds: float = TIME_CHUNK,
) -> DataFrame:
    """Backward as-of join: the latest right row at or before each left row, as struct ``name``.

    Both sides meet in ``(key, time bucket)``. A bucket whose rows start before its own first
    right row gets one carried row, the last right row of the buckets before it. ``values`` must
    order right rows that share a time (the largest wins).
    """
    cols = left.columns
    lrow = F.struct(*[F.col(c) for c in cols])
    t = F.col(left_time)
    # rows without a time match nothing; spread them so that they cannot pile up in one task
    bucket = F.coalesce(time_chunk(t, chunk_seconds), -F.lit(1 << 40) - F.pmod(F.xxhash64(lrow), F.lit(4096)))
    lpart = left.select(*by, bucket.alias("__b"), t.alias("__t"), F.lit(1).alias("__k"), lrow.alias("__l"))
    r = right.select(
        *by,
        time_chunk(right_time, chunk_seconds).alias("__b"),
        F.col(right_time).alias("__t"),
        F.struct(*[F.col(c) for c in values]).alias("__r"),
    )
    rtype = r.schema["__r"].dataType
    # summaries: last right row per bucket, and the buckets that hold left rows
    rb = r.groupBy(*by, "__b").agg(F.max(F.struct("__t", "__r")).alias("__m")).withColumn("__k", F.lit(1))
    lb = (
        left.where(t.isNotNull())
        .select(*by, time_chunk(t, chunk_seconds).alias("__b"))
        .distinct()
        .select(*by, "__b", F.lit(None).cast(rb.schema["__m"].dataType).alias("__m"), F.lit(0).alias("__k"))
    )
    wc = Window.partitionBy(*by).orderBy("__b", "__k").rowsBetween(Window.unboundedPreceding, 0)
    carry = (
        rb.select(*by, "__b", "__m", "__k")
        .unionByName(lb)
        .withColumn("__c", F.last("__m", ignorenulls=True).over(wc))
        .where((F.col("__k") == 0) & F.col("__c").isNotNull())
    )
    none_left = F.lit(None).cast(lpart.schema["__l"].dataType).alias("__l")
    none_right = F.lit(None).cast(rtype).alias("__r")
    both = (
        lpart.select(*by, "__b", "__t", "__k", "__l", none_right)
        .unionByName(r.select(*by, "__b", "__t", F.lit(0).alias("__k"), none_left, "__r"))
        .unionByName(
            carry.select(*by, "__b", F.col("__c.__t").alias("__t"), F.lit(0).alias("__k"), none_left, F.col("__c.__r").alias("__r"))
        )
    )
    w = Window.partitionBy(*by, "__b").orderBy("__t", "__k", "__r").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn(name, F.last("__r", ignorenulls=True).over(w))
        .where(F.col("__k") == 1)
        .select(*[F.col("__l")[c].alias(c) for c in cols], name)
    )


def islands(df: DataFrame, by: list[str], order: list[str], chunk: str, starts: Column, name: str) -> DataFrame:
    """Number the runs of rows that begin where ``starts`` is true."""
    return running(df, by, order, chunk, sums={name: starts.cast("int")})


def fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    schema: T.StructType | str,
    step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> DataFrame:
    """Sequential rule over each key group, streamed in order as Arrow batches.

    Rows are partitioned by ``keys`` and sorted inside the task, so a group is never held in
    memory; ``step`` sees batches that may start or end in the middle of a group.
    """
    cols = [F.col(k) for k in keys]
    return df.repartition(*cols).sortWithinPartitions(*keys, *order).mapInArrow(step, schema)


def order_image(value: Column) -> Column:
    """A long for each double, in the same order: exponent and 52 bits of mantissa, below zero negated.

    Powers of two scale exactly, so equal images mean equal values (zeros of both signs are equal).
    """
    size = F.abs(value)
    e = F.floor(F.log2(size)).cast("int")
    # the logarithm may be off by one next to a power of two
    e = F.when(F.pow(F.lit(2.0), e) > size, e - 1).when(F.pow(F.lit(2.0), e + 1) <= size, e + 1).otherwise(e)
    wide = F.lit(float(1 << 52))
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + ((size / F.pow(F.lit(2.0), e) - 1) * wide).cast("long")
    tiny = (size * F.pow(F.lit(2.0), F.lit(1022)) * wide).cast("long")  # subnormal numbers
    image = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0**-1022, tiny).otherwise(normal)
    return F.when(F.isnan(value), F.lit((2047 << 52) + 1)).when(value < 0, -image).otherwise(image)


def at_ranks(series: DataFrame, value: str, ranks: Column, bits: int = 16) -> DataFrame:
    """Values of each track at given ranks, exactly: track_id, k, rank_value. Nulls are left out.

    ``ranks`` is an array of ranks from 0, as a function of the track's number of values ``n``. Radix
    selection: equal values are counted first, then each level looks at the next ``bits`` bits of the values'
    order image, only within the prefixes that hold a rank. A histogram of a prefix has at most 2^bits
    rows whatever the values are, so no track's values are ever gathered. The joins are never broadcasts: both
    sides grow with the tracks, whatever Spark makes of the size of exploded values.
    """
    v = series.where(F.col(value).isNotNull()).groupBy("track_id", F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    v = v.withColumn("image", order_image(F.col("v")))
    none = F.lit(0).cast("long")
    want = v.groupBy("track_id").agg(F.sum("c").alias("n")).select("track_id", F.array_distinct(ranks).alias("ks"), none.alias("before"), none.alias("prefix"))
    for shift in range(64 - bits, -1, -bits):
        prefix = F.shiftright("image", shift + bits) if shift + bits < 64 else none
        h = v.select("track_id", prefix.alias("prefix"), F.shiftright("image", shift).alias("p"), "c", "v").join(want.drop("v").hint("merge"), ["track_id", "prefix"])
        h = h.groupBy("track_id", "prefix", "before", "ks", "p").agg(F.sum("c").alias("c"), F.min("v").alias("v"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy("track_id", "prefix").orderBy("p"))
        h = h.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
        h = h.withColumn("ks", F.filter("ks", lambda k: (k >= F.col("before")) & (k < F.col("upto")))).where(F.size("ks") > 0)
        want = h.select("track_id", F.col("p").alias("prefix"), "before", "ks", "v")
    return want.select("track_id", F.explode("ks").alias("k"), F.col("v").alias("rank_value"))


def median(series: DataFrame, value: str) -> DataFrame:
    """Median of each track's values: track_id, median; tracks without values have no row."""
    middle = F.array(F.floor((F.col("n") - 1) / 2).cast("long"), F.ceil((F.col("n") - 1) / 2).cast("long"))
    # an odd count has one middle rank, an even one two
    return at_ranks(series, value, middle).groupBy("track_id").agg(((F.min("rank_value") + F.max("rank_value")) / 2).alias("median"))
