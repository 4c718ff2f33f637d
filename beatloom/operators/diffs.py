"""Differences between two sources of the same tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatloom import constants as K
from beatloom.operators import folds

PREVIEW = 12


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key by ``order`` (E5); a minimum, so it is combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("b"))
    return best.select(*keys, *[F.col("b")[c].alias(c) for c in rest])


def compare_positions(left: DataFrame, right: DataFrame, value: str, tolerance: float = K.TIME_TOLERANCE) -> DataFrame:
    """Values that differ at the same position, missing ones included.

    Both sides: track_id, pos and ``value``. Numbers differ above the tolerance, anything else
    when unequal.
    """
    number = left.schema[value].dataType.typeName() in ("double", "float", "long", "integer", "decimal")
    j = left.select("track_id", "pos", F.col(value).alias("primary"), F.lit(True).alias("__l")).join(
        right.select("track_id", "pos", F.col(value).alias("fallback"), F.lit(True).alias("__r")), ["track_id", "pos"], "full_outer"
    )
    same = F.col("primary").eqNullSafe(F.col("fallback")) & F.col("__l").eqNullSafe(F.col("__r"))
    if number:
        delta = F.col("fallback") - F.col("primary")
        same = F.coalesce(F.abs(delta) <= tolerance, F.col("primary").eqNullSafe(F.col("fallback")))
    else:
        delta = F.lit(None).cast("double")
    return j.where(~same).select("track_id", "pos", "primary", "fallback", delta.alias("delta"))


def compare_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Counts that differ by key, a missing key counting as zero."""
    j = left.select(*keys, F.col("n").alias("l")).join(right.select(*keys, F.col("n").alias("r")), keys, "full_outer")
    a, b = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    return j.select(*keys, a.alias("primary"), b.alias("fallback"), (b - a).alias("delta")).where(F.col("delta") != 0)


def union_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both sides with zero-filled counts."""
    j = left.select(*keys, F.col("n").alias("l")).join(right.select(*keys, F.col("n").alias("r")), keys, "full_outer")
    return j.select(*keys, F.coalesce("l", F.lit(0)).alias("primary"), F.coalesce("r", F.lit(0)).alias("fallback"))


def match_onsets(primary: DataFrame, fallback: DataFrame, tolerance: float = K.ONSET_MATCH_TOLERANCE) -> DataFrame:
    """Greedy one-to-one matching of onsets, primary order first.

    Both sides: track_id, pos, onset_seconds, with pos in onset order. A long run without a gap is split where
    few fallback onsets are within reach of both sides (``folds``); where more than six are at every place in
    twelve seconds, a segment goes on. ``kind`` is matched, shifted (moved by more than half a millisecond),
    primary_only or fallback_only.
    """
    side = lambda df, k: df.select(
        "track_id", F.col("onset_seconds").cast("double").alias("t"), F.lit(k).alias("side"), F.col("pos").cast("long").alias("pos")
    )
    out = folds.match_sides(side(primary, 0).unionByName(side(fallback, 1)).where(F.col("t").isNotNull()), tolerance)
    delta = F.round(F.col("fallback_onset") - F.col("primary_onset"), 6)
    return out.withColumn("delta", delta).withColumn(
        "kind", F.when(F.abs("delta") > K.TIME_TOLERANCE, "shifted").otherwise(F.col("kind"))
    )


def diff_provenance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Provenance keys whose values differ, nulls being equal to each other."""
    long = lambda df, name: df.select("track_id", *[F.col(k).cast("string").alias(k) for k in K.PROVENANCE_KEYS]).unpivot(
        "track_id", K.PROVENANCE_KEYS, "key", name
    )
    j = long(a, "primary").join(long(b, "fallback"), ["track_id", "key"])
    return j.where(~F.col("primary").eqNullSafe(F.col("fallback")))


def preview(df: DataFrame, keys: list[str], order: list, n: int = PREVIEW) -> DataFrame:
    """First ``n`` rows per key (T6). Ranks are cut off below the shuffle as well, so a task sends at most
    ``n`` rows of a key, however many it has."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
