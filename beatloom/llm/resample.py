"""Draw documents that resemble a target: importance weights over hashed word n-grams, then Gumbel top-k.

Every document is scanned once for a pass: a running CRC over its normalised bytes gives the CRC, and so
the bucket, of each of its n-grams (``prefix_crc``). The first pass counts buckets, the second adds up
gains. What passes through the driver is one number for each of a fixed number of buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from beatloom.llm import prefix_crc
from beatloom.llm.staging import stage, unused

BUCKETS = 10_000
LONGEST = 3  # words in a feature
PART = 1 << 22  # bytes of text at work


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Work units (first text, bytes, bounds, context words) of about ``PART`` bytes.

    A longer text is cut between words; each further cut repeats the last words before it as context.
    """
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PART, "right")) - 1)
        low, high = int(bounds[at]), int(bounds[end])
        if high - low <= PART:
            yield at, data[low:high], bounds[at : end + 1] - low, 0
        else:
            head = np.zeros(0, np.uint8)
            context = 0
            while low < high:
                cut = min(low + PART, high)
                while cut < high and prefix_crc.FOLD[data[cut]] != 0x20:
                    cut += 1
                piece = np.concatenate([head, data[low:cut]])
                yield at, piece, np.array([0, len(piece)]), context
                words = bytes(prefix_crc.FOLD[piece]).split()[-(LONGEST - 1) :]
                head, context = np.frombuffer(b" ".join(words) + b" ", np.uint8), len(words)
                low = cut
        at = end


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each text starts; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n): features of all texts by bucket; a task gives at most one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, bounds, context in _pieces(*_texts(batch.column(0))):
                for _, crc in prefix_crc.ngram_crcs(data, bounds, LONGEST, context)[1]:
                    total += np.bincount(crc % buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counted = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: the log ratio of its smoothed shares in target and corpus, in thousandths."""
    counts = []
    for frame, column in ((corpus, text), (target, target_text)):
        n = [0] * buckets
        for r in bucket_counts(frame, column, buckets).collect():  # at most one row for each bucket
            n[r.bucket] = r.n
        counts.append(n)
    (s, t), (all_s, all_t) = counts, map(sum, counts)
    ratio = lambda i: (t[i] + 1) * (all_s + buckets) / ((s[i] + 1) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(i))) for i in range(buckets)], np.int64)


def _weigher(gain: np.ndarray, column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for at, data, bounds, context in _pieces(*_texts(batch.column(column))):
                n, grams = prefix_crc.ngram_crcs(data, bounds, LONGEST, context)
                rows = slice(at, at + len(n))
                words[rows] += n
                for text, crc in grams:
                    features[rows] += np.bincount(text, minlength=len(n))
                    # sums of whole numbers far below 2^53 are exact in doubles
                    weight[rows] += np.bincount(text, gain[crc % len(gain)], len(n)).astype(np.int64)
            kept = [c for i, c in enumerate(batch.columns) if i != column]
            names = [f.name for i, f in enumerate(batch.schema) if i != column]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (words, features, weight))], names=[*names, "w1", "w2", "w3"])

    return weigh


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All documents with n_words, n_features, weight, score and rank; rank is null where a row is not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are drawn by
    highest score, ties to the smaller doc_id. ``keep`` names the columns that go along (default: all);
    added names get underscores where taken. Null and empty texts have no features, weight 0 and are never
    drawn; a null doc_id hashes like an empty one and comes last among equal scores; repeated rows are
    drawn each for itself. Without documents there are no rows, without target texts gains compare with
    equal shares.
    """
    keep = [c for c in docs.columns] if keep is None else keep
    gain = gains(docs, target, text, target_text)
    source = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias(unused(docs, "whole_text")))
    numbers = [unused(docs, n) for n in ("n_words", "n_features", "weight")]
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in numbers]])
    weighed = source.mapInArrow(_weigher(gain, len(keep)), schema)
    words, _, weight = numbers
    score, rank, part, number = (unused(docs, n) for n in ("score", "rank", "part", "number"))
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stage(weighed.withColumn(score, (F.col(weight) + noise).cast("long")), "importance-scores")
    able = scored.where(F.col(words) >= least_words)
    drawn = percent * able.count() // 100
    # ranks: rows by ranges of the order, numbered inside each, plus the rows in the ranges before
    order = [F.col(score).desc(), F.col(doc_id).asc_nulls_last()]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(able.repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id()), "importance-ranges")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(number))
    ahead = F.coalesce(F.sum(number).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(sizes.select(part, ahead.alias(number))), part)  # one row for each range
    placed = placed.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*order)) + F.col(number))
    columns = [*keep, *numbers, score]
    placed = placed.select(*columns, F.when(F.col(rank) <= drawn, F.col(rank)).cast("long").alias(rank))
    return placed.unionByName(scored.where(F.col(words) < least_words).select(*columns, F.lit(None).cast("long").alias(rank)))


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their importance for the benchmark texts, and the rank of those drawn."""
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return draw(docs, target, keep=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")
