"""Continuous jobs with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.operators import charts as C
from beatloom.operators import ledger as L
from beatloom.sources import files


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _few_listings(spark: SparkSession) -> SparkSession:
    """A session with the same settings in which the files of a batch are listed by few tasks, not by one for each."""
    s = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            s.conf.set(key, value)
    s.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    return s


def stream_charts(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int = 1000, bytes_per_batch: int | None = None):
    """Charts of new payload files, each file once, stopping when nothing is left (ST1).

    A batch that is retried overwrites its own folder, so a lost executor or a restart leaves no
    duplicates. A batch costs much whatever it holds, so ``bytes_per_batch``, which then bounds it instead of the
    number of files, keeps batches of small files few. Spark reads a handful of small files to a task, and each
    task of the many steps that follow sets up its columns anew; a batch is therefore dealt over as many tasks
    as there are cores.
    """
    bound = ("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else ("maxBytesPerTrigger", bytes_per_batch)
    docs = (
        _few_listings(spark).readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
        .option(*bound).format("text").load(path)
        .select(files.file_stem("_metadata.file_name").alias("track_id"), F.try_parse_json("value").alias("raw"))
    )

    cores = spark.sparkContext.defaultParallelism

    def generate(batch: DataFrame, batch_id: int) -> None:
        result = C.generate_charts(batch.coalesce(cores))
        for name in ("charts", "measures", "notes"):
            result[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    return docs.writeStream.foreachBatch(generate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_submissions(stream: DataFrame, key: str = "idempotency_key", time: str = "created_at", delay: str = "1 day") -> DataFrame:
    """Submissions unique by idempotency key within the watermark (ST2).

    The state holds the keys of the last ``delay``; rows later than that are dropped. The delay is
    our own rule, since an unbounded state would grow for ever.
    """
    return stream.where(F.col(key).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_job_state(events: DataFrame) -> DataFrame:
    """Latest state per job from the event log, in update mode (ST3); the batch twin is job_state."""
    return L.job_state(events)


def run_to_folder(df: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Drain a stream into Parquet; in update mode each batch's changed rows go to their own folder."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return w.format("parquet").outputMode("append").start(out)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return w.outputMode(mode).foreachBatch(save).start()
